"""Text expressions: Unicode-aware, JVM-side, ``Column -> Column``.

The character classes are written with ``\\x{..}`` escapes, which both the JVM
regex engine and RE2 read, so the same text can be used to cross-check results
in another SQL engine.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------
# The 29 code points that count as white space, and the line separators among
# them. JVM ``\s`` and SQL ``trim`` know only a few of these.
WHITESPACE = (
    r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
LINE_BREAKS = r"\x{a}-\x{d}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}"
WHITESPACE_CHARS = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)
PROMPT_OPEN = "Transcript:\n"
PROMPT_CLOSE = "\n\nVerdict:"
URL_MARKS = ("http://", "https://", "www.")
# --------------------------------------------------------------------------


@lru_cache(maxsize=1)
def digit_class() -> str:
    """Character class of everything Unicode gives a digit value.

    Wider than ``\\p{Nd}``: superscripts, circled digits and the like count.
    """
    ranges: list[list[int]] = []
    for code in range(sys.maxunicode + 1):
        if unicodedata.digit(chr(code), None) is None:
            continue
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "".join(
        rf"\x{{{lo:x}}}" if lo == hi else rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in ranges
    )


# JVM forms of the classes. A class is tested range by range, so each begins
# with one cheap test that settles the letters most texts are made of.
_WS = rf"[[^\x{{21}}-\x{{84}}]&&[{WHITESPACE}]]"
_VISIBLE = rf"[[\x{{21}}-\x{{84}}][^{WHITESPACE}]]"
_IN_LINE = rf"[[\x{{20}}-\x{{84}}][^{LINE_BREAKS}]]"
# Runs that are not already a single plain space.
_LOOSE_SPACE = rf" {_WS}+|[[^\x{{20}}]&&{_WS}]{_WS}*"


def normalise(text: Column) -> Column:
    """Trim, and turn every run of white space into one space."""
    return F.trim(F.regexp_replace(text, _LOOSE_SPACE, " "))


def strip(text: Column) -> Column:
    """Trim Unicode white space at both ends (no regex, so no backtracking)."""
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def is_blank(text: Column) -> Column:
    return F.length(strip(text)) == 0


def text_hash(text: Column) -> Column:
    """SHA-256 of the normalised text; NULL for a missing text."""
    return F.sha2(normalise(text), 256)


def fingerprint(text: Column) -> Column:
    """SHA-256 of the normalised text; a missing text hashes as ``None``."""
    return F.coalesce(text_hash(text), F.sha2(F.lit("None"), 256))


def payload_hash(payload: Column) -> Column:
    """SHA-256 of the raw bytes, nothing normalised."""
    return F.sha2(payload, 256)


def char_count(text: Column) -> Column:
    return F.length(text)


def word_count(text: Column) -> Column:
    flat = normalise(text)
    gaps = F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit("")))
    return gaps + (flat != "").cast("int")


def digit_ratio(text: Column) -> Column:
    total = F.length(text)
    # Unassigned code points are let through to the full class, because the
    # JVM may know an older Unicode version than the class was made from.
    digits = rf"[[\p{{N}}\p{{Cn}}]&&[{digit_class()}]]"
    rest = F.length(F.regexp_replace(text, f"{digits}+", ""))
    return (total - rest) / F.greatest(total, F.lit(1))


def has_url(text: Column) -> Column:
    lowered = F.lower(text)
    found = F.lit(False)
    for mark in URL_MARKS:
        found = found | F.contains(lowered, F.lit(mark))
    return found.cast("int")


def turn_count(text: Column) -> Column:
    """Lines holding something other than white space, at least 1.

    One match begins at the first visible character of a line and runs to its
    end, so every line is met once and the scan stays linear.
    """
    lines = F.regexp_count(text, F.lit(f"{_VISIBLE}{_IN_LINE}*"))
    return F.when(text.isNotNull(), F.greatest(lines, F.lit(1)))


def text_features(text: Column) -> dict[str, Column]:
    """The five deterministic text features by name."""
    return {
        "char_count": char_count(text),
        "word_count": word_count(text),
        "turn_count": turn_count(text),
        "digit_ratio": digit_ratio(text),
        "has_url": has_url(text),
    }


def extract_transcript(prompt: Column) -> Column:
    """Text between the first open marker and the first close marker after it."""
    opened = F.instr(prompt, PROMPT_OPEN)
    body = F.substring(prompt, opened + len(PROMPT_OPEN), F.length(prompt))
    closed = F.instr(body, PROMPT_CLOSE)
    return (
        F.when(opened == 0, prompt)
        .when(closed == 0, body)
        .otherwise(F.substring(body, F.lit(1), closed - 1))
    )


def excerpt(text: Column, limit: int = 180) -> Column:
    """Single-line, pipe-escaped form, cut with an ellipsis beyond ``limit``."""
    flat = F.replace(normalise(text), F.lit("|"), F.lit("\\|"))
    return F.when(F.length(flat) <= limit, flat).otherwise(
        F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))
    )
