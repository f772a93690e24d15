import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from callsieve.llm.token_counts import _encoder, _Lengths, count_tokens, frequent_pretokens, pretokens

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
LENGTHS = _Lengths(_encoder(open(PATH, "rb").read()), {})

parts = st.lists(st.sampled_from(["the", " ", "  ", "\n", "ing", "▁", "<s>", "ß", "\x00", "你", "aaa", "\t", "</s>", "<0x0A>", "<unk>"]))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), parts.map("".join)))
def test_sum_over_pretokens_is_the_count(text):
    assert sum(LENGTHS[p] for p in pretokens(text)) == len(LIBRARY.encode(text))


def test_documents(spark, messy, nothing):
    rows = count_tokens(messy, PATH, limit=100).collect()
    expected = [
        (r.doc_id, len((r.text or "").encode()), n := len(LIBRARY.encode(r.text or "")), n > 100)
        for r in messy.collect()
    ]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, rows), key=key) == sorted(expected, key=key)
    assert count_tokens(nothing, PATH).count() == 0


def test_frequent_first(spark, messy):
    assert frequent_pretokens(messy, "text", 2) == ["long", "words"]
