"""Registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsieve.llm import arc_warc, bpe, decontaminate, embedding_dedup, filter_audit, html_text, langid, ngram_join, ppm, prefix_trie, quality_bayes, secret_scan, token_counts
from callsieve.session import configure, fresh_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every text, as digests."""
    coded = bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from three quarters of them."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~langid.held_out())
    found = langid.classify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies of every text: five words, similarity of 0.8 or more."""
    return ngram_join.similar_documents(_table(spark, sf_dir, "documents"), threshold=0.8)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through ARC into WARC files and back."""
    path = fresh_dir(spark, "warc")
    arc_warc.pages_to_warc(_table(spark, sf_dir, "pages"), path)
    return arc_warc.read_warc(spark, path).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_hits(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.hit_words(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label with a cosine of 0.98 or more."""
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text."""
    docs = _table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op9_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text: source as host, language as its path."""
    found = quality_bayes.judge_documents(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "source", "lang", text=False
    )
    return found.select("doc_id", "evidence", "host_posterior", "path_posterior", "posterior", "accepted")


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code length of every text, learned from six sevenths of them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return ppm.score_documents(docs, ~ppm.seventh_held_out()).select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of five filters, for each source."""
    return filter_audit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text."""
    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in secret_scan.BASE_RULES]
    base = F.filter("spans", lambda x: x["kind"].isin(kinds))
    of = lambda k: F.filter("spans", lambda x: x["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secret_scan.joined(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prefixes of the conversations, with shared openings."""
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_langid": op2_langid,
    "op3_ngram_join": op3_ngram_join,
    "op4_warc": op4_warc,
    "op5_decontaminate": op5_decontaminate,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_html_text": op7_html_text,
    "op8_token_counts": op8_token_counts,
    "op9_quality_bayes": op9_quality_bayes,
    "op10_ppm": op10_ppm,
    "op11_filter_audit": op11_filter_audit,
    "op12_secret_scan": op12_secret_scan,
    "op13_prefix_trie": op13_prefix_trie,
}

_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

ORACLE_SQL: dict[str, str] = {
    "op3_ngram_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
            FROM d, range(1, len(w) - least(len(w), 5) + 2) AS r(i) WHERE len(w) > 0
        ), n AS (SELECT doc_id, count(*) AS n, sum(hash(g)) AS sig FROM s GROUP BY 1),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        link AS (
            SELECT a, b, na.n = nb.n AND c = na.n AS same
            FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
            WHERE c >= 0.8 * (na.n + nb.n - c) - 1e-9 * (na.n + nb.n - c)
        ), reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM documents
            UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other
        ), comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1),
        own AS (SELECT a AS doc_id, count(*) AS n_links, min(CASE WHEN same THEN b END) AS copy FROM link GROUP BY 1)
        SELECT doc_id, least(doc_id, coalesce(copy, doc_id)) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links,
            component_id, component_id = doc_id AS kept
        FROM comp LEFT JOIN own USING (doc_id)
    """,
    "op4_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
            CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)
    """,
    "op5_decontaminate": f"""
        WITH item AS (SELECT item_id, {_SQL_WORDS.format("text")} AS w FROM benchmark),
        bw AS (
            SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
            FROM (SELECT item_id, w, least(len(w), 10) AS k FROM item WHERE len(w) > 0), range(1, len(w) - k + 2) AS r(i)
        ),
        d AS (SELECT doc_id, {_SQL_WORDS.format("text")} AS w FROM documents),
        dw AS (
            SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
            FROM d, (SELECT DISTINCT k FROM bw), range(1, len(w) - k + 2) AS r(i)
        ),
        hit AS (SELECT DISTINCT doc_id, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, range(i, i + k) AS r(p) GROUP BY 1),
        items AS (
            SELECT doc_id, count(DISTINCT item_id) AS n_items,
                sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
            FROM hit GROUP BY 1
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op6_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), link AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ), reach(vec_id, other) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON link.a = reach.other
        ), comp AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1),
        n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY 1)
        SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, component_id = vec_id AS kept
        FROM comp LEFT JOIN n USING (vec_id)
    """,
    "op11_filter_audit": r"""
        WITH d AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), f AS (
            SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
                100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
                coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e,
                coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
            FROM d LEFT JOIN (
                SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1
            ) USING (doc_id)
        ), m AS (
            SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x, i: [a, b, c, d, e][i]) AS failed, count(*) AS n,
                count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
            FROM f GROUP BY 1, 2
        ), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (
            SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM l p, l q, l r, l s, l t
            WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
        ), r AS (
            SELECT part, filter_order, step::INTEGER AS step, substr(filter_order, step, 1) AS x,
                list_contains(failed, substr(filter_order, step, 1)) AS fails,
                len(list_filter(failed, lambda y: instr(filter_order, y) < step)) > 0 AS gone, len(failed) = 1 AS alone, n, good, toxic
            FROM m, o, range(1, 6) AS g(step)
        ), s AS (
            SELECT part, filter_order, step, x,
                sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
                sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
                sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
                sum(CASE WHEN fails AND alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
                sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
                sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
            FROM r GROUP BY ALL
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
            (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
        FROM s
    """,
    "op13_prefix_trie": """
        WITH crc AS (
            SELECT list_transform(range(256), lambda n: list_reduce(
                range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS tab
        ), t AS (
            SELECT *, row_number() OVER (
                PARTITION BY c ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || text)) AS pos
            FROM (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
        ), ids AS (
            SELECT c, c - c % 100 AS b, xor(list_reduce(
                list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 6 AS h
            FROM (SELECT DISTINCT c FROM t), crc
        ), base AS (SELECT c AS b, count(*) AS n FROM t GROUP BY 1),
        r AS (
            SELECT ids.c, pos AS d, role, text FROM ids JOIN t ON t.c = b AND pos <= h
            UNION ALL
            SELECT c, pos - h + least(h, coalesce(n, 0)), role, text FROM ids JOIN t USING (c) LEFT JOIN base USING (b) WHERE pos > h
        ), s AS (
            SELECT c, coalesce(turns, []) AS turns FROM ids LEFT JOIN (
                SELECT c, list({'role': role, 'text': text} ORDER BY d) AS turns FROM r GROUP BY 1
            ) USING (c)
        ), p AS (
            SELECT c, d, sha256(to_json(turns[1:d])::VARCHAR) AS k, CASE WHEN d > 0 THEN sha256(to_json(turns[1:d - 1])::VARCHAR) END AS up,
                CASE WHEN d > 0 THEN length(turns[d].text) ELSE 0 END AS chars, len(turns) = d AS ended
            FROM s, range(0, len(turns) + 1) AS g(d)
        ), n AS (
            SELECT k, any_value(up) AS up, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
                string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended) AS ends
            FROM p GROUP BY 1
        ), kids AS (SELECT up AS k, count(*) AS n_children FROM n GROUP BY 1),
        m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (k)),
        sums AS (
            SELECT p.k, count(*) FILTER (m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.chars) AS saved_tokens
            FROM m JOIN p ON p.c = m.conv_id AND p.d <= m.depth GROUP BY 1
        )
        SELECT m.conv_id, m.depth::BIGINT AS depth, o.conv_id AS parent_conv_id, m.n_convs, m.n_children::BIGINT AS n_children, n_leaves,
            saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
        FROM m JOIN sums USING (k) LEFT JOIN n o ON o.k = m.up
    """,
}
