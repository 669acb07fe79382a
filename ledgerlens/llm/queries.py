"""One query per operator over the synthetic tables; see each operator's module.

The operators keep their own interfaces and outputs; a query picks the tables,
the folds and the columns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import align, compression, ctw, decontaminate, hardneg, idcoder, itq, lines, minhash, outliers, packing, pieces, warc
from ledgerlens.llm.common import crc32_of, stored, table

FOLDS = 5


def fold(name: str = "doc_id"):
    """crc32 of the id as text, modulo 5; a null id is in fold 0."""
    return F.coalesce(crc32_of(name) % FOLDS, F.lit(0))


def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    stats, names = outliers.with_statistics(docs)
    stats = stored(stats.drop("text"), "op1-statistics")  # the texts are read once
    judged, names = outliers.judge(stats, names, outliers.fit(stats, names))
    return judged.select(
        "doc_id", *(F.col(names[c]).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        F.col(names["base_failed"]).alias("base_failed"), F.col(names["kept"]).alias("kept"),
        F.col(names["distance"]).alias("distance"), F.col(names["level"]).alias("estimate"))


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


def op3_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(fold() != 0)
    scored, score = compression.scored(docs, compression.fit(docs, labels))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), F.col(score).alias("score"),
                         (F.col(score) >= 0.3).cast("int").alias("predicted"))


def op4_itq_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2, threshold=0.8)
    return rows.select("doc_id", F.col(names["size"]).alias("n_shingles"), F.col(names["component"]).alias("component_id"),
                       F.col("doc_id").eqNullSafe(F.col(names["component"])).alias("kept"))


def op6_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = idcoder.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, blank_joins=False)
    return back.select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, words = ctw.fit(docs.filter(fold() != 1))
    scored = ctw.scored(docs, model, words)
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op10_line_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, names = lines.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.col(names["text"])
    return out.select("doc_id", F.col(names["exact"]).alias("n_exact"), F.col(names["near"]).alias("n_near"),
                      F.col(names["emptied"]).alias("emptied"), F.length(text).cast("long").alias("kept_chars"), F.md5(F.encode(text, "UTF-8")).alias("kept_md5"))


def op11_kronecker_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hardneg.mine(rows, F.col("id") % 100 == 0)


def op12_prefix_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op13_run_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_robust_outliers, op2_warc_round_trip, op3_compression_classifier, op4_itq_neighbours, op5_bbit_minhash,
        op6_id_files, op7_piece_encoding, op8_karmarkar_karp, op9_context_tree, op10_line_neighbourhood, op11_kronecker_negatives, op12_prefix_windows,
        op13_run_skipping)
}

#: Line dedup stated on the lines themselves: every line of ten words or more
#: with each one-word deletion as text, the earliest line of each, and no hash.
_LINES_SQL = r"""
WITH rows AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM rows),
worded AS (SELECT doc_id, pos, line, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM split),
keyed AS (SELECT doc_id, pos, line, words, array_to_string(words, ' ') AS key, (doc_id::HUGEINT * 1000000000 + pos) AS place FROM worded),
lines_ AS (SELECT * FROM keyed WHERE len(words) > 0),
firsts AS (SELECT key, min(place) AS place, any_value(words) AS words FROM lines_ GROUP BY key),
long AS (SELECT key, place, words, len(words) AS n FROM firsts WHERE len(words) >= 10),
spots AS (SELECT key, place, words, n, unnest(range(1, n + 1)) AS i FROM long),
gone AS (SELECT key, place, i, array_to_string(list_concat(words[1:i - 1], words[i + 1:n]), ' ') AS rest FROM spots),
replaced AS (SELECT g.key FROM gone g JOIN (SELECT rest, i, min(place) AS place FROM gone GROUP BY rest, i) e USING (rest, i) WHERE e.place < g.place),
shorter AS (SELECT g.key FROM gone g JOIN long l ON l.key = g.rest WHERE l.place < g.place),
longer AS (SELECT l.key FROM long l JOIN gone g ON g.rest = l.key WHERE g.place < l.place),
near AS (SELECT key FROM replaced UNION SELECT key FROM shorter UNION SELECT key FROM longer),
fate AS (SELECT k.doc_id, k.pos, k.line, len(k.words) > 0 AS worded,
                len(k.words) > 0 AND k.place > f.place AS exact,
                len(k.words) > 0 AND k.key IN (SELECT key FROM near) AS near
         FROM keyed k LEFT JOIN firsts f ON f.key = k.key AND len(k.words) > 0),
kept AS (SELECT doc_id, count(*) FILTER (WHERE exact) AS n_exact, count(*) FILTER (WHERE near AND NOT exact) AS n_near,
                coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT (exact OR near)), '') AS text,
                bool_or(worded) AND NOT coalesce(bool_or(worded AND NOT (exact OR near)), false) AS emptied
         FROM fate GROUP BY doc_id)
SELECT doc_id, n_exact::BIGINT AS n_exact, n_near::BIGINT AS n_near, emptied, length(text)::BIGINT AS kept_chars, md5(text) AS kept_md5 FROM kept
"""

_WARC_SQL = """
WITH r AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT html, max(page_id) AS head FROM r GROUP BY html)
SELECT page_id, octet_length(encode(r.html))::BIGINT AS payload_bytes, {digest} AS payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to
FROM r JOIN h USING (html)
"""


def _base32_of_sha1(text: str) -> str:
    """DuckDB expression: base32 of the SHA-1 of a string, from its hex form
    (forty digits are 160 bits: 32 letters of five bits)."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    bits = f"array_to_string(list_transform(string_split(sha1({text}), ''), lambda d: lpad(bin(instr('0123456789abcdef', d) - 1), 4, '0')), '')"
    return (f"array_to_string(list_transform(range(32), lambda i: '{alphabet}'[(1 + list_sum(list_transform(range(5), "
            f"lambda j: (substring({bits}, (5 * i + j + 1)::INTEGER, 1)::INTEGER * (16 // (1 << j)::INTEGER)))))::INTEGER]), '')")


#: Every anchor against every row, all inner products spelt out.
_NEGATIVES_SQL = """
WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM r),
s AS (SELECT a.rid AS arid, a.vec_id AS anchor_id, q.vec_id AS other_id, a.label = q.label AS same, list_inner_product(a.v, q.v)::BIGINT AS score
      FROM q a JOIN q ON a.rid <> q.rid AND len(a.v) = len(q.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT arid, anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY arid ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id,
       row_number() OVER (PARTITION BY p.arid, positive_id, positive_score ORDER BY score DESC, other_id)::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.arid = p.arid AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

#: All windows of all documents against all windows of all items, as text.
_WINDOWS_SQL = r"""
WITH lowered AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
worded AS (SELECT rid, doc_id, list_filter(string_split_regex(text, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM lowered),
items AS (SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark WHERE text IS NOT NULL),
starts AS (SELECT item_id, words, least(len(words), 10) AS n, unnest(range(0, greatest(len(words) - 10, 0) + 1)) AS s FROM items WHERE len(words) > 0),
wanted AS (SELECT DISTINCT item_id, n, array_to_string(words[s + 1:s + n], ' ') AS window FROM starts),
places AS (SELECT rid, words, n, unnest(range(0, len(words) - n + 1)) AS s FROM worded, (SELECT DISTINCT n FROM wanted) WHERE len(words) >= n),
found AS (SELECT rid, s, p.n, item_id FROM places p JOIN wanted w ON w.n = p.n AND w.window = array_to_string(p.words[s + 1:s + p.n], ' ')),
hits AS (SELECT rid, count(DISTINCT s + k) AS n_hit FROM (SELECT DISTINCT rid, s, unnest(range(0, n)) AS k FROM found) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM worded LEFT JOIN hits USING (rid) LEFT JOIN named USING (rid)
"""


#: Where SQL cannot state an operator it is absent here; tests/llm compares it
#: with a brute-force version.
ORACLE_SQL: dict[str, str] = {
    "op2_warc_round_trip": _WARC_SQL.format(digest=_base32_of_sha1("r.html")),
    "op10_line_neighbourhood": _LINES_SQL,
    "op11_kronecker_negatives": _NEGATIVES_SQL,
    "op12_prefix_windows": _WINDOWS_SQL,
}
