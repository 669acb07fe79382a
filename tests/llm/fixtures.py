"""Small tables with the awkward rows: nulls in every column, empty and very
long texts, ties and repeated rows, and extra columns with clashing names."""

import random

from pyspark.sql import types as T

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *(T.StructField(c, T.StringType()) for c in ("kept", "id", "rid", "size", "score", "row", "key", "mcd_kept", "line_text", "near_size", "near_row"))])
PROSE = ("the quick river runs past an old stone mill where seven grey herons wait for fish and "
         "nobody has counted the willows since the last flood took away the wooden bridge")


def docs(spark, rows=None):
    """Rows (doc_id, text, lang, source); the extra columns hold text or null."""
    rows = edge_rows() if rows is None else rows
    extra = ["x", None, "y", "", "z", None, "1", "no", "t", None, "r"]
    return spark.createDataFrame([(d, t, la, s, None if t is None else len(t), *extra) for d, t, la, s in rows], DOCS)


def edge_rows():
    near = PROSE.replace("seven", "eight")
    return [
        (1, PROSE, "en", "a"), (2, None, "en", "a"), (3, "", "en", "a"), (None, PROSE + " again and again", "en", None),
        (4, LONG, "en", "a"), (5, LONG, None, "a"), (6, near, "en", "b"), (6, near, "en", "b"), (7, "  \n \t ", "en", "b"),
        (8, "one", "fr", "b"), (9, "one", "fr", "b"), (10, "a\n\nb\n" + PROSE, "en", None), (None, None, None, None),
        (11, "é ü x  y ▁ z", "de", "a"), (12, "ends with blank ", "en", "a"), (13, " starts", "en", "a"), (14, "two  blanks", "en", "a")]


def prose(seed: int, n: int) -> str:
    """``n`` words of made-up text that share few word pairs with other seeds."""
    r = random.Random(seed)
    return " ".join("".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(n))
