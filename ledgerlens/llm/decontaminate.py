"""Benchmark decontamination: a prefix-filtered set join, on DataFrames only.

A window is ``width`` consecutive words of an item (a shorter item is one
window). A document word is hit if it lies in an occurrence of a window.

1. Windows are taken apart into shingles of ``shingle`` words, each with its
   place. As all of a window must occur, the prefix that two equal sets must
   share is one shingle long.
2. One pass over the documents: the hash of the shingle that starts at every
   word meets the benchmark's shingles; matches keep row, place and document
   length. Each document also gives one closing row, which matches a shingle of
   its own, so that documents without a match are counted too.
3. The matches tell how often each shingle occurs in the corpus. Every window
   is joined by its rarest shingle only; windows with a shingle that never
   occurs are out. Candidates must fit into the document (position) and the
   document must be as long as the window (length).
4. A candidate is verified over the whole window: all its shingles must be
   matches at their places.
5. Per document: the union of the verified stretches, and the items.

No join has a hint: Spark picks by size, and none depends on a key being rare.
Words and shingles are compared by 64-bit hashes.

Definitions. Letters A-Z are lowered, nothing else is; words are runs of
a-z, 0-9 and characters beyond ASCII. Null or empty texts, and texts without a
word, have no words (documents) or no window (items). Every row of a repeated
document has a result of its own; rows of an item that repeat its id count as
one item with the windows of all its texts. Windows of a null item hit words
but name no item. Without items nothing is hit, and an empty table of
documents gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, once A-Z are lowered.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A length that no shingle has: the closing row of a document.
_CLOSING = -1


def _lowered(text: Column) -> Column:
    """A-Z lowered. Only texts with other characters than ASCII need the slower
    way, which leaves those characters alone."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.filter(F.split(_lowered(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN), lambda w: w != "")


def _shingle(words: Column, at: Column, length: int) -> Column:
    """Hash of the ``length`` words from place ``at`` (from 0) on."""
    return F.xxhash64(F.lit(length), *(F.get(words, at + i) for i in range(length)))


def _shingles(words: Column, length: int) -> Column:
    """The hashes of all shingles of a length, by place."""
    places = F.sequence(F.lit(0), F.size(words) - length)
    return F.when(F.size(words) >= length, F.transform(places, lambda i: _shingle(words, i, length))).otherwise(F.array().cast("array<bigint>"))


def windows(items: DataFrame, width: int, shingle: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(wid, n, length, shingles) of every distinct window, and (wid, item)."""
    worded = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))
    each = stored(worded.select("item", F.explode(F.transform(starts, lambda s: F.slice("words", s + 1, F.lit(width)))).alias("window"))
                  .select("item", "window", F.xxhash64("window").alias("wid")), "windows")
    n = F.size("window")
    by_length = F.when(n >= shingle, _shingles(F.col("window"), shingle))
    for length in range(shingle - 1, 0, -1):
        by_length = by_length.when(n == length, _shingles(F.col("window"), length))
    distinct = each.dropDuplicates(["wid"]).select(
        "wid", n.alias("n"), F.least(n, F.lit(shingle)).alias("length"), by_length.alias("shingles"))
    return distinct, each.filter(F.col("item").isNotNull()).select("wid", "item").distinct()


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, shingle: int = 3, *, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit (words inside an occurrence
    of a window), n_items and items (the items of those windows, as strings,
    sorted), stretches (begin, end of the words hit, merged)."""
    shingle = min(shingle, width)
    distinct, owners = windows(items, width, shingle, item_col, item_text_col)
    distinct = stored(distinct, "windows-shingles")
    placed = stored(distinct.select("wid", "n", F.posexplode("shingles").alias("offset", "key")), "windows-places")
    lengths = sorted(r[0] for r in distinct.select("length").distinct().collect())  # at most `shingle` numbers

    closing = F.xxhash64(F.lit(_CLOSING))
    known = placed.select("key").distinct().union(docs.sparkSession.range(1).select(closing.alias("key")))
    worded = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    size = F.size("words")
    kinds = [F.struct(_shingles(F.col("words"), k).alias("keys")) for k in lengths] + [F.struct(F.array(closing).alias("keys"))]
    keys = worded.select("row", "doc_id", size.alias("n_words"), F.explode(F.array(*kinds)).alias("kind")).select(
        "row", "doc_id", "n_words", F.posexplode("kind.keys").alias("place", "key"))
    found = stored(keys.join(known, "key"), "matches")

    rows = found.filter(F.col("key") == closing).select("row", "doc_id", "n_words")
    matches = found.filter(F.col("key") != closing).select("row", "n_words", "place", "key")
    counts = matches.groupBy("key").agg(F.count(F.lit(1)).alias("seen"))
    rarity = placed.join(counts, "key", "left")
    prefix = rarity.groupBy("wid", "n").agg(
        F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "offset", "key")).alias("least")).filter("least.seen > 0")
    begin = F.col("place") - F.col("offset")
    candidates = (matches.join(prefix.select("wid", "n", "least.offset", "least.key"), "key")
                  .filter((begin >= 0) & (begin + F.col("n") <= F.col("n_words")))
                  .select("row", "wid", "n", begin.alias("begin")))
    wanted = (candidates.join(distinct.select("wid", "shingles"), "wid")
              .select("row", "wid", "n", "begin", F.size("shingles").alias("all"), F.posexplode("shingles").alias("offset", "key"))
              .withColumn("place", F.col("begin") + F.col("offset")))
    held = wanted.join(matches.select("row", "place", "key"), ["row", "place", "key"])
    occurs = stored(held.groupBy("row", "begin", "wid").agg(F.max("n").alias("n"), F.max("all").alias("all"), F.count(F.lit(1)).alias("held"))
                    .filter("held = all").select("row", "begin", (F.col("begin") + F.col("n")).alias("end"), "wid"), "occurrences")

    hit = occurs.groupBy("row").agg(_merged(F.sort_array(F.collect_set(F.struct("begin", "end")))).alias("stretches"))
    named = (occurs.select("row", "wid").distinct().join(owners, "wid")
             .groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items")))
    none = F.array().cast("array<struct<begin:int,end:int>>")
    stretches = F.coalesce("stretches", none)
    return (rows.join(hit, "row", "left").join(named, "row", "left")
            .select("doc_id", F.col("n_words").cast("long").alias("n_words"),
                    F.aggregate(stretches, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"]).alias("n_hit"),
                    F.size(F.coalesce("items", F.array().cast("array<string>"))).cast("long").alias("n_items"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"), stretches.alias("stretches")))


def _merged(stretches: Column) -> Column:
    """Sorted stretches without overlap: each only from where those before end."""
    start = F.struct(F.lit(0).alias("reach"), F.array().cast("array<struct<begin:int,end:int>>").alias("out"))

    def add(s: Column, x: Column) -> Column:
        begin = F.greatest(x["begin"], s["reach"])
        return F.struct(F.greatest(x["end"], s["reach"]).alias("reach"),
                        F.when(x["end"] > begin, F.concat(s["out"], F.array(F.struct(begin.alias("begin"), x["end"].alias("end"))))).otherwise(s["out"]).alias("out"))

    return F.aggregate(stretches, start, add, lambda s: s["out"])
