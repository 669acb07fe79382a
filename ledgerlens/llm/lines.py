"""Line dedup: a deletion-neighbourhood join over all lines of all texts.

A line is dropped when an earlier line (by document id, then position) has
the same words, or, for lines of ``near_words`` words or more, words within an
edit distance of one: one word inserted, deleted or replaced.

Only DataFrame functions are used. The plan:

1. Every line becomes a hash of its words and a few keys of its start and end.
2. Equal lines: one aggregation finds the first occurrence of every hash.
3. Two lines within one edit have the same first or the same last half (up to
   rounding). Lines that share neither with another line cannot have a
   partner and stop here; that is a count per key, not a join of lines. The
   same is done once more with the words of the rest: all but one quarter
   must agree, which also tells in which quarter the edit lies.
4. The others emit their deletion neighbourhood: the line itself and the line
   without its i-th word, for the places in such a quarter, as hashed keys. Lines with one key in common are
   within one edit when both lack the same position or one lacks none. The
   earliest line of each key is found by aggregation, so a key that thousands
   of lines share costs a row per line, never a pair per pair.
5. The edit distance of every line to the earlier line so found is verified on
   the words themselves.
6. The positions to drop go back to their documents.

Definitions: null or empty text has no lines and stays as it is; lines without
a word are kept. Rows with the same id and text are one document: they keep
and lose the same lines. A null id comes first. Words are separated by ASCII
white space, which does not count in a comparison; case does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import fresh, stored

#: Fewest words of a line that is compared with others up to one edit; in a
#: shorter one a word is more than a detail.
NEAR_WORDS = 10
#: Longer lines get their deletion keys by a window instead of an array.
ARRAY_WORDS = 1000
_HASH = ["h1", "h2"]
_PLACE = ["id", "rid", "pos"]


def _clean(line: Column) -> Column:
    """The words of a line with one blank between; most lines are so already,
    and only the others are taken apart by a pattern."""
    plain = F.trim(line)
    odd = F.lit(False)
    for x in ("\t", "\r", "\x0b", "\x0c", "  "):
        odd = odd | F.contains(plain, F.lit(x))
    words = F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(odd, F.array_join(words, " ")).otherwise(plain)


def _half(n: Column) -> Column:
    """Words in the start and end keys of a line whose shorter partner has n."""
    return (F.floor(n / 8) * 4).cast("int")


def _keys(line: Column, n: Column) -> Column:
    """Hashes of the start and of the end of a clean line, for partners of n or
    n - 1 words (the same keys unless n is a multiple of 8)."""
    def pair(m: Column) -> list[Column]:
        part = lambda k: F.call_function("substring_index", line, F.lit(" "), k)
        return [F.xxhash64(F.lit(1), m, part(m)), F.xxhash64(F.lit(2), m, part(-m))]

    return F.when(n % 8 == 0, F.array(*pair(_half(n)), *pair(_half(n - 1)))).otherwise(F.array(*pair(_half(n))))


def _lines(docs: DataFrame, near_words: int) -> DataFrame:
    """id, rid, pos, h1, h2, keys (null for short lines) of every line with a word."""
    lines = docs.select("id", "rid", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("id", "rid", "pos", _clean(F.col("line")).alias("line")).filter("line <> ''")
    lines = lines.withColumn("n", F.size(F.split("line", " ")))
    return lines.select(
        "id", "rid", "pos", F.xxhash64("line").alias("h1"), F.hash(F.lit(7), F.col("line")).alias("h2"),
        F.when(F.col("n") >= near_words, _keys(F.col("line"), F.col("n"))).alias("keys"))


def _first() -> Column:
    return F.min(F.struct(*_PLACE)).alias("first")


def _place_sum(i: Column, word: Column, seed: int) -> Column:
    """A 40-bit hash of a word at a place; sums of them identify word sequences."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), i, word), 24)


def _place_sums(seed: int, back: int) -> Column:
    """The hashes of all words, each ``back`` places before its own."""
    return F.transform("words", lambda w, i: _place_sum(i - back, w, seed))


def _quarters(words: DataFrame) -> DataFrame:
    """h1, h2, begin, end, key: a line's key without one of its quarters, which
    are the words from begin to before end. Partners of n or n - 1 words have
    the same length of a quarter unless n is a multiple of 4."""
    n = F.size("words")

    def parts(size: Column) -> list[Column]:
        out = []
        for s in range(4):
            before, after = size * s, size * (3 - s)
            key = F.xxhash64(F.lit(s), size, F.slice("words", F.lit(1), before), F.slice("words", n - after + 1, after))
            out.append(F.struct(before.alias("begin"), (n - after).alias("end"), key.alias("key")))
        return out

    size = lambda m: F.floor(m / 4).cast("int")
    each = F.when(n % 4 == 0, F.array(*parts(size(n)), *parts(size(n - 1)))).otherwise(F.array(*parts(size(n))))
    return words.select(*_HASH, F.explode(each).alias("q")).select(*_HASH, "q.*")


def _with_quarters(words: DataFrame) -> DataFrame:
    """The lines that agree with another in all but a quarter, with those quarters."""
    quarters = _quarters(words)
    shared = stored(quarters.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo < hi").select("key"), "lines-quarters")
    places = quarters.join(shared, "key", "left_semi").groupBy(*_HASH).agg(F.collect_set(F.struct("begin", "end")).alias("quarters"))
    return words.join(stored(places, "lines-places"), _HASH)


def _deletions(lines: DataFrame) -> DataFrame:
    """One row per deletion key: left (words left), a and b (sums over the
    remaining words at their new places), at (place deleted, -1: none). Places
    outside the line's ``quarters`` are left out."""
    carried = [*_HASH, "first"]
    wanted = lambda at: F.exists("quarters", lambda q: (at >= q["begin"]) & (at < q["end"]))
    total = lambda arr: F.aggregate(arr, F.lit(0).cast("long"), lambda s, x: s + x)
    out = []
    for seed, name in ((11, "a"), (13, "b")):
        out += [_place_sums(seed, 0).alias(f"{name}_here"), _place_sums(seed, 1).alias(f"{name}_moved")]
    arrays = lines.filter(F.size("words") <= ARRAY_WORDS).select(*carried, "quarters", F.size("words").alias("n"), *out)

    def running(name: str) -> Column:
        """Element i: the sum without word i. Each differs from the one before by two terms."""
        step = F.zip_with(F.slice(f"{name}_here", F.lit(1), F.col("n") - 1), F.slice(f"{name}_moved", F.lit(2), F.col("n") - 1), lambda h, m: h - m)
        start = total(F.col(f"{name}_moved")) - F.element_at(f"{name}_moved", 1)
        return F.aggregate(step, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    own = F.struct(F.col("n").alias("left"), total(F.col("a_here")).alias("a"), total(F.col("b_here")).alias("b"), F.lit(-1).alias("at"))
    gone = F.transform(F.arrays_zip(running("a").alias("x"), running("b").alias("y")),
                       lambda z, i: F.struct((F.col("n") - 1).alias("left"), z["x"].alias("a"), z["y"].alias("b"), i.alias("at")))
    gone = F.filter(gone, lambda z: wanted(z["at"]))
    short = arrays.select(*carried, F.explode(F.concat(F.array(own), gone)).alias("k")).select(*carried, "k.*")

    words = lines.filter(F.size("words") > ARRAY_WORDS).select(*carried, "quarters", F.size("words").alias("n"), F.posexplode("words").alias("at", "w"))
    line = W.partitionBy(*_HASH)
    before = line.orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    after = line.orderBy("at").rowsBetween(1, W.unboundedFollowing)
    sums = words.select(*carried, "quarters", "n", "at", *(
        (F.coalesce(F.sum(_place_sum(F.col("at"), F.col("w"), seed)).over(before), F.lit(0))
         + F.coalesce(F.sum(_place_sum(F.col("at") - 1, F.col("w"), seed)).over(after), F.lit(0))).alias(name)
        for seed, name in ((11, "a"), (13, "b"))))
    whole = words.groupBy(*_HASH, "n").agg(F.first("first").alias("first"), *(
        F.sum(_place_sum(F.col("at"), F.col("w"), seed)).alias(name) for seed, name in ((11, "a"), (13, "b"))))
    long = sums.filter(wanted(F.col("at"))).select(*carried, (F.col("n") - 1).alias("left"), "a", "b", "at").unionByName(
        whole.select(*carried, F.col("n").alias("left"), "a", "b", F.lit(-1).alias("at")))
    return short.unionByName(long)


def _within_one(a: Column, b: Column) -> Column:
    """Edit distance of two word arrays is at most one: what is left between
    the common start and the common end is at most one word of either."""
    def common(x: Column, y: Column) -> Column:
        differs = F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), False)
        return F.when(differs == 0, F.size(x)).otherwise(differs - 1)

    longest = F.greatest(F.size(a), F.size(b))
    return ((F.abs(F.size(a) - F.size(b)) <= 1)
            & (common(a, b) + common(F.reverse(a), F.reverse(b)) >= longest - 1))


def _sharing(lines: DataFrame) -> DataFrame:
    """h1, h2 of the distinct lines that share a key with another."""
    keyed = lines.filter("keys IS NOT NULL").select(*_HASH, F.explode("keys").alias("key"))
    shared = stored(keyed.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo < hi").select("key"), "lines-shared")
    return stored(keyed.join(shared, "key", "left_semi").select(*_HASH).distinct(), "lines-sharing")


def _near(docs: DataFrame, found: DataFrame) -> DataFrame:
    """h1, h2 of the lines of ``found`` (h1, h2, first) that have an earlier
    line within one edit."""
    wanted = found.groupBy(F.col("first.rid").alias("rid")).agg(F.collect_list(F.struct(*_HASH, "first")).alias("wanted"))
    wanted = stored(wanted, "lines-wanted")
    one_each = docs.select("rid", "text").join(wanted, "rid")
    texts = one_each.withColumn("lines", F.split("text", "\n")).select(F.explode(F.transform(
        "wanted", lambda w: F.struct(w["h1"].alias("h1"), w["h2"].alias("h2"), w["first"].alias("first"),
                                     F.element_at("lines", w["first"]["pos"] + 1).alias("line")))).alias("x")).select("x.*")
    texts = stored(texts.dropDuplicates(_HASH).withColumn("words", F.split(_clean(F.col("line")), " ")).drop("line"), "lines-words")

    texts = stored(_with_quarters(texts), "lines-candidates")
    keys = stored(_deletions(texts), "lines-deletions")
    same = ["left", "a", "b"]
    by_place = keys.groupBy(*same, "at").agg(_first_of(), F.count("*").alias("n")).filter((F.col("n") > 1) & (F.col("at") >= 0))
    both = keys.groupBy(*same).agg(F.min(F.when(F.col("at") < 0, F.col("first"))).alias("own_first"),
                                   F.min(F.when(F.col("at") >= 0, F.col("first"))).alias("gone_first"))
    both = stored(both.filter("own_first IS NOT NULL AND gone_first IS NOT NULL"), "lines-indels")
    by_place = stored(by_place.select(*same, "at", F.col("first").alias("earlier")), "lines-replaced")
    replaced = keys.join(by_place, [*same, "at"]).select(*_HASH, "first", "earlier")
    moved = keys.join(both, same).select(
        *_HASH, "first", F.when(F.col("at") < 0, F.col("gone_first")).otherwise(F.col("own_first")).alias("earlier"))
    links = stored(replaced.unionByName(moved).filter(F.col("earlier") < F.col("first")).select(*_HASH, "earlier").distinct(), "lines-links")
    mine = links.join(texts.select(*_HASH, "words"), _HASH)
    other = texts.select(F.col("first").alias("earlier"), F.col("words").alias("other"))
    return mine.join(other, "earlier").filter(_within_one(F.col("words"), F.col("other"))).select(*_HASH).distinct()


def _first_of() -> Column:
    return F.min("first").alias("first")


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_words: int = NEAR_WORDS) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the text that is left of every row.

    Returns the frame and the names of its new columns: ``text`` (lines joined
    again; null stays null), ``exact`` and ``near`` (lines dropped, by reason;
    a line that is both counts as exact) and ``emptied`` (the text had words
    and has none left).
    """
    rid = fresh(df, "line_rid")
    df = df.withColumn(rid, F.xxhash64(F.col(id_col), F.col(text_col)))
    docs = df.select(F.col(id_col).alias("id"), F.col(rid).alias("rid"), F.col(text_col).alias("text"))
    lines = stored(_lines(docs, near_words), "lines")

    # the places of lines move once, for the repeated ones and for those with a partner
    firsts = (lines.groupBy(*_HASH).agg(_first(), F.count("*").alias("n"))
              .join(_sharing(lines).withColumn("sharing", F.lit(True)), _HASH, "left")
              .withColumn("sharing", F.coalesce("sharing", F.lit(False))).filter("n > 1 OR sharing"))
    firsts = stored(firsts, "lines-firsts")
    repeated = firsts.filter("n > 1").select(*_HASH, "first")
    near = stored(_near(docs, firsts.filter("sharing").select(*_HASH, "first")), "lines-near")
    fate = stored(repeated.withColumn("near", F.lit(False)).unionByName(
        near.withColumn("first", F.lit(None).cast(repeated.schema["first"].dataType)).withColumn("near", F.lit(True)))
        .groupBy(*_HASH).agg(F.max("first").alias("first"), F.max("near").alias("near")), "lines-fate")
    later = F.col("first").isNotNull() & (F.struct(*_PLACE) != F.col("first"))
    dropped = (lines.select(*_HASH, *_PLACE).join(fate, _HASH).withColumn("later", later).filter("later OR near")
               .groupBy("rid").agg(F.collect_set(F.when(F.col("later"), F.col("pos"))).alias("exact"),
                                   F.collect_set(F.when(~F.col("later"), F.col("pos"))).alias("near")))
    names = {c: fresh(df, f"line_{c}") for c in ("text", "exact", "near", "emptied")}
    dropped = stored(dropped, "lines-dropped").select(
        F.col("rid").alias(rid), F.col("exact").alias(names["exact"]), F.col("near").alias(names["near"]))
    out = df.join(dropped, rid, "left")
    gone = F.concat(names["exact"], names["near"])
    left = F.concat_ws("\n", F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains(gone, i)))
    out = out.withColumn(names["text"], F.when(F.col(names["exact"]).isNull(), F.col(text_col)).otherwise(left))
    has_word = lambda c: F.col(c).rlike(r"[^\x20\x09-\x0D]")
    out = out.withColumn(names["emptied"], F.coalesce(has_word(text_col) & ~has_word(names["text"]), F.lit(False)))
    for c in ("exact", "near"):
        out = out.withColumn(names[c], F.coalesce(F.size(names[c]).cast("long"), F.lit(0).cast("long")))
    return out.drop(rid), names
