"""Quality rules: robust multivariate outliers per language and source.

Each text gives a vector of transformed statistics. For every (lang, source)
a minimum-covariance-determinant (MCD) estimate of location and scatter is
found; texts whose Mahalanobis distance from it is too large are rejected,
as are texts that fail two plain base rules.

The estimate is the usual one, spread over Spark. Every group starts from
several estimates: coordinatewise median and MAD, and the moments of small
random subsets. All take ``TRIAL`` concentration steps, the one of least
determinant goes on until its determinant no longer falls, and the least
determinant met on the way is kept. One step is one aggregation: distances
fall into narrow logarithmic bins, each (group, start, bin) carries its count
and moments (pre-aggregated in every task), and the bins nearest the centre
that together hold ``h`` of the group's vectors give the next centre and
scatter. No group's rows ever meet in one task, however large it is. A last
step takes all vectors within the 97.5 % distance.

Definitions:

* Equal vectors of a group count once in the estimate, so thousands of
  copies of one text cannot shrink its scatter to a point.
* A group with fewer than ``min_rows`` distinct vectors takes the estimate of
  its language, a language with fewer that of all texts; with fewer than that
  in all, only the base rules judge.
* The scatter has a floor per statistic (``FLOORS``): a statistic that is
  constant in a group must not reject the first text that differs a little.
  A text's own sampling variance is added to it, so short texts are not
  rejected for the noise of their shares.
* Null or empty text: all counts 0, fails the base rules. Null lang or source
  is a value of its own. Repeated rows are each judged.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import append_columns, fresh, stored

#: Statistics of the vector with the least standard deviation assumed for each:
#: arcsine-root shares of symbols, ASCII capitals and punctuation among word
#: characters, log mean word length, arcsine-root shares of repeated lines
#: and of words in repeated windows.
FLOORS = {"symbols": 0.03, "capitals": 0.04, "punctuation": 0.04, "word_length": 0.08,
          "dup_lines": 0.08, "repeat_words": 0.08}
DIM = len(FLOORS)
SYMBOLS = b"#*$%&|<>"
PUNCTUATION = b".,;:!?'\"()-"
SPACES = b" \t\n\r\x0b\x0c"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
STARTS = 4  # median and MAD, and random subsets
TRIAL = 2
MOST_STEPS = 20
MIN_ROWS = 5 * DIM
_SETTLED = 1e-3  # of the logarithm of the determinant

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more.

    Windows are compared exactly: ranks of pairs, of pairs of pairs, and so
    on (``width`` is a power of two).
    """
    n = len(words)
    if n <= width:
        return 0
    seen: dict[bytes, int] = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    span = 1
    while span < width:
        both = rank[:-span] * np.int64(n + 1) + rank[span:]
        _, rank, times = np.unique(both, return_inverse=True, return_counts=True)
        if len(times) == len(rank):
            return 0
        span *= 2
    hits = np.flatnonzero(times[rank] > 1)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, hits, 1)
    np.add.at(cover, hits + width, -1)
    return int((np.cumsum(cover[:n]) > 0).sum())


def text_counts(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with
    words, capitals, punctuation of one text."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in text.split("\n") if x.strip(SPACES.decode())]
    return (len(words), len(text) - int(by_byte[list(SPACES)].sum()), int(by_byte[list(SYMBOLS)].sum()),
            len(lines) - len(set(lines)), repeat_words(words), len(lines),
            int(by_byte[65:91].sum()), int(by_byte[list(PUNCTUATION)].sum()))


def _vectors(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Statistic vectors and their sampling variances from rows of counts."""
    words, chars, symbols, dup, rep, lines, caps, punct = np.maximum(c.T.astype(float), 0)
    share = lambda k, n: np.arcsin(np.sqrt(np.clip(k / np.maximum(n, 1), 0, 1)))
    x = np.stack([share(symbols, chars), share(caps, chars), share(punct, chars),
                  np.log((chars + 1) / (words + 1)), share(dup, lines), share(rep, words)], axis=1)
    by_char, by_word = 0.25 / np.maximum(chars, 1), 0.25 / np.maximum(words, 1)
    noise = np.stack([by_char, by_char, by_char, by_word, 0.25 / np.maximum(lines, 1), by_word], axis=1)
    return np.round(x, 6), noise


def _list_array(rows: np.ndarray) -> pa.Array:
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d, dtype=np.int32)), pa.array(rows.ravel()))


def with_statistics(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the counts, the base verdict, the vector and the group key.

    Returns the frame and the names given to the new columns (they avoid
    names that ``df`` already has).
    """
    base = [*_COUNTS, "base_failed", "vector", "noise", "group"]
    names = {c: fresh(df, f"mcd_{c}") for c in base}
    fields = ([T.StructField(names[c], T.LongType()) for c in _COUNTS]
              + [T.StructField(names["base_failed"], T.BooleanType())]
              + [T.StructField(names[c], T.ArrayType(T.DoubleType())) for c in ("vector", "noise")])

    def compute(column: pa.Array) -> list[pa.Array]:
        c = np.array([text_counts(t or "") for t in column.to_pylist()], np.int64).reshape(-1, 8)
        x, noise = _vectors(c)
        failed = (c[:, 0] < MIN_WORDS) | (100 * c[:, 4] > MAX_REPEAT_PERCENT * c[:, 0])
        return [*(pa.array(c[:, i]) for i in range(5)), pa.array(failed), _list_array(x), _list_array(noise)]

    out = append_columns(df, [text], fields, compute)
    return out.withColumn(names["group"], _fine_key(lang, source)), names


def _fine_key(lang: str, source: str):
    return F.to_json(F.struct(F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source")))


_STEP = "key string, start int, mean array<double>, scatter array<double>, inverse array<double>, log_det double, n long"


def _chi2_quantile(p: float, dim: int) -> float:
    """Wilson and Hilferty's approximation."""
    lo, hi = -9.0, 9.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * (1 + math.erf(mid / math.sqrt(2))) < p else (lo, mid)
    return dim * (1 - 2 / (9 * dim) + lo * math.sqrt(2 / (9 * dim))) ** 3


def _chi2_cdf(x: float, dim: int) -> float:
    z = ((max(x, 1e-12) / dim) ** (1 / 3) - 1 + 2 / (9 * dim)) / math.sqrt(2 / (9 * dim))
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def _consistency(kept: float) -> float:
    """Factor by which the scatter of the nearest share ``kept`` is too small."""
    return kept / _chi2_cdf(_chi2_quantile(kept, DIM), DIM + 2) if kept < 1 else 1.0


def _row(key: str, start: int, mean: np.ndarray, scatter: np.ndarray, n: int) -> pd.DataFrame:
    inverse = np.linalg.inv(scatter)
    return pd.DataFrame({"key": [key], "start": [start], "mean": [np.round(mean, 9).tolist()], "scatter": [np.round(scatter, 12).ravel().tolist()],
                         "inverse": [inverse.ravel().tolist()], "log_det": [round(float(np.linalg.slogdet(scatter)[1]), 9)], "n": [n]})


def _subset(pdf: pd.DataFrame) -> pd.DataFrame:
    """Moments of a random subset (``DIM`` + 1 vectors)."""
    x = pdf.sort_values("place")[[f"x{i}" for i in range(DIM)]].to_numpy(float)
    floors = np.array(list(FLOORS.values()))
    return _row(pdf["key"].iat[0], int(pdf["start"].iat[0]), x.mean(axis=0), np.cov(x.T, bias=True) + np.diag(floors**2), len(x))


def _start(pdf: pd.DataFrame) -> pd.DataFrame:
    """Median and MAD of each statistic from its histogram (bins of 1/512)."""
    centre, spread = np.zeros(DIM), np.zeros(DIM)

    def median(value: np.ndarray, n: np.ndarray) -> float:
        order = np.argsort(value, kind="stable")
        total = np.cumsum(n[order])
        return float(value[order][np.searchsorted(total, total[-1] / 2)])

    for d, g in pdf.groupby("d"):
        v, n = g["bin"].to_numpy(float) / 512, g["n"].to_numpy()
        centre[d] = median(v, n)
        spread[d] = 1.4826 * median(np.abs(v - centre[d]), n)
    floors = np.array(list(FLOORS.values()))
    return _row(pdf["key"].iat[0], 0, centre, np.diag(spread**2 + floors**2), int(pdf.loc[pdf["d"] == 0, "n"].sum()))


def _moments(pdf: pd.DataFrame, share: float | None, limit: float | None) -> pd.DataFrame:
    """Next centre and scatter from the bins nearest the present centre:
    those that hold ``share`` of the vectors, or those up to ``limit``."""
    pdf = pdf.sort_values("bin")
    n = pdf["n"].to_numpy()
    if share is not None:
        last = int(np.searchsorted(np.cumsum(n), math.ceil(share * n.sum())))
    else:
        last = max(0, int((pdf["bin"].to_numpy() <= _bin(limit)).sum()) - 1)
    near = pdf.iloc[: last + 1]
    m = int(near["n"].sum())
    sums = near[[f"s{i}" for i in range(DIM)]].sum().to_numpy() / m
    cross = np.zeros((DIM, DIM))
    for i in range(DIM):
        for j in range(i, DIM):
            cross[i, j] = cross[j, i] = near[f"q{i}_{j}"].sum() / m
    cov = cross - np.outer(sums, sums)
    cov = (cov + cov.T) / 2
    np.fill_diagonal(cov, np.maximum(np.diag(cov), 0))
    factor = _consistency(share if share is not None else 0.975)
    floors = np.array(list(FLOORS.values()))
    return _row(pdf["key"].iat[0], int(pdf["start"].iat[0]), sums, cov * factor + np.diag(floors**2), int(n.sum()))


def _update(share: float | None, limit: float | None):
    def update(pdf: pd.DataFrame) -> pd.DataFrame:
        return _moments(pdf, share, limit)

    return update


def _bin(d2: float) -> int:
    return int(math.floor(math.log2(1 + d2) * 32))


def fit(stats: DataFrame, names: dict[str, str], lang: str = "lang", h: float = 0.75, starts: int = STARTS, min_rows: int = MIN_ROWS) -> DataFrame:
    """MCD estimate for every (lang, source) of a frame of ``with_statistics``.

    Returns one row per group: its centre, scatter (row by row), whose
    estimate it is, and log_det, that of the concentrated scatter. ``h`` is
    the share of vectors in the concentration steps, of which there are at
    most ``MOST_STEPS`` after the trial.
    """
    own = stored(
        stats.filter(~F.col(names["base_failed"]))
        .select(F.col(names["group"]).alias("fine"), F.to_json(F.struct(F.col(lang).cast("string").alias("lang"))).alias("coarse"),
                F.col(names["vector"]).alias("x"))
        .groupBy("fine", "coarse", "x").count().drop("count"), "mcd-vectors")
    per_fine = stored(own.groupBy("fine", "coarse").agg(F.count("*").alias("n")), "mcd-groups")
    per_lang = per_fine.groupBy("coarse").agg(F.sum("n").alias("n_lang"), F.min("n").alias("n_least"))
    total = per_fine.agg(F.sum("n"), F.count("*")).first()
    n_all, n_groups = total[0] or 0, total[1]
    lang_ok, all_ok = F.col("n_lang") >= min_rows, F.lit(n_all >= min_rows)
    level = (F.when(F.col("n") >= min_rows, "source").when(lang_ok, "lang").when(all_ok, "all"))
    key = (F.when(F.col("n") >= min_rows, F.col("fine")).when(lang_ok, F.concat(F.lit("lang:"), "coarse")).when(all_ok, F.lit("all")))
    few = 1 + n_groups // 2000
    groups = stored(
        per_fine.join(per_lang, "coarse").select(
            "fine", level.alias("level"), key.alias("key"),
            F.array_compact(F.array(
                F.when(F.col("n") >= min_rows, F.col("fine")),
                F.when((F.col("n_least") < min_rows) & lang_ok, F.concat(F.lit("lang:"), "coarse")))).alias("feeds"))
        .repartition(few), "mcd-levels")
    uses_all = n_groups > 0 and bool(groups.filter("level = 'all'").take(1))
    feeds = F.concat("feeds", F.array(F.lit("all"))) if uses_all else F.col("feeds")
    rows = own.join(groups, "fine").select(F.explode(feeds).alias("key"), "x")
    rows = stored(rows.select("key", *(F.col("x")[i].alias(f"x{i}") for i in range(DIM))), "mcd-rows")

    binned = (rows.select("key", F.posexplode(F.array(*(F.floor(F.col(f"x{i}") * 512) for i in range(DIM)))).alias("d", "bin"))
              .groupBy("key", "d", "bin").agg(F.count("*").alias("n")))
    params = binned.groupBy("key").applyInPandas(_start, _STEP)
    if starts > 1:
        x = [f"x{i}" for i in range(DIM)]
        first = Window.partitionBy("key", "start").orderBy(F.xxhash64("start", *x), *x)
        subsets = (rows.withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(starts - 1))))
                   .withColumn("place", F.row_number().over(first)).filter(F.col("place") <= DIM + 1))
        params = params.unionByName(subsets.groupBy("key", "start").applyInPandas(_subset, _STEP))
    params = stored(params.repartition(few), "mcd-start")
    cross = [(i, j) for i in range(DIM) for j in range(i, DIM)]

    def step(params: DataFrame, share: float | None, limit: float | None, name: str) -> DataFrame:
        delta = [F.col(f"x{i}") - F.col("mean")[i] for i in range(DIM)]
        d2 = sum((delta[i] * delta[j] * F.col("inverse")[i * DIM + j] * (1 if i == j else 2) for i, j in cross), F.lit(0.0))
        near = (rows.join(params.select("key", "start", "mean", "inverse"), "key")
                .withColumn("bin", F.floor(F.log2(1 + F.greatest(d2, F.lit(0.0))) * 32))
                .groupBy("key", "start", "bin").agg(F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(DIM)),
                                                    *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i, j in cross)))
        return stored(near.groupBy("key", "start").applyInPandas(_update(share, limit), _STEP).repartition(few), name)

    def least(params: DataFrame) -> DataFrame:
        best = F.min_by(F.struct(*(c for c in params.columns if c != "key")), F.struct("log_det", "start"))
        return params.groupBy("key").agg(best.alias("best")).select("key", "best.*")

    for k in range(TRIAL):
        params = step(params, h, None, f"mcd-trial{k}")
    best = stored(least(params).repartition(few), "mcd-best")
    for k in range(MOST_STEPS):
        params = step(best, h, None, f"mcd-step{k}")
        falls = params.join(best.select("key", F.col("log_det").alias("before")), "key").filter(F.col("before") - F.col("log_det") > _SETTLED)
        settled = not falls.take(1)
        best = stored(least(best.unionByName(params)).repartition(few), f"mcd-best{k}")
        if settled:
            break
    params = step(best, None, _chi2_quantile(0.975, DIM), "mcd-reweighted").join(best.select("key", F.col("log_det").alias("least")), "key")
    return stored(groups.join(params, "key").select(F.col("fine").alias("group"), "mean", "scatter", "level", F.col("n").alias("n_rows"), F.col("least").alias("log_det"))
                  .repartition(few), "mcd-model")


def judge(stats: DataFrame, names: dict[str, str], model: DataFrame, tail: float = 1e-7) -> tuple[DataFrame, dict[str, str]]:
    """``stats`` with the squared distance and the verdict of every row.

    A text is an outlier when its distance exceeds the chi-squared quantile
    that leaves ``tail``. Where no estimate exists the distance is null and
    the base rules decide.
    """
    made = {c: fresh(stats, f"mcd_{c}") for c in ("distance", "kept", "mean", "scatter", "level")}
    m = model.select(F.col("group").alias(names["group"]), F.col("mean").alias(made["mean"]),
                     F.col("scatter").alias(made["scatter"]), F.col("level").alias(made["level"]))
    joined = stats.join(m, names["group"], "left")
    cut = _chi2_quantile(1 - tail, DIM)

    def distances(x: pa.Array, noise: pa.Array, mean: pa.Array, scatter: pa.Array, failed: pa.Array) -> list[pa.Array]:
        known = np.array([v is not None for v in mean.to_pylist()], bool)
        d2 = np.full(len(x), np.nan)
        if known.any():
            mask = pa.array(known)
            flat = lambda a: np.asarray(a.filter(mask).flatten(), float)
            delta = (flat(x) - flat(mean)).reshape(-1, DIM)
            s = flat(scatter).reshape(-1, DIM, DIM).copy()
            s[:, np.arange(DIM), np.arange(DIM)] += flat(noise).reshape(-1, DIM)
            d2[known] = np.einsum("ni,ni->n", delta, np.linalg.solve(s, delta[:, :, None])[:, :, 0])
        kept = ~np.asarray(failed.to_pylist(), bool) & ~(known & (d2 > cut))
        return [pa.array(d2, mask=~known), pa.array(kept, pa.bool_())]

    out = append_columns(joined, [names["vector"], names["noise"], made["mean"], made["scatter"], names["base_failed"]],
                         [T.StructField(made["distance"], T.DoubleType()), T.StructField(made["kept"], T.BooleanType())], distances)
    return out, {**names, **made}


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", **params) -> tuple[DataFrame, dict[str, str]]:
    """Every row of ``docs`` with its statistics and verdict; see ``judge``.

    The statistics are computed twice (for the estimate and for the verdict):
    cheaper than moving the texts through a join, and ``docs`` keeps its order
    of partitions.
    """
    tail = params.pop("tail", 1e-7)
    stats, names = with_statistics(docs, text, lang, source)
    return judge(stats, names, fit(stats, names, lang, **params), tail)
