"""Quality classifier by compression: two zstandard dictionaries, one score.

One dictionary is built from text labelled good, one from text labelled bad.
A text is cut into blocks of 1,024 bytes (so that a long text cannot adapt the
compressor to itself and outgrow the dictionaries); every block is compressed
with each dictionary. The normalised difference of the summed sizes,

    (size with the bad - size with the good) / (their sum),

goes through a logistic curve, fitted by Newton's method to labelled texts
that gave no dictionary block, and becomes a score from 0 to 1.

What is learnt, learns from a bounded, deterministic sample of labelled rows:
per label the ``sample_rows`` ids of least hash for the dictionaries, as many
others for the curve, and of the dictionaries' texts the ``sample_blocks``
blocks of least hash. Every text is scored whole.

Definitions: null text counts as empty. An empty text has difference 0 and
gets the curve's value there. Without labels of both kinds, all scores are 0.5.
Labels that are null or not 0 or 1 are ignored; an id with both labels counts
as bad. Repeated rows are each scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import append_columns, fresh, stored

BLOCK = 1024
DICTIONARY_BYTES = 160 * 1024
SAMPLE_ROWS = 1500
SAMPLE_BLOCKS = 6000
LEVEL = 3


@dataclass(frozen=True)
class Model:
    """Both dictionaries and the curve: score = 1 / (1 + exp(-(intercept + slope * difference)))."""

    good: bytes
    bad: bytes
    intercept: float
    slope: float


def blocks(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "replace")
    return [raw[i:i + BLOCK] for i in range(0, len(raw), BLOCK)]


def _compressors(model: Model) -> list[zstandard.ZstdCompressor]:
    out = []
    for content in (model.good, model.bad):
        d = zstandard.ZstdCompressionDict(content)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def difference(text: str | None, compressors: list[zstandard.ZstdCompressor]) -> float:
    good = bad = 0
    for b in blocks(text):
        good += len(compressors[0].compress(b))
        bad += len(compressors[1].compress(b))
    return (bad - good) / (bad + good) if good else 0.0


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve, with a slight pull on the slope
    so that perfectly separated labels still have a finite one."""
    scale = float(np.std(x)) or 1.0
    z, w = np.stack([np.ones_like(x), x / scale], axis=1), np.zeros(2)
    pull = np.diag([1e-6, 1e-2])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + pull, z.T @ (y - p) - pull @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1] / scale)


def _sample(labels: DataFrame, rows: int) -> DataFrame:
    """id, label, role: per label ``rows`` ids for the dictionaries, ``rows`` for the curve."""
    picked = None
    for value in (0, 1):
        own = labels.filter(F.col("label") == value).orderBy(F.xxhash64("id", F.lit(17)), "id").limit(2 * rows)
        own = own.withColumn("role", F.when(F.pmod(F.xxhash64("id", F.lit(19)), F.lit(2)) == 0, "dictionary").otherwise("curve"))
        picked = own if picked is None else picked.unionByName(own)
    return picked


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample_rows: int = SAMPLE_ROWS, sample_blocks: int = SAMPLE_BLOCKS) -> Model:
    """Dictionaries and curve from the labelled rows of ``docs``.

    The caller chooses which labels may be learnt from by passing only those.
    At most 4 * ``sample_rows`` texts are read for it, and at most 2 *
    ``sample_blocks`` blocks and as many numbers as texts reach the driver.
    """
    clean = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
             .filter("id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.min("label").alias("label")))
    picked = stored(_sample(clean, sample_rows), "compress-sample")  # 4 * sample_rows short rows at most
    texts = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id"), "compress-texts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, label, block, at = [], [], [], []
            for i, k, t in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                for j, b in enumerate(blocks(t)):
                    ids.append(i), label.append(k), block.append(b), at.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(label, pa.int32()), pa.array(block, pa.binary()), pa.array(at, pa.int32())], ["id", "label", "block", "at"])

    cut_up = texts.filter("role = 'dictionary'").select(F.col("id").cast("long"), "label", "text").mapInArrow(cut, "id long, label int, block binary, at int")
    cut_up = stored(cut_up, "compress-blocks")
    samples = {}
    for value in (0, 1):
        rows = cut_up.filter(F.col("label") == value).orderBy(F.xxhash64("id", "at"), "id", "at").limit(sample_blocks).select("block").collect()
        samples[value] = [bytes(r[0]) for r in rows]
    if not samples[0] or not samples[1]:
        return Model(b"", b"", 0.0, 0.0)
    model = Model(_dictionary(samples[1]), _dictionary(samples[0]), 0.0, 1.0)
    measured = append_columns(texts.filter("role = 'curve'").select("label", "text"), ["text"], [T.StructField("difference", T.DoubleType())],
                              lambda c, column: [pa.array([difference(t, c) for t in column.to_pylist()], pa.float64())], lambda: _compressors(model))
    points = np.array([tuple(r) for r in measured.select("label", "difference").collect()], float).reshape(-1, 2)
    if len(set(points[:, 0])) < 2:  # too few labels for a fold of their own
        return Model(model.good, model.bad, 0.0, 50.0)
    order = np.lexsort((points[:, 0], points[:, 1]))
    intercept, slope = fit_curve(points[order, 1], points[order, 0])
    return Model(model.good, model.bad, intercept, slope)


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; with too little text to train one, the text itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def scored(df: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, str]:
    """``df`` with the score of every whole text; returns the frame and the
    name of the new column."""
    name = fresh(df, "quality_score")
    if not model.good:
        return df.withColumn(name, F.lit(0.5)), name

    def score(compressors: list[zstandard.ZstdCompressor], column: pa.Array) -> list[pa.Array]:
        d = np.array([difference(t, compressors) for t in column.to_pylist()], float)
        return [pa.array(1 / (1 + np.exp(-np.clip(model.intercept + model.slope * d, -700, 700))))]

    return append_columns(df, [text_col], [T.StructField(name, T.DoubleType())], score, lambda: _compressors(model)), name
