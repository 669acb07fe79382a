"""Corpus pipeline: documents through five of the operators in ``ledgerlens/llm``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which ``run`` writes as Parquet and rereads as the
next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlens.llm import compression, lines, minhash, outliers, packing  # noqa: E402
from ledgerlens.llm.common import stored, table  # noqa: E402
from ledgerlens.llm.queries import fold  # noqa: E402

LEAST_QUALITY = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under ``LEAST_QUALITY`` go. Labels of fold 0 stay
    unseen, as in the operator's query."""
    labels = table(spark, sf_dir, "labels").filter(fold() != 0)
    scored, score = compression.scored(docs, compression.fit(docs, labels))
    return scored.filter(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier rule reject go."""
    judged, names = outliers.quality_rules(docs)
    return judged.filter(names["kept"]).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line of the corpus equals, or almost equals, go;
    documents of which no word is left go too. n_chars follows the text."""
    out, names = lines.line_dedup(docs)
    changed = F.col(names["exact"]) + F.col(names["near"]) > 0
    new = {"text": F.col(names["text"]), "n_chars": F.when(changed, F.length(names["text"]).cast("long")).otherwise(F.col("n_chars"))}
    return out.filter(~F.col(names["emptied"])).select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest id."""
    return minhash.without_duplicates(docs, width=5, threshold=0.8).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in sequences of at most 1,024."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("packing", pack),
]

#: Compression scores, distances and token ids cannot be stated in SQL; the
#: tests compare the stages with brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
