"""The corpus pipeline: stages over ``documents``, each written as Parquet
and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keelson.llm import stages
from keelson.llm.common import cut, read

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", stages.quality_rules),
    ("line_dedup", stages.line_dedup),
    ("jaccard_join", stages.jaccard_join),
    ("mixing", stages.mixing),
    ("pieces", stages.encoding),
]

#: Hash thresholds and token ids are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
