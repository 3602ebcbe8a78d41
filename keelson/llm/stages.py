"""The pipeline's stages: each takes (spark, docs, sf_dir) and returns rows
with the columns of ``docs`` (the last one: the encoded documents)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import jaccard, pieces, repetition
from .common import cut, prepare, words
from .lines import remove_boilerplate
from .mixing import mix

SHINGLE, PERCENT = 5, 80  # near duplicates of the pipeline
BATCH = "4m"              # of rows that go to a Python worker at a time


def _like(made: DataFrame, docs: DataFrame) -> DataFrame:
    return made.select(*[F.col(f"`{c}`") for c in docs.columns])


def _ready(spark: SparkSession) -> None:
    """Session needs of a stage. All stages share their executors, whose Python
    workers stay, so batches are bounded by bytes: long texts would fill them."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rule and the repetition limits keep."""
    _ready(spark)
    return repetition.keep_good(spark, docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on many sites. One of which all
    lines with a word went (a copy of text kept elsewhere) goes itself."""
    _ready(spark)
    made = remove_boilerplate(docs)
    return _like(made.filter((F.col("_line_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest id (of
    several such, or without ids, the one with the smallest text hash); one that
    links with nothing stays. Of rows equal in id and text one stays."""
    _ready(spark)
    found = jaccard.classes(docs, size=SHINGLE, percent=PERCENT)
    # a null id in a component without ids is its own smallest
    least = found.filter(F.col("id").eqNullSafe(F.col("component")))
    keep = (least.filter("n > 0").groupBy("label").agg(F.first("component").alias("_jac_id"), F.min("th").alias("_jac_th")).drop("label")
            .union(least.filter("n = 0").select("id", "th").distinct()))
    keep = cut(keep)
    hashed = docs.withColumn("_jac_text", F.xxhash64("text"))
    stay = hashed.join(keep, F.col("doc_id").eqNullSafe(F.col("_jac_id")) & (F.col("_jac_text") == F.col("_jac_th")), "left_semi")
    once = stay.withColumn("_jac_nth", F.row_number().over(W.partitionBy("doc_id", "_jac_text").orderBy("doc_id")))
    return _like(once.filter("_jac_nth = 1"), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, each as often as it takes it. Rows are
    numbered and written first, so that equal ones are told apart for good."""
    _ready(spark)
    sized = cut(docs.withColumn("_mix_size", words(F.col("text"))).withColumn("_mix_row", F.monotonically_increasing_id()))
    mixed = mix(sized, "source", "_mix_size", ["doc_id", "text"], "_mix_row", prefix="_mix_")
    again = F.explode(F.array_repeat(F.lit(0), F.col("_mix_times").cast("int")))
    return _like(mixed.withColumn("_mix_copy", again), docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's columns but the text, with n_tokens and its token ids."""
    _ready(spark)
    return pieces.encode(docs)
