"""Mixing sources to target weights by hash-threshold histograms (native).

Every source gets a target number of words. A row's place is a 60-bit hash;
a source takes the rows whose hash lies below its threshold. The threshold is
found without sorting: words are summed by (source, hash bucket), the bucket
in which the running sum passes the budget is the boundary, and only the rows
of that bucket are summed again by the next 12 bits. Sums are aggregated
before they are shuffled, so a source that holds a third of all rows costs no
more than its 4096 buckets.

Defined results: null sizes and null texts count 0 words; a null source is a
source of its own (last in code-point order); empty input gives no rows;
sources without words have target 0; rows of 0 words are taken or not, which
adds nothing; equal rows share the content hash and are told apart by a frozen
row number, so a run of them can be cut anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, read, words

WEIGHTS = (3, 1, 2)   # repeating over the sources in code-point order
SHARE = 1.5           # of all words, to be shared among the sources
MAX_REPEAT = 2        # no document, so no source, more than so often
BITS, LEVELS = 12, 5  # bits a level, levels
HASH_BITS = 36        # of the content hash; the rest tells equal rows apart


def place(content: list[Column], row: Column) -> Column:
    """60-bit place of a row: 36 bits of its content, 24 of its row number."""
    low = BITS * LEVELS - HASH_BITS
    high = F.shiftrightunsigned(F.xxhash64(*content), 64 - HASH_BITS)
    return F.shiftleft(high, low) + F.shiftrightunsigned(F.xxhash64(F.lit(7), row), 64 - low)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = MAX_REPEAT) -> DataFrame:
    """``(src, size)`` rows -> one row per source: src, source_size, target.

    Weighted shares of ``share`` x all words, held at ``cap`` x the source; the
    excess goes to the others by weight until none is above. That is the water
    level: with the sources in order of cap/weight, the first one whose share
    of what the earlier ones leave stays below its cap sets the level.
    """
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("src").asc_nulls_last())  # one row per source
    nth = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("cap", cap * F.col("source_size"))
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), F.col("src").asc_nulls_last())
    earlier = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    open_w = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0))
    per = per.withColumn("level", left / open_w).withColumn("nth", F.row_number().over(by_ratio))
    fits = F.col("level") <= F.col("cap") / F.col("w")
    level = F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("nth"))).over(everything)
    return per.select("src", "source_size",
                      F.least("cap", F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def _boundary(hist: DataFrame) -> DataFrame:
    """Per source, the bucket in which the running sum passes what is left."""
    w = W.partitionBy("src").orderBy("bucket")
    run = hist.withColumn("upto", F.sum("words").over(w))
    return (run.filter(F.col("before") + F.col("upto") > F.col("rest"))
            .groupBy("src", "rest")
            .agg(F.min(F.struct("bucket", "words", (F.col("before") + F.col("upto") - F.col("words")).alias("before")))
                 .alias("b"))
            .select("src", "rest", F.col("b.bucket").alias("bucket"), F.col("b.words").alias("words"),
                    F.col("b.before").alias("before")))


def thresholds(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """rows: src, size, k (60-bit place). goal: of ``targets``. Adds to goal:
    base (whole repeats) and limit (rows with k below it are taken once more).
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = cut(goal.withColumn("base", whole.cast("long"))
               .withColumn("rest", F.col("target") - F.col("base") * F.col("source_size")))
    total = BITS * LEVELS
    state = goal.select("src", "rest", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("before"))
    for level in range(1, LEVELS + 1):
        shift = total - BITS * level
        bucket = F.shiftright("k", shift)
        if level > 1:  # only the rows of the boundary bucket
            last = state.select(F.col("src").alias("_s"), F.col("bucket").alias("_b"))
            rows = rows.join(last, F.col("src").eqNullSafe(F.col("_s")) & (F.shiftright("k", shift + BITS) == F.col("_b")),
                             "left_semi")
            if level == 2:
                rows = cut(rows)
        hist = rows.groupBy("src", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        known = state.select(F.col("src").alias("_s"), "rest", "before")
        hist = hist.join(known, F.col("src").eqNullSafe(F.col("_s"))).drop("_s")
        state = _boundary(hist)
        if level < LEVELS:
            state = cut(state)
    closer = F.when(2 * (F.col("rest") - F.col("before")) >= F.col("words"), 1).otherwise(0)
    last = state.select(F.col("src").alias("_s"), (F.col("bucket") + closer).alias("limit"))
    return cut(goal.join(last, F.col("src").eqNullSafe(F.col("_s")), "left").drop("_s")
               .withColumn("limit", F.coalesce("limit", F.lit(0))))


def mix(docs: DataFrame, source: str, size: str, content: list[str], row: str, weights=WEIGHTS,
        share: float = SHARE, cap: float = MAX_REPEAT, prefix: str = "") -> DataFrame:
    """``docs`` with {prefix}source_size, {prefix}target and {prefix}taken: the
    size times the number of times the mix takes the row (0 to ``cap``)."""
    k = place([F.col(c) for c in content], F.col(row))
    rows = cut(docs.select(F.col(source).alias("src"), F.col(size).alias("size"), k.alias("k")))
    limits = thresholds(rows, targets(rows, weights, share, cap)).select(
        F.col("src").alias("_mix_src"), F.col("source_size").alias(f"{prefix}source_size"),
        F.col("target").alias(f"{prefix}target"), F.col("base").alias("_mix_base"), F.col("limit").alias("_mix_limit"))
    times = F.col("_mix_base") + F.when(k < F.col("_mix_limit"), 1).otherwise(0)
    return (docs.join(limits, docs[source].eqNullSafe(F.col("_mix_src")))
            .withColumn(f"{prefix}times", times)
            .withColumn(f"{prefix}taken", docs[size] * times)
            .drop("_mix_src", "_mix_base", "_mix_limit"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed at the default weights."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    slim = cut(docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("t"),
                           F.monotonically_increasing_id().alias("row")))
    out = mix(slim, "source", "size", ["doc_id", "t"], "row")
    return out.select("doc_id", "size", "source_size", "target", "taken", "times")
