"""Frame quality, near-duplicate flag, fallback and the frame funnel.

Input: a frames table with ``video_id``, ``frame_idx`` (unique per video),
``brightness``, ``laplacian_var`` and ``dhash`` (16 hex chars).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson import constants as K
from keelson.functions import frames as FR
from keelson.operators.ordering import DEFAULT_CHUNK_ROWS, index_chunk, last_before, ordinal


def flag_quality(df: DataFrame, min_b: float = K.MIN_BRIGHTNESS, max_b: float = K.MAX_BRIGHTNESS,
                 min_lap: float = K.MIN_LAPLACIAN) -> DataFrame:
    """``quality_ok`` and the hash as a long (``hash``)."""
    return (df.withColumn("hash", FR.hex_to_hash("dhash"))
              .withColumn("quality_ok", FR.is_good("brightness", "laplacian_var", "hash", min_b, max_b, min_lap)))


def prev_good_hash(df: DataFrame, threshold: int = K.HAMMING_THRESHOLD, key: str = "video_id",
                   order: str = "frame_idx", rn: str | None = None,
                   chunk_rows: int = DEFAULT_CHUNK_ROWS, chunk: str | None = None) -> DataFrame:
    """G1: hash of the nearest earlier quality_ok frame (duplicates count),
    its hamming distance and the duplicate flag (distance <= threshold).
    Computed for every frame; the stored ``prev_dhash`` is null for bad ones.

    Skew-safe: the per-video order is a chunked ordinal and the carry is
    chunked (see :mod:`keelson.operators.ordering`). Pass the frames' own
    ``chunk`` column to reuse their partitioning."""
    d = df if "quality_ok" in df.columns else flag_quality(df)
    if rn is None:
        d = ordinal(d, key, [order], name="_rn", chunk=index_chunk(order, chunk_rows), keep_chunk="_ck")
        rn, chunk = "_rn", "_ck"
    d = last_before(d, key, rn, F.when(F.col("quality_ok"), F.col("hash")), "_prev", chunk_rows=chunk_rows, chunk=chunk)
    d = (d.withColumn("hamming_to_prev", FR.hamming("hash", "_prev"))
          .withColumn("is_duplicate", F.coalesce(F.col("_prev").isNotNull() & (F.col("hamming_to_prev") <= threshold),
                                                 F.lit(False)))
          .withColumn("prev_dhash", F.when(F.col("quality_ok") & F.col("_prev").isNotNull(), FR.hash_to_hex("_prev"))))
    return d.drop("_prev", "_rn", "_ck") if rn == "_rn" else d.drop("_prev")


def keep_frames(df: DataFrame) -> DataFrame:
    """quality_ok and not duplicate."""
    return df.where(F.col("quality_ok") & ~F.col("is_duplicate"))


def with_fallback(df: DataFrame, n: int = K.FALLBACK_FRAMES, key: str = "video_id") -> DataFrame:
    """D5 + J2: the kept frames (D2), plus, for videos where none is kept,
    the first ``n`` frames that have a hash, marked ok with mode
    ``raw_extracted``. Output has ``fallback_mode``."""
    passing = F.col("quality_ok") & ~F.col("is_duplicate")
    normal = df.where(passing).withColumn("fallback_mode", F.lit("normal"))
    per_video = df.groupBy(key).agg(F.count_if(passing).alias("_kept"))
    empty = per_video.where(F.col("_kept") == 0).select(F.col(key).alias("_empty"))
    # top-n per video by frame_idx: the row_number <= n filter lets Spark
    # insert a partial group limit before the shuffle
    first = Window.partitionBy(key).orderBy("frame_idx")
    fallback = (df.join(empty, F.col(key).eqNullSafe(F.col("_empty")), "left_semi").where(F.col("hash").isNotNull())
                  .withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n).drop("_r")
                  .withColumn("quality_ok", F.lit(True)).withColumn("is_duplicate", F.lit(False))
                  .withColumn("prev_dhash", F.lit(None).cast("string"))
                  .withColumn("hamming_to_prev", F.lit(None).cast("int"))
                  .withColumn("fallback_mode", F.lit("raw_extracted")))
    return normal.unionByName(fallback)


def frame_funnel(flagged: DataFrame, target: int = K.TARGET_FRAMES, key: str = "video_id",
                 fallback_n: int = K.FALLBACK_FRAMES) -> DataFrame:
    """per video extracted, quality_ok, deduplicated, candidate (after
    D5), processed (after selection: min(candidate, target)) and segmented
    frames. One aggregation with map-side partial counts."""
    passing = F.col("quality_ok") & ~F.col("is_duplicate")
    g = flagged.groupBy(key).agg(
        F.count(F.lit(1)).alias("extracted_frames"),
        F.count_if(F.col("quality_ok")).alias("quality_ok_frames"),
        F.count_if(passing).alias("deduplicated_frames"),
        F.count_if(F.col("hash").isNotNull()).alias("_hashed"))
    candidate = F.when(F.col("deduplicated_frames") > 0, F.col("deduplicated_frames")) \
        .otherwise(F.least(F.col("_hashed"), F.lit(fallback_n)))
    return (g.withColumn("candidate_processed_frames", candidate.cast("bigint"))
             .withColumn("processed_frames", F.least(F.col("candidate_processed_frames"), F.lit(target)).cast("bigint"))
             .withColumn("segmented_frames", F.col("processed_frames"))
             .withColumn("fallback_mode", F.when(F.col("deduplicated_frames") > 0, F.lit("normal"))
                         .otherwise(F.lit("raw_extracted")))
             .drop("_hashed"))
