"""Representative and story frame selection.

The reference walks a Python list per video. Here every step is a Spark
aggregation or a bounded fold:

* G2 coverage buckets come from a distributed per-video ordinal.
* H1/H2 (per bucket, walk candidates best-first, keep one when it is far
  enough from the ones kept so far, stop at ``k``) are done as at most ``k``
  rounds of "best candidate compatible with the current picks": a candidate
  skipped once stays incompatible because picks only grow, so the walk's
  next pick is always the best compatible candidate. Each round is a join
  with the (small) picks table plus a max-by aggregation with map-side
  partials, so a huge bucket never lands in one task.
* H4 folds at most ``buckets * k`` picks per video (bounded by parameters,
  not data) with SQL ``aggregate``.
* H5 is a top-(target - n) per video with ``row_number`` (partial group limit
  before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson import constants as K
from keelson.functions import frames as FR
from keelson.operators.ordering import index_chunk, ordinal
from keelson.session import cut_lineage

PICK_TYPE = "array<struct<s:double,f:bigint,h:bigint>>"


def coverage_bucket(rn, total, buckets: int) -> Column:
    """Bucket of the rn-th (1-based) of ``total`` ordered rows when they
    are cut into B = max(1, min(buckets, total)) slices
    [int(b*T/B), int((b+1)*T/B)). Equal to ``floor((rn*B - 1) / T)``; not ntile."""
    t = F.col(total) if isinstance(total, str) else total
    b = F.greatest(F.lit(1), F.least(F.lit(buckets), t))
    r = F.col(rn) if isinstance(rn, str) else rn
    return F.floor((r * b - 1) / t).cast("int")


def add_buckets(df: DataFrame, buckets: int, key: str = "video_id", order: str = "frame_idx",
                total_col: str = "_T") -> DataFrame:
    """G2 on a table: adds ``_rn`` (1-based), ``_T`` and ``bucket``."""
    d = ordinal(df, key, [order], name="_rn", chunk=index_chunk(order), total=total_col)
    return d.withColumn("bucket", coverage_bucket("_rn", total_col, buckets))


def bucket_rank(df: DataFrame, key: str = "video_id") -> DataFrame:
    """Rank inside (video, bucket) by (quality score, frame_idx) desc.
    Reporting helper; the selection itself never needs the full rank. A
    bucket of a hot video can be large, so the rank is a chunked ordinal:
    chunks are whole score units, -floor(score) grows along the order."""
    d = (df.withColumn("_vb", F.concat_ws("|", F.col(key).cast("string"), F.col("bucket").cast("string")))
           .withColumn("_ns", -F.col("score")).withColumn("_nf", -F.col("frame_idx")))
    d = ordinal(d, "_vb", ["_ns", "_nf"], name="bucket_rank", chunk=(-F.floor(F.col("score"))).cast("bigint"))
    return d.drop("_vb", "_ns", "_nf")


def _compatible(acc: Column, f: Column, h: Column, gap: int, dist: int | None) -> Column:
    """A candidate against every frame chosen so far (index gap, hash
    distance). The chosen set holds at most k frames, so this is a bounded
    check, never an all-pairs self join within a bucket."""
    def ok(e):
        cond = F.abs(e["f"] - f) >= gap
        if dist is not None:
            cond = cond & (FR.visual_distance(e["h"], h) >= dist)
        return cond
    return F.forall(acc, ok)


def _pick_round(cand: DataFrame, picks: DataFrame, keys: list[str], k: int, gap: int,
                dist: int | None) -> DataFrame:
    """One walk step for every bucket: append the best compatible candidate."""
    j = cand.join(picks.hint("shuffle_merge"), keys, "left")
    acc = F.coalesce(F.col("acc"), F.array().cast(PICK_TYPE))
    good = (F.size(acc) < k) & _compatible(acc, F.col("frame_idx"), F.col("hash"), gap, dist)
    best = F.max(F.when(good, F.struct(F.col("score").alias("s"), F.col("frame_idx").alias("f"),
                                       F.col("hash").alias("h"))))
    g = j.groupBy(*keys).agg(F.first(acc).alias("acc"), best.alias("_x"))
    return g.select(*keys, F.when(F.col("_x").isNotNull(), F.concat("acc", F.array("_x")))
                    .otherwise(F.col("acc")).alias("acc"))


def pick_diverse(cand: DataFrame, k: int = K.FRAMES_PER_BUCKET, gap: int = K.MIN_INDEX_GAP,
                 dist: int = K.BUCKET_MIN_DISTANCE, keys: tuple[str, ...] = ("video_id", "bucket")) -> DataFrame:
    """H1 + H2 + H3: per (video, bucket) up to ``k`` picks, first with the
    gap and hash-distance rules, then (if short) with the gap rule only.
    ``cand`` needs ``score``, ``frame_idx``, ``hash``. Returns (keys, acc).
    Candidates and the picks of each round are materialised: rounds in one plan
    share their partitioning, so one task would hold the sorts of all of them."""
    keys = list(keys)
    cand = cut_lineage(cand.select(*keys, "score", "frame_idx", "hash"))
    picks = cand.select(*keys).distinct().withColumn("acc", F.array().cast(PICK_TYPE))
    for rule_dist in [dist] * k + [None] * k:
        picks = cut_lineage(_pick_round(cand, picks, keys, k, gap, rule_dist))
    return picks


def round_robin(picks: DataFrame, target: int = K.TARGET_FRAMES, dist: int = K.GLOBAL_MIN_DISTANCE,
                key: str = "video_id") -> DataFrame:
    """H4: across buckets by (depth, bucket); a pick closer than ``dist`` to
    any selected frame is skipped once ``selected >= B``; stop at target.
    ``picks``: (key, bucket, acc, _B). At most B * k rows per video."""
    e = picks.select(key, "bucket", "_B", F.posexplode("acc").alias("depth", "x"))
    per = e.groupBy(key).agg(F.first("_B").alias("_B"), F.array_sort(F.collect_list(
        F.struct("depth", "bucket", F.col("x.s").alias("s"), F.col("x.f").alias("f"), F.col("x.h").alias("h")))).alias("arr"))
    sel_type = "array<struct<s:double,f:bigint,h:bigint>>"

    def step(acc, x):
        take = (F.size(acc) < target) & ((F.size(acc) < F.col("_B")) | F.forall(
            acc, lambda s: FR.visual_distance(s["h"], x["h"]) >= dist))
        return F.when(take, F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["f"].alias("f"), x["h"].alias("h"))))) \
            .otherwise(acc)

    folded = per.select(key, F.aggregate("arr", F.array().cast(sel_type), step).alias("sel"))
    return folded.select(key, F.explode("sel").alias("x")).select(
        key, F.col("x.f").alias("frame_idx"), F.lit("round_robin").alias("picked_by"))


def _fold_prefix(ranked: DataFrame, keys: list[str], k: int, gap: int, dist: int) -> DataFrame:
    """H1 then H2 as SQL folds over a bucket's best-first prefix (an array
    of at most N candidates). Returns (keys, acc, h1_n)."""
    empty = F.array().cast(PICK_TYPE)

    def walk(rule_dist):
        def step(acc, x):
            ok = (F.size(acc) < k) & _compatible(acc, x["f"], x["h"], gap, rule_dist)
            return F.when(ok, F.concat(acc, F.array(x))).otherwise(acc)
        return step

    h1 = F.aggregate("prefix", empty, walk(dist))
    g = ranked.withColumn("_h1", h1)
    return g.select(*keys, "_total", F.size("_h1").alias("h1_n"),
                    F.aggregate("prefix", F.col("_h1"), walk(None)).alias("acc"))


def select_representative(cand: DataFrame, target: int = K.TARGET_FRAMES, buckets: int = K.COVERAGE_BUCKETS,
                          per_bucket: int = K.FRAMES_PER_BUCKET, key: str = "video_id",
                          prefix: int | None = None) -> DataFrame:
    """H6 (whole H): the representative subset per video. ``cand`` needs
    (key, frame_idx unique per key, score, hash). Videos with at most
    ``target`` candidates keep all; others get bucket picks (H1-H3), the
    round-robin (H4) and a fill by (score desc, frame_idx asc) (H5).
    Returns (key, frame_idx, picked_by).

    Bucket picks: the gap-only walk (H2) never looks past the first
    ``11 * k + 1`` candidates of a bucket (each pick blocks at most 11
    frame positions), so both walks are folded over a best-first prefix of
    ``prefix`` >= 12k candidates per bucket, taken with a top-N per group
    (partial limits before the shuffle). Only buckets whose H1 walk ran out
    inside the prefix while more candidates exist are finished exactly by
    the round-based walk (:func:`pick_diverse`) over their full candidates."""
    target = max(target, 1)
    k = max(per_bucket, 1)
    n_prefix = max(prefix or 64, 12 * k)
    keys = [key, "bucket"]
    base = cand.select(key, "frame_idx", "score", "hash")
    base = ordinal(base, key, ["frame_idx"], name="_rn", chunk=index_chunk("frame_idx"), total="_T")
    base = base.withColumn("bucket", coverage_bucket("_rn", "_T", buckets)) \
        .withColumn("_B", F.greatest(F.lit(1), F.least(F.lit(buckets), F.col("_T"))))
    # several branches read the bucketed candidates (prefix, sizes, the
    # unresolved check, the fill): materialise them once in the shared
    # checkpoint folder instead of recomputing the frame pipeline per branch
    base = cut_lineage(base.select(key, "frame_idx", "score", "hash", "bucket", "_B", "_T"))
    small = base.where(F.col("_T") <= target).select(key, "frame_idx", F.lit("all").alias("picked_by"))
    big = base.where(F.col("_T") > target)

    # best-first prefix per bucket: row_number <= N is planned as a group limit
    rank = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("frame_idx").desc())
    top = big.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= n_prefix)
    sizes = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"), F.first("_B").alias("_B"))
    ranked = (top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        F.col("_r"), F.struct(F.col("score").alias("s"), F.col("frame_idx").alias("f"), F.col("hash").alias("h")).alias("c"))))
        .alias("_p")).select(*keys, F.transform("_p", lambda e: e["c"]).alias("prefix"))
        .join(sizes.hint("shuffle_merge"), keys))
    # read by the picks and by the buckets left open: folded once
    folded = cut_lineage(_fold_prefix(ranked, keys, k, K.MIN_INDEX_GAP, K.BUCKET_MIN_DISTANCE))
    open_ = (F.col("h1_n") < k) & (F.col("_total") > n_prefix)
    picks = folded.where(~open_).select(*keys, "acc")
    unresolved = folded.where(open_).select(*keys)
    # H1 may need candidates beyond the prefix: such buckets are walked by
    # rounds over all their candidates
    if not unresolved.isEmpty():
        rest_cand = big.join(unresolved.hint("shuffle_merge"), keys, "left_semi")
        picks = picks.unionByName(pick_diverse(rest_cand, k, K.MIN_INDEX_GAP, K.BUCKET_MIN_DISTANCE, tuple(keys)))
    # merge joins: the tables cut above are small files of many rows, which Spark would broadcast
    picks = picks.hint("shuffle_merge").join(sizes.select(*keys, "_B").hint("shuffle_merge"), keys)
    chosen = round_robin(picks, target, K.GLOBAL_MIN_DISTANCE, key)
    n = chosen.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    rest = big.join(chosen.hint("shuffle_merge"), [key, "frame_idx"], "left_anti")
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("frame_idx").asc())
    fill = (rest.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= target)
                .join(n.hint("shuffle_merge"), key, "left").where(F.col("_r") <= F.lit(target) - F.coalesce(F.col("_n"), F.lit(0)))
                .select(key, "frame_idx", F.lit("fill").alias("picked_by")))
    return small.unionByName(chosen).unionByName(fill)


def story_frames(frames: DataFrame, target: int = 4, buckets: int = 4, key: str = "asset_id") -> DataFrame:
    """Best frame per coverage bucket by (risk, #classes, frame_idx) desc,
    then fill to ``target`` by (risk, #classes) desc, frame_idx asc; at most
    ``target`` per asset. ``frames`` needs frame_idx, risk_score,
    predicted_class_ids. Returns frames rows with ``story_rank``."""
    d = ordinal(frames, key, ["frame_idx"], name="_rn", chunk=index_chunk("frame_idx"), total="_T")
    small = d.where(F.col("_T") <= target).withColumn("story_pick", F.lit("all"))
    big = d.where(F.col("_T") > target).withColumn("bucket", coverage_bucket("_rn", "_T", buckets))
    n_cls = F.size("predicted_class_ids")
    best_key = F.struct(F.col("risk_score"), n_cls, F.col("frame_idx"))
    best = big.groupBy(key, "bucket").agg(F.max(best_key)["frame_idx"].alias("frame_idx"))
    picked = big.join(best.select(key, "frame_idx"), [key, "frame_idx"], "left_semi")
    cols = [c for c in frames.columns]
    picked_rows = picked.select(*cols).withColumn("story_pick", F.lit("bucket"))
    if buckets >= target:
        # every asset above the target gets exactly `target` bucket picks
        # (B = min(buckets, T) = target), so the fill can add nothing
        return small.select(*cols, "story_pick").unionByName(picked_rows)
    npick = best.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    rest = big.join(best.select(key, "frame_idx"), [key, "frame_idx"], "left_anti")
    w = Window.partitionBy(key).orderBy(F.col("risk_score").desc(), n_cls.desc(), F.col("frame_idx").asc())
    fill = (rest.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= target)
                .join(npick, key).where(F.col("_r") <= F.lit(target) - F.col("_n")).drop("_r", "_n"))
    cols = [c for c in frames.columns]
    return (small.select(*cols, "story_pick")
            .unionByName(picked.select(*cols).withColumn("story_pick", F.lit("bucket")))
            .unionByName(fill.select(*cols).withColumn("story_pick", F.lit("fill"))))
