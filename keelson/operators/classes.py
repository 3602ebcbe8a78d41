"""Class statistics per frame and per asset (F3-F7, F12, F13, F16, F17, G5,
E2, E3, D7, I8).

Long form in: ``(asset_id, frame_idx, class_id, pixels)``. Per-asset outputs
are single aggregations with map-side partials, so a hot asset is split
across tasks before the shuffle. The class dimension is a fixed 5-row table
(safe to broadcast); per-class columns are generated from it instead of
joining a cross product of assets x classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions.num import brnd, rnd

from keelson import constants as K
from keelson.functions import classes as CL
from keelson.functions import risk as RK
from keelson.functions import text as TX

VISIBLE = [(cid, name, rgb) for cid, name, rgb in K.CLASS_INFO if cid not in K.VISIBLE_EXCLUDED_IDS]


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _hex(rgb) -> str:
    return "#{:02x}{:02x}{:02x}".format(*rgb)


def mask_histogram(masks: DataFrame, key: str = "frame_id", mask: str = "mask") -> DataFrame:
    """class -> pixel count per mask, counted inside the row (no pixel is
    shuffled). Returns (key, class_pixel_counts map, sorted by class)."""
    return masks.select(key, CL.count_values(mask).alias("class_pixel_counts"))


def argmax_mask(probs: Column, threshold: float | None = None, class_ids: list[int] | None = None) -> Column:
    """Per pixel, the channel with the highest probability (first
    max wins). With ``class_ids`` the pixel gets that channel's class id (a
    channel beyond the list: 0); with ``threshold``, 0 unless the maximum
    reaches it. ``probs``: array<array<double>> (pixels x channels)."""
    def pick(p):
        at = F.array_position(p, F.array_max(p)).cast("int")  # from 1
        if class_ids is None:
            value = at - 1
        elif not class_ids:
            value = F.lit(0)
        else:
            value = F.coalesce(F.get(F.array(*[F.lit(int(c)) for c in class_ids]), at - 1), F.lit(0))
        return value if threshold is None else F.when(F.array_max(p) >= threshold, value).otherwise(F.lit(0))
    return F.transform(probs, pick)


def class_summary(counts: DataFrame, key: str = "asset_id") -> DataFrame:
    """per asset and visible class: pixel_count, frames_present (frames
    with a positive count), pixel_share = round(count / visible total, 6)
    (0 when the total is 0). Classes with no rows are still listed."""
    aggs = [F.sum(F.when(CL.is_visible("class_id"), F.col("pixels")).otherwise(F.lit(0))).alias("_total")]
    for cid, _, _ in VISIBLE:
        aggs.append(F.sum(F.when(F.col("class_id") == cid, F.col("pixels")).otherwise(F.lit(0))).alias(f"_p{cid}"))
        aggs.append(F.count_if((F.col("class_id") == cid) & (F.col("pixels") > 0)).alias(f"_f{cid}"))
    keys = _keys(key)
    g = counts.groupBy(*keys).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(cid).alias("class_id"), F.lit(name).alias("class_name"),
                              F.lit(_hex(rgb)).alias("color_hex"),
                              F.col(f"_p{cid}").cast("bigint").alias("pixel_count"),
                              F.col(f"_f{cid}").cast("bigint").alias("frames_present"))
                     for cid, name, rgb in VISIBLE])
    e = g.select(*keys, "_total", F.explode(rows).alias("c")).select(*keys, "_total", "c.*")
    return e.withColumn("pixel_share", F.when(F.col("_total") > 0, rnd(F.col("pixel_count") / F.col("_total"), 6))
                        .otherwise(F.lit(0.0))).drop("_total")


def class_summary_binary(frames: DataFrame, key: str = "asset_id") -> DataFrame:
    """when any frame of an asset is in binary mode, each sign class gets
    pseudo-pixels max(1, round_half_even(score * 1000)) per frame where it is
    a sign (predicted minus {0,1}, else the primary sign). Assets without a
    binary frame are left out (use :func:`class_summary`)."""
    flagged = frames.groupBy(key).agg(F.max((F.col("prediction_mode") == K.PREDICTION_MODES[2]).cast("int")).alias("_bin"))
    f = frames.join(flagged.where("_bin = 1").select(key), key, "left_semi")
    signs = F.filter("predicted_class_ids", lambda x: ~x.isin(*K.SIGN_EXCLUDED_IDS))
    fallback = F.when(~F.col("primary_sign_id").isin(*K.SIGN_EXCLUDED_IDS), F.array("primary_sign_id")) \
        .otherwise(F.array().cast("array<int>"))
    s = f.select(key, "frame_idx", "classification_scores",
                 F.explode(F.when(F.size(signs) > 0, signs).otherwise(fallback)).alias("class_id"))
    s = s.where(F.col("class_id").isin(*[c for c, _, _ in VISIBLE]))
    s = s.withColumn("pseudo", F.greatest(F.lit(1), brnd(
        F.coalesce(F.element_at("classification_scores", F.col("class_id")), F.lit(0.0)) * 1000.0, 0).cast("bigint")))
    s = s.select(key, "frame_idx", "class_id", F.col("pseudo").alias("pixels"))
    return class_summary(s, key)


def frame_top_classes(frames: DataFrame, k: int = 3) -> DataFrame:
    """Top-k visible classes of a frame by pixels (count > 0), ties by
    class id, each with its ratio. Adds ``top_classes``."""
    ent = F.filter(F.map_entries("class_pixel_counts"), lambda e: CL.is_visible(e["key"]) & (e["value"] > 0))
    ranked = F.array_sort(F.transform(ent, lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("class_id"))))
    top = F.transform(F.slice(ranked, 1, k), lambda e: F.struct(
        e["class_id"].alias("class_id"), CL.class_name(e["class_id"]).alias("class_name"),
        (-e["neg"]).alias("pixel_count"),
        F.coalesce(F.element_at("class_pixel_ratios", e["class_id"]), F.lit(0.0)).alias("pixel_share")))
    return frames.withColumn("top_classes", top)


def asset_risk(frames: DataFrame, key: str = "asset_id", preset: str = "pipeline") -> DataFrame:
    """mean and max frame risk (3 decimals) and the band."""
    g = frames.groupBy(*_keys(key)).agg(rnd(F.avg("risk_score"), 3).alias("risk_score"),
                                rnd(F.max("risk_score"), 3).alias("max_risk_score"))
    return g.withColumn("risk_band", RK.risk_band("risk_score", preset))


def fallback_risk(class_metrics: DataFrame, keys: list[str]) -> DataFrame:
    """sum(share * w) / max(sum(share), 1e-6) by class name weights
    (3 decimals), 0 without shares. ``class_metrics`` has class_name and
    pixel_share_pct."""
    share = F.col("pixel_share_pct") / 100.0
    g = class_metrics.groupBy(*keys).agg(F.sum(share * RK.fallback_weight("class_name")).alias("_w"),
                                         F.sum(share).alias("_s"))
    return g.select(*keys, F.when(F.col("_s") != 0, rnd(F.col("_w") / F.greatest(F.col("_s"), F.lit(1e-6)), 3))
                    .otherwise(F.lit(0.0)).alias("fallback_risk"))


def asset_class_stats(class_metrics: DataFrame, keys: list[str], order: str = "live") -> DataFrame:
    """F13 + F16 in one aggregation per asset: the fallback risk and the
    primary issue (same rules as :func:`fallback_risk`, :func:`primary_issue`)."""
    share = F.col("pixel_share_pct") / 100.0
    rank = (F.struct(F.col("frames_present"), F.col("pixel_share_pct"), F.col("pixel_count"), -F.col("class_id"))
            if order == "live" else
            F.struct(F.col("pixel_share_pct"), F.col("frames_present"), F.col("pixel_count"), -F.col("class_id")))
    g = class_metrics.groupBy(*keys).agg(
        F.sum(share * RK.fallback_weight("class_name")).alias("_w"), F.sum(share).alias("_s"),
        F.max(F.when(_defect_rows(class_metrics), F.struct(rank.alias("r"), F.col("class_name_ru").alias("n"))))["n"].alias("_d"),
        F.max(F.when(F.col("class_name") != "Void", F.struct(rank.alias("r"), F.col("class_name_ru").alias("n"))))["n"].alias("_a"))
    pick = F.col("_d") if order == "live" else F.coalesce(F.col("_d"), F.col("_a"))
    return g.select(*keys, F.when(F.col("_s") != 0, rnd(F.col("_w") / F.greatest(F.col("_s"), F.lit(1e-6)), 3))
                    .otherwise(F.lit(0.0)).alias("fallback_risk"),
                    F.coalesce(pick, F.lit(K.NO_ISSUE_LABEL)).alias("primary_issue"))


def _defect_rows(class_metrics: DataFrame) -> Column:
    return (~F.col("class_name").isin(*K.NON_DEFECT_NAMES)) & ((F.col("frames_present") > 0) | (F.col("pixel_share_pct") > 0))


def primary_issue(class_metrics: DataFrame, keys: list[str], order: str = "live") -> DataFrame:
    """F16: translated name of the main defect per asset: defects by frames
    desc then share desc (``live``) or share then frames (``shadowed``, which
    also falls back to any non-Void class); 'not found' when none. Ties keep
    the summary order (pixels desc, class id asc). Aggregation, not a window."""
    cm = class_metrics
    if order == "live":
        rank = F.struct(F.col("frames_present"), F.col("pixel_share_pct"), F.col("pixel_count"), -F.col("class_id"))
    else:
        rank = F.struct(F.col("pixel_share_pct"), F.col("frames_present"), F.col("pixel_count"), -F.col("class_id"))
    defect = _defect_rows(cm)
    g = cm.groupBy(*keys).agg(
        F.max(F.when(defect, F.struct(rank.alias("r"), F.col("class_name_ru").alias("n"))))["n"].alias("_d"),
        F.max(F.when(F.col("class_name") != "Void", F.struct(rank.alias("r"), F.col("class_name_ru").alias("n"))))["n"].alias("_a"))
    pick = F.col("_d") if order == "live" else F.coalesce(F.col("_d"), F.col("_a"))
    return g.select(*keys, F.coalesce(pick, F.lit(K.NO_ISSUE_LABEL)).alias("primary_issue"))


def issue_type_count(class_metrics: DataFrame, keys: list[str]) -> DataFrame:
    """number of defect classes present."""
    return class_metrics.groupBy(*keys).agg(F.count_if(_defect_rows(class_metrics)).alias("issue_types"))


def with_class(df: DataFrame, dim: DataFrame, how: str = "left") -> DataFrame:
    """E2 (left) / E3 (inner, visible only): attach name, colour, weight from
    the class dimension. The dimension has a fixed 5 rows: broadcast it."""
    if how == "visible":
        return df.join(F.broadcast(dim.where("is_visible")), "class_id", "inner")
    j = df.join(F.broadcast(dim), "class_id", "left")
    return j.withColumn("class_name", F.coalesce(F.col("class_name"), F.lit("Unknown")))


def class_heatmap(counts: DataFrame, n: int = 18, key: str = "asset_id") -> DataFrame:
    """F17 (long form): for the first ``n`` frames of each asset (by
    frame_idx), the share percent of every visible class in the frame
    (denominator = all pixels of the frame, at least 1); 0 when absent.
    Returns (key, frame_pos, frame_idx, class_id, class_name, share_pct)."""
    frames = counts.groupBy(key, "frame_idx").agg(
        F.sum("pixels").alias("_tot"),
        *[F.sum(F.when(F.col("class_id") == cid, F.col("pixels")).otherwise(F.lit(0))).alias(f"_p{cid}")
          for cid, _, _ in VISIBLE])
    w = Window.partitionBy(key).orderBy("frame_idx")
    first = frames.withColumn("frame_pos", F.row_number().over(w)).where(F.col("frame_pos") <= n)
    rows = F.array(*[F.struct(F.lit(cid).alias("class_id"), F.lit(name).alias("class_name"),
                              rnd(F.col(f"_p{cid}") / F.greatest(F.col("_tot"), F.lit(1)) * 100.0, 2).alias("share_pct"))
                     for cid, name, _ in VISIBLE])
    return first.select(key, "frame_pos", "frame_idx", F.explode(rows).alias("c")).select(key, "frame_pos", "frame_idx", "c.*")


def pivot_heatmap(long: DataFrame, n: int = 18, key: str = "asset_id") -> DataFrame:
    """One column per frame position (fixed 1..n, so the pivot needs
    no distinct pass), zeros for missing."""
    p = long.groupBy(key, "class_id", "class_name").pivot("frame_pos", list(range(1, n + 1))).agg(F.first("share_pct"))
    return p.fillna(0.0)


def frame_signs(frames: DataFrame, min_ratio: float = K.EXTRA_SIGN_MIN_RATIO, k: int = 3) -> DataFrame:
    """I8: per frame the primary sign label (highest-ratio visible defect
    class), extra sign labels with ratio >= min_ratio (distinct, best first,
    at most k) and the truth label (extras, else the primary sign name when
    it is a defect, else 'no clear sign')."""
    names = CL.class_name_map()
    ent = F.filter(F.map_entries("class_pixel_ratios"), lambda e: ~F.coalesce(
        F.element_at(names, e["key"]), F.lit("")).isin("Normal", "Ship hull", "Void", ""))
    ranked = F.array_sort(F.transform(ent, lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("id"))))
    primary = F.get(F.transform(ranked, lambda e: CL.translate(F.element_at(names, e["id"]))), 0)
    extras = F.slice(F.array_distinct(F.transform(F.filter(ranked, lambda e: -e["neg"] >= min_ratio),
                                                  lambda e: CL.translate(F.element_at(names, e["id"])))), 1, k)
    main = CL.translate(F.coalesce(F.col("primary_sign_name"), F.lit("")))
    truth = F.when(F.size(extras) > 0, F.array_join(extras, ", ")) \
        .when((main != "") & ~main.isin(K.CLASS_TRANSLATIONS["Normal"], K.CLASS_TRANSLATIONS["Void"]), main) \
        .otherwise(F.lit(K.NO_SIGN_LABEL))
    return (frames.withColumn("primary_sign_label", F.coalesce(primary, CL.translate(F.col("primary_sign_name"))))
                  .withColumn("extra_signs", extras).withColumn("truth_label", truth))


def defect_frames(frames: DataFrame, min_ratio: float = K.DEFECT_MIN_RATIO) -> DataFrame:
    """Frames that show a defect."""
    return frames.where(CL.has_defect("class_pixel_ratios", "primary_sign_name", min_ratio))


def time_labels(frames: DataFrame) -> DataFrame:
    return frames.withColumn("time_label", TX.time_label("timestamp_sec"))


def filter_or_all(df: DataFrame, pred: Column, keys: list[str]) -> DataFrame:
    """The rows matching ``pred``, or all of a group's rows when none
    match. The per-group flag is an aggregation joined back (no window over
    a possibly huge group)."""
    flagged = df.withColumn("_p", F.coalesce(pred, F.lit(False)))
    anyp = flagged.groupBy(*keys).agg(F.max(F.col("_p").cast("int")).alias("_any"))
    return flagged.join(anyp, keys).where(F.col("_p") | (F.col("_any") == 0)).drop("_p", "_any")


def first_distinct(df: DataFrame, keys: list[str], label: str, order: str, n: int = 3) -> DataFrame:
    """per group the first ``n`` distinct labels in ``order``: each
    label's first position (aggregation), then a top-n by that position."""
    first = df.groupBy(*keys, label).agg(F.min(order).alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_first", label)
    return first.withColumn("label_rank", F.row_number().over(w)).where(F.col("label_rank") <= n).drop("_first")
