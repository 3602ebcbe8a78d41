"""Risk, band, state, imputation and scaling-estimate column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keelson.functions.num import brnd, rnd

from keelson import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def risk_weight(class_id) -> Column:
    cid = _c(class_id)
    expr = F.when(cid == 2, F.lit(K.RISK_WEIGHTS[2]))
    for k in (6, 9):
        expr = expr.when(cid == k, F.lit(K.RISK_WEIGHTS[k]))
    return expr.otherwise(F.lit(K.DEFAULT_RISK_WEIGHT))


def risk_score(ratios) -> Column:
    """Risk of a frame from its class -> ratio map (keys in ascending
    order): sum of ratio * weight over visible classes with ratio > 0, plus a
    coverage bonus, corrosion bonus and class-8 bonus; capped, 3 decimals."""
    from keelson.functions.frames import let
    r = _c(ratios)
    corrosion = F.least(F.lit(K.CORROSION_BONUS_CAP), F.coalesce(F.element_at(r, F.lit(9)), F.lit(0.0)) * K.CORROSION_BONUS_FACTOR)
    defect8 = F.least(F.lit(K.DEFECT8_BONUS_CAP), F.coalesce(F.element_at(r, F.lit(8)), F.lit(0.0)) * K.DEFECT8_BONUS_FACTOR)

    def score(visible):
        weighted = F.aggregate(visible, F.lit(0.0), lambda acc, e: acc + e["value"] * risk_weight(e["key"]))
        coverage = F.least(F.lit(K.COVERAGE_BONUS_CAP), F.size(visible) * K.COVERAGE_BONUS_STEP)
        total = F.coalesce(weighted, F.lit(0.0)) + coverage + corrosion + defect8
        return rnd(F.least(F.lit(K.RISK_CAP), total), 3)

    # visible classes with a positive ratio, bound once (entries in key order)
    return let(F.filter(F.map_entries(r), lambda e: (~e["key"].isin(*K.VISIBLE_EXCLUDED_IDS)) & (e["value"] > 0)), score)


def _three_way(score, cuts, labels, high_inclusive=True) -> Column:
    s = _c(score)
    lo, hi = cuts
    return F.when(s >= hi, F.lit(labels[2])).when(s >= lo, F.lit(labels[1])).otherwise(F.lit(labels[0]))


def risk_band(score, preset: str = "pipeline") -> Column:
    """Pipeline cuts (>= .7 high, >= .45 medium) or dashboard cuts
    (< .35 low, < .7 medium, else high)."""
    cuts = K.PIPELINE_BAND_CUTS if preset == "pipeline" else K.DASHBOARD_BAND_CUTS
    return _three_way(score, cuts, K.BAND_LABELS)


def urgency(score) -> Column:
    """C20."""
    return _three_way(score, K.PIPELINE_BAND_CUTS, K.URGENCY_LABELS)


def state_label(score) -> Column:
    """C20."""
    return _three_way(score, K.PIPELINE_BAND_CUTS, K.STATE_LABELS)


def _code(label, table: dict, default: int) -> Column:
    kv = []
    for k, v in table.items():
        kv += [F.lit(k), F.lit(v)]
    return F.coalesce(F.element_at(F.create_map(*kv), F.trim(F.coalesce(_c(label), F.lit("")))), F.lit(default))


def issue_code(label) -> Column:
    """Issue label -> code, unknown 0."""
    return _code(label, K.ISSUE_CODES, K.ISSUE_DEFAULT_CODE)


def state_code(label) -> Column:
    """State label -> code, unknown 1."""
    return _code(label, K.STATE_CODES, K.STATE_DEFAULT_CODE)


def _impute(value, source, factor, floor) -> Column:
    v, s = _c(value), _c(source)
    guess = F.greatest(brnd(s * factor, 0).cast("bigint"), F.least(s, F.lit(floor)).cast("bigint"))
    return F.when((v <= 0) & (s > 0), guess).otherwise(v).cast("bigint")


def effective_video_counts(extracted, quality_ok, deduplicated, processed, segmented,
                           inference_s, pipeline_s, avg_ms=None) -> Column:
    """Impute missing funnel counts step by step and the inference
    time; returns a struct that also says whether anything was imputed."""
    q = _impute(F.coalesce(_c(quality_ok), F.lit(0)), F.coalesce(_c(extracted), F.lit(0)), *K.VIDEO_IMPUTE[0])
    d = _impute(F.coalesce(_c(deduplicated), F.lit(0)), q, *K.VIDEO_IMPUTE[1])
    p = _impute(F.coalesce(_c(processed), F.lit(0)), d, *K.VIDEO_IMPUTE[2])
    s = _impute(F.coalesce(_c(segmented), F.lit(0)), p, *K.VIDEO_IMPUTE[3])
    inf0 = F.coalesce(_c(inference_s), F.lit(0.0))
    pipe = F.coalesce(_c(pipeline_s), F.lit(0.0))
    inf = F.when((inf0 <= 0) & (pipe != 0), rnd(pipe * K.VIDEO_INFERENCE_SHARE, 4)).otherwise(inf0)
    ms0 = F.coalesce(_c(avg_ms), F.lit(0.0)) if avg_ms is not None else F.lit(0.0)
    ms = F.when((ms0 <= 0) & (s > 0), rnd(inf / s * 1000.0, 3)).otherwise(ms0)
    imputed = ((q != F.coalesce(_c(quality_ok), F.lit(0))) | (d != F.coalesce(_c(deduplicated), F.lit(0)))
               | (p != F.coalesce(_c(processed), F.lit(0))) | (s != F.coalesce(_c(segmented), F.lit(0)))
               | (inf != inf0))
    return F.struct(q.alias("quality_ok_frames"), d.alias("deduplicated_frames"), p.alias("processed_frames"),
                    s.alias("segmented_frames"), rnd(inf, 4).alias("inference_wall_seconds"),
                    ms.alias("avg_inference_ms"), imputed.alias("imputed"))


def effective_photo_counts(total_images, inference_s, pipeline_s, avg_ms=None) -> Column:
    """Photo form: inference = .34 * pipeline when missing, ms per image."""
    n = F.coalesce(_c(total_images), F.lit(0)).cast("bigint")
    inf0 = F.coalesce(_c(inference_s), F.lit(0.0))
    pipe = F.coalesce(_c(pipeline_s), F.lit(0.0))
    inf = F.when((inf0 <= 0) & (pipe != 0), rnd(pipe * K.PHOTO_INFERENCE_SHARE, 4)).otherwise(inf0)
    ms0 = F.coalesce(_c(avg_ms), F.lit(0.0)) if avg_ms is not None else F.lit(0.0)
    ms = F.when((ms0 <= 0) & (n > 0), rnd(inf / n * 1000.0, 3)).otherwise(ms0)
    return F.struct(n.alias("total_images"), rnd(inf, 4).alias("inference_wall_seconds"),
                    ms.alias("avg_inference_ms"), (inf != inf0).alias("imputed"))


def benchmark_curve(items, total_s, inference_s, kind: str | Column = "video") -> Column:
    """Array of (scale, items, pipeline_seconds, inference_seconds) for
    scale 1..4; empty when items <= 0. Overhead max(.25, .14 t) for video,
    max(.12, .12 t) for photo."""
    t = F.coalesce(_c(total_s), F.lit(0.0))
    if isinstance(kind, str):
        floor, frac = K.VIDEO_OVERHEAD if kind == "video" else K.PHOTO_OVERHEAD
        overhead = F.greatest(F.lit(floor), t * frac)
    else:
        overhead = F.when(kind == "photo", F.greatest(F.lit(K.PHOTO_OVERHEAD[0]), t * K.PHOTO_OVERHEAD[1])) \
            .otherwise(F.greatest(F.lit(K.VIDEO_OVERHEAD[0]), t * K.VIDEO_OVERHEAD[1]))
    variable = F.greatest(F.lit(0.0), t - overhead)
    inf = F.greatest(F.lit(0.0), F.coalesce(_c(inference_s), F.lit(0.0)))
    points = F.transform(F.array(*[F.lit(s) for s in K.CURVE_SCALES]), lambda s: F.struct(
        s.alias("scale"), (_c(items) * s).cast("bigint").alias("items"),
        rnd(overhead + variable * s, 3).alias("pipeline_seconds"),
        rnd(inf * s, 3).alias("inference_seconds")))
    return F.when(_c(items) > 0, points).otherwise(F.array().cast(
        "array<struct<scale:int,items:bigint,pipeline_seconds:double,inference_seconds:double>>"))


def parallel_estimate(total_s) -> Column:
    """One and two videos; two run 1.72x one in parallel, 2x in sequence."""
    t = _c(total_s)
    rows = F.array(
        F.struct(F.lit(K.PARALLEL_LABELS[0]).alias("label"), F.lit(1).alias("videos"),
                 rnd(t, 3).alias("sequential_seconds"), rnd(t, 3).alias("parallel_seconds")),
        F.struct(F.lit(K.PARALLEL_LABELS[1]).alias("label"), F.lit(2).alias("videos"),
                 rnd(t * 2, 3).alias("sequential_seconds"), rnd(t * K.PARALLEL_FACTOR, 3).alias("parallel_seconds")))
    return F.when(t > 0, rows).otherwise(F.array().cast(
        "array<struct<label:string,videos:int,sequential_seconds:double,parallel_seconds:double>>"))


def fallback_weight(class_name) -> Column:
    """F13 weights by class name."""
    n = _c(class_name)
    expr = None
    for name, w in K.FALLBACK_RISK_WEIGHTS.items():
        expr = F.when(n == name, F.lit(w)) if expr is None else expr.when(n == name, F.lit(w))
    return expr.otherwise(F.lit(K.FALLBACK_RISK_DEFAULT))
