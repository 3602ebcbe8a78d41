"""The five mart tables and the report rows from manifests (B7, L1-L5, F19,
I7), as the readers return them (A6, A7, J1): one row per asset with its run
counts, class summaries, dynamics and frames inside. A manifest's lists are
bounded by the job that writes it, so every table is a projection of the
manifest row (and an explode): no join, no shuffle.

Where a manifest lacks class summaries, dynamics or a benchmark curve, the
table has no rows for it (no placeholder values are made up).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson import constants as K
from keelson.functions import classes as CL
from keelson.functions import risk as RK
from keelson.functions import text as TX
from keelson.functions.num import rnd
from keelson.operators.classes import frame_signs
from keelson.operators.marts import MART_CLASSES, primary_of, shares_risk
from keelson.operators.marts import stage_times as stage_rows

KEYS = ["kind", "asset_id", "updated_at_epoch"]


def _some(*cols: Column) -> Column:
    """The first that is neither null nor zero, else 0.0."""
    return F.coalesce(*[F.nullif(c, F.lit(0).cast("double")) for c in (x.cast("double") for x in cols)], F.lit(0.0))


def _count(name: str) -> Column:
    return F.coalesce(F.col(f"run_counts.{name}"), F.lit(0)).cast("bigint")


def _blank(c) -> Column:
    return F.nullif((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def _class_rows(summaries: Column) -> Column:
    """Class summaries as mart rows: canonical name, allowed classes only,
    share in percent; none when no class has frames or pixels."""
    rows = F.transform(F.coalesce(summaries, F.array()), lambda c: F.struct(
        c["class_id"].alias("class_id"), CL.canonical_class(c["class_name"]).alias("class_name"),
        CL.translate(CL.canonical_class(c["class_name"])).alias("class_name_ru"),
        F.coalesce(c["frames_present"], F.lit(0)).cast("bigint").alias("frames_present"),
        F.coalesce(c["pixel_count"], F.lit(0)).cast("bigint").alias("pixel_count"),
        TX.share_pct(c["pixel_share"]).alias("pixel_share_pct")))
    rows = F.filter(rows, lambda c: c["class_name"].isin(*MART_CLASSES))
    seen = F.exists(rows, lambda c: (c["frames_present"] > 0) | (c["pixel_count"] > 0))
    return F.when(seen, rows).otherwise(F.slice(rows, 1, 0))


def prepare(manifests: DataFrame) -> DataFrame:
    """C29, C30 and the class rows of every manifest."""
    asset = F.coalesce(_blank("video_id"), _blank("source_batch"), _blank("generated_at_utc"),
                       F.when(F.col("kind") == "photo", F.lit("photos")).otherwise(F.lit("unknown")))
    t = TX.epoch_iso("_updated_at")
    return (manifests.withColumn("asset_id", asset).withColumn("updated_at_epoch", t["epoch"]).withColumn("updated_at_iso", t["iso"])
            .withColumn("_rows", _class_rows(F.col("class_summaries"))))


def _seconds() -> dict[str, Column]:
    c = "run_counts."
    return {"extraction_wall_seconds": _some(F.col(c + "extraction_wall_seconds")),
            "preprocessing_wall_seconds": _some(F.col(c + "preprocessing_wall_seconds"), F.col(c + "decode_prepare_wall_seconds")),
            "inference_wall_seconds": _some(F.col(c + "inference_wall_seconds")),
            "export_stage_wall_seconds": _some(F.col(c + "export_stage_wall_seconds"), F.col(c + "postprocess_write_wall_seconds")),
            "pipeline_wall_seconds": _some(F.col(c + "pipeline_wall_seconds"))}


def runs(manifests: DataFrame) -> DataFrame:
    """L1: one row per manifest, with C31/C32 on its own counts and the stored
    risk (F13 where it is missing or not positive)."""
    m, s, video = prepare(manifests), _seconds(), F.col("kind") == "video"
    images = F.coalesce(F.nullif(F.col("total_images"), F.lit(0)), F.size(F.coalesce("images", F.array())).cast("bigint"))
    v = RK.effective_video_counts(_count("extracted_frames"), _count("quality_ok_frames"), _count("deduplicated_frames"),
                                  _count("processed_frames"), _count("segmented_frames"), s["inference_wall_seconds"],
                                  s["pipeline_wall_seconds"], F.col("run_counts.avg_inference_ms_per_frame"))
    p = RK.effective_photo_counts(images, s["inference_wall_seconds"], s["pipeline_wall_seconds"],
                                  F.col("run_counts.avg_inference_ms_per_image"))
    stored = F.coalesce(F.col("risk_summary.score"), F.lit(0.0))
    m = (m.withColumn("_v", v).withColumn("_p", p).withColumn("primary_issue", primary_of(F.col("_rows")))
         .withColumn("risk_score", F.when(stored > 0, stored).otherwise(shares_risk(F.col("_rows")))))

    def funnel(name: str) -> Column:
        return F.when(video, F.col(f"_v.{name}")).otherwise(_count(name))
    shown = F.when(video, F.coalesce(F.nullif(F.col("_v.segmented_frames"), F.lit(0)), F.lit(0))) \
        .otherwise(F.coalesce(F.nullif(_count("segmented_frames"), F.lit(0)), F.col("_p.total_images")))
    return m.withColumn("state_label", RK.state_label("risk_score")).select(
        "kind", "asset_id", "updated_at_iso", "updated_at_epoch",
        F.when(video, F.coalesce(_blank("source_video"), F.col("asset_id"))).otherwise(
            F.coalesce(_blank("source_batch"), F.lit(K.PHOTO_BATCH_NAME))).alias("source_name"),
        _count("extracted_frames").alias("extracted_frames"), funnel("quality_ok_frames").alias("quality_ok_frames"),
        funnel("deduplicated_frames").alias("deduplicated_frames"), funnel("processed_frames").alias("processed_frames"),
        shown.cast("bigint").alias("segmented_frames"),
        F.when(video, F.lit(0)).otherwise(F.col("_p.total_images")).cast("bigint").alias("total_images"),
        s["extraction_wall_seconds"].alias("extraction_wall_seconds"), s["preprocessing_wall_seconds"].alias("preprocessing_wall_seconds"),
        F.when(video, F.col("_v.inference_wall_seconds")).otherwise(F.col("_p.inference_wall_seconds")).alias("inference_wall_seconds"),
        s["export_stage_wall_seconds"].alias("export_stage_wall_seconds"), s["pipeline_wall_seconds"].alias("pipeline_wall_seconds"),
        F.when(video, F.col("_v.avg_inference_ms")).otherwise(
            _some(F.col("run_counts.avg_inference_ms_per_frame"), F.col("_p.avg_inference_ms"))).alias("avg_inference_ms"),
        "risk_score", RK.risk_band("risk_score", "dashboard").alias("risk_band"),
        "primary_issue", RK.issue_code("primary_issue").alias("primary_issue_code"),
        "state_label", RK.state_code("state_label").alias("state_code"))


def class_metrics(manifests: DataFrame) -> DataFrame:
    """L2."""
    return prepare(manifests).select(*KEYS, F.explode("_rows").alias("c")).select(
        *KEYS, "c.class_name", "c.class_name_ru", "c.frames_present", "c.pixel_count", "c.pixel_share_pct")


def dynamics(manifests: DataFrame) -> DataFrame:
    """The label is the frame index (the point's index without one)."""
    d = prepare(manifests).select(*KEYS, F.explode("dynamics_series").alias("d"))
    idx = F.coalesce("d.frame_idx", "d.index", F.lit(0)).cast("bigint")
    return d.select(*KEYS, idx.alias("frame_idx"), idx.cast("string").alias("frame_label"),
                    F.coalesce("d.risk_score", F.lit(0.0)).alias("risk_score"),
                    F.coalesce(CL.translate("d.dominant_class_name"), F.lit("")).alias("dominant_class_name_ru"))


def stage_times(manifests: DataFrame) -> DataFrame:
    """L4 / K1 on the manifest's own times (nothing imputed)."""
    return stage_rows(prepare(manifests).select(*KEYS, *[c.alias(n) for n, c in _seconds().items()]), KEYS)


def benchmark_curve(manifests: DataFrame) -> DataFrame:
    """The stored curve."""
    c = prepare(manifests).select(*KEYS, F.explode("benchmark_curve").alias("c"))
    return c.select(*KEYS, F.coalesce("c.scale", F.lit(1)).alias("scale"), F.coalesce("c.items", F.lit(0)).cast("bigint").alias("items"),
                    F.coalesce("c.pipeline_seconds", F.lit(0.0)).alias("pipeline_seconds"),
                    F.coalesce("c.inference_seconds", F.lit(0.0)).alias("inference_seconds"))


def build_marts(manifests: DataFrame) -> dict[str, DataFrame]:
    """The five tables by name, ready for ``sinks.write_marts``."""
    return {f.__name__: f(manifests) for f in (runs, class_metrics, dynamics, stage_times, benchmark_curve)}


def reviewed_items(manifests: DataFrame) -> DataFrame:
    """the first counter that isn't zero, of six in the run counts, then
    the manifest's own number of images."""
    counters = [_count(n) for n in ("segmented_frames", "processed_frames", "deduplicated_frames", "quality_ok_frames", "extracted_frames")]
    counters += [F.col("run_counts.total_images")] if "total_images" in manifests.schema["run_counts"].dataType.names else []
    counters.append(F.col("total_images"))
    first = reduce(lambda rest, c: F.coalesce(F.nullif(c, F.lit(0)), rest), reversed(counters), F.lit(0))
    return prepare(manifests).select(*KEYS, first.cast("bigint").alias("reviewed_items"))


def review_rows(manifests: DataFrame, n: int = 8) -> DataFrame:
    """The first ``n`` of a video's top frames (else of its frames) or of
    the photo batch's images: name, sign, time (video) or risk (photo) text,
    and the image's name."""
    video = F.col("kind") == "video"
    none = F.array()
    top = F.coalesce("top_frames", none)
    source = F.when(~video, F.coalesce("images", none)).when(F.size(top) > 0, top).otherwise(F.coalesce("frames", none))
    rows = prepare(manifests).select(*KEYS, F.posexplode(F.slice(source, 1, n)).alias("row_no", "f")).select(
        *KEYS, "row_no", "f.frame_idx", "f.timestamp_sec", "f.filename", "f.risk_score", "f.processed_image",
        F.coalesce(_blank("f.primary_sign_name"), F.col("f.dominant_class_name")).alias("primary_sign_name"),
        F.transform_keys(F.coalesce("f.class_pixel_ratios", F.create_map().cast("map<string,double>")),
                         lambda k, v: k.cast("int")).alias("class_pixel_ratios"))
    rows = frame_signs(rows)
    main = CL.translate(F.coalesce("primary_sign_name", F.lit("")))

    def fixed(c: str, digits: int) -> Column:
        return F.coalesce(F.format_string(f"%.{digits}f", rnd(c, digits)), F.lit("-"))
    number = F.when(F.col("timestamp_sec").isNotNull(), fixed("timestamp_sec", 1)).otherwise(F.lit("-"))
    risk = F.when(F.col("risk_score").isNotNull(), fixed("risk_score", 3)).otherwise(F.lit("-"))
    return rows.select(
        *KEYS, (F.col("row_no") + 1).alias("row_no"),
        F.when(video, F.concat(F.lit(K.FRAME_LABEL_PREFIX + " "), F.coalesce("frame_idx", F.lit(0)).cast("string")))
        .otherwise(F.coalesce("filename", F.lit("-"))).alias("item"),
        F.when(video, F.col("truth_label")).otherwise(F.when(main != "", main).otherwise(F.lit(K.NO_SIGN_LABEL))).alias("sign"),
        F.when(video, number).otherwise(risk).alias("value"),
        F.coalesce(F.nullif(TX.filename(F.coalesce("processed_image", F.lit(""))), F.lit("")), F.lit("-")).alias("image"))
