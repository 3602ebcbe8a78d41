"""Manifest documents (B6, C46): one nested row per asset, with only
bounded lists inside (classes, curve points, story frames), so no group is
ever collected whole into one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson import constants as K
from keelson.functions import classes as CL
from keelson.functions import risk as RK
from keelson.functions import text as TX
from keelson.functions.num import rnd
from keelson.operators import selection as S
from keelson.operators.marts import KEYS, Marts


def visible_classes(manifests: DataFrame) -> DataFrame:
    """The class list to show: the newest video manifest that has one,
    else the photo manifest's, else the default four; normalised (C23).
    One aggregation (max of a ranked struct), one row out."""
    has = (F.size(F.coalesce(F.col("visible_classes"), F.array())) > 0).cast("int")
    rank = F.struct(has.alias("has"), (F.col("kind") == "video").cast("int").alias("video"),
                    F.col("_updated_at").alias("t"),
                    F.transform(F.col("visible_classes"), lambda x: F.struct(x["class_id"].alias("class_id"),
                                                                             x["class_name"].alias("class_name"),
                                                                             x["color_hex"].alias("color_hex"))).alias("c"))
    best = manifests.agg(F.max(rank).alias("b"))
    chosen = F.when(F.col("b.has") == 1, F.col("b.c")).otherwise(F.array().cast(
        "array<struct<class_id:int,class_name:string,color_hex:string>>"))
    return best.select(CL.normalize_classes(chosen).alias("visible_classes"))


def _by_frame(a, b):
    return F.when(a["frame_idx"] < b["frame_idx"], -1).when(a["frame_idx"] > b["frame_idx"], 1).otherwise(0)


def _frame_entry() -> Column:
    """A frame of a manifest's lists; map keys are text, as JSON has them."""
    def text_keys(c: str) -> Column:
        return F.transform_keys(c, lambda k, v: k.cast("string")).alias(c)
    return F.struct("frame_idx", F.col("primary_sign_id").alias("dominant_class_id"), F.col("primary_sign_name").alias("dominant_class_name"),
                    "primary_sign_name", "predicted_class_ids", text_keys("class_pixel_counts"), text_keys("class_pixel_ratios"), "risk_score")


def class_list() -> Column:
    """The visible classes with their colours, the same in every manifest."""
    return F.array(*[F.struct(F.lit(c).alias("class_id"), F.lit(name).alias("class_name"), F.array(*[F.lit(x) for x in rgb]).alias("color_rgb"),
                              TX.rgb_hex(*[F.lit(x) for x in rgb]).alias("color_hex"))
                     for c, name, rgb in K.CLASS_INFO if c not in K.VISIBLE_EXCLUDED_IDS])


def build_manifests(marts: Marts, story_frames: int = K.STORY_FRAMES, roots: dict[str, str] | None = None) -> DataFrame:
    """One manifest row per (kind, asset): run counts, risk summary, class
    list and summaries, benchmark curve, parallel estimate, all frames with
    the dynamics series, the story frames and the folders (``roots``). The
    frames of an asset are the ones analysed, which the selection (H) bounds.
    ``manifest_marts.build_marts`` makes every mart table from these rows, also
    after a way through files."""
    marts = marts.shared()
    runs = marts.runs
    cm = marts.class_metrics.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("pixel_count")).alias("_o"), "class_id", "class_name", "pixel_count", "frames_present",
        (F.col("pixel_share_pct") / 100.0).alias("pixel_share")))).alias("_cs"))
    frames = marts.frames.withColumn("asset_key", F.concat_ws("|", "kind", F.col("asset_id").cast("string")))
    seen = frames.groupBy(*KEYS).agg(F.array_sort(F.collect_list(_frame_entry()), _by_frame).alias("_frames"),
                                     F.max("risk_score").alias("_max_risk"))
    story = S.story_frames(frames, story_frames, story_frames, key="asset_key")
    top = story.groupBy(*KEYS).agg(F.array_sort(F.collect_list(_frame_entry()), _by_frame).alias("top_frames"))
    m = runs.join(cm, KEYS, "left").join(seen, KEYS, "left").join(top, KEYS, "left")
    video = F.col("kind") == "video"
    shown = F.when(video, F.col("segmented_frames")).otherwise(F.col("total_images"))
    series = F.transform("_frames", lambda f: F.struct(f["frame_idx"].alias("frame_idx"), f["risk_score"].alias("risk_score"),
                                                       f["primary_sign_name"].alias("dominant_class_name")))
    folders = F.create_map(*[F.lit(x) for kv in (roots or {}).items() for x in kv]).cast("map<string,string>")
    return m.select(
        F.col("asset_id").cast("string").alias("video_id"), "kind", F.col("source_name").alias("source_video"),
        F.when(~video, F.col("source_name")).alias("source_batch"), F.col("updated_at_iso").alias("generated_at_utc"), "total_images",
        class_list().alias("visible_classes"),
        F.struct("extracted_frames", "quality_ok_frames", "deduplicated_frames", F.col("deduplicated_frames").alias("candidate_processed_frames"),
                 "processed_frames", "segmented_frames", "extraction_wall_seconds", "preprocessing_wall_seconds", "inference_wall_seconds",
                 "export_stage_wall_seconds", "pipeline_wall_seconds", F.when(video, F.col("avg_inference_ms")).alias("avg_inference_ms_per_frame"),
                 F.when(~video, F.col("avg_inference_ms")).alias("avg_inference_ms_per_image")).alias("run_counts"),
        F.struct(F.col("risk_score").alias("score"), rnd("_max_risk", 3).alias("max_score"), F.col("risk_band").alias("band")).alias("risk_summary"),
        RK.benchmark_curve(shown, "pipeline_wall_seconds", "inference_wall_seconds", F.col("kind")).alias("benchmark_curve"),
        RK.parallel_estimate("pipeline_wall_seconds").alias("parallel_estimate"), series.alias("dynamics_series"), folders.alias("hdfs_roots"),
        F.transform("_cs", lambda c: c.dropFields("_o")).alias("class_summaries"),
        F.when(video, F.col("_frames")).alias("frames"), F.when(~video, F.col("_frames")).alias("images"), "top_frames")
