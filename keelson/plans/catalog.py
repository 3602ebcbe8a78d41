"""Registered queries: one per operator of the inventory, keyed by its id.

Each entry takes ``(spark, sf_dir)``, reads the driver's tables through the
bindings and returns a DataFrame with scalar, explicitly named columns (the
same names as the DuckDB oracle in :mod:`keelson.plans.oracle`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.functions.num import rnd

from keelson import constants as K
from keelson.functions import classes as CL
from keelson.functions import frames as FR
from keelson.functions import risk as RK
from keelson.functions import text as TX
from keelson.operators import classes as OC
from keelson.operators import manifest_marts as MM
from keelson.operators import quality as Q
from keelson.operators import selection as S
from keelson.operators.near import near_frames
from keelson.sources import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(key: str):
    def deco(fn):
        QUERIES[key] = fn
        return fn
    return deco


# ---- shared pipelines --------------------------------------------------------

def flagged_frames(spark, sf) -> DataFrame:
    """frames_v -> D1 -> G1, with the quality score."""
    fr = B.frames_v(spark, sf)
    d = Q.prev_good_hash(Q.flag_quality(fr), rn="frame_rn", chunk="frame_chunk")
    return d.withColumn("score", FR.quality_score("brightness", "laplacian_var"))


def candidates(spark, sf) -> DataFrame:
    """D2 union D5 (J2). The flagged frames feed three branches (kept rows,
    per-video counts, fallback rows): materialise them once in the shared
    checkpoint folder rather than re-running the frame chain per branch."""
    from keelson.session import cut_lineage
    return Q.with_fallback(cut_lineage(flagged_frames(spark, sf)))


# ---- C: per-frame scalars on frames_v ---------------------------------------

@query("c2_frame_rows")
def c2_frame_rows(spark, sf):
    """C2 with every_n = 12 at 25 fps."""
    fr = B.frames_v(spark, sf)
    idx = FR.frame_index(F.col("frame_idx"), F.lit(12))
    return fr.select("video_id", idx.alias("frame_idx"),
                     rnd(FR.frame_timestamp(idx, F.lit(25.0)), 6).alias("timestamp_sec"),
                     F.format_string("frames/%d/frame_%06d.jpg", F.col("video_id"), idx).alias("raw_frame_path"))


@query("c9_hamming")
def c9_hamming(spark, sf):
    """Distance of each frame's hash to the previous frame's; the
    previous frame is an equi-join on frame_idx - 1 (no window)."""
    fr = B.frames_v(spark, sf).withColumn("hash", FR.hex_to_hash("dhash"))
    prev = fr.select("video_id", (F.col("frame_idx") + 1).alias("frame_idx"), F.col("hash").alias("prev_hash"))
    j = fr.join(prev, ["video_id", "frame_idx"], "left")
    return j.select("video_id", "frame_idx", FR.hamming("hash", "prev_hash").alias("hamming"),
                    FR.visual_distance("hash", "prev_hash").alias("visual_distance"))


@query("c11_quality_score")
def c11_quality_score(spark, sf):
    fr = B.frames_v(spark, sf)
    return fr.select("video_id", "frame_idx", rnd(FR.quality_score("brightness", "laplacian_var"), 6).alias("score"))


@query("d1_quality_ok")
def d1_quality_ok(spark, sf):
    fr = Q.flag_quality(B.frames_v(spark, sf))
    return fr.select("video_id", "frame_idx", "quality_ok")


@query("g1_prev_quality_hash")
def g1_prev_quality_hash(spark, sf):
    d = flagged_frames(spark, sf)
    return d.select("video_id", "frame_idx", "quality_ok", "prev_dhash", "hamming_to_prev", "is_duplicate")


@query("d2_keep_frames")
def d2_keep_frames(spark, sf):
    d = Q.keep_frames(flagged_frames(spark, sf))
    return d.select("video_id", "frame_idx", "dhash")


@query("f2_frame_funnel")
def f2_frame_funnel(spark, sf):
    return Q.frame_funnel(flagged_frames(spark, sf))


@query("d5_fallback")
def d5_fallback(spark, sf):
    """D5 + J2: kept frames plus the raw fallback for videos with none kept."""
    c = candidates(spark, sf)
    return c.select("video_id", "frame_idx", "fallback_mode")


@query("d5_fallback_dark")
def d5_fallback_dark(spark, sf):
    """D5 + J2 where it falls back: every seventh video is too dark, so none of
    its frames passes and its first frames with a hash are taken."""
    fr = B.frames_v(spark, sf)
    dark = fr.withColumn("brightness", F.when(F.col("video_id") % 7 == 0, F.lit(0.0)).otherwise(F.col("brightness")))
    d = Q.prev_good_hash(Q.flag_quality(dark), rn="frame_rn", chunk="frame_chunk")
    from keelson.session import cut_lineage
    return Q.with_fallback(cut_lineage(d)).select("video_id", "frame_idx", "fallback_mode")


def varied_frames(spark, sf) -> DataFrame:
    """frames_v in blocks of 50 frames, with hashes that vary: a frame's
    brightness flips up to 19 bits of its hash, at one of three places.
    Materialised, since classes and frames both read it."""
    from keelson.session import DROP_SHUFFLES, cut_lineage, held
    fr = B.frames_v(spark, sf).withColumn("bits", FR.hex_to_hash("dhash"))
    flips = F.expr("shiftleft(shiftleft(1L, cast(floor(brightness) AS int) % 20) - 1, cast(frame_idx % 3 AS int) * 20)")
    fr = fr.select("video_id", F.floor(F.col("frame_idx") / 50).cast("int").alias("bucket"), "frame_idx",
                   F.col("bits").bitwiseXOR(flips).alias("hash"))
    with held(spark, DROP_SHUFFLES):
        return cut_lineage(fr)


@query("e8_near_frames_1")
def e8_near_frames_1(spark, sf):
    """The first frame of a block that differs in one bit at most."""
    return near_frames(varied_frames(spark, sf), 1).select("video_id", "bucket", "frame_idx", "near_idx")


@query("e8_near_frames_6")
def e8_near_frames_6(spark, sf):
    """E8 at a distance of up to six bits."""
    return near_frames(varied_frames(spark, sf), 6).select("video_id", "bucket", "frame_idx", "near_idx")


@query("g2_coverage_bucket")
def g2_coverage_bucket(spark, sf):
    c = candidates(spark, sf)
    d = S.add_buckets(c, K.COVERAGE_BUCKETS)
    return d.select("video_id", "frame_idx", "bucket")


@query("g3_bucket_rank")
def g3_bucket_rank(spark, sf):
    c = candidates(spark, sf).withColumn("score", FR.quality_score("brightness", "laplacian_var"))
    d = S.bucket_rank(S.add_buckets(c, K.COVERAGE_BUCKETS))
    return d.select("video_id", "frame_idx", "bucket", "bucket_rank")


def _selection(spark, sf, target, buckets, per_bucket) -> DataFrame:
    c = candidates(spark, sf).withColumn("score", FR.quality_score("brightness", "laplacian_var"))
    return S.select_representative(c, target, buckets, per_bucket)


@query("h6_select_representative")
def h6_select_representative(spark, sf):
    """H1-H6 with the reference defaults (64 / 24 / 3)."""
    return _selection(spark, sf, K.TARGET_FRAMES, K.COVERAGE_BUCKETS, K.FRAMES_PER_BUCKET)


@query("h1_select_compact")
def h1_select_compact(spark, sf):
    """H1-H6 with a compact configuration (16 frames, 6 buckets, 3 per
    bucket) so that every branch of the walk runs on this data."""
    return _selection(spark, sf, 16, 6, 3)


# ---- class statistics on class_counts_v (asset = supplier, frame = order) ----

def frame_preds(spark, sf) -> DataFrame:
    return B.frame_predictions(B.class_counts_v(spark, sf))


def class_metrics_v(spark, sf) -> DataFrame:
    """F6 summary shaped like the class_metrics mart."""
    s = OC.class_summary(B.class_counts_v(spark, sf))
    return s.select("asset_id", "class_id", CL.canonical_class("class_name").alias("class_name"),
                    CL.translate("class_name").alias("class_name_ru"), "frames_present", "pixel_count",
                    TX.share_pct("pixel_share").alias("pixel_share_pct"))


@query("f6_class_summary")
def f6_class_summary(spark, sf):
    return OC.class_summary(B.class_counts_v(spark, sf))


@query("f20_visible_pixels")
def f20_visible_pixels(spark, sf):
    return frame_preds(spark, sf).select("asset_id", "frame_idx",
                                         CL.visible_pixels("class_pixel_counts").alias("visible_pixels"))


@query("c25_ratios")
def c25_ratios(spark, sf):
    f = frame_preds(spark, sf)
    return f.select("asset_id", "frame_idx", F.explode("class_pixel_ratios").alias("class_id", "ratio"))


@query("k3_explode_map")
def k3_explode_map(spark, sf):
    """K3: map -> rows (the counts map rebuilt from rows, then exploded)."""
    f = frame_preds(spark, sf)
    return f.select("asset_id", "frame_idx", F.explode("class_pixel_counts").alias("class_id", "pixels"))


@query("c18_risk_score")
def c18_risk_score(spark, sf):
    return frame_preds(spark, sf).select("asset_id", "frame_idx", "risk_score")


@query("c19_risk_band")
def c19_risk_band(spark, sf):
    f = frame_preds(spark, sf)
    return f.select("asset_id", "frame_idx", RK.risk_band("risk_score", "pipeline").alias("band_pipeline"),
                    RK.risk_band("risk_score", "dashboard").alias("band_dashboard"))


@query("c20_urgency_state")
def c20_urgency_state(spark, sf):
    f = frame_preds(spark, sf)
    return f.select("asset_id", "frame_idx", RK.urgency("risk_score").alias("urgency"),
                    RK.state_label("risk_score").alias("state_label"))


@query("c21_codes")
def c21_codes(spark, sf):
    f = frame_preds(spark, sf)
    issue = CL.translate("primary_sign_name")
    return f.select("asset_id", "frame_idx", RK.issue_code(issue).alias("issue_code"),
                    RK.state_code(RK.state_label("risk_score")).alias("state_code"))


@query("f4_dominant_class")
def f4_dominant_class(spark, sf):
    f = frame_preds(spark, sf)
    return f.select("asset_id", "frame_idx", "dominant_class_id",
                    CL.class_name("dominant_class_id").alias("dominant_class_name"))


@query("f5_predicted_ids")
def f5_predicted_ids(spark, sf):
    f = frame_preds(spark, sf)
    return f.select("asset_id", "frame_idx", F.array_join("predicted_class_ids", ",").alias("predicted_class_ids"))


@query("c27_primary_sign")
def c27_primary_sign(spark, sf):
    return frame_preds(spark, sf).select("asset_id", "frame_idx", "primary_sign_id", "primary_sign_name")


@query("c47_predicted_names")
def c47_predicted_names(spark, sf):
    f = frame_preds(spark, sf)
    return f.select("asset_id", "frame_idx",
                    F.array_join(CL.predicted_names("predicted_class_ids", K.SIGN_EXCLUDED_IDS), ", ").alias("video_names"),
                    F.array_join(CL.predicted_names("predicted_class_ids", K.VISIBLE_EXCLUDED_IDS), ", ").alias("photo_names"))


@query("c26_text_fields")
def c26_text_fields(spark, sf):
    """Ids as CSV text, counts as JSON keyed by class name."""
    f = frame_preds(spark, sf)
    named = F.transform_keys("class_pixel_counts", lambda k, v: CL.class_name(k))
    return f.select("asset_id", "frame_idx", F.array_join("predicted_class_ids", ",").alias("predicted_csv"),
                    F.to_json(named).alias("counts_json"))


@query("g5_top_classes")
def g5_top_classes(spark, sf):
    f = OC.frame_top_classes(frame_preds(spark, sf))
    e = f.select("asset_id", "frame_idx", F.posexplode("top_classes").alias("pos", "c"))
    return e.select("asset_id", "frame_idx", (F.col("pos") + 1).alias("class_rank"), "c.class_id", "c.class_name",
                    "c.pixel_count", "c.pixel_share")


@query("i8_frame_signs")
def i8_frame_signs(spark, sf):
    f = OC.frame_signs(frame_preds(spark, sf))
    return f.select("asset_id", "frame_idx", "primary_sign_label",
                    F.array_join("extra_signs", ", ").alias("extra_signs"), "truth_label")


@query("d7_has_defect")
def d7_has_defect(spark, sf):
    return OC.defect_frames(frame_preds(spark, sf)).select("asset_id", "frame_idx")


@query("e2_with_class")
def e2_with_class(spark, sf):
    cc = B.class_counts_v(spark, sf)
    j = OC.with_class(cc, CL.class_dimension(spark), "left")
    return j.select("asset_id", "frame_idx", "class_id", "pixels", "class_name", "color_hex", "risk_weight")


@query("e3_visible_only")
def e3_visible_only(spark, sf):
    cc = B.class_counts_v(spark, sf)
    j = OC.with_class(cc, CL.class_dimension(spark), "visible")
    return j.select("asset_id", "frame_idx", "class_id", "pixels", "class_name")


@query("f12_asset_risk")
def f12_asset_risk(spark, sf):
    return OC.asset_risk(frame_preds(spark, sf))


@query("f17_class_heatmap")
def f17_class_heatmap(spark, sf):
    return OC.class_heatmap(B.class_counts_v(spark, sf), 18)


@query("k4_pivot_frames")
def k4_pivot_frames(spark, sf):
    return OC.pivot_heatmap(OC.class_heatmap(B.class_counts_v(spark, sf), 18), 18)


@query("f13_fallback_risk")
def f13_fallback_risk(spark, sf):
    return OC.fallback_risk(class_metrics_v(spark, sf), ["asset_id"])


@query("f15_issue_type_count")
def f15_issue_type_count(spark, sf):
    return OC.issue_type_count(class_metrics_v(spark, sf), ["asset_id"])


@query("f16_primary_issue")
def f16_primary_issue(spark, sf):
    return OC.primary_issue(class_metrics_v(spark, sf), ["asset_id"], "live")


@query("f16_primary_issue_shadowed")
def f16_primary_issue_shadowed(spark, sf):
    return OC.primary_issue(class_metrics_v(spark, sf), ["asset_id"], "shadowed")


@query("g4_story_frames")
def g4_story_frames(spark, sf):
    f = frame_preds(spark, sf)
    s = S.story_frames(f, K.STORY_FRAMES, K.STORY_FRAMES, key="asset_id")
    return s.select("asset_id", "frame_idx", "story_pick")


@query("g4_story_frames_fill")
def g4_story_frames_fill(spark, sf):
    """G4 with more frames wanted than buckets, so the fill adds some."""
    s = S.story_frames(frame_preds(spark, sf), 8, 3, key="asset_id")
    return s.select("asset_id", "frame_idx", "story_pick")


# ---- marts and dashboard panels (asset = (kind, customer), frame = order) ----

from keelson.operators import marts as M  # noqa: E402


def marts(spark, sf) -> M.Marts:
    return M.build_marts(B.mart_lines(spark, sf))


@query("l1_runs_mart")
def l1_runs_mart(spark, sf):
    return marts(spark, sf).runs


@query("l2_class_metrics_mart")
def l2_class_metrics_mart(spark, sf):
    return marts(spark, sf).class_metrics


@query("l3_dynamics_mart")
def l3_dynamics_mart(spark, sf):
    return marts(spark, sf).dynamics


@query("l4_stage_times_mart")
def l4_stage_times_mart(spark, sf):
    return marts(spark, sf).stage_times


@query("l5_benchmark_curve_mart")
def l5_benchmark_curve_mart(spark, sf):
    return marts(spark, sf).benchmark_curve


@query("c42_parallel_estimate")
def c42_parallel_estimate(spark, sf):
    return marts(spark, sf).parallel_estimate


for _kind in ("video", "photo"):
    def _panels(kind):
        @query(f"l6_panel_issue_types_{kind}")
        def l6(spark, sf):
            return M.panel_issue_types(marts(spark, sf), kind)

        @query(f"l7_panel_primary_code_{kind}")
        def l7(spark, sf):
            return M.panel_primary_code(marts(spark, sf), kind)

        @query(f"l8_panel_state_code_{kind}")
        def l8(spark, sf):
            return M.panel_state_code(marts(spark, sf), kind)

        @query(f"l9_panel_risk_{kind}")
        def l9(spark, sf):
            return M.panel_risk(marts(spark, sf), kind)

        @query(f"l10_panel_class_frames_{kind}")
        def l10(spark, sf):
            return M.panel_class_frames(marts(spark, sf), kind)

        @query(f"l11_panel_class_table_{kind}")
        def l11(spark, sf):
            return M.panel_class_table(marts(spark, sf), kind)

        @query(f"l12_panel_dynamics_{kind}")
        def l12(spark, sf):
            return M.panel_dynamics(marts(spark, sf), kind)

        @query(f"l13_panel_class_share_{kind}")
        def l13(spark, sf):
            return M.panel_class_share(marts(spark, sf), kind)
    _panels(_kind)


@query("e4_latest_run_rows")
def e4_latest_run_rows(spark, sf):
    m = marts(spark, sf)
    return m.scoped(m.latest("video")).class_metrics.select("kind", "asset_id", "class_name", "frames_present")


@query("i3_top_by_frames")
def i3_top_by_frames(spark, sf):
    """I3 per asset: defect classes by frames then share, first 8."""
    cm = marts(spark, sf).class_metrics.where(~F.col("class_name").isin(*K.NON_DEFECT_NAMES))
    w = Window.partitionBy("kind", "asset_id").orderBy(F.col("frames_present").desc(), F.col("pixel_share_pct").desc(),
                                                       F.col("class_id"))
    return cm.withColumn("pos", F.row_number().over(w)).where("pos <= 8").select(
        "kind", "asset_id", "pos", "class_name_ru", "frames_present")


@query("i4_top_by_share")
def i4_top_by_share(spark, sf):
    """I4 per asset: defect classes with share > 0 by share, first 8."""
    cm = marts(spark, sf).class_metrics.where(~F.col("class_name").isin(*K.NON_DEFECT_NAMES) & (F.col("pixel_share_pct") > 0))
    w = Window.partitionBy("kind", "asset_id").orderBy(F.col("pixel_share_pct").desc(), F.col("class_id"))
    return cm.withColumn("pos", F.row_number().over(w)).where("pos <= 8").select(
        "kind", "asset_id", "pos", "class_name_ru", "pixel_share_pct")


@query("i5_first_points")
def i5_first_points(spark, sf):
    """I5 per asset: the first 12 dynamics points by frame_idx."""
    d = marts(spark, sf).dynamics
    w = Window.partitionBy("kind", "asset_id").orderBy("frame_idx")
    return d.withColumn("pos", F.row_number().over(w)).where("pos <= 12").select(
        "kind", "asset_id", "pos", "frame_label", "risk_score")


@query("i6_defect_table")
def i6_defect_table(spark, sf):
    return M.defect_table(marts(spark, sf))


@query("c37_recommendations")
def c37_recommendations(spark, sf):
    r = M.recommendations_mart(marts(spark, sf), "live")
    return r.select("kind", "asset_id", F.array_join("recommendations", " | ").alias("recommendations"),
                    "primary_recommendation")


@query("c37_recommendations_strict")
def c37_recommendations_strict(spark, sf):
    r = M.recommendations_mart(marts(spark, sf), "strict")
    return r.select("kind", "asset_id", F.array_join("recommendations", " | ").alias("recommendations"),
                    "primary_recommendation")


@query("f19_reviewed_items")
def f19_reviewed_items(spark, sf):
    return M.reviewed_items(marts(spark, sf).runs)


@query("f14_timing_stats")
def f14_timing_stats(spark, sf):
    """ms of inference per item and seconds per item (0 when none)."""
    r = marts(spark, sf).runs
    n = F.when(F.col("kind") == "photo", F.col("total_images")).otherwise(F.col("segmented_frames"))
    return r.select("kind", "asset_id",
                    F.when(n > 0, rnd(F.col("inference_wall_seconds") / n * 1000.0, 3)).otherwise(F.lit(0.0)).alias("ms_per_item"),
                    F.when(n > 0, rnd(F.col("pipeline_wall_seconds") / n, 3)).otherwise(F.lit(0.0)).alias("sec_per_item"))


@query("l16_report_tables")
def l16_report_tables(spark, sf):
    """KPI row per asset: reviewed items, issue types, primary issue,
    risk, urgency, summary sentence (C40)."""
    m = marts(spark, sf)
    r = m.runs.join(M.reviewed_items(m.runs), M.KEYS).join(OC.issue_type_count(m.class_metrics, M.KEYS), M.KEYS)
    kind_label = F.when(F.col("kind") == "photo", F.lit(K.KIND_LABELS["photo"])).otherwise(F.lit(K.KIND_LABELS["video"]))
    return r.select("kind", "asset_id", "reviewed_items", "issue_types", "primary_issue", "risk_score",
                    RK.urgency("risk_score").alias("urgency"),
                    TX.summary_text(kind_label, "primary_issue", "risk_band", "risk_score", RK.urgency("risk_score"))
                    .alias("summary"), TX.conclusion_text(kind_label, "primary_issue", "risk_band", "risk_score").alias("conclusion"))


# ---- runs_v (kind, customer, order) and stage_v (supplier) -----------------

@query("g9_latest_run")
def g9_latest_run(spark, sf):
    r = B.runs_v(spark, sf)
    lr = M.latest_run(r, None, time_col="updated_at", tie=F.col("run_id"))
    return lr.select("kind", "asset_id", "run_id", "updated_at", rnd("risk_score", 6).alias("risk_score"))


@query("g10_latest_kind")
def g10_latest_kind(spark, sf):
    return M.latest_kind(B.runs_v(spark, sf), time_col="updated_at")


@query("c29_c30_run_ids")
def c29_c30_run_ids(spark, sf):
    r = B.runs_v(spark, sf)
    t = TX.epoch_iso("updated_at")
    return r.select("run_id", TX.asset_id(F.col("asset_id"), F.col("run_id")).alias("asset_key"),
                    t["epoch"].alias("updated_at_epoch"), t["iso"].alias("updated_at_iso"))


@query("c19_run_band")
def c19_run_band(spark, sf):
    r = B.runs_v(spark, sf)
    s = rnd("risk_score", 3)
    return r.select("run_id", s.alias("risk_score"), RK.risk_band(s, "pipeline").alias("band_pipeline"),
                    RK.risk_band(s, "dashboard").alias("band_dashboard"), RK.state_label(s).alias("state_label"),
                    RK.state_code(RK.state_label(s)).alias("state_code"))


@query("k1_stage_times")
def k1_stage_times(spark, sf):
    return M.stage_times(B.stage_v(spark, sf), ["asset_id"])


@query("c31_effective_video_counts")
def c31_effective_video_counts(spark, sf):
    s = B.stage_v(spark, sf)
    c = RK.effective_video_counts("items", F.lit(0), F.lit(0), F.lit(0), F.lit(0),
                                  "inference_wall_seconds", "pipeline_wall_seconds")
    return s.select("asset_id", F.col("items").alias("extracted_frames"), c.alias("c")).select(
        "asset_id", "extracted_frames", "c.*")


@query("c32_effective_photo_counts")
def c32_effective_photo_counts(spark, sf):
    s = B.stage_v(spark, sf)
    c = RK.effective_photo_counts("items", F.lit(0.0), "pipeline_wall_seconds")
    return s.select("asset_id", c.alias("c")).select("asset_id", "c.*")


@query("c41_benchmark_curve")
def c41_benchmark_curve(spark, sf):
    s = B.stage_v(spark, sf)
    rows = []
    for kind in ("video", "photo"):
        curve = RK.benchmark_curve("items", "pipeline_wall_seconds", "inference_wall_seconds", kind)
        rows.append(s.select("asset_id", F.lit(kind).alias("kind"), F.explode(curve).alias("p")))
    u = rows[0].unionByName(rows[1])
    return u.select("asset_id", "kind", "p.*")


# ---- photo arrivals (events as photo files) and media (pages) --------------

from keelson.operators import hotspots as HS  # noqa: E402
from keelson.operators import inference as INF  # noqa: E402
from keelson.operators import media as MD  # noqa: E402


@query("f1_max_mtime")
def f1_max_mtime(spark, sf):
    return MD.max_mtime(B.arrivals_v(spark, sf))


@query("d4_latest_batch")
def d4_latest_batch(spark, sf):
    return MD.latest_batch(B.arrivals_v(spark, sf)).select("event_id", "path", "modificationTime")


@query("i1_photos_newest")
def i1_photos_newest(spark, sf):
    return MD.photos_newest(B.arrivals_v(spark, sf), cols=["event_id", "path", "modificationTime"])


@query("g6_risk_series")
def g6_risk_series(spark, sf):
    """Arrivals numbered oldest first, with a risk per photo
    (value / 490 capped at .98, 3 decimals)."""
    a = B.arrivals_v(spark, sf)
    s = MD.risk_series(a.select("event_id", "path", "modificationTime", "value"))
    return s.select("event_id", "photo_index", F.col("path").alias("label"),
                    rnd(F.least(F.col("value") / 490.0, F.lit(0.98)), 3).alias("risk_score"))


@query("m3_burst_sessions_batch")
def m3_burst_sessions_batch(spark, sf):
    """M3 batch twin: 20-second bursts over all arrivals."""
    return MD.burst_sessions(B.arrivals_v(spark, sf).select("path", "modificationTime"))


@query("c1_path_names")
def c1_path_names(spark, sf):
    m = B.media_v(spark, sf)
    return m.select("page_id", TX.filename("path").alias("filename"), TX.stem("path").alias("stem"),
                    TX.source_name("path").alias("source_name"))


@query("c28_size_kb")
def c28_size_kb(spark, sf):
    m = B.media_v(spark, sf)
    return m.select("page_id", "length", TX.size_kb("length").alias("size_kb"))


@query("c38_safe_name")
def c38_safe_name(spark, sf):
    m = B.media_v(spark, sf)
    return m.select("page_id", TX.safe_name("path", "item").alias("safe_name"))


@query("e9_existing_only")
def e9_existing_only(spark, sf):
    """Listed items (documents, by id) kept only when their page exists."""
    docs = B.table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), "source")
    return MD.existing_only(docs, B.media_v(spark, sf), "page_id")


@query("a12_peek")
def a12_peek(spark, sf):
    """A few columns of a curated table, first 20 by key."""
    return B.media_v(spark, sf).select("page_id", "length").orderBy("page_id").limit(20)


# binding matchers for the hotspot photo assignment: pages by language
# segment (the engine matcher finds nothing here, so its static list is used)
PAGE_MATCHERS = {"bow-thruster": r"(?i)/de/", "propeller": r"(?i)/fr/", "engine": r"(?i)/it/"}


def _page_sources(spark, sf):
    return B.media_v(spark, sf).select(F.col("path").alias("filename"), F.col("page_id").alias("source_order"))


@query("l17_assign_hotspot_photos")
def l17_assign_hotspot_photos(spark, sf):
    a = HS.assign_hotspot_photos(_page_sources(spark, sf), PAGE_MATCHERS)
    return a.select("hotspot_id", "pos", "photo_url", "origin")


@query("l17_hotspot_counts")
def l17_hotspot_counts(spark, sf):
    return HS.hotspot_counts(spark, HS.assign_hotspot_photos(_page_sources(spark, sf), PAGE_MATCHERS))


@query("e6_match_photos")
def e6_match_photos(spark, sf):
    m = HS.match_photos(_page_sources(spark, sf), PAGE_MATCHERS)
    return m.select("hotspot_id", "filename")


@query("e7_exclude_taken")
def e7_exclude_taken(spark, sf):
    """Pages no matcher took."""
    src = _page_sources(spark, sf)
    taken = HS.match_photos(src, PAGE_MATCHERS).select("filename")
    return src.join(taken, "filename", "left_anti").select("source_order", "filename")


@query("g8_even_chunks")
def g8_even_chunks(spark, sf):
    """The untaken pages split in even chunks over two hotspots."""
    src = _page_sources(spark, sf)
    a = HS.assign_hotspot_photos(src, {"propeller": r"(?i)/fr/"}, {"propeller": []})
    return a.where(F.col("origin") == "chunk").select("hotspot_id", "pos", "photo_url")


@query("e10_hotspot_lists")
def e10_hotspot_lists(spark, sf):
    a = HS.assign_hotspot_photos(_page_sources(spark, sf), PAGE_MATCHERS)
    return HS.hotspot_lists(spark, a).select("hotspot_id", "text", "pos", "photo_url")


@query("e5_sensor_for")
def e5_sensor_for(spark, sf):
    h = B.hotspots_v(spark, sf).select("data_key", F.col("hotspot_id"))
    s = B.sensors_v(spark, sf)
    return HS.sensor_for(h, s, "data_key", ["quality1", "toxic1"])


@query("k2_sensors_long")
def k2_sensors_long(spark, sf):
    return HS.sensors_long(B.sensors_v(spark, sf), "data_key")


@query("k2_sensors_arrays")
def k2_sensors_arrays(spark, sf):
    a = HS.sensors_arrays(HS.sensors_long(B.sensors_v(spark, sf), "data_key"), "data_key")
    return a.select("data_key", "metric", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("values"))


@query("j1_all_manifests")
def j1_all_manifests(spark, sf):
    """Runs and customers as one tagged list (unionByName, missing
    columns as null)."""
    r = B.runs_v(spark, sf).select("kind", "asset_id", "run_id")
    c = B.table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("asset_id"),
                                             F.col("c_mktsegment").alias("segment"))
    return r.unionByName(c, allowMissingColumns=True)


# ---- patches (embeddings as 8x8 gray grids / 8 pixels x 8 channels) --------

def _patches(spark, sf):
    return B.patches_v(spark, sf)


@query("c6_brightness")
def c6_brightness(spark, sf):
    p = _patches(spark, sf)
    return p.select("frame_id", rnd(FR.brightness("pixels"), 6).alias("brightness"))


@query("c7_laplacian_var")
def c7_laplacian_var(spark, sf):
    p = _patches(spark, sf)
    return p.select("frame_id", rnd(FR.laplacian_var("pixels", F.lit(8), F.lit(8)), 6).alias("laplacian_var"))


@query("c8_dhash")
def c8_dhash(spark, sf):
    p = _patches(spark, sf)
    return p.select("frame_id", FR.dhash_hex("pixels", 8).alias("dhash"))


@query("c12_norm_stats")
def c12_norm_stats(spark, sf):
    s = FR.norm_stats("pixels")
    return _patches(spark, sf).select("frame_id", rnd(s["norm_min"], 9).alias("norm_min"),
                                      rnd(s["norm_max"], 9).alias("norm_max"), rnd(s["norm_mean"], 9).alias("norm_mean"))


def _scaled(col="pixels"):
    """patch values as 0..255 intensities."""
    return F.transform(F.col(col), lambda x: rnd((x + 0.5) * 255.0, 0))


@query("c14_normalize_channels")
def c14_normalize_channels(spark, sf):
    n = FR.normalize_channels(_scaled(), 3)
    return _patches(spark, sf).select("frame_id", n.alias("n")).select(
        "frame_id", rnd(F.aggregate("n", F.lit(0.0), lambda a, x: a + x), 6).alias("norm_sum"),
        rnd(F.array_min("n"), 6).alias("norm_min"), rnd(F.array_max("n"), 6).alias("norm_max"))


TWO_HEAD_IDS = [1, 2, 6, 9]  # class of a two-head model's channel; further channels have none


def _pixel_probs():
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: F.slice(B.patch_probs(), p * 8 + 1, 8))


def _mask(threshold=None, class_ids=None):
    return OC.argmax_mask(_pixel_probs(), threshold, class_ids)


@query("f11_argmax_mask")
def f11_argmax_mask(spark, sf):
    return _patches(spark, sf).select("frame_id", F.array_join(_mask(), ",").alias("mask"))


@query("f10_two_head_mask")
def f10_two_head_mask(spark, sf):
    return _patches(spark, sf).select("frame_id", F.array_join(_mask(K.TWO_HEAD_THRESHOLD, TWO_HEAD_IDS), ",").alias("mask"))


@query("f3_mask_histogram")
def f3_mask_histogram(spark, sf):
    m = _patches(spark, sf).select("frame_id", _mask().alias("mask"))
    h = OC.mask_histogram(m, "frame_id", "mask")
    return h.select("frame_id", F.explode("class_pixel_counts").alias("class_id", "pixels"))


@query("c15_colorize")
def c15_colorize(spark, sf):
    m = _patches(spark, sf).select("frame_id", FR.colorize(_mask()).alias("rgb"))
    return m.select("frame_id", F.array_join(F.transform("rgb", lambda c: TX.rgb_hex(c[0], c[1], c[2])), ",").alias("colors"))


@query("c16_blend")
def c16_blend(spark, sf):
    """Overlay of the first channel (as 0..255) with the mask colour's
    red component, alpha .45."""
    p = _patches(spark, sf)
    img = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.element_at(_scaled(), i * 8 + 1))
    red = F.transform(FR.colorize(_mask()), lambda c: c[0].cast("double"))
    return p.select("frame_id", F.array_join(FR.blend(img, red), ",").alias("overlay"))


@query("n1_frame_metrics")
def n1_frame_metrics(spark, sf):
    p = _patches(spark, sf)
    dec = p.select("frame_id", F.col("pixels").alias("gray"), F.lit(8).alias("width"), F.lit(8).alias("height"),
                   F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"))
    m = INF.frame_metrics(dec, hash_cols=8)
    return m.select("frame_id", "width", "height", "status", rnd("brightness", 6).alias("brightness"),
                    rnd("laplacian_var", 6).alias("laplacian_var"), "dhash")


@query("n4_score_frames")
def n4_score_frames(spark, sf):
    """N4 + N5: batched scoring with the NumPy stand-in model (softmax per
    pixel) and native post-processing (multiclass argmax, class counts,
    dominant class, risk)."""
    p = _patches(spark, sf).withColumn("x", B.patch_probs())
    s = INF.score_frames(p, INF.softmax_stub(8), "x", channels=8, batch_size=64, input_size=64)
    r = INF.postprocess(s, "multiclass_segmentation")
    return r.select("frame_id", F.array_join("mask", ",").alias("mask"), "dominant_class_id", "risk_score")


def _result(r):
    counts = F.transform(F.array_sort(F.map_entries("class_pixel_counts")), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return r.select("frame_id", F.array_join("mask", ",").alias("mask"), F.array_join(counts, ",").alias("counts"),
                    F.array_join("predicted_class_ids", ",").alias("predicted"), "dominant_class_id")


@query("n5_two_head_channels")
def n5_two_head_channels(spark, sf):
    """N5 with several segmentation channels: channel -> class id, dominant
    class 1 where no channel reaches the threshold."""
    p = _patches(spark, sf).withColumn("probs", _pixel_probs())
    return _result(INF.postprocess(p, K.PREDICTION_MODES[1], K.TWO_HEAD_THRESHOLD, TWO_HEAD_IDS))


@query("n5_two_head_binary")
def n5_two_head_binary(spark, sf):
    """N5 with one foreground channel (the first of each pixel) and classifier
    scores (the frame's first four values, for classes 1, 2, 6, 9)."""
    p = _patches(spark, sf).withColumn("probs", F.transform(_pixel_probs(), lambda x: F.slice(x, 1, 1)))
    score = F.map_from_arrays(F.array(*[F.lit(c) for c in TWO_HEAD_IDS]), F.slice(B.patch_probs(), 1, 4))
    return _result(INF.postprocess(p.withColumn("classification_scores", score), K.PREDICTION_MODES[2]))


# ---- images as bytes, masks as runs ------------------------------------------

from keelson.functions import runs as RN  # noqa: E402
from keelson.operators import pixels as PX  # noqa: E402


def _decode_patch(content: bytes):
    """The codec of the patches: 64 raw bytes, anything else is broken."""
    import numpy as np
    return np.frombuffer(content, np.uint8).reshape(8, 8) if len(content) == 64 else None


def _stored_probs():
    return lambda x: x


@query("c13_preprocess")
def c13_preprocess(spark, sf):
    """Patches as 8 x 8 images (of label 3: cut off, of label 5:
    missing), their middle half resized to 2 x 2 and encoded again."""
    p = _patches(spark, sf).select("frame_id", "label", B.bytes_of(_scaled()).alias("content"))
    broken = F.when(F.col("label") == 3, F.substring("content", 1, 10)).when(F.col("label") == 5, F.lit(None)).otherwise(F.col("content"))
    r = PX.preprocess_pixels(p.withColumn("content", broken), _decode_patch, lambda a: a.tobytes(), (0.25, 0.25, 0.75, 0.75), 2, 2)
    return r.select("frame_id", F.lower(F.hex("processed_content")).alias("processed"),
                    F.concat_ws(",", "crop_x1", "crop_y1", "crop_x2", "crop_y2").alias("crop"), "processed_width", "processed_height",
                    *[rnd(c, 9).alias(c) for c in ("norm_min", "norm_max", "norm_mean")], "status", "error")


def _scored_runs(spark, sf, make, **more):
    p = _patches(spark, sf).withColumn("x", B.patch_probs())
    return PX.score_runs(p, make, "x", **more)


@query("f11_mask_runs")
def f11_mask_runs(spark, sf):
    """F11 as runs: value and length of every run of the argmax mask."""
    r = _scored_runs(spark, sf, _stored_probs, channels=8)
    return r.select("frame_id", F.array_join(F.transform("runs", lambda x: F.concat_ws("x", x["value"], x["length"])), ",").alias("runs"))


@query("f3_run_histogram")
def f3_run_histogram(spark, sf):
    r = _scored_runs(spark, sf, _stored_probs, channels=8)
    return r.select("frame_id", F.explode(RN.count_runs("runs")).alias("class_id", "pixels"))


@query("c15_run_colors")
def c15_run_colors(spark, sf):
    """C15 on runs, written out by pixel for the report."""
    r = _scored_runs(spark, sf, _stored_probs, channels=8).select("frame_id", RN.colorize_runs("runs").alias("c"))
    return r.select("frame_id", F.array_join(F.flatten(F.transform("c", lambda x: F.array_repeat(
        TX.rgb_hex(x["rgb"][0], x["rgb"][1], x["rgb"][2]), x["length"]))), ",").alias("colors"))


@query("c16_run_overlay")
def c16_run_overlay(spark, sf):
    """The first three channels of a pixel are its RGB image, overlaid
    with the colours of the mask's runs."""
    rgb = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.element_at(_scaled(), (F.floor(i / 3) * 8 + i % 3 + 1).cast("int")))
    p = _patches(spark, sf).select("frame_id", B.patch_probs().alias("x"), B.bytes_of(rgb).alias("pixels"), F.lit(4).alias("width"))
    r = PX.score_runs(p, _stored_probs, "x", channels=8, keep=("frame_id", "pixels", "width"))
    return PX.overlay_runs(r).select("frame_id", F.lower(F.hex("overlay_content")).alias("overlay"), "status")


@query("n4_score_runs")
def n4_score_runs(spark, sf):
    """N4 and N5 as :func:`n4_score_frames`, the mask as runs."""
    s = _scored_runs(spark, sf, INF.softmax_stub(8), channels=8)
    return PX.postprocess_runs(s).select("frame_id", F.array_join(RN.from_runs("runs"), ",").alias("mask"), "dominant_class_id", "risk_score")


@query("n5_run_two_head_channels")
def n5_run_two_head_channels(spark, sf):
    """N5 on runs, several channels; the classifier's ids stand in for missing segmentation ids."""
    s = _scored_runs(spark, sf, _stored_probs, channels=8, mode=K.PREDICTION_MODES[1], classifier_ids=TWO_HEAD_IDS)
    return _result(PX.postprocess_runs(s, K.PREDICTION_MODES[1]).withColumn("mask", RN.from_runs("runs")))


@query("n5_run_two_head_binary")
def n5_run_two_head_binary(spark, sf):
    """N5 on runs, one foreground channel and classifier scores."""
    p = _patches(spark, sf).withColumn("x", F.transform(_pixel_probs(), lambda x: F.get(x, 0)))
    score = F.map_from_arrays(F.array(*[F.lit(c) for c in TWO_HEAD_IDS]), F.slice(B.patch_probs(), 1, 4))
    p = p.withColumn("classification_scores", score)
    s = PX.score_runs(p, _stored_probs, "x", channels=1, mode=K.PREDICTION_MODES[2], keep=("frame_id", "classification_scores"))
    return _result(PX.postprocess_runs(s, K.PREDICTION_MODES[2]).withColumn("mask", RN.from_runs("runs")))


# ---- classifier scores (binary-classification mode) on class_counts_v ------

def _scores(spark, sf):
    s = B.scores_v(spark, sf)
    a = CL.active_classes("classification_scores", K.ACTIVE_SCORE_THRESHOLD)
    return s.withColumn("_a", a)


@query("f9_active_classes")
def f9_active_classes(spark, sf):
    s = _scores(spark, sf)
    return s.select("asset_id", "frame_idx", F.array_join("_a.active", ",").alias("active"),
                    F.array_join("_a.defects", ",").alias("defects"))


@query("f8_apportion")
def f8_apportion(spark, sf):
    """F8: foreground pixels split over the defect classes by score."""
    s = _scores(spark, sf).where("fg > 0")
    scored = F.transform("_a.defects", lambda c: F.struct(c.alias("id"), F.element_at("classification_scores", c).alias("score")))
    # a frame without foreground has no entries; exploded as an expression: of a column, Spark would work it out again in a filter for rows without entries
    return s.select("asset_id", "frame_idx", F.explode(CL.apportion("fg", scored)).alias("class_id", "pixels"))


@query("f7_binary_summary")
def f7_binary_summary(spark, sf):
    s = _scores(spark, sf)
    frames = s.select("asset_id", "frame_idx", "prediction_mode", "classification_scores",
                      F.col("_a.defects").alias("predicted_class_ids"),
                      F.coalesce(F.get("_a.defects", 0), F.lit(1)).alias("primary_sign_id"))
    return OC.class_summary_binary(frames)


# ---- marts and report rows from manifests ----------------------------------

def _manifest_query(key: str, table):
    def run(spark, sf):
        return table(B.manifests_v(spark, sf))
    run.__doc__ = table.__doc__
    query(key)(run)


for _key, _table in (("b7_manifest_runs", MM.runs), ("b7_manifest_class_metrics", MM.class_metrics),
                     ("b7_manifest_dynamics", MM.dynamics), ("b7_manifest_stage_times", MM.stage_times),
                     ("b7_manifest_benchmark_curve", MM.benchmark_curve), ("f19_manifest_reviewed_items", MM.reviewed_items),
                     ("i7_manifest_review_rows", MM.review_rows)):
    _manifest_query(_key, _table)


@query("a6_manifest_files")
def a6_manifest_files(spark, sf):
    """A6 + A7 + B6 + J1: every manifest written as a document of its own
    (videos) or as the newest photo batch, scanned again, and the runs table made of them."""
    from keelson.sources import readers as R
    from keelson.sources import sinks as SK
    root = _scratch(spark, "manifests")
    SK.write_manifest_documents(B.manifests_v(spark, sf), root)
    return MM.runs(R.all_manifests(spark, root)).drop("updated_at_iso", "updated_at_epoch")


# ---- remaining inventory items --------------------------------------------------

@query("e1_join_metrics")
def e1_join_metrics(spark, sf):
    """Image metrics joined to extracted rows by (video, file name)."""
    fr = B.frames_v(spark, sf)
    extracted = fr.select("video_id", F.format_string("frames/%d/frame_%06d.jpg", F.col("video_id"), F.col("frame_idx"))
                          .alias("raw_frame_path"), "timestamp_sec")
    metrics = fr.select("video_id", F.format_string("frame_%06d.jpg", F.col("frame_idx")).alias("filename"),
                        "brightness", "laplacian_var")
    j = extracted.withColumn("filename", TX.filename("raw_frame_path")).join(metrics, ["video_id", "filename"], "inner")
    return j.select("video_id", "filename", rnd("timestamp_sec", 6).alias("timestamp_sec"), "brightness", "laplacian_var")


@query("d9_filter_or_all")
def d9_filter_or_all(spark, sf):
    """Per asset the defect classes present, or every class when none."""
    cm = class_metrics_v(spark, sf)
    pred = ~F.col("class_name").isin(*K.NON_DEFECT_NAMES) & (F.col("frames_present") > 0)
    return OC.filter_or_all(cm, pred, ["asset_id"]).select("asset_id", "class_id", "frames_present")


@query("f18_distinct_in_order")
def f18_distinct_in_order(spark, sf):
    """the first three distinct primary-sign labels of each asset in
    frame order."""
    f = frame_preds(spark, sf).withColumn("label", CL.translate("primary_sign_name"))
    return OC.first_distinct(f, ["asset_id"], "label", "frame_idx", 3).select("asset_id", "label_rank", "label")


@query("i7_review_rows")
def i7_review_rows(spark, sf):
    """The review rows of each asset: its story frames (at most 6, so
    within the first 8), frame label, truth label (I8) and time label."""
    f = frame_preds(spark, sf)
    story = S.story_frames(f, K.STORY_FRAMES, K.STORY_FRAMES, key="asset_id").drop("story_pick")
    s = OC.frame_signs(story)
    return s.select("asset_id", "frame_idx", F.concat(F.lit(K.FRAME_LABEL_PREFIX + " "), F.col("frame_idx").cast("string"))
                    .alias("frame_label"), "truth_label", F.lit("-").alias("time_text"))


def _entries(m, fmt: str):
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.format_string(fmt, e["key"], e["value"])), ",")


@query("l14_photo_record")
def l14_photo_record(spark, sf):
    """One record per photo of the photo assets (frames of kind photo;
    the frame number stands for the file's length)."""
    f = marts(spark, sf).frames.where(F.col("kind") == "photo")
    name = F.format_string("%d.jpg", F.col("frame_idx"))
    return f.select("asset_id", name.alias("filename"), F.concat(F.lit("raw/photos/"), name).alias("source_path"),
                    F.col("frame_idx").alias("size_bytes"), TX.size_kb("frame_idx").alias("size_kb"),
                    F.concat(F.lit("images/"), name).alias("processed_image"),
                    F.concat(F.lit("masks/"), name).alias("mask_image"),
                    F.concat(F.lit("overlays/"), name).alias("overlay_image"),
                    "dominant_class_id", CL.class_name("dominant_class_id").alias("dominant_class_name"),
                    F.array_join(CL.predicted_names("predicted_class_ids", K.VISIBLE_EXCLUDED_IDS), ", ").alias("predicted_class_names"),
                    _entries("class_pixel_counts", "%d:%d").alias("class_pixel_counts"),
                    _entries("class_pixel_ratios", "%d:%.6f").alias("class_pixel_ratios"), "prediction_mode", "risk_score")


@query("l15_frame_record")
def l15_frame_record(spark, sf):
    """The manifest's top-frame record: story frames with time (at 25
    frames a second), primary sign, predicted ids, ratios, the three top
    classes (G5) and the image paths."""
    f = OC.frame_top_classes(frame_preds(spark, sf))
    story = S.story_frames(f, K.STORY_FRAMES, K.STORY_FRAMES, key="asset_id")
    name = F.format_string("frame_%06d.jpg", F.col("frame_idx"))
    return story.select("asset_id", "frame_idx", rnd(FR.frame_timestamp(F.col("frame_idx"), F.lit(25.0)), 6).alias("timestamp_sec"),
                        F.col("primary_sign_id").alias("dominant_class_id"),
                        F.col("primary_sign_name").alias("dominant_class_name"),
                        F.array_join("predicted_class_ids", ",").alias("predicted_class_ids"),
                        _entries("class_pixel_ratios", "%d:%.6f").alias("class_pixel_ratios"),
                        F.array_join(F.transform("top_classes", lambda c: c["class_id"]), ",").alias("top_classes"),
                        F.concat(F.lit("frames/"), name).alias("processed_image"), F.concat(F.lit("masks/"), name).alias("mask_image"),
                        F.concat(F.lit("overlays/"), name).alias("overlay_image"))


@query("c5_crop_box")
def c5_crop_box(spark, sf):
    """C4 + C5: a crop text as pixel boxes of small images, plain and clamped."""
    p = B.table(spark, sf, "pages").select("page_id", (F.col("page_id") % 23).cast("int").alias("w"), (F.col("page_id") % 31).cast("int").alias("h"))
    p = p.withColumn("c", FR.parse_crop(F.lit("0.05, 0.10, 0.95, 0.90"))).withColumn("w", F.col("w") + 1).withColumn("h", F.col("h") + 1)
    return p.select("page_id", FR.crop_box("w", "h", "c").alias("a"), FR.crop_box("w", "h", "c", clamp=True).alias("b")).select(
        "page_id", *[F.col(f"{s}.crop_{k}").alias(f"{n}_{k}") for s, n in (("a", "plain"), ("b", "clamped")) for k in ("x1", "y1", "x2", "y2")])


@query("c24_class_ids")
def c24_class_ids(spark, sf):
    """Class names of a configuration, written in several ways, to ids."""
    name = F.coalesce(CL.class_name(F.col("p_partkey") % 10), F.lit(""))
    names = F.array(F.concat(F.lit(" "), F.upper(name)), F.translate(name, " ", "-"), F.col("p_name"))
    return B.table(spark, sf, "part").select("p_partkey", F.array_join(CL.class_ids(names), ",").alias("ids"))


@query("c45_asset_path")
def c45_asset_path(spark, sf):
    """A relative path joined to its root, whatever slashes they end or
    begin with."""
    p = B.table(spark, sf, "pages")
    return p.select("page_id", TX.asset_path(F.concat("url", F.lit("//")), F.concat(F.lit("/img/"), F.col("page_id").cast("string"))).alias("path"))


@query("c48_describe")
def c48_describe(spark, sf):
    """A hotspot's description by its text; a default for unknown ones."""
    texts = F.array(*[F.lit(t) for _, t, _, _ in K.HOTSPOTS])
    d = B.table(spark, sf, "documents").select("doc_id", F.coalesce(F.get(texts, (F.col("doc_id") % 5).cast("int")), F.col("source")).alias("text"))
    return HS.describe(d).select("doc_id", "text", "description")


@query("c35_time_label")
def c35_time_label(spark, sf):
    fr = B.frames_v(spark, sf)
    return fr.select("video_id", "frame_idx", TX.time_label("timestamp_sec").alias("time_label"))


@query("c43_trimmed_frames")
def c43_trimmed_frames(spark, sf):
    """Frames left after a 3 s trim at 25 fps, per video."""
    fun = Q.frame_funnel(flagged_frames(spark, sf))
    return fun.select("video_id", FR.trimmed_frames("extracted_frames", F.lit(3), F.lit(25.0)).alias("trimmed_frames"))


@query("c44_json_map")
def c44_json_map(spark, sf):
    """Class-count maps through JSON text (string keys) and back."""
    f = frame_preds(spark, sf).select("asset_id", "frame_idx", F.to_json("class_pixel_counts").alias("j"))
    m = f.select("asset_id", "frame_idx", CL.json_map("j", "bigint").alias("m"))
    return m.select("asset_id", "frame_idx", F.explode("m").alias("class_id", "pixels"))


# ---- streaming operators, run to completion (availableNow) ------------------

def _scratch(spark, name: str) -> str:
    import uuid
    from keelson.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"


def _run_to_table(sdf, spark, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming query over everything available and return its
    output as a batch table (Parquet sink in the shared folder)."""
    root = _scratch(spark, name)
    q = (sdf.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ck")
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(sdf.schema).parquet(f"{root}/out")


@query("m1_ingest_files")
def m1_ingest_files(spark, sf):
    """M1: the table files of the data folder indexed by a file stream."""
    from keelson.streaming import streams as ST
    root = _scratch(spark, "ingest")
    ST.ingest_files(spark, sf, f"{root}/out", f"{root}/ck", glob="*.parquet").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("filename")


@query("m2_stream_duplicates")
def m2_stream_duplicates(spark, sf):
    """M2: previous-good-hash flags carried in per-video stream state; equal
    to G1 when a video's frames arrive in order (here: one micro-batch)."""
    from keelson.streaming import streams as ST
    from keelson.session import cut_lineage
    frames = cut_lineage(flagged_frames(spark, sf).select("video_id", "frame_idx", "quality_ok", "hash"))
    path = frames.inputFiles()[0].rsplit("/", 1)[0]
    sdf = spark.readStream.schema(frames.schema).parquet(path)
    out = _run_to_table(ST.stream_duplicates(sdf), spark, "dups")
    prev = F.when(F.col("quality_ok"), FR.hash_to_hex("prev_hash"))
    return out.select("video_id", "frame_idx", "quality_ok", prev.alias("prev_dhash"), "hamming_to_prev", "is_duplicate")


@query("m2_stream_duplicates_any_order")
def m2_stream_duplicates_any_order(spark, sf):
    """M2 with frames that come up to a sixteenth of the recording late, over
    several micro-batches: the flags are those of the whole video (G1)."""
    from keelson.streaming import streams as ST
    from keelson.session import cut_lineage
    at = F.timestamp_micros((F.col("timestamp_sec") * 1e6).cast("bigint") + 1_700_000_000_000_000)
    frames = cut_lineage(flagged_frames(spark, sf).select("video_id", "frame_idx", "quality_ok", "hash", at.alias("at")))
    first, last = (v or 0 for v in frames.agg(F.min(F.unix_micros("at")), F.max(F.unix_micros("at"))).first())
    late = (last - first) // 16
    arrival = F.unix_micros("at") - first + F.pmod(F.xxhash64("video_id", "frame_idx"), F.lit(1000)) * (late / 1000)
    width = (last - first + late) / 6 + 1
    root = _scratch(spark, "arrivals")
    for part in range(6):  # one after the other, so that the stream reads them in this order
        frames.where(F.floor(arrival / width) == part).write.mode("append").parquet(root)
    # a row of no video moves the watermark past all frames
    end = frames.limit(1).select(F.lit(-1).cast("bigint").alias("video_id"), F.lit(0).cast("bigint").alias("frame_idx"),
                                 F.lit(False).alias("quality_ok"), F.lit(None).cast("bigint").alias("hash"),
                                 F.timestamp_micros(F.lit(last + 10 * int(width + late))).alias("at"))
    end.write.mode("append").parquet(root)
    sdf = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 8).parquet(root)
    out = _run_to_table(ST.stream_duplicates_in_order(sdf, delay=f"{int(width + late) // 1_000_000 + 1} seconds", keep="3650 days"), spark, "ordered")
    prev = F.when(F.col("quality_ok"), FR.hash_to_hex("prev_hash"))
    return out.select("video_id", "frame_idx", "quality_ok", prev.alias("prev_dhash"), "hamming_to_prev", "is_duplicate")


@query("m3_stream_bursts")
def m3_stream_bursts(spark, sf):
    """M3: 20-second bursts of arrivals as streaming session windows."""
    from keelson.streaming import streams as ST
    ev = B.table(spark, sf, "events")
    path = ev.inputFiles()[0].rsplit("/", 1)[0]
    sdf = (spark.readStream.schema(ev.schema).option("pathGlobFilter", "events.parquet").parquet(path)
           .select(F.col("ts").cast("timestamp").alias("modificationTime"), F.lit("photos").alias("source_root")))
    return _run_to_table(ST.stream_bursts(sdf), spark, "bursts")


@query("m4_stream_daily_counts")
def m4_stream_daily_counts(spark, sf):
    """M4: events per day and type; days still open under the one-day
    watermark at the end of the input are not emitted (append mode)."""
    from keelson.streaming import streams as ST
    ev = B.table(spark, sf, "events")
    path = ev.inputFiles()[0].rsplit("/", 1)[0]
    sdf = (spark.readStream.schema(ev.schema).option("pathGlobFilter", "events.parquet").parquet(path)
           .select(F.col("ts").cast("timestamp").alias("ts"), "event_type"))
    return _run_to_table(ST.stream_daily_counts(sdf), spark, "daily")


@query("m5_stream_latest_run")
def m5_stream_latest_run(spark, sf):
    """M5: latest run per kind kept by a foreachBatch merge."""
    from keelson.streaming import streams as ST
    o = B.table(spark, sf, "orders")
    path = o.inputFiles()[0].rsplit("/", 1)[0]
    sdf = (spark.readStream.schema(o.schema).option("pathGlobFilter", "orders.parquet").parquet(path)
           .select(F.when(F.col("o_orderstatus") == "P", F.lit("photo")).otherwise(F.lit("video")).alias("kind"),
                   F.col("o_custkey").alias("asset_id"), F.col("o_orderkey").alias("run_id"),
                   F.col("o_orderdate").cast("timestamp").alias("updated_at")))
    root = _scratch(spark, "latest")
    ST.stream_latest_run(sdf, f"{root}/table", f"{root}/ck").awaitTermination()
    return ST.current_table(spark, f"{root}/table").select("kind", "asset_id", "run_id", "updated_at")
