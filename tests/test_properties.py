"""Properties on the smoke data and edge groups (FIXTURES §5)."""

from pyspark.sql import functions as F

from keelson import constants as K
from keelson.functions import classes as CL
from keelson.operators import classes as OC
from keelson.operators import marts as M
from keelson.operators import quality as Q
from keelson.operators import selection as S
from keelson.plans import catalog as C
from keelson.sources import bindings as B
from paths import SMOKE

EMPTY_FRAMES = "video_id long, frame_idx long, brightness double, laplacian_var double, dhash string"


def test_bucket_sizes_even(spark):
    d = S.add_buckets(C.candidates(spark, SMOKE), K.COVERAGE_BUCKETS)
    sizes = d.groupBy("video_id", "bucket").count().groupBy("video_id").agg(
        F.sum("count").alias("t"), F.max("count").alias("mx"), F.min("count").alias("mn"))
    tot = d.groupBy("video_id").count()
    j = sizes.join(tot, "video_id")
    assert j.where("t != count or mx - mn > 1").count() == 0


def test_shares_and_risk_ranges(spark):
    s = OC.class_summary(B.class_counts_v(spark, SMOKE)).groupBy("asset_id").agg(F.sum("pixel_share").alias("s"))
    assert s.where("abs(s - 1) > 1e-5").count() == 0
    r = C.frame_preds(spark, SMOKE)
    assert r.where("risk_score < 0 or risk_score > 0.98").count() == 0


def test_funnel_never_increases(spark):
    f = Q.frame_funnel(C.flagged_frames(spark, SMOKE))
    assert f.where("quality_ok_frames > extracted_frames or deduplicated_frames > quality_ok_frames "
                   "or processed_frames > candidate_processed_frames").count() == 0


def test_empty_and_single_frame(spark):
    empty = spark.createDataFrame([], EMPTY_FRAMES)
    g = Q.prev_good_hash(Q.flag_quality(empty))
    assert Q.frame_funnel(g).count() == 0
    one = spark.createDataFrame([(1, 0, 100.0, 50.0, "00000000000000ff")], EMPTY_FRAMES)
    g1 = Q.prev_good_hash(Q.flag_quality(one))
    row = g1.collect()[0]
    assert row.quality_ok and not row.is_duplicate and row.prev_dhash is None
    cand = Q.with_fallback(g1).withColumn("score", F.lit(1.0))
    assert S.select_representative(cand, 64, 24, 3).count() == 1


def test_all_bad_frames_fall_back_to_36(spark):
    rows = [(7, i, 1.0, 0.0, f"{i:016x}") for i in range(50)]      # too dark, flat
    g = Q.prev_good_hash(Q.flag_quality(spark.createDataFrame(rows, EMPTY_FRAMES)))
    c = Q.with_fallback(g)
    assert c.count() == K.FALLBACK_FRAMES
    assert {r.fallback_mode for r in c.collect()} == {"raw_extracted"}
    f = Q.frame_funnel(g).collect()[0]
    assert f.candidate_processed_frames == 36 and f.fallback_mode == "raw_extracted"


def test_all_hashes_null(spark):
    rows = [(3, i, 100.0, 50.0, None) for i in range(10)]
    g = Q.prev_good_hash(Q.flag_quality(spark.createDataFrame(rows, EMPTY_FRAMES)))
    assert g.where("quality_ok or is_duplicate").count() == 0   # no hash -> not ok
    assert Q.with_fallback(g).count() == 0                      # nothing with a hash to fall back to


def test_unknown_class_only_void_and_ties(spark):
    counts = spark.createDataFrame([(1, 1, 3, 10), (1, 1, 0, 5), (2, 1, 0, 7), (3, 1, 2, 4), (3, 1, 6, 4)],
                                   "asset_id long, frame_idx long, class_id int, pixels long")
    f = {r.asset_id: r for r in B.frame_predictions(counts).collect()}
    assert f[1].primary_sign_name == "Unknown"            # id 3 has no name, no KeyError
    assert f[2].dominant_class_id == 0 and f[2].risk_score == 0.0
    assert f[3].dominant_class_id == 2                   # tie -> lowest id
    s = {(r.asset_id, r.class_id): r.pixel_share for r in OC.class_summary(counts).collect()}
    assert s[(2, 1)] == 0.0 and s[(2, 9)] == 0.0         # only Void: all shares 0
    assert CL is not None


def test_latest_run_tie_breaks(spark):
    runs = spark.createDataFrame([("video", 5, 100), ("video", 3, 100), ("photo", 9, 90), ("photo", 1, 100)],
                                 "kind string, asset_id long, updated_at_epoch long")
    got = {r.kind: r.asset_id for r in M.latest_run(runs).collect()}
    assert got == {"video": 3, "photo": 1}
    assert M.latest_kind(runs).collect()[0].kind == "photo"    # photo wins a tie
