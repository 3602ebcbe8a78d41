"""Smaller operators: crops, class lists, media plan, manifests, blobs."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.functions import classes as CL
from keelson.functions import frames as FR
from keelson.operators import hotspots as HS
from keelson.operators import inference as INF
from keelson.operators import manifests as MF
from keelson.operators.marts import build_marts
from keelson.sources import bindings as B
from keelson.sources import readers as R
from keelson.sources import sinks as W
from paths import SMOKE


def one(spark, col):
    return spark.range(1).select(col.alias("v")).collect()[0]["v"]


def test_crop_parse_and_box(spark):
    c = FR.parse_crop(F.lit("0.05,0.10,0.95,0.90"))
    box = one(spark, FR.crop_box(F.lit(256), F.lit(256), c))
    assert (box["crop_x1"], box["crop_y1"], box["crop_x2"], box["crop_y2"]) == (12, 25, 243, 230)
    tiny = one(spark, FR.crop_box(F.lit(1), F.lit(1), FR.parse_crop(F.lit("0.5,0.5,0.5,0.5")), clamp=True))
    assert tiny["crop_x2"] - tiny["crop_x1"] >= 1
    with pytest.raises(Exception):
        one(spark, FR.parse_crop(F.lit("0.1,0.2,0.3")))


def test_class_lists(spark):
    cls = F.array(F.struct(F.lit(1).alias("class_id"), F.lit("Ship hull").alias("class_name"), F.lit("#fff").alias("color_hex")),
                  F.struct(F.lit(7).alias("class_id"), F.lit("Rust?").alias("class_name"), F.lit("#000").alias("color_hex")))
    got = one(spark, CL.normalize_classes(cls))
    assert [(r["class_name"], r["color_hex"]) for r in got] == [("Normal", "#3b82f6")]
    assert len(one(spark, CL.normalize_classes(F.array().cast("array<struct<class_id:int,class_name:string,color_hex:string>>")))) == 4
    ids = one(spark, CL.class_ids(F.array(F.lit(" Marine-Growth "), F.lit("paint peel"), F.lit("nope"))))
    assert list(ids) == [2, 6]


def test_describe_default(spark):
    h = spark.createDataFrame([("Киль",), ("x",)], "text string")
    got = [r.description for r in HS.describe(h).collect()]
    assert got[0].startswith("Коррозия") and got[1] == "Связанные снимки hotspot."


def test_probe_and_plan(spark, tmp):
    os.makedirs(f"{tmp}/v")
    for n in ("a.mp4", "b.mp4", "c.mp4"):
        open(f"{tmp}/v/{n}", "wb").write(b"0")
    media = R.scan_media(spark, f"{tmp}/v", R.VIDEO_GLOB)
    specs = {"a.mp4": (25.0, 64, 48, 250), "b.mp4": (0.0, 64, 48, 100), "c.mp4": (10.0, 64, 48, 20)}
    probed = R.probe_media(media, lambda p: specs[p.rsplit("/", 1)[1]])
    plan = R.extraction_plan(probed, start_sec=3, every_n=12, max_frames=960)
    per = {r.video_id: r.n for r in plan.groupBy("video_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    # a: (10 - 3) s * 25/12 fps -> ceil(14.58) = 15; b: no fps -> 0 s; c: start 3 >= 2 s -> from 0: ceil(2 * 10/12) = 2
    assert per == {"a": 15, "c": 2}
    assert plan.where("video_id = 'c'").agg(F.max("trim_start_sec")).collect()[0][0] == 0


def test_decode_errors_kept_as_rows(spark):
    df = spark.createDataFrame([(1, bytes([1, 2, 3, 4])), (2, b"")], "frame_id long, content binary")
    dec = INF.decode_frames(df, lambda b: np.frombuffer(b, dtype=np.uint8).reshape(2, 2) if len(b) == 4 else None)
    m = {r.frame_id: r for r in INF.frame_metrics(dec, hash_cols=2).collect()}
    assert m[1].status == "ok" and m[1].brightness == pytest.approx(2.5) and m[1].width == 2
    assert m[2].status == "error" and m[2].brightness is None


def test_tables_roundtrip(spark, tmp):
    from keelson import schemas as SC
    df = spark.createDataFrame([("v1", "s", "p", 0, 0.0), ("v2", "s", "p", 1, None)], SC.FRAMES_EXTRACTED)
    W.write_partitioned(df, f"{tmp}/cur/video_frames_extracted")
    for name in ("video_frames_processed", "video_frame_segmentations", "video_pipeline_runs"):
        os.makedirs(f"{tmp}/cur/{name}")
    t = R.register_tables(spark, f"{tmp}/cur")
    assert spark.sql("SELECT count(*) FROM video_frames_extracted").collect()[0][0] == 2
    assert R.peek(t["video_frames_extracted"], ["video_id"], 1).count() == 1


def test_manifest_write_read_and_visible_classes(spark, tmp):
    m = MF.build_manifests(build_marts(B.mart_lines(spark, SMOKE))).where("kind = 'video'")
    n = m.count()
    W.write_manifests(m.drop("kind"), f"{tmp}/man")
    back = spark.read.json(f"{tmp}/man")
    assert back.count() == n
    rows = back.select(F.size("class_summaries").alias("c"), F.size("top_frames").alias("t")).collect()
    assert all(r.c == 4 and 1 <= r.t <= 6 for r in rows)
    man = spark.createDataFrame([("video", None, "2024-01-01"), ("photo", None, "2024-01-02")],
                                "kind string, visible_classes array<struct<class_id:int,class_name:string,color_hex:string>>, _updated_at string")
    assert len(MF.visible_classes(man).collect()[0][0]) == 4


def test_marts_survive_the_way_through_manifest_files(spark, tmp):
    """build_marts(read(write(build_manifests))) gives every table of the videos again, L3 too."""
    from keelson.operators import manifest_marts as MM
    marts = build_marts(B.mart_lines(spark, SMOKE))
    m = MF.build_manifests(marts, roots={"masks": "/m"})
    W.write_manifest_documents(m, f"{tmp}/r")
    back = R.all_manifests(spark, f"{tmp}/r")
    assert back.where("kind = 'photo'").count() == 1
    first = back.where("kind = 'video'").first()
    assert first.hdfs_roots == {"masks": "/m"} and len(first.parallel_estimate) == 2 and first.visible_classes[0].color_hex.startswith("#")
    assert first.run_counts.candidate_processed_frames == first.run_counts.deduplicated_frames and first.risk_summary.max_score is not None
    tables = MM.build_marts(back.where("kind = 'video'"))
    for name, cols in (("dynamics", ["asset_id", "frame_idx", "frame_label", "risk_score", "dominant_class_name_ru"]),
                       ("class_metrics", ["asset_id", "class_name", "frames_present", "pixel_count"]),
                       ("stage_times", ["asset_id", "stage_name", "stage_order"]),
                       ("benchmark_curve", ["asset_id", "scale", "items"]),
                       ("runs", ["asset_id", "extracted_frames", "quality_ok_frames", "deduplicated_frames", "processed_frames",
                                 "segmented_frames", "risk_score", "primary_issue_code", "state_code"])):
        want = marts[name].where("kind = 'video'").withColumn("asset_id", F.col("asset_id").cast("string")).select(*cols).collect()
        got = tables[name].select(*cols).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)) and want, name


def test_defect_export_existing_only(spark, tmp):
    os.makedirs(f"{tmp}/r/frames")
    open(f"{tmp}/r/frames/a.jpg", "wb").write(b"1")
    frames = spark.createDataFrame(
        [("v", 1, {2: 0.5}, "Marine growth", f"{tmp}/r", "frames/a.jpg", "overlays/a.jpg"),
         ("v", 2, {1: 1.0}, "Normal", f"{tmp}/r", "frames/b.jpg", "overlays/b.jpg")],
        "video_id string, frame_idx long, class_pixel_ratios map<int,double>, primary_sign_name string, "
        "_root string, processed_image string, overlay_image string")
    files = R.scan_media(spark, f"{tmp}/r")
    files = files.withColumn("path", F.regexp_replace("path", "^file:", ""))
    got = W.defect_export(frames, files).collect()
    assert [(r.item_no, r.role) for r in got] == [(1, "source")]
    assert got[0].folder == "v/001_frame_000001_Обрастание" and got[0].file == got[0].folder + "/source_a.jpg"


def test_defect_export_names_the_issues_and_photos(spark, tmp):
    """Extra signs from a ratio of 1e-4, best first, else the primary sign; photos go by file name."""
    schema = ("source_batch string, photo_index long, filename string, class_pixel_ratios map<int,double>, primary_sign_name string, "
              "_root string, processed_image string, overlay_image string, frame_idx long")
    rows = [("b/7", 1, "bow left.jpg", {9: 0.0002, 2: 0.3, 1: 0.6}, "Marine growth", "/r", "p/1.jpg", "o/1.jpg", None),
            ("b/7", 2, None, {9: 0.00001}, "Corrosion", "/r/", "p/2.jpg", "", None),
            ("b/7", 3, "clean.jpg", {1: 1.0}, "Normal", "/r", "p/3.jpg", "o/3.jpg", None)]
    files = spark.createDataFrame([("/r/p/1.jpg",), ("/r/o/1.jpg",), ("/r/p/2.jpg",), ("/r/p/3.jpg",)], "path string")
    got = W.defect_export(spark.createDataFrame(rows, schema), files, key="source_batch", kind="photo", order="photo_index").collect()
    assert sorted(r.file for r in got) == ["b_7/001_bow_left.jpg_Обрастание__Коррозия/overlay_1.jpg",
                                           "b_7/001_bow_left.jpg_Обрастание__Коррозия/source_1.jpg", "b_7/002_photo_002_Коррозия/source_2.jpg"]


def _manifest_rows(spark, rows):
    """rows: (id, seconds, frames) as read_manifests has them."""
    from keelson import schemas as SC
    base = spark.createDataFrame([(f"v{i}", t, n) for i, t, n in rows], "video_id string, t long, n long")
    have = {"video_id": F.col("video_id"), "run_counts": F.struct(F.col("n").alias("extracted_frames")),
            "dynamics_series": F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.struct(k.cast("long").alias("frame_idx")))}
    empty = spark.createDataFrame([], SC.MANIFEST).drop("_corrupt_record", *have)
    out = base.select(*[c.alias(k) for k, c in have.items()], F.lit("video").alias("kind"), F.timestamp_seconds("t").alias("_updated_at"))
    for f in empty.schema.fields:
        out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
    for name, fields in (("run_counts", "struct<extracted_frames:bigint,quality_ok_frames:bigint,deduplicated_frames:bigint,processed_frames:bigint,"
                          "segmented_frames:bigint,extraction_wall_seconds:double,preprocessing_wall_seconds:double,inference_wall_seconds:double,"
                          "export_stage_wall_seconds:double,pipeline_wall_seconds:double,avg_inference_ms_per_frame:double,"
                          "decode_prepare_wall_seconds:double,postprocess_write_wall_seconds:double,avg_inference_ms_per_image:double>"),
                         ("dynamics_series", "array<struct<frame_idx:bigint,risk_score:double,dominant_class_name:string,index:bigint>>")):
        out = out.withColumn(name, F.from_json(F.to_json(name), fields))
    return out


def test_refresh_by_changed_assets_equals_a_full_rebuild(spark, tmp):
    """Added, changed and vanished assets; the folders of others aren't touched."""
    from keelson.operators import manifest_marts as MM

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{tmp}/m/runs") for f in fs if f.endswith(".parquet")}

    def check(rows):
        m = _manifest_rows(spark, rows)
        n = W.refresh_marts(m, f"{tmp}/m")
        for name, want in MM.build_marts(m).items():
            if name in ("runs", "dynamics"):
                got = spark.read.parquet(f"{tmp}/m/{name}").drop("part").select(*want.columns)
                assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name
        return n
    rows = [(i, 1000 + i, 1 + i % 4) for i in range(40)]
    assert check(rows) == 40
    before = files()
    assert check(rows) == 0 and files() == before
    rows = [r for r in rows if r[0] not in (3, 17)] + [(100, 5000, 2)]  # two gone, one new
    rows = [(i, t + 9000, n + 3) if i == 20 else (i, t, n) for i, t, n in rows]  # one changed
    assert check(rows) == 4
    assert len(set(files().items()) & set(before.items())) >= len(before) - 4


def test_partitioned_write_spreads_a_hot_asset(spark, tmp):
    """One asset with most rows is written by several tasks, small ones share them; nothing is lost or doubled."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes",)}
    df = spark.range(60_000).select(F.when(F.col("id") % 10 < 8, F.lit("hot")).otherwise(F.concat(F.lit("v"), F.col("id") % 5)).alias("video_id"),
                                    "id", F.md5(F.col("id").cast("string")).alias("x"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        W.write_partitioned(df, f"{tmp}/t")
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    back = spark.read.parquet(f"{tmp}/t")
    assert back.count() == 60_000 and back.select("id").distinct().count() == 60_000
    made = {d: len([f for f in os.listdir(f"{tmp}/t/{d}") if f.endswith(".parquet")]) for d in os.listdir(f"{tmp}/t") if d.startswith("video_id=")}
    assert made["video_id=hot"] >= 3 and len(made) == 3 and all(n <= 2 for d, n in made.items() if d != "video_id=hot")


def test_preprocess_frames_crop_resize(spark):
    img = np.arange(100, dtype=np.uint8).reshape(10, 10)
    df = spark.createDataFrame([(1, img.tobytes()), (2, b"bad")], "frame_id long, content binary")
    dec = lambda b: np.frombuffer(b, dtype=np.uint8).reshape(10, 10) if len(b) == 100 else None
    rows = {r.frame_id: r for r in INF.preprocess_frames(df, dec, (0.0, 0.0, 1.0, 1.0), 5, 5).collect()}
    r = rows[1]
    assert r.status == "ok" and len(r.gray) == 25 and (r.crop_x2, r.crop_y2) == (10, 10)
    assert r.gray[0] == pytest.approx(img[:2, :2].mean())
    assert rows[2].status == "error" and rows[2].error == "undecodable"


def test_catalog_tables_see_folders_after_repair(spark, tmp):
    """A folder added later is seen after repair, one that is gone goes, and a filter on video_id reads one partition."""
    from keelson import schemas as SC

    def add(video):
        row = [(video, "s.mp4", f"/f/{i}", i, i / 25.0) for i in range(3)]
        W.write_partitioned(spark.createDataFrame(row, SC.FRAMES_EXTRACTED), f"{tmp}/cur/video_frames_extracted")
    for video in ("a", "b"):
        add(video)
    names = R.create_tables(spark, f"{tmp}/cur", "curated_test")
    table = "curated_test.video_frames_extracted"
    try:
        assert table in names and R.repair_tables(spark, "curated_test")["video_frames_extracted"] == 2
        assert spark.table(table).count() == 6
        add("c")
        assert spark.table(table).where("video_id = 'c'").count() == 0  # not yet known
        assert R.repair_tables(spark, "curated_test")["video_frames_extracted"] == 3
        one = spark.table(table).where("video_id = 'c'")
        assert one.count() == 3 and one.columns[-1] == "video_id"
        plan = one._jdf.queryExecution().executedPlan()
        assert "video_id" in plan.toString() and "PartitionFilters" in plan.toString() and len(one.inputFiles()) == 1
        import shutil
        shutil.rmtree(f"{tmp}/cur/video_frames_extracted/video_id=a")
        assert R.repair_tables(spark, "curated_test")["video_frames_extracted"] == 2
        assert spark.table(table).count() == 6
    finally:
        spark.sql("DROP DATABASE curated_test CASCADE")


def test_run_rows(spark):
    """B2: the run row of every video, from its pieces."""
    from keelson import schemas as SC
    from keelson.operators.runs import run_rows
    probed = spark.createDataFrame([("a", "/v/a.mp4", 25.0, 1000, 40.0), ("b", "/v/b.mp4", 0.0, 9, 0.0)],
                                   "video_id string, source_video string, fps double, source_total_frames long, duration_sec double")
    funnel = spark.createDataFrame([("a", 80, 60, 50, 50, 48, "normal")], "video_id string, extracted_frames long, quality_ok_frames long, "
                                   "deduplicated_frames long, candidate_processed_frames long, processed_frames long, fallback_mode string")
    seg = spark.createDataFrame([("a", "ok")] * 47 + [("a", "error")], "video_id string, status string")
    times = spark.createDataFrame([("a", 1.23456, 2.0, 3.0, 4.0, 10.5)], "video_id string, extraction_wall_seconds double, "
                                  "preprocessing_wall_seconds double, inference_wall_seconds double, export_stage_wall_seconds double, pipeline_wall_seconds double")
    got = run_rows(probed, funnel, seg, times, {"masks_root": "/m", "curated_processed_root": "/c"}, 3, 12)
    assert got.schema.names == SC.PIPELINE_RUNS.names and [f.dataType for f in got.schema] == [f.dataType for f in SC.PIPELINE_RUNS]
    rows = {r.video_id: r for r in got.collect()}
    a, b = rows["a"], rows["b"]
    assert (a.trim_start_sec, a.trimmed_frames, a.extracted_frames, a.processed_frames, a.segmented_frames) == (3, 925, 80, 48, 47)
    assert (a.extraction_wall_seconds, a.masks_root, a.curated_processed_root, a.overlays_root, a.fallback_mode) == (1.2346, "/m/a", "/c", None, "normal")
    assert (b.trimmed_frames, b.extracted_frames, b.segmented_frames, b.pipeline_wall_seconds) == (0, 0, 0, None)


def test_newest_manifest_and_constant(spark):
    from keelson.functions.text import with_constant
    m = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-02-01")], "video_id string, _updated_at string")
    assert R.newest_manifest(m).collect()[0].video_id == "b"
    assert with_constant(m, "k", 3).select("k").distinct().collect()[0].k == 3


def test_measured_frames_equal_native_metrics(spark):
    """One NumPy pass gives what the native expressions give; the native hash
    reads a 9 x 8 image as it is."""
    import numpy as np
    from keelson.operators import inference as INF
    rng = np.random.default_rng(4)
    images = {i: rng.integers(0, 256, (8, 9)).astype(np.uint8) for i in range(6)}
    df = spark.createDataFrame([(i, bytearray(a.tobytes())) for i, a in images.items()] + [(6, None), (7, bytearray(b"bad"))],
                               "frame_id long, content binary")

    def decode(b):
        return np.frombuffer(b, np.uint8).reshape(8, 9)
    got = {r.frame_id: r for r in INF.measure_frames(df, decode).collect()}
    want = {r.frame_id: r for r in INF.frame_metrics(INF.decode_frames(df, decode), hash_cols=9).collect()}
    for i in images:
        assert got[i].dhash == want[i].dhash and len(got[i].dhash) == 16
        assert abs(got[i].brightness - want[i].brightness) < 1e-9 and abs(got[i].laplacian_var - want[i].laplacian_var) < 1e-6
    assert got[6].status == got[7].status == "error" and got[7].error and got[6].brightness is None


def test_area_resize_weighs_cells():
    import numpy as np
    from keelson.operators.inference import _area_resize
    a = np.array([[0.0, 3.0, 6.0]])
    assert np.allclose(_area_resize(a, 2, 1), [[1.0, 5.0]])  # the middle cell counts half in each
    colour = np.arange(24, dtype=float).reshape(2, 4, 3)
    assert np.allclose(_area_resize(colour, 2, 1)[0, 0], colour[:, :2].mean((0, 1)))
