"""Bindings: the driver's tables seen as inspection-domain views.

The reference ships no sample media, so the test tables stand in for the
domain tables (the same mapping is written in DuckDB SQL in
:mod:`keelson.plans.oracle`):

============== =========== ====================================================
view           from        mapping
============== =========== ====================================================
frames_v       events      video_id=user_id; frame_idx = ordinal by (ts,
                           event_id) - 1; brightness=value; laplacian_var =
                           props.k; dhash = first 16 hex of md5(event_type);
                           timestamp_sec = seconds since the video's first event
class_counts_v lineitem    asset_id=l_suppkey; frame_idx=l_orderkey; class by
                           l_linenumber 1->1, 2->2, 3->6, 4->9, else 0 (Void);
                           pixels = sum(l_quantity)
runs_v         orders      kind = photo when o_orderstatus='P' else video;
                           asset_id=o_custkey; updated_at=o_orderdate;
                           run_id=o_orderkey; risk=least(totalprice/5e5, .98)
stage_v        lineitem    per l_suppkey: extraction=sum(qty), preprocessing=
                           sum(tax), inference=sum(discount), export=
                           sum(extendedprice)/1e6, total = sum + count/1000
mart frames    lineitem ⋈  per (kind, o_custkey) asset, frame = order: class
               orders      pixels as in class_counts_v
media_v        pages       path=url; length=length(html)
arrivals_v     events      modificationTime = ts as UTC timestamp
patches_v      embeddings  64 floats as 8x8 gray grid / 8 px x 8 channels
hotspots_v     documents   hotspot per document; sensors_v = labels (quality,
                           toxic), joined by doc_id
============== =========== ====================================================

Sums that feed rounded outputs are taken as DECIMAL so both engines add
exactly the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import classes as CL
from keelson.functions import risk as RK
from keelson.functions.num import rnd
from keelson.operators.ordering import ordinal, time_chunk


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def class_of_line(linenumber) -> F.Column:
    ln = F.col(linenumber) if isinstance(linenumber, str) else linenumber
    return (F.when(ln == 1, 1).when(ln == 2, 2).when(ln == 3, 6).when(ln == 4, 9).otherwise(0)).cast("int")


def frames_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per extracted frame (see module table)."""
    ev = table(spark, sf_dir, "events")
    df = ev.select(
        F.col("user_id").alias("video_id"), "event_id", "ts",
        F.col("value").alias("brightness"),
        F.get_json_object("props", "$.k").cast("double").alias("laplacian_var"),
        F.substring(F.md5(F.col("event_type")), 1, 16).alias("dhash"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"))
    # hour chunks keep a hot video spread over many tasks (see ordering.py)
    df = ordinal(df, "video_id", ["ts", "event_id"], name="frame_rn", start=1, group_min=["_us"],
                 chunk=time_chunk("ts"), keep_chunk="frame_chunk")
    return df.select(
        "video_id", (F.col("frame_rn") - 1).alias("frame_idx"), "frame_rn", "frame_chunk", "event_id",
        ((F.col("_us") - F.col("_us_first")) / 1e6).alias("timestamp_sec"),
        "brightness", "laplacian_var", "dhash")


def class_counts_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, frame_idx, class_id) -> pixels."""
    li = table(spark, sf_dir, "lineitem")
    return (li.select(F.col("l_suppkey").alias("asset_id"), F.col("l_orderkey").alias("frame_idx"),
                      class_of_line("l_linenumber").alias("class_id"), "l_quantity")
              .groupBy("asset_id", "frame_idx", "class_id")
              .agg(F.sum("l_quantity").cast("bigint").alias("pixels")))


def frame_predictions(counts: DataFrame, keys: tuple[str, ...] = ("asset_id",)) -> DataFrame:
    """Per frame: class maps (ascending class id), predicted ids, dominant and
    primary sign, risk. One aggregation over at most a handful of classes per
    frame, so the collected lists are bounded by the class count."""
    g = counts.groupBy(*keys, "frame_idx").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("class_id", "pixels")))).alias("class_pixel_counts"))
    return with_predictions(g)


def with_predictions(frames: DataFrame) -> DataFrame:
    """The predictions that follow from a frame's class_pixel_counts."""
    return (frames.withColumn("class_pixel_ratios", CL.ratios("class_pixel_counts"))
             .withColumn("predicted_class_ids", CL.predicted_ids("class_pixel_counts"))
             .withColumn("dominant_class_id", CL.dominant_class("class_pixel_counts", 0))
             .withColumn("primary_sign_id", CL.primary_sign("predicted_class_ids", "dominant_class_id"))
             .withColumn("primary_sign_name", CL.class_name("primary_sign_id"))
             .withColumn("risk_score", RK.risk_score("class_pixel_ratios"))
             .withColumn("prediction_mode", F.lit("multiclass_segmentation")))


def runs_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.when(F.col("o_orderstatus") == "P", F.lit("photo")).otherwise(F.lit("video")).alias("kind"),
        F.col("o_custkey").alias("asset_id"), F.col("o_orderkey").alias("run_id"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
        F.least(F.col("o_totalprice") / 500000.0, F.lit(0.98)).alias("risk_score"))


def _stage_sums(df: DataFrame, keys: list[str], extra: list | None = None) -> DataFrame:
    dec = "decimal(18,2)"
    extra = extra or []
    g = df.groupBy(*keys).agg(
        F.sum(F.col("l_quantity").cast(dec)).alias("_q"), F.sum(F.col("l_tax").cast(dec)).alias("_t"),
        F.sum(F.col("l_discount").cast(dec)).alias("_d"), F.sum(F.col("l_extendedprice").cast(dec)).alias("_e"),
        F.count(F.lit(1)).alias("items"), *extra)
    return stage_seconds(g, [*keys, "items", *[c for c in g.columns if c not in keys and not c.startswith("_") and c != "items"]])


def stage_seconds(sums: DataFrame, keep: list[str]) -> DataFrame:
    """Stage seconds from the sums _q, _t, _d, _e (decimals) and items."""
    return sums.select(
        *keep, F.col("_q").cast("double").alias("extraction_wall_seconds"),
        F.col("_t").cast("double").alias("preprocessing_wall_seconds"),
        F.col("_d").cast("double").alias("inference_wall_seconds"),
        (F.col("_e") / 1000000).cast("double").alias("export_stage_wall_seconds"),
        (F.col("_q") + F.col("_t") + F.col("_d") + F.col("_e") / 1000000 + F.col("items") / 1000.0)
        .cast("double").alias("pipeline_wall_seconds"))


def stage_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "asset_id")
    return _stage_sums(li, ["asset_id"])


def mart_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem joined to its order: (kind, asset_id=o_custkey, frame_idx=order)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax",
                                                 "l_discount", "l_extendedprice")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        F.when(F.col("o_orderstatus") == "P", F.lit("photo")).otherwise(F.lit("video")).alias("kind"),
        F.col("o_custkey").alias("asset_id"), F.col("l_orderkey").alias("frame_idx"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
        "l_linenumber", "l_quantity", "l_tax", "l_discount", "l_extendedprice")


def media_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id"), F.col("url").alias("path"), F.length("html").cast("bigint").alias("length"))


def arrivals_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", F.format_string("photos/%d.jpg", F.col("event_id")).alias("path"),
                     F.col("ts").cast("timestamp").alias("modificationTime"), "event_type", "value")


def patches_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("frame_id"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("pixels"),
                    F.col("label"))


def hotspots_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("hotspot_id"), F.col("source").alias("text"),
                    F.col("doc_id").alias("data_key"), "lang")


def sensors_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    lb = table(spark, sf_dir, "labels")
    return lb.select(F.col("doc_id").alias("data_key"), F.col("quality").cast("double").alias("quality1"),
                     F.col("toxic").cast("double").alias("toxic1"))


def patch_probs(pixels: str = "pixels") -> F.Column:
    """patches_v as a model output: 8 pixels x 8 channels, value + 0.5."""
    return F.transform(F.col(pixels), lambda x: x + 0.5)


def bytes_of(values: F.Column) -> F.Column:
    """array of numbers -> binary, one byte a value (held between 0 and 255)."""
    two = F.transform(values, lambda v: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), v.cast("long"))).cast("long")), 2, "0"))
    return F.unhex(F.array_join(two, ""))


CLASSIFIER_IDS = (1, 2, 6, 9)


def scores_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per frame of class_counts_v: classifier scores = class share of the
    frame (classifier ids 1, 2, 6, 9, 6 decimals), foreground = non-Void
    pixels; binary-classification mode."""
    from keelson.functions.num import rnd
    c = class_counts_v(spark, sf_dir)
    g = c.groupBy("asset_id", "frame_idx").agg(
        F.sum("pixels").alias("tot"), F.sum(F.when(F.col("class_id") != 0, F.col("pixels")).otherwise(0)).alias("fg"),
        *[F.sum(F.when(F.col("class_id") == k, F.col("pixels")).otherwise(0)).alias(f"_p{k}") for k in CLASSIFIER_IDS])
    scores = F.create_map(*[x for k in CLASSIFIER_IDS for x in (F.lit(k), rnd(F.col(f"_p{k}") / F.col("tot"), 6))])
    return g.select("asset_id", "frame_idx", "tot", "fg", scores.alias("classification_scores"),
                    F.lit(K_BINARY).alias("prediction_mode"))


K_BINARY = "binary_segmentation_with_classification"


def manifests_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows (as ``readers.read_manifests`` returns them) bound to
    orders and their lines: an order is a run, its lines are its frames, and
    remainders of the customer key decide which counts are missing."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("q"), F.max(F.col("l_discount").cast("double")).alias("r"),
        F.max(F.col("l_tax").cast("double")).alias("x")).withColumn("c", class_of_line("l_linenumber"))
    name = F.when((F.col("c") == 1) & (F.col("l_orderkey") % 2 == 0), F.lit("Ship hull")).otherwise(CL.class_name("c"))
    li = li.withColumn("name", name).withColumn("file", F.concat(F.lit("img/f"), F.col("l_linenumber").cast("string"), F.lit(".jpg")))
    frame = F.struct(
        F.col("l_linenumber").cast("bigint").alias("frame_idx"), F.when(F.col("x") > 0, F.col("x") * 10).alias("timestamp_sec"),
        F.col("name").alias("dominant_class_name"), F.lit(None).cast("string").alias("primary_sign_name"),
        F.create_map(F.col("c").cast("string"), F.col("r")).alias("class_pixel_ratios"),
        F.col("file").alias("processed_image"), F.concat(F.lit("p"), F.col("l_linenumber").cast("string")).alias("filename"),
        F.when(F.col("r") > 0, F.col("r")).alias("risk_score"))
    one = F.struct("l_linenumber", "c", "name", "q", frame.alias("f"))
    per = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one), lambda a, b: a["l_linenumber"] - b["l_linenumber"])
                                      .alias("lines"))  # an order has few lines
    o = table(spark, sf_dir, "orders").join(per, F.col("o_orderkey") == F.col("l_orderkey"))
    video, tp = F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("double")

    def cust(n: int, r: int) -> F.Column:
        return F.col("o_custkey") % n == r
    total = F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, l: a + l["q"])
    kinds = F.array_distinct(F.transform("lines", lambda l: F.struct(l["c"].alias("c"), l["name"].alias("name"))))

    def of(k):
        return F.filter("lines", lambda l: l["c"] == k["c"])

    def pixels(k):
        return F.aggregate(of(k), F.lit(0).cast("bigint"), lambda a, l: a + l["q"])
    summaries = F.transform(kinds, lambda k: F.struct(
        k["c"].alias("class_id"), k["name"].alias("class_name"), pixels(k).alias("pixel_count"),
        F.size(of(k)).cast("bigint").alias("frames_present"), rnd(pixels(k) / total, 6).alias("pixel_share")))
    frames = F.transform("lines", lambda l: l["f"])
    points = F.transform("lines", lambda l: F.struct(
        l["f"]["frame_idx"].alias("frame_idx"), l["f"]["risk_score"].alias("risk_score"), l["name"].alias("dominant_class_name"),
        F.lit(None).cast("bigint").alias("index")))
    extracted = F.when(video, F.floor(tp / 1000))
    counts = F.struct(
        extracted.cast("bigint").alias("extracted_frames"),
        F.when(~cust(3, 0), F.floor(extracted * 0.8)).cast("bigint").alias("quality_ok_frames"),
        F.when(cust(4, 0), F.lit(0)).otherwise(F.floor(extracted * 0.6)).cast("bigint").alias("deduplicated_frames"),
        F.lit(None).cast("bigint").alias("processed_frames"),
        F.when(cust(5, 0), F.floor(extracted * 0.3)).cast("bigint").alias("segmented_frames"),
        rnd(tp / 50000, 3).alias("extraction_wall_seconds"),
        F.when(cust(2, 0), F.lit(0.0)).otherwise(rnd(tp / 40000, 3)).alias("preprocessing_wall_seconds"),
        rnd(tp / 45000, 3).alias("decode_prepare_wall_seconds"),
        F.when(~cust(3, 1), rnd(tp / 30000, 3)).alias("inference_wall_seconds"),
        F.lit(None).cast("double").alias("export_stage_wall_seconds"),
        F.when(cust(2, 0), rnd(tp / 60000, 3)).alias("postprocess_write_wall_seconds"),
        rnd(tp / 9000, 3).alias("pipeline_wall_seconds"),
        F.lit(None).cast("double").alias("avg_inference_ms_per_frame"), F.lit(None).cast("double").alias("avg_inference_ms_per_image"))
    curve = F.array(F.struct(F.lit(1).alias("scale"), F.col("o_custkey").cast("bigint").alias("items"),
                             rnd(tp / 9000, 3).alias("pipeline_seconds"), F.lit(None).cast("double").alias("inference_seconds")))
    key = F.col("o_orderkey").cast("string")
    return o.select(
        F.when(video, F.lit("video")).otherwise(F.lit("photo")).alias("kind"), F.when(video, key).alias("video_id"),
        F.when(~video & ~cust(5, 0), F.concat(F.lit("batch-"), key)).alias("source_batch"), F.concat(F.lit("g"), key).alias("generated_at_utc"),
        F.when(video & ~cust(3, 0), F.concat(F.lit("cam/"), key, F.lit(".mp4"))).alias("source_video"),
        F.col("o_orderdate").cast("timestamp").alias("_updated_at"), F.when(~video, F.size("lines")).cast("bigint").alias("total_images"),
        counts.alias("run_counts"), F.struct(F.when(~cust(4, 0), rnd(F.least(tp / 500000, F.lit(.98)), 3)).alias("score")).alias("risk_summary"),
        F.when(~cust(7, 0), summaries).alias("class_summaries"), points.alias("dynamics_series"), curve.alias("benchmark_curve"),
        F.when(video & cust(2, 0), frames).alias("top_frames"), F.when(video, frames).alias("frames"), F.when(~video, frames).alias("images"))
