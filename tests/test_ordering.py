"""The chunked ordinal / carry / running sum equal plain windows, also when
one key holds most rows and chunks are tiny."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from keelson.operators.ordering import depth_chunks, index_chunk, last_before, ordinal, running_sum


def _data(spark):
    rows = [(1 if i % 10 else 2, i, (i * 7919) % 1000, None if i % 3 else i) for i in range(3000)]
    return spark.createDataFrame(rows, "k long, t long, v long, x long")


def test_ordinal_matches_row_number(spark):
    df = _data(spark)
    got = ordinal(df, "k", ["t"], name="rn", chunk=index_chunk("t", 17))
    w = Window.partitionBy("k").orderBy("t")
    ref = df.withColumn("rn2", F.row_number().over(w))
    assert got.join(ref, ["k", "t"]).where("rn != rn2").count() == 0
    assert got.count() == df.count()


def test_last_before_matches_window(spark):
    df = ordinal(_data(spark), "k", ["t"], name="rn", chunk=index_chunk("t", 17))
    got = last_before(df, "k", "rn", "x", "prev", chunk_rows=5)
    w = Window.partitionBy("k").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    ref = df.withColumn("prev2", F.last("x", ignorenulls=True).over(w))
    assert got.join(ref.select("k", "t", "prev2"), ["k", "t"]).where("not (prev <=> prev2)").count() == 0


def test_running_sum_matches_window(spark):
    df = _data(spark)
    got = running_sum(df, "k", ["t"], "v", "s", chunk=index_chunk("t", 11))
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("s2", F.sum("v").over(w))
    assert got.join(ref.select("k", "t", "s2"), ["k", "t"]).where("s != s2").count() == 0


def test_hot_key_is_spread_over_tasks(spark):
    """One video with 90% of the rows: the chunked ordinal's window runs
    over (video, hour) groups, so the hot video lands in several tasks."""
    from keelson.operators.ordering import time_chunk
    rows = spark.range(0, 40000).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(F.lit(99)).alias("video_id"),
        (F.lit(1_700_000_000) + F.col("id") * 13).cast("timestamp").alias("ts"), F.col("id").alias("event_id"))
    out = ordinal(rows, "video_id", ["ts", "event_id"], name="rn", chunk=time_chunk("ts"))
    # AQE would coalesce this tiny shuffle into one partition; on a large
    # input partitions stay near the advisory size, so measure without it
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = out.where("video_id = 99").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert parts >= 4
    w = Window.partitionBy("video_id").orderBy("ts", "event_id")
    ref = rows.withColumn("rn2", F.row_number().over(w))
    assert out.join(ref, ["video_id", "event_id"]).where("rn != rn2").count() == 0


def test_null_keys_and_order_values_stay(spark):
    rows = [(k, t, (t or 0) * 3 + (k or 0), t) for k in (1, 2, None) for t in (None, *range(40))]
    df = spark.createDataFrame(rows, "k long, t long, v long, x long")
    got = ordinal(df, "k", ["t"], name="rn", chunk=index_chunk("t", 7), keep_chunk="ck", total="n")
    got = last_before(got, "k", "rn", "x", "prev", chunk="ck")
    got = running_sum(got, "k", ["t"], "v", "s", chunk="ck")
    w = Window.partitionBy("k").orderBy("t")
    ref = df.select("k", "t", F.row_number().over(w).alias("rn"), F.count("*").over(Window.partitionBy("k")).alias("n"),
                    F.last("x", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("prev"),
                    F.sum("v").over(w).alias("s"))
    assert sorted(map(str, got.select("k", "t", "rn", "n", "prev", "s").collect())) == sorted(map(str, ref.collect()))
    assert got.count() == 123


def test_hot_video_stays_spread_through_buckets(spark):
    """Totals come from the chunk summaries: also without broadcasts nothing
    gathers a video that holds most rows (H6 and G4 share this step)."""
    from keelson.operators.selection import add_buckets
    rows = spark.range(0, 200000).select(F.when(F.col("id") % 10 < 8, F.lit(9)).otherwise(F.col("id") % 5).alias("video_id"),
                                         (F.col("id") * 7).alias("frame_idx"))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = add_buckets(rows, 8)
        most = out.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count"), F.count("*")).first()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert most[1] >= 6 and most[0] < 0.5 * 200000


def _uneven(spark, n=24_000):
    """80 % of the rows in one second of one minute, in every source; the rest hours apart; ties in time; one key holds most rows."""
    i = F.col("id")
    when = F.when(i % 5 < 4, F.lit(1_700_000_000)).otherwise(F.lit(1_600_000_000) + i * 7200)
    return spark.range(0, n).select(F.when(i % 10 == 9, i % 3).otherwise(F.lit(7)).alias("k"), when.cast("timestamp").alias("ts"),
                                    F.format_string("f%05d", (i * 7919) % n).alias("path"), (i % 5).alias("v"))


def test_depth_chunks_are_even_and_ordered(spark):
    """One second with 80 % of the rows, and rows hours apart (one per minute
    chunk): the largest chunk stays below twice the mean, and chunks follow the order."""
    df = _uneven(spark)
    out = depth_chunks(df, "k", ["ts", "path"], rows=200)
    sizes = [r["count"] for r in out.where("k = 7").groupBy("_depth").count().collect()]
    assert len(sizes) > 60 and max(sizes) < 2 * sum(sizes) / len(sizes)
    w = Window.partitionBy("k").orderBy("ts", "path")
    falls = out.withColumn("before", F.lag("_depth").over(w)).where("before > _depth").count()
    assert falls == 0 and out.count() == df.count()


def test_chunks_of_a_table_are_bounded(spark, monkeypatch):
    from keelson.operators import ordering
    monkeypatch.setattr(ordering, "MAX_CHUNKS", 16)
    out = depth_chunks(_uneven(spark), "k", ["ts", "path"], rows=10)
    assert out.select("k", "_depth").distinct().count() <= 16 + 4


def test_ordinal_over_depth_chunks_matches_windows(spark):
    df = _uneven(spark, 6000).unionByName(spark.createDataFrame([(None, None, "a", 1), (None, None, "b", 2), (7, None, "z", 3)],
                                                                "k long, ts timestamp, path string, v long"))
    d = depth_chunks(df, "k", ["ts", "path"], rows=50)
    d = ordinal(d, "k", ["ts", "path"], name="rn", chunk=F.col("_depth"), keep_chunk="ck", total="n")
    d = running_sum(last_before(d, "k", "rn", "v", "prev", chunk="ck"), "k", ["ts", "path"], "v", "s", chunk="ck")
    w = Window.partitionBy("k").orderBy("ts", "path")
    ref = df.select("k", "path", F.row_number().over(w).alias("rn"), F.count("*").over(Window.partitionBy("k")).alias("n"),
                    F.lag("v").over(w).alias("prev"), F.sum("v").over(w).alias("s"))
    assert sorted(map(str, d.select("k", "path", "rn", "n", "prev", "s").collect())) == sorted(map(str, ref.collect()))


def test_bursts_and_series_of_uneven_arrivals(spark):
    """G6 and M3 over many chunks equal plain windows over the whole batch."""
    from keelson.operators.media import burst_sessions, risk_series
    df = _uneven(spark, 5000).select(F.col("ts").alias("modificationTime"), "path")
    w = Window.orderBy("modificationTime", "path")
    got = risk_series(df, chunk_rows=100)
    assert got.join(df.withColumn("n", F.row_number().over(w)), "path").where("n <> photo_index").count() == 0
    new = F.coalesce((F.unix_micros("modificationTime") - F.unix_micros(F.lag("modificationTime").over(w)) > 20_000_000).cast("int"), F.lit(1))
    ref = (df.withColumn("new", new).withColumn("session_no", F.sum("new").over(w)).groupBy("session_no")
           .agg(F.min("modificationTime"), F.max("modificationTime"), F.count("*")))
    assert sorted(map(tuple, burst_sessions(df, chunk_rows=100).collect())) == sorted(map(tuple, ref.collect()))
