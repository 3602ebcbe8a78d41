"""Streams agree with their batch twins on closed windows."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from keelson.functions import frames as FR
from keelson.operators import media as MD
from keelson.operators import quality as Q
from keelson.plans import catalog as C
from keelson.streaming import streams as ST
from paths import SMOKE


def _events_dir(tmp):
    d = f"{tmp}/events_src"
    os.makedirs(d)
    shutil.copy(f"{SMOKE}/events.parquet", f"{d}/part-0.parquet")
    return d


def test_ingest_files_available_now(spark, tmp):
    os.makedirs(f"{tmp}/in")
    for i in range(3):
        with open(f"{tmp}/in/f{i}.jpg", "wb") as fh:
            fh.write(b"x" * (i + 1))
    q = ST.ingest_files(spark, f"{tmp}/in", f"{tmp}/out", f"{tmp}/ck")
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp}/out").count() == 3


def test_stream_duplicates_equals_batch(spark, tmp):
    """All columns, with null hashes and hashes that differ in the last bit."""
    odd = spark.createDataFrame([(900, i, i % 4 != 1, None if i % 5 == 2 else (1 << 62) + i // 2) for i in range(40)]
                                + [(901, 0, True, None), (901, 1, True, -1), (901, 2, True, -2)],
                                "video_id long, frame_idx long, quality_ok boolean, hash long")
    frames = C.flagged_frames(spark, SMOKE).select("video_id", "frame_idx", "quality_ok", "hash").unionByName(odd)
    path = f"{tmp}/frames"
    frames.write.parquet(path)
    batch = Q.prev_good_hash(spark.read.parquet(path)).select(
        "video_id", "frame_idx", "quality_ok", "hamming_to_prev", "is_duplicate", "prev_dhash")
    sdf = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    q = ST.stream_duplicates(sdf).writeStream.format("memory").queryName("dups").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("dups").select("video_id", "frame_idx", "quality_ok", "hamming_to_prev", "is_duplicate",
                                     F.when(F.col("quality_ok"), FR.hash_to_hex("prev_hash")).alias("prev_dhash"))
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))


def _arrivals(spark, rows, root, batches, seed):
    """Write ``rows`` (video, idx, ok, hash, second) in ``batches`` files; a frame comes up to 40 seconds late."""
    import random
    r = random.Random(seed)
    order = sorted(rows, key=lambda x: x[4] + r.uniform(0, 40))
    size = -(-len(order) // batches)
    parts = [order[i:i + size] for i in range(0, len(order), size)]
    parts.append([(-1, 0, False, None, 10_000.0)])  # moves the watermark past all frames
    for part in parts:
        df = spark.createDataFrame(part, "video_id long, frame_idx long, quality_ok boolean, hash long, s double")
        df.withColumn("at", F.timestamp_micros((F.col("s") * 1e6).cast("long") + 1_700_000_000_000_000)).drop("s").coalesce(1).write.mode("append").parquet(root)


def test_stream_duplicates_in_any_order_equals_batch(spark, tmp):
    """Frames shuffled over several micro-batches: all columns as G1 has them,
    also for a null video, null hashes and frames of one instant."""
    import random
    r = random.Random(1)
    rows = [(v, i, r.choice([True, True, False, None]), None if i % 11 == 5 else (1 << 40) + r.getrandbits(6), i // 2 * 0.5003)
            for v in (1, 2, None) for i in range(120)]
    _arrivals(spark, rows, f"{tmp}/frames", 6, 2)
    sdf = spark.readStream.schema(spark.read.parquet(f"{tmp}/frames").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/frames")
    out = ST.stream_duplicates_in_order(sdf, delay="1 minute")
    q = (out.writeStream.format("parquet").option("path", f"{tmp}/out").option("checkpointLocation", f"{tmp}/ck")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    frames = spark.createDataFrame([x[:2] + (bool(x[2]),) + x[3:4] for x in rows], "video_id long, frame_idx long, quality_ok boolean, hash long")
    batch = Q.prev_good_hash(frames).select("video_id", "frame_idx", "quality_ok", "hamming_to_prev", "is_duplicate", "prev_dhash")
    got = spark.read.parquet(f"{tmp}/out").select("video_id", "frame_idx", "quality_ok", "hamming_to_prev", "is_duplicate",
                                                  F.when(F.col("quality_ok"), FR.hash_to_hex("prev_hash")).alias("prev_dhash"))
    assert len(q.recentProgress) >= 6
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))


def test_state_of_a_finished_video_goes(spark, tmp):
    """``keep`` after its latest frame a video starts anew."""
    def one(i, s):
        return (5, i, True, 77, float(s))
    for part in ([one(0, 0), one(1, 1)], [(-1, 0, False, None, 100.0)], [one(2, 110)], [(-1, 1, False, None, 5000.0)], [one(3, 5010)],
                 [(-1, 2, False, None, 9000.0)]):
        df = spark.createDataFrame(part, "video_id long, frame_idx long, quality_ok boolean, hash long, s double")
        df.withColumn("at", F.timestamp_micros((F.col("s") * 1e6).cast("long") + 1_700_000_000_000_000)).drop("s").coalesce(1).write.mode("append").parquet(f"{tmp}/f")
    sdf = spark.readStream.schema(spark.read.parquet(f"{tmp}/f").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/f")
    out = ST.stream_duplicates_in_order(sdf, delay="10 seconds", keep="10 minutes").where("video_id = 5")
    q = (out.writeStream.format("parquet").option("path", f"{tmp}/out").option("checkpointLocation", f"{tmp}/ck")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.frame_idx: (r.prev_hash, r.is_duplicate) for r in spark.read.parquet(f"{tmp}/out").collect()}
    assert got == {0: (None, False), 1: (77, True), 2: (77, True), 3: (None, False)}


def test_latest_run_table_survives_a_broken_swap(spark, tmp):
    schema = "kind string, run_id long, updated_at timestamp"
    table = f"{tmp}/latest"
    assert ST.current_table(spark, table, spark.createDataFrame([], schema).schema) is None
    one = spark.sql("select 'photo' kind, 1L run_id, timestamp'2024-01-01' updated_at")
    ST.replace_table(one, table)
    os.makedirs(f"{table}/v2")  # a write that broke off
    with open(f"{table}/v2/part-bad.parquet", "w") as fh:
        fh.write("no parquet")
    assert ST.current_table(spark, table, one.schema).count() == 1
    for i in range(2, 5):
        ST.replace_table(one.unionByName(one).limit(i % 2 + 1), table)
        assert ST.current_table(spark, table).count() == i % 2 + 1
    assert sorted(os.listdir(table)) == ["v3", "v4"]  # the current one and the one before
    with open(f"{table}/v4/part-bad.parquet", "w") as fh:
        fh.write("no parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer"):
        ST.current_table(spark, table, one.schema).collect()


def test_stream_bursts_closed_windows_match_batch(spark, tmp):
    src = _events_dir(tmp)
    schema = spark.read.parquet(src).schema
    sdf = spark.readStream.schema(schema).parquet(src).select(F.col("ts").cast("timestamp").alias("modificationTime"),
                                                                F.lit("photos").alias("source_root"))
    q = ST.stream_bursts(sdf).writeStream.format("memory").queryName("bursts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    streamed = spark.table("bursts")
    ev = spark.read.parquet(src).select(F.col("ts").cast("timestamp").alias("modificationTime"),
                                        F.col("event_id").cast("string").alias("path"))
    batch = MD.burst_sessions(ev)
    n_batch = batch.count()
    # append mode withholds the last, still open, session
    assert streamed.count() in (n_batch - 1, n_batch)
    assert streamed.agg(F.sum("photos")).collect()[0][0] <= ev.count()


def test_stream_daily_counts_closed_days(spark, tmp):
    src = _events_dir(tmp)
    sdf = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))
    q = ST.stream_daily_counts(sdf).writeStream.format("memory").queryName("daily").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.day_start, r.event_type): r.n for r in spark.table("daily").collect()}
    ev = spark.read.parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))
    ref = {(r.d, r.event_type): r.n for r in ev.groupBy(F.window("ts", "1 day").start.alias("d"), "event_type")
           .agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got and all(ref[k] == v for k, v in got.items())


def test_stream_latest_run(spark, tmp):
    runs = spark.read.parquet(f"{SMOKE}/orders.parquet").select(
        F.when(F.col("o_orderstatus") == "P", "photo").otherwise("video").alias("kind"),
        F.col("o_custkey").alias("asset_id"), F.col("o_orderkey").alias("run_id"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    src = f"{tmp}/runs_src"
    runs.repartition(3).write.parquet(src)
    sdf = spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", 1).parquet(src)
    ST.stream_latest_run(sdf, f"{tmp}/latest", f"{tmp}/ck").awaitTermination()
    got = {r.kind: r.run_id for r in ST.current_table(spark, f"{tmp}/latest").collect()}
    ref = {r.kind: r.run_id for r in ST.latest_per_kind(runs).collect()}
    assert got == ref


class _State:
    """A handle, its states and its timers in one: counts the calls."""

    def __init__(self):
        self.calls, self.value, self.items, self.times = 0, None, [], []

    def getValueState(self, *_):
        return self

    getListState = getMapState = getValueState

    def _call(self):
        self.calls += 1

    def get(self):
        self._call()
        return self.value

    def iterator(self):
        self._call()
        return iter([])

    def update(self, v):
        self._call()
        self.value = v

    def updateValue(self, k, v):
        self._call()

    removeKey = registerTimer = appendValue = lambda self, *_: self._call()
    clear = _call


class _At:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def _brute_prev(frames, threshold=8):
    last, out = None, []
    for i, ok, h, _ in sorted(frames):
        far = (int(h, 16) ^ int(last, 16)).bit_count() if last is not None and h is not None else None
        out.append((i, last, far))
        last = h if ok and h is not None else last
    return out


def test_a_batch_of_a_video_is_a_few_calls_of_the_state():
    frames = [(i, i % 3 > 0, f"{i * 7919:016x}", 1000 + i) for i in range(500)]
    state = _State()
    p = ST._ordered_dedup(8, 10 ** 9)
    p.init(state)
    rows = [dict(zip(("frame_idx", "quality_ok", "hex", "at"), f, strict=True)) for f in reversed(frames)]
    assert list(p.handleInputRows((5,), iter(rows), _At(0))) == []
    got = list(p.handleExpiredTimer((5,), _At(2000), None))
    assert state.calls <= 10
    assert [(r.frame_idx, r.prev_hex, r.hamming_to_prev) for r in got] == _brute_prev(frames)


def test_packs_beyond_the_value_go_to_the_list():
    class Video(_State):
        """Value state and list state apart."""
        def getListState(self, *_):
            self.list = _List()
            return self.list

    class _List(_State):
        def appendValue(self, v):
            self.items.append(v)

        def get(self):
            return iter(self.items)

        def clear(self):
            self.items = []

    frames = [(i, i % 4 > 0, None if i % 5 == 0 else f"{i * 104729:016x}", 1000 + i) for i in range(40)]
    state = Video()
    p = ST._ordered_dedup(8, 10 ** 9, packed=3)
    p.init(state)
    got = []
    for part in range(4):  # every fourth frame; the watermark stays before the first, then passes half, then all
        rows = [dict(zip(("frame_idx", "quality_ok", "hex", "at"), f, strict=True)) for f in frames[part::4]]
        got += p.handleInputRows((5,), iter(rows), _At(0))
    assert got == [] and len(state.list.items) > 8
    again = dict(zip(("frame_idx", "quality_ok", "hex", "at"), (frames[39][0], True, f"{1:016x}", 1039), strict=True))
    got += p.handleInputRows((5,), iter([again]), _At(1019))  # a repeated index replaces the one that waits
    assert [r.frame_idx for r in got] == list(range(20))
    got += p.handleExpiredTimer((5,), _At(5000), None)
    frames[39] = (39, True, f"{1:016x}", 1039)
    assert [(r.frame_idx, r.prev_hex, r.hamming_to_prev) for r in got] == _brute_prev(frames)
    assert state.list.items == []
