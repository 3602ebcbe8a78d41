"""Structured Streaming forms of the event-driven parts (M1-M5).

* M1 ``ingest_files`` — new files in a folder -> file index table
  (``binaryFile`` stream, checkpointed, ``availableNow`` or periodic).
* M2 ``stream_duplicates`` — previous-good-hash dedup carried across
  micro-batches in per-video state (``applyInPandasWithState``). Batch twin:
  G1 (same rows when each video's frames arrive in order).
  ``stream_duplicates_in_order`` needs no order of arrival: frames wait in
  state by index (``transformWithState``) until the watermark has passed them.
* M3 ``stream_bursts`` — photo bursts as 20-second session windows with a
  watermark. Batch twin: ``media.burst_sessions``.
* M4 ``stream_daily_counts`` — per-day counts with a watermark; late rows
  beyond it are dropped. Batch twin: ``groupBy(window(ts, '1 day'))``.
* M5 ``stream_latest_run`` — latest run per kind kept fresh with
  ``foreachBatch``: merge the batch with the current table, keep the newest
  per kind, replace the table. Batch twin: G9.

Checkpoint folders are arguments; on a cluster they belong in the shared
folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from keelson import constants as K
from keelson.functions import frames as FR
from keelson.functions import text as TX

LISTING = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
                        T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def ingest_files(spark: SparkSession, src: str, out: str, checkpoint: str, glob: str = "*",
                 available_now: bool = True) -> StreamingQuery:
    """M1: index every new file (path, filename, length, mtime) once."""
    s = (spark.readStream.format("binaryFile").schema(LISTING).option("pathGlobFilter", glob)
         .option("recursiveFileLookup", "true").load(src))
    idx = s.select("path", TX.filename("path").alias("filename"), "length", "modificationTime")
    w = idx.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


DEDUP_OUT = T.StructType([T.StructField("video_id", T.LongType()), T.StructField("frame_idx", T.LongType()),
                          T.StructField("quality_ok", T.BooleanType()), T.StructField("prev_hex", T.StringType()),
                          T.StructField("hamming_to_prev", T.IntegerType()), T.StructField("is_duplicate", T.BooleanType())])
DEDUP_STATE = T.StructType([T.StructField("prev", T.StringType())])


def _dedup_state(threshold: int):
    # self-contained closure: the executors unpickle it without importing keelson
    def fn(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        # hashes travel as hex strings: a pandas column of longs with a null
        # would turn into floats, which lose the low bits
        prev = state.get[0] if state.exists else None
        frames = pd.concat(list(batches)).sort_values("frame_idx")
        prevs, distances, duplicates = [], [], []
        for ok, h in zip(frames["quality_ok"], frames["hex"], strict=True):
            ham = (int(h, 16) ^ int(prev, 16)).bit_count() if prev is not None and h is not None else None
            prevs.append(prev)
            distances.append(ham)
            duplicates.append(ham is not None and ham <= threshold)
            if ok and h is not None:
                prev = h
        if prev is not None:
            state.update((prev,))
        yield pd.DataFrame({
            "video_id": [None if pd.isna(key[0]) else int(key[0])] * len(frames), "frame_idx": frames["frame_idx"].tolist(),
            "quality_ok": frames["quality_ok"].tolist(), "prev_hex": prevs,
            "hamming_to_prev": pd.array(distances, dtype="Int32"), "is_duplicate": duplicates}).astype({"video_id": "Int64"})
    return fn


def stream_duplicates(sdf: DataFrame, threshold: int = K.HAMMING_THRESHOLD) -> DataFrame:
    """M2: ``sdf`` has video_id, frame_idx (not null), quality_ok, hash (long,
    may be null). State per video = the last hash of a quality_ok frame; a
    micro-batch's rows of one video are bounded by the trigger size, so set
    ``maxFilesPerTrigger`` on the source when a video can be large."""
    rows = sdf.select("video_id", "frame_idx", F.coalesce("quality_ok", F.lit(False)).alias("quality_ok"),
                      FR.hash_to_hex("hash").alias("hex"))
    out = rows.groupBy("video_id").applyInPandasWithState(_dedup_state(threshold), DEDUP_OUT, DEDUP_STATE, "append",
                                                          GroupStateTimeout.NoTimeout)
    return out.select("video_id", "frame_idx", "quality_ok", FR.hex_to_hash("prev_hex").alias("prev_hash"),
                      "hamming_to_prev", "is_duplicate")


#: Frames wait in RocksDB state; the default store has no maps and timers.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Frames that a video's state value holds; more go to a list of such packs.
PACKED = 4096


def _ordered_dedup(threshold: int, keep_ms: int, packed: int = PACKED) -> StatefulProcessor:
    # the class is made here so that it is pickled whole: executors needn't import keelson
    class OrderedDedup(StatefulProcessor):
        """State of a video: the last good hash, the latest time seen, the
        earliest one that waits (due), the time of its last timer (ends) and the
        frames that wait, packed as columns: a call of the state costs far more
        than a frame, so there is one to read and one to write. A timer at a
        batch's latest time releases what the watermark has passed; one
        ``keep_ms`` after the latest of all ends the video."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            pack = "idx array<long>, ok array<boolean>, hashes array<string>, at array<long>"
            self.handle = handle
            self.video = handle.getValueState("video", f"hex string, seen long, due long, ends long, more boolean, {pack}")
            self.more = handle.getListState("more", pack)

        def read(self) -> dict:
            held = self.video.get()
            if held is None:
                return {"hex": None, "seen": -1, "due": None, "ends": None, "more": False, "frames": []}
            return dict(zip(("hex", "seen", "due", "ends", "more"), held)) | {"frames": list(zip(*held[5:], strict=True))}

        def write(self, s: dict) -> None:
            def pack(frames):
                return tuple(map(list, zip(*frames, strict=True))) or ([], [], [], [])
            while len(s["frames"]) > packed:
                self.more.appendValue(pack(s["frames"][:packed]))
                s |= {"more": True, "frames": s["frames"][packed:]}
            self.video.update((s["hex"], s["seen"], s["due"], s["ends"], s["more"], *pack(s["frames"])))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            s = self.read()
            # what is due goes out first: new rows are later than the watermark
            yield from self.release(key, s, timerValues.getCurrentWatermarkInMs())
            new = [(r["frame_idx"], r["quality_ok"], r["hex"], r["at"]) for r in rows]
            times = [f[3] for f in new]
            s["frames"] += new
            s["seen"] = max(s["seen"], *times)
            s["due"] = min(times) if s["due"] is None else min(s["due"], *times)
            self.handle.registerTimer(s["seen"])
            if s["ends"] is None:
                s["ends"] = s["seen"] + keep_ms
                self.handle.registerTimer(s["ends"])
            self.write(s)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            s, now = self.read(), timerValues.getCurrentWatermarkInMs()
            if s["seen"] < 0:
                return
            before = s["due"], s["ends"]
            yield from self.release(key, s, now)
            if s["seen"] < 0:
                self.video.clear()
                return
            if s["ends"] <= now:  # frames came since that timer was set
                s["ends"] = s["seen"] + keep_ms
                self.handle.registerTimer(s["ends"])
            if before != (s["due"], s["ends"]):
                self.write(s)

        def release(self, key, s: dict, now: int) -> Iterator[Row]:
            if s["due"] is not None and s["due"] <= now:
                packs = [zip(*p, strict=True) for p in self.more.get()] if s["more"] else []
                # by index; one that came again replaces the one before
                waiting = {f[0]: f for p in [*packs, s["frames"]] for f in p}
                if s["more"]:
                    self.more.clear()
                for idx in sorted(i for i, f in waiting.items() if f[3] <= now):
                    _, ok, h, _ = waiting.pop(idx)
                    last = s["hex"]
                    far = (int(h, 16) ^ int(last, 16)).bit_count() if last is not None and h is not None else None
                    yield Row(video_id=key[0], frame_idx=idx, quality_ok=ok, prev_hex=last, hamming_to_prev=far,
                              is_duplicate=far is not None and far <= threshold)
                    if ok and h is not None:
                        s["hex"] = h
                s |= {"more": False, "frames": list(waiting.values()), "due": min((f[3] for f in waiting.values()), default=None)}
            if 0 <= s["seen"] <= now - keep_ms:
                s |= {"hex": None, "seen": -1, "ends": None}  # nothing has come for so long: the video is over

        def close(self) -> None:
            pass

    return OrderedDedup()


def stream_duplicates_in_order(sdf: DataFrame, at: str = "at", delay: str = "10 minutes", threshold: int = K.HAMMING_THRESHOLD,
                               keep: str = "1 day") -> DataFrame:
    """M2 for frames that arrive in any order: ``sdf`` as for
    :func:`stream_duplicates` and with ``at``, the time of a frame, which
    doesn't fall along a video's frame indices. A frame comes out once the watermark
    (``delay`` behind the latest frame of all videos) has passed it, with the
    answer it has in the whole video; one that comes later than that is
    dropped, as late rows are (times must be after 1970, where watermarks begin). A repeated index replaces the one that waits.
    ``keep`` after its latest frame, a video's state goes: should it go on,
    its next frame is a first one. A task holds a video's frames of ``delay``."""
    spark = sdf.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    keep_ms = spark.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {keep})").first()[0]
    rows = sdf.withWatermark(at, delay).select(
        F.col(at), "video_id", "frame_idx", F.coalesce("quality_ok", F.lit(False)).alias("quality_ok"), FR.hash_to_hex("hash").alias("hex"))
    # whole milliseconds, upwards: a frame is due exactly when the watermark, which has whole ones, has reached it
    rows = rows.select(at, "video_id", "frame_idx", "quality_ok", "hex", F.ceil(F.unix_micros(at) / 1000).cast("bigint").alias("_ms"))
    rows = rows.withColumnRenamed(at, "_event").withColumnRenamed("_ms", "at")
    out = rows.groupBy("video_id").transformWithState(_ordered_dedup(threshold, keep_ms), DEDUP_OUT, "append", "eventTime")
    return out.select("video_id", "frame_idx", "quality_ok", FR.hex_to_hash("prev_hex").alias("prev_hash"),
                      "hamming_to_prev", "is_duplicate")


def stream_bursts(sdf: DataFrame, ts: str = "modificationTime", gap_sec: int = K.PHOTO_BATCH_WINDOW_SEC,
                  watermark: str | None = None, by: str = "source_root") -> DataFrame:
    """M3: one row per burst of a source folder (``by``) once its session
    closes (append mode). Streaming session windows need such a key; each
    folder's session state lives with one task, bounded by the trigger size."""
    wm = watermark or f"{gap_sec} seconds"
    return (sdf.withWatermark(ts, wm).groupBy(by, F.session_window(ts, f"{gap_sec} seconds").alias("burst"))
            .agg(F.count(F.lit(1)).alias("photos"))
            .select(by, F.col("burst.start").alias("session_window_start"), F.col("burst.end").alias("session_window_end"),
                    "photos"))


def stream_daily_counts(sdf: DataFrame, ts: str = "ts", by: str = "event_type", watermark: str = "1 day") -> DataFrame:
    """M4: rows per day and type; windows are emitted once the watermark
    passes them; rows later than the watermark are dropped."""
    return (sdf.withWatermark(ts, watermark).groupBy(F.window(ts, "1 day").alias("day"), by)
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("day.start").alias("day_start"), by, "n"))


def latest_per_kind(df: DataFrame, time_col: str = "updated_at") -> DataFrame:
    """G9 core: newest row per kind (ties: larger run_id)."""
    return df.groupBy("kind").agg(F.max(F.struct(F.col(time_col).alias("_t"), F.col("run_id").alias("_r"),
                                                 F.struct(*[c for c in df.columns if c != "kind"]).alias("row")))
                                  .alias("m")).select("kind", "m.row.*")


def _folders(spark: SparkSession, path: str):
    """Hadoop's file system of ``path`` and a maker of its paths."""
    to = spark._jvm.org.apache.hadoop.fs.Path
    return to(path).getFileSystem(spark._jsc.hadoopConfiguration()), to


def _versions(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the table's complete versions: folders that Spark's commit has marked."""
    fs, to = _folders(spark, table)
    if not fs.exists(to(table)):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(to(table)) if f.isDirectory()]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(to(f"{table}/{n}/_SUCCESS")))


def replace_table(df: DataFrame, table: str) -> None:
    """Write ``df`` as the next version of ``table``, a folder beside the
    others. Nothing is renamed: a version counts from the moment that the
    write's commit marks it, so a reader finds the old or the new table and a
    broken write leaves the old one. The version before stays for its readers."""
    fs, to = _folders(df.sparkSession, table)
    held = _versions(df.sparkSession, table)
    df.write.mode("overwrite").parquet(f"{table}/v{(held or [0])[-1] + 1}")
    for old in held[:-1]:
        fs.delete(to(f"{table}/v{old}"), True)


def current_table(spark: SparkSession, table: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The newest complete version; None before the first. Read errors are raised."""
    held = _versions(spark, table)
    if not held:
        return None
    read = spark.read if schema is None else spark.read.schema(schema)
    return read.parquet(f"{table}/v{held[-1]}")


def stream_latest_run(sdf: DataFrame, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """M5: keep ``table`` = latest run per kind. Each micro-batch is merged
    with the current table; the result (at most one row per kind) is the next
    version. Read it with :func:`current_table`."""
    def merge(batch: DataFrame, epoch: int) -> None:
        cur = current_table(batch.sparkSession, table, batch.schema)
        replace_table(latest_per_kind(batch if cur is None else batch.unionByName(cur)), table)

    w = sdf.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
