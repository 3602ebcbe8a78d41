"""Frames by time segments (A4, A5) against one task per video."""

import os

import pytest
from pyspark.sql import functions as F

from keelson.sources import readers as R
from keelson.sources.frame_source import COLUMNS, NO_FRAMES, read_frames

PROBE = "path string, fps double, duration_sec double"
VIDEOS = [("/v/long.mp4", 25.0, 400.0), ("/v/short.mov", 30.0, 3.0), ("/v/past.mp4", 25.0, 5.0), ("/v/late.mp4", 25.0, 100.0),
          ("/v/empty.mp4", 25.0, 9.0), ("/v/unknown.avi", 0.0, 0.0), ("/v/slow.mkv", 1.0, 60.0)]


def decoder(log=None):
    """A seekable video: a frame's bytes tell its time. ``late`` has none but from 0."""
    def decode(path, start, every_n, max_frames):
        if log:
            with open(f"{log}/{os.getpid()}-{path.replace('/', '_')}-{start:.3f}", "w"):
                pass
        fps, seconds = {"/v/long.mp4": (25.0, 400.0), "/v/short.mov": (30.0, 3.0), "/v/past.mp4": (25.0, 5.0), "/v/late.mp4": (25.0, 100.0),
                        "/v/empty.mp4": (25.0, 0.0), "/v/unknown.avi": (25.0, 11.0), "/v/slow.mkv": (1.0, 60.0)}[path]
        step = 1 / max(fps / max(every_n, 1), 0.2)
        for k in range(max_frames):
            at = start + k * step
            if at >= seconds - 1e-9 or (path == "/v/late.mp4" and start > 0):
                return
            yield k, f"{path}@{at:.4f}".encode()
    return decode


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("segment", [1, 7, 256])
@pytest.mark.parametrize("most", [50, 960])
def test_segments_equal_one_task(spark, segment, most):
    probed = spark.createDataFrame(VIDEOS, PROBE)
    one = R.extract_frames(probed, decoder(), 6.0, 12, most, report_empty=True)
    cut = read_frames(spark, probed, decoder(), 6.0, 12, most, segment, report_empty=True)
    cols = ["path", "video_id", "trim_start_sec", "frame_idx", "timestamp_sec", "content", "error"]
    assert rows(cut.select(*cols)) == rows(one.select(*cols))
    assert cut.where("error IS NOT NULL").select("video_id", "error").collect() == [("empty", NO_FRAMES)]


def test_a_long_video_is_spread(spark):
    probed = spark.createDataFrame(VIDEOS[:1], PROBE)
    got = read_frames(spark, probed, decoder(), 0.0, 1, 10_000, 500)
    parts = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) == 20 and {r["count"] for r in parts} == {500}


def test_without_content_nothing_is_decoded(spark, tmp):
    probed = spark.createDataFrame(VIDEOS[:3], PROBE)
    got = read_frames(spark, probed, decoder(tmp), 2.0, 12, 960, 40, columns=["video_id", "frame_idx", "source_timestamp_sec"])
    whole = read_frames(spark, probed, decoder(), 2.0, 12, 960, 40)
    assert got.columns == ["video_id", "frame_idx", "source_timestamp_sec"]
    assert rows(got) == rows(whole.select(*got.columns)) and not os.listdir(tmp)


@pytest.mark.parametrize("where", ["source_timestamp_sec >= 100 AND source_timestamp_sec < 130.5", "frame_idx = 600", "timestamp_sec > 385",
                                   "video_id = 'short'", "path IN ('/v/long.mp4', '/v/past.mp4') AND timestamp_sec <= 1", "frame_idx < 0"])
def test_predicates_cut_the_plan(spark, tmp, where):
    probed = spark.createDataFrame(VIDEOS[:3], PROBE)
    want = rows(R.extract_frames(probed, decoder(), 4.0, 12, 960).withColumn(
        "source_timestamp_sec", F.col("trim_start_sec") + F.col("timestamp_sec")).where(where).select(*COLUMNS[:2], "frame_idx", "content"))
    got = read_frames(spark, probed, decoder(tmp), 4.0, 12, 960, 20).where(where)
    assert rows(got.select(*COLUMNS[:2], "frame_idx", "content")) == want
    opened = len([f for f in os.listdir(tmp) if "long" in f])
    assert opened <= 6  # of 42 segments


def test_no_videos(spark):
    assert read_frames(spark, spark.createDataFrame([], PROBE), decoder(), 0.0, 1, 10).count() == 0
