"""Frames of videos as a data source whose partitions are time segments (A4, A5).

``extract_frames`` gives a video to one task; a long one is then the job's
tail. Here the driver plans segments of ``segment_frames`` sampled frames from
the probe's rows (one small entry per segment, as Spark's file index has one
per file), and every segment is a partition that seeks to its own start.

* Columns: without ``content`` nothing is decoded; rows come from the plan.
* Predicates on ``path`` and ``video_id`` drop videos, those on ``frame_idx``,
  ``timestamp_sec`` and ``source_timestamp_sec`` cut the range of frames before
  segments are planned. Spark tests all of them again, so they only save work.

The decoder must be able to seek: its k-th frame from ``start_sec`` is the
video's at ``start_sec + k / sample_fps``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
                                    InputPartition, LessThan, LessThanOrEqual)

from keelson.functions import frames as FR
from keelson.session import ship_package

NO_FRAMES = "no frames in the video"
DEFAULT_FPS, LEAST_SAMPLE_FPS = 25.0, 0.2
BATCH_BYTES = 16_000_000
SCHEMA = ("path string, video_id string, trim_start_sec double, frame_idx long, timestamp_sec double, "
          "source_timestamp_sec double, content binary, error string")
TYPES = dict(c.split() for c in SCHEMA.split(", "))
COLUMNS = list(TYPES)


@dataclass(frozen=True)
class Video:
    path: str
    fps: float
    start: float
    frames: int  # planned; -1 if the duration isn't known

    @property
    def video_id(self) -> str:
        return re.sub(r"\.[^.]*$", "", self.path.rsplit("/", 1)[-1])


@dataclass(frozen=True)
class Plan:
    every_n: int
    max_frames: int
    segment_frames: int
    report_empty: bool

    def step(self, v: Video) -> float:
        """Seconds from one sampled frame to the next."""
        fps = v.fps if v.fps > 0 else DEFAULT_FPS
        return 1 / max(fps / max(self.every_n, 1), LEAST_SAMPLE_FPS)

    def row(self, v: Video, k: int, start: float) -> dict:
        """The columns of the k-th sampled frame but its content, as ``extract_frames`` has them."""
        idx = k * max(self.every_n, 1)
        at = idx / v.fps if v.fps > 0 else None
        return {"path": v.path, "video_id": v.video_id, "trim_start_sec": start, "frame_idx": idx, "timestamp_sec": at,
                "source_timestamp_sec": start + (at or 0.0), "error": None}


class Segment(InputPartition):
    def __init__(self, video: Video, first: int, count: int, last: bool):
        super().__init__((video.path, first))
        self.video, self.first, self.count, self.last = video, first, count, last


def planned_range(plan: Plan, v: Video, tests: list[tuple[str, str, object]]) -> tuple[int, int]:
    """The ordinals [a, b) that pass the pushed comparisons; the compared
    columns don't fall with the ordinal, so each comparison cuts one end."""
    n = v.frames if v.frames >= 0 else plan.max_frames
    a, b = 0, n

    def first(holds: Callable[[int], bool]) -> int:
        low, high = 0, n
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if holds(mid) else (mid + 1, high)
        return low

    for column, op, want in tests:
        values = (lambda k, c=column: plan.row(v, k, v.start)[c])
        if n and values(0) is None:
            return 0, 0  # a comparison with null never holds
        if op in (">", ">=", "="):
            a = max(a, first(lambda k: values(k) > want if op == ">" else values(k) >= want))
        if op in ("<", "<=", "="):
            b = min(b, first(lambda k: values(k) >= want if op == "<" else values(k) > want))
    return a, b


class SegmentReader(DataSourceReader):
    OPS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}

    def __init__(self, plan: Plan, videos: list[Video], decode: Callable, more: dict, schema) -> None:
        self.plan, self.videos, self.decode, self.more = plan, videos, decode, more
        self.columns = [f.name for f in schema.fields]
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in ("path", "video_id") and isinstance(f, (EqualTo, In)):
                among = set(f.value) if isinstance(f, In) else {f.value}
                self.videos = [v for v in self.videos if getattr(v, column) in among]
            elif column in ("frame_idx", "timestamp_sec", "source_timestamp_sec") and type(f) in self.OPS and f.value is not None:
                self.tests.append((column, self.OPS[type(f)], f.value))
            yield f

    def partitions(self) -> list[InputPartition]:
        out = []
        for v in self.videos:
            if v.frames < 0:  # nothing to plan by: one task
                out.append(Segment(v, 0, self.plan.max_frames, True))
                continue
            a, b = planned_range(self.plan, v, self.tests)
            size = self.plan.segment_frames
            # segments keep their places whatever the range is; the first one always
            # runs, since it alone tells whether the start has frames at all
            for first in range(0, max(v.frames, 1), size):
                if first == 0 or (first < b and first + size > a):
                    out.append(Segment(v, first, size, first + size >= v.frames))
        return out

    def read(self, partition: Segment | None) -> Iterator:
        import pyarrow as pa

        if partition is None:
            return
        kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "binary": pa.binary()}
        types = pa.schema([(c, kinds[TYPES[c]]) for c in self.columns])
        rows: list[dict] = []
        held = 0
        for row in self.rows(partition):
            rows.append({c: row.get(c) for c in self.columns})
            held += 200 + len(row.get("content") or b"")
            if held > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, types)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, types)

    def rows(self, s: Segment) -> Iterator[dict]:
        v, plan = s.video, self.plan
        if "content" not in self.columns and v.frames >= 0:
            for k in range(s.first, min(s.first + s.count, v.frames)):
                yield plan.row(v, k, v.start)
            return
        # the last segment takes what the decoder still has, the probe may be short
        count = plan.max_frames - s.first if s.last else s.count
        begin = v.start + s.first * plan.step(v)
        n = 0
        for row in self.decoded(v, begin, count, s.first, v.start):
            n += 1
            yield row
        if s.first or n:
            return
        if v.start > 0:  # no frames from the start: all segments are empty, and this one reads from 0
            for row in self.decoded(v, 0.0, plan.max_frames, 0, 0.0):
                n += 1
                yield row
        if not n and plan.report_empty:
            yield {"path": v.path, "video_id": v.video_id, "trim_start_sec": 0.0, "error": NO_FRAMES}

    def decoded(self, v: Video, begin: float, count: int, first: int, start: float) -> Iterator[dict]:
        for n, (k, content) in enumerate(self.decode(v.path, begin, self.plan.every_n, count, **self.more)):
            if n >= count:
                return
            yield self.plan.row(v, first + int(k), start) | {"content": bytes(content)}


def read_frames(spark: SparkSession, probed: DataFrame, decode_fn: Callable[..., Iterator[tuple[int, bytes]]], start_sec: float,
                every_n: int, max_frames: int, segment_frames: int = 256, crop: tuple[float, float, float, float] | None = None,
                size: tuple[int, int] | None = None, report_empty: bool = False, columns: list[str] | None = None) -> DataFrame:
    """A4 + A5: the sampled frames of all videos in ``probed`` (path, fps,
    duration_sec), the rows of ``extract_frames`` with one task per segment.
    ``decode_fn``, ``crop`` and ``size`` are as there. ``columns`` are the ones
    to read (default: all); without ``content`` no video is opened."""
    from keelson.sources.readers import decoder_options

    start = FR.effective_start(F.lit(float(start_sec)), F.col("duration_sec")).cast("double")
    fps = F.coalesce(F.col("fps"), F.lit(0.0))
    videos = []
    for r in probed.select("path", fps.alias("fps"), "duration_sec", start.alias("start")).toLocalIterator():
        known = (r.duration_sec or 0) > 0
        rate = max((r.fps if r.fps > 0 else DEFAULT_FPS) / max(every_n, 1), LEAST_SAMPLE_FPS)
        frames = max(0, min(max_frames, ceil((r.duration_sec - r.start) * rate))) if known else -1
        videos.append(Video(r.path, float(r.fps), float(r.start), frames))
    plan, more = Plan(every_n, max_frames, max(1, segment_frames), report_empty), decoder_options(crop, size)
    name = f"keelson_frames_{uuid.uuid4().hex}"

    class Frames(DataSource):
        """The segments of one call."""

        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return SegmentReader(plan, list(videos), decode_fn, more, schema)

    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Frames)
    wanted = [c for c in COLUMNS if c in columns] if columns else [c for c in COLUMNS if report_empty or c != "error"]
    return spark.read.format(name).schema(", ".join(f"{c} {TYPES[c]}" for c in wanted)).load()
