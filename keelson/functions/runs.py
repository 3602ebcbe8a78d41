"""Run-length masks: array<struct<value int, length int>>, in pixel order.

A mask has few classes in large areas, so its runs are a small part of its
pixels. Neighbouring runs may have the same value; empty masks have no runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from keelson.functions.frames import class_color_map, let

RUNS = "array<struct<value:int,length:int>>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_runs(mask) -> Column:
    """array<int> -> its runs; null -> null."""
    def runs(m):
        n = F.size(m)
        every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(every, lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)))
        return let(starts, lambda s: F.transform(s, lambda at, k: F.struct(
            F.get(m, at).cast("int").alias("value"), (F.coalesce(F.get(s, k + 1), n) - at).alias("length"))))
    return F.when(_c(mask).isNotNull(), let(_c(mask), runs)).cast(RUNS)


def from_runs(runs) -> Column:
    """The pixels of a run-length mask (small masks: a report, a test)."""
    return F.flatten(F.transform(_c(runs), lambda r: F.array_repeat(r["value"], r["length"])))


def map_runs(runs, value: Callable[[Column], Column]) -> Column:
    """The runs with other values."""
    return F.transform(_c(runs), lambda r: F.struct(value(r["value"]).cast("int").alias("value"), r["length"].alias("length")))


def run_pixels(runs, value: int | None = None) -> Column:
    """Pixels of all runs, or of those with ``value``."""
    some = _c(runs) if value is None else F.filter(_c(runs), lambda r: r["value"] == value)
    return F.aggregate(some, F.lit(0).cast("bigint"), lambda n, r: n + r["length"])


def count_runs(runs) -> Column:
    """F3 on runs: map of each value to its pixels, in order of the values."""
    kinds = F.array_sort(F.array_distinct(F.transform(_c(runs), lambda r: r["value"])))
    return F.map_from_arrays(kinds, F.transform(kinds, lambda v: F.aggregate(
        F.filter(_c(runs), lambda r: r["value"] == v), F.lit(0).cast("bigint"), lambda n, r: n + r["length"])))


def colorize_runs(runs) -> Column:
    """C15 on runs: array<struct<rgb array<int>, length int>>; black when the id is unknown."""
    colors, black = class_color_map(), F.array(F.lit(0), F.lit(0), F.lit(0))
    return F.transform(_c(runs), lambda r: F.struct(
        F.coalesce(F.element_at(colors, r["value"]), black).alias("rgb"), r["length"].alias("length")))
