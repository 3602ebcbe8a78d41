"""Near frames (E8) against all pairs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from keelson.operators import near as N


def brute(rows, d):
    """rows: (video, bucket, idx, hash) -> smallest earlier near frame of each."""
    out = []
    for v, b, i, h in rows:
        near = [j for w, c, j, g in rows if (w, c) == (v, b) and j < i and h is not None and g is not None
                and ((h ^ g) & (2 ** 64 - 1)).bit_count() <= d]
        out.append((v, b, i, h, min(near, default=None)))
    return sorted(out, key=str)


def frames(n, seed):
    r = random.Random(seed)
    seeds = [r.getrandbits(64) for _ in range(5)] + [0, 2 ** 64 - 1]
    rows = []
    for i in range(n):
        h = r.choice(seeds)
        for _ in range(r.randint(0, 5)):
            h ^= 1 << r.randrange(64)
        h = h - 2 ** 64 if h >> 63 else h
        rows.append((r.choice([1, 2, None]), r.choice([0, 1, None]), r.choice([i, i, i - 1]), None if r.random() < .05 else h))
    return rows


SCHEMA = "video_id long, bucket int, frame_idx long, hash long"


@pytest.mark.parametrize(("d", "spare"), [(0, None), (1, None), (3, 0), (6, None), (6, 2), (62, None)])
def test_near_frames_match_all_pairs(spark, d, spare):
    rows = frames(250, d)
    got = N.near_frames(spark.createDataFrame(rows, SCHEMA), d, spare=spare)
    assert got.columns == ["video_id", "bucket", "frame_idx", "hash", "near_idx"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, d)


@pytest.mark.parametrize("parts", [2, 16])
def test_hot_cells_and_classes_are_salted(spark, monkeypatch, parts):
    monkeypatch.setattr(N, "PARTS", parts)
    rows = [(1, 0, i, i % 40) for i in range(200)] + [(1, 0, 200 + i, 7) for i in range(200)] + frames(60, 9)
    got = N.near_frames(spark.createDataFrame(rows, SCHEMA), 2)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 2)


def test_masks_cover_every_difference():
    r = random.Random(2)
    for d, spare in ((1, 0), (3, 1), (6, 1), (6, 2)):
        masks = N.band_masks(d, spare)
        assert len(masks) == N.index_rows(d, spare)
        for _ in range(300):
            flips = sum(1 << b for b in r.sample(range(64), d))
            assert any(not (flips & m) for m in masks)


def test_plan_has_no_product_and_equal_hashes_stay_linear(spark):
    """A bucket of 20,000 equal hashes is one class; no join forms pairs of rows."""
    same = spark.createDataFrame([(1, 0, i, 5) for i in range(20_000)], SCHEMA)
    got = N.near_frames(same, 6)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert got.agg(F.count("near_idx"), F.max("near_idx"), F.count(F.lit(1))).first()[:] == (19_999, 0, 20_000)


def test_no_frames(spark):
    assert N.near_frames(spark.createDataFrame([], SCHEMA), 1).count() == 0
    assert N.near_frames(spark.createDataFrame([(1, 0, 0, None)], SCHEMA), 1).collect()[0].near_idx is None


def test_only_hot_keys_are_broadcast(spark, monkeypatch):
    plans = []

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def cut(df, _cut=N.cut_lineage):
        plans.append(plan(df))
        return _cut(df)
    monkeypatch.setattr(N, "cut_lineage", cut)
    plans.append(plan(N.near_frames(spark.createDataFrame(frames(60, 3), SCHEMA), 6)))
    joins = [line.split("HashJoin ")[1] for p in plans for line in p.splitlines() if "BroadcastHashJoin " in line]
    assert joins
    for keys in joins:
        left, right = keys.split("], [")
        assert ("_hot#" in left and "BuildLeft" in right) or ("_hot#" in right and "BuildRight" in right), keys


@pytest.mark.parametrize(("whole", "turn", "parts"), [(0, 1, 1024), (20, 3_000, 16), (28, 10 ** 6, 2)])
def test_large_groups_go_through_the_index_in_turns(spark, monkeypatch, whole, turn, parts):
    """No group, some and most are compared whole; a turn of the index is one choice of bands, some or all."""
    for k, v in (("WHOLE", whole), ("TURN", turn), ("PARTS", parts)):
        monkeypatch.setattr(N, k, v)
    rows = frames(250, 4) + [(5, 0, i, 3 * i) for i in range(60)] + [(6, 0, i, 7) for i in range(60)]
    for d in (1, 3):
        got = N.near_frames(spark.createDataFrame(rows, SCHEMA), d)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, d)


def test_cells_of_one_number_are_told_apart(spark, monkeypatch):
    """Groups that meet in the index by chance are no groups of each other."""
    monkeypatch.setattr(N, "WHOLE", 0)
    monkeypatch.setattr(N.F, "xxhash64", lambda *c: N.F.lit(0).cast("bigint"))
    rows = frames(60, 5)
    got = N.near_frames(spark.createDataFrame(rows, SCHEMA), 2)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 2)


def test_small_groups_write_no_index_and_leave_two_tables(spark, monkeypatch):
    """A class of a small group is shuffled as it is, not once per choice of bands (28 for six bits)."""
    plans, made = [], []

    def cut(df, _cut=N.cut_lineage):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        made.append(_cut(df))
        return made[-1]
    monkeypatch.setattr(N, "cut_lineage", cut)
    rows = [(i // 50, 0, i % 50, i * 37 % 1000) for i in range(400)]
    got = N.near_frames(spark.createDataFrame(rows, SCHEMA), 6)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 6)
    assert plans and not any("Generate" in p for p in plans)
    there = [os.path.exists(df.inputFiles()[0].removeprefix("file:")) for df in made]
    assert sum(there) == 2, there
