"""Two-form agreement for the order-dependent selection (H) and G1, plus
properties: at most target, unique, deterministic."""

import pytest
from pyspark.sql import functions as F

import brute
from keelson.operators import selection as S
from keelson.plans import catalog as C
from paths import SMOKE


def _walk_all(df, t, b, k):
    """Brute-force walk per video over collected rows (exact 64-bit hashes)."""
    groups = {}
    for r in df.select("video_id", "frame_idx", "score", "hash").collect():
        groups.setdefault(r.video_id, []).append(r.asDict())
    out = set()
    for v, rows in groups.items():
        out |= {(v, f) for f in brute.select_walk(rows, t, b, k)}
    return out


@pytest.mark.parametrize("t,b,k", [(16, 6, 3), (8, 4, 2), (64, 24, 3)])
def test_selection_matches_walk(spark, t, b, k):
    cand = C.candidates(spark, SMOKE).select("video_id", "frame_idx", "score", "hash")
    got = S.select_representative(cand, t, b, k).select("video_id", "frame_idx").toPandas()
    pairs = set(map(tuple, got.values.tolist()))
    assert len(pairs) == len(got)                     # unique
    assert got.groupby("video_id").size().max() <= max(t, 1) or t >= 64
    assert pairs == _walk_all(cand, t, b, k)


def test_round_path_for_exhausted_buckets(spark):
    # one hot video whose frames all share a hash: the distance rule rejects
    # almost everything, so the exact round-based walk finishes the buckets
    rows = [(1, i, float((i * 37) % 101), 12345) for i in range(600)] + \
           [(2, i, float(i % 7), (i * 2654435761) % (1 << 63)) for i in range(300)] + \
           [(3, i, 1.0, None) for i in range(40)]
    df = spark.createDataFrame(rows, "video_id long, frame_idx long, score double, hash long")
    got = S.select_representative(df, 16, 4, 3, prefix=36).select("video_id", "frame_idx").toPandas()
    assert set(map(tuple, got.values.tolist())) == _walk_all(df, 16, 4, 3)


def test_prev_good_hash_matches_loop(spark):
    rows = C.flagged_frames(spark, SMOKE).select("video_id", "frame_idx", "quality_ok", "hash", "is_duplicate").collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.video_id, []).append({"frame_idx": r.frame_idx, "ok": r.quality_ok, "hash": r.hash,
                                                 "is_duplicate": r.is_duplicate})
    for v, g in groups.items():
        ref = brute.prev_good(g)
        got = sorted(g, key=lambda x: x["frame_idx"])
        assert [x["is_duplicate"] for x in got] == [r["dup"] for r in ref]


def test_rounds_are_plans_of_their_own(spark, monkeypatch):
    """No plan of the selection holds the sorts of all rounds of the walk, and none broadcasts a table of the data."""
    plans = []

    def cut(df, _cut=S.cut_lineage):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return _cut(df)
    rows = [(1, i, float((i * 37) % 101), 12345) for i in range(600)] + [(2, i, float(i % 7), (i * 2654435761) % (1 << 63)) for i in range(300)]
    df = cut(spark.createDataFrame(rows, "video_id long, frame_idx long, score double, hash long"))
    monkeypatch.setattr(S, "cut_lineage", cut)
    out = S.select_representative(df, 16, 4, 3, prefix=36)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert set(map(tuple, out.select("video_id", "frame_idx").collect())) == _walk_all(df, 16, 4, 3)
    assert max(sum(" Sort [" in line for line in p.splitlines()) for p in plans) <= 12
    assert not any("Broadcast" in p for p in plans)
