"""Worked values (FIXTURES §4) for the column functions."""

import pytest
from pyspark.sql import functions as F

from keelson.functions import classes as CL
from keelson.functions import frames as FR
from keelson.functions import risk as RK
from keelson.functions import text as TX
from keelson.operators.selection import coverage_bucket


def one(spark, col):
    return spark.range(1).select(col.alias("v")).collect()[0]["v"]


def ratios_map(d):
    return F.create_map(*[x for k, v in sorted(d.items()) for x in (F.lit(k), F.lit(float(v)))]) if d else \
        F.create_map().cast("map<int,double>")


@pytest.mark.parametrize("ratios,expected", [
    ({}, 0.0), ({0: 1.0}, 0.0), ({1: 1.0}, 0.27), ({0: .5, 1: .3, 9: .2}, 0.495),
    ({2: .4, 6: .1, 1: .5}, 0.449), ({9: 1.0}, 0.98), ({6: .5, 9: .05, 0: .45}, 0.495)])
def test_risk_score(spark, ratios, expected):
    assert one(spark, RK.risk_score(ratios_map(ratios))) == pytest.approx(expected)


@pytest.mark.parametrize("b,lap,expected", [(118, 50, 136.0), (12, 18, 23.129492), (59, 0, 50.0), (250, 100, 72.0),
                                            (300, 10, 7.2)])
def test_quality_score(spark, b, lap, expected):
    assert one(spark, FR.quality_score(F.lit(float(b)), F.lit(float(lap)))) == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize("grid,expected", [
    (list(range(72)), "ffffffffffffffff"), ([5] * 72, "0000000000000000"),
    ([i % 2 for i in range(9)] * 8, "aaaaaaaaaaaaaaaa")])
def test_dhash(spark, grid, expected):
    assert one(spark, FR.dhash_hex(F.array(*[F.lit(float(v)) for v in grid]), 9)) == expected


def test_hamming(spark):
    a, b = FR.hex_to_hash(F.lit("f000000000000001")), FR.hex_to_hash(F.lit("0000000000000001"))
    assert one(spark, FR.hamming(a, b)) == 4
    assert one(spark, FR.hamming(a, F.lit(None).cast("bigint"))) is None
    assert one(spark, FR.visual_distance(a, F.lit(None).cast("bigint"))) == 64


def test_coverage_bucket_not_ntile(spark):
    df = spark.range(1, 11).select(coverage_bucket(F.col("id"), F.lit(10), 4).alias("b")).orderBy(F.monotonically_increasing_id())
    assert [r.b for r in df.collect()] == [0, 0, 1, 1, 1, 2, 2, 3, 3, 3]


def test_apportion(spark):
    s = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(v).alias("score")) for i, v in ((9, .9), (6, .5), (2, .4))])
    assert dict(one(spark, CL.apportion(F.lit(1000), s))) == {9: 500, 6: 278, 2: 222}
    s2 = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(v).alias("score")) for i, v in ((9, .5), (2, .5))])
    assert dict(one(spark, CL.apportion(F.lit(7), s2))) == {9: 4, 2: 3}


def test_benchmark_curve(spark):
    v = one(spark, RK.benchmark_curve(F.lit(64), F.lit(24.0), F.lit(8.0), "video"))
    assert [p["pipeline_seconds"] for p in v] == [24.0, 44.64, 65.28, 85.92]
    p = one(spark, RK.benchmark_curve(F.lit(10), F.lit(5.0), F.lit(2.0), "photo"))
    assert [x["pipeline_seconds"] for x in p] == [5.0, 9.4, 13.8, 18.2]
    assert one(spark, F.size(RK.benchmark_curve(F.lit(0), F.lit(5.0), F.lit(2.0), "photo"))) == 0


def test_bands(spark):
    assert one(spark, RK.risk_band(F.lit(0.40), "pipeline")) == "Низкий"
    assert one(spark, RK.risk_band(F.lit(0.40), "dashboard")) == "Средний"


def test_hex_and_safe_name(spark):
    assert one(spark, TX.rgb_hex(F.lit(59), F.lit(130), F.lit(246))) == "#3b82f6"
    assert one(spark, TX.safe_name(F.lit("..a_b._"))) == "a_b"
    assert one(spark, TX.safe_name(F.lit("a b/é-1.x"))) == "a_b_é-1.x"
    assert one(spark, TX.safe_name(F.lit("..."), "item")) == "item"


def test_imputation(spark):
    c = one(spark, RK.effective_video_counts(F.lit(100), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0.0), F.lit(10.0)))
    assert (c["quality_ok_frames"], c["deduplicated_frames"], c["processed_frames"], c["segmented_frames"]) == (78, 67, 62, 59)
    assert c["inference_wall_seconds"] == pytest.approx(3.1) and c["imputed"]


def test_primary_sign_and_dominant(spark):
    counts = F.create_map(F.lit(0), F.lit(10).cast("bigint"), F.lit(1), F.lit(5).cast("bigint"),
                          F.lit(6), F.lit(5).cast("bigint"))
    assert one(spark, CL.dominant_class(counts)) == 1          # tie -> lowest id
    assert list(one(spark, CL.predicted_ids(counts))) == [1, 6]
    assert one(spark, CL.primary_sign(CL.predicted_ids(counts), CL.dominant_class(counts))) == 6


def test_laplacian_var_flat_and_edge(spark):
    flat = F.array(*[F.lit(3.0)] * 16)
    assert one(spark, FR.laplacian_var(flat, F.lit(4), F.lit(4))) == pytest.approx(0.0)
    import numpy as np
    g = np.arange(16, dtype=float).reshape(4, 4) ** 2
    p = np.pad(g, 1, mode="reflect")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    got = one(spark, FR.laplacian_var(F.array(*[F.lit(float(v)) for v in g.ravel()]), F.lit(4), F.lit(4)))
    assert got == pytest.approx(lap.var())


def test_apportion_works_its_list_out_once(spark, tmp_path):
    """The ranked list stands once in the plan of F8, not again for its sum, its size, every class and a filter."""
    from keelson.plans import catalog
    lines = [(1, 10, 2, 5.0), (1, 10, 3, 4.0), (1, 10, 5, 1.0), (2, 10, 5, 7.0), (3, 11, 1, 5.0), (4, 11, 4, 6.0), (None, 11, 2, 1.0)]
    (spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double")
     .write.parquet(f"{tmp_path}/lineitem.parquet"))
    out = catalog.f8_apportion(spark, str(tmp_path))
    assert {tuple(r) for r in out.collect()} == {(10, 1, 2, 5), (10, 1, 6, 4), (11, 4, 9, 6), (11, None, 2, 1)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort") == 1, plan
