"""Images as bytes and masks as runs, held against the list forms and plain NumPy."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson import constants as K
from keelson.functions import classes as CL
from keelson.functions import runs as RN
from keelson.operators import inference as INF
from keelson.operators import pixels as PX


def image(i, h=6, w=8):
    return np.random.default_rng(i).integers(0, 256, (h, w, 3)).astype(np.uint8)


def packed(a):
    return bytearray(np.array(a.shape, np.int32).tobytes() + a.tobytes())


@pytest.fixture()
def unpack():
    """The reading half of :func:`packed`; a closure, which tasks get by value."""
    def read(b):
        if len(b) < 12:
            return None
        return np.frombuffer(b[12:], np.uint8).reshape(np.frombuffer(b[:12], np.int32))
    return read


def contents(spark):
    rows = [(i, packed(image(i, 5 + i, 8))) for i in range(4)] + [(4, None), (5, bytearray(b"x")), (6, packed(image(6))[:-1]), (None, packed(image(7))), (0, packed(image(0, 1, 1)))]
    return spark.createDataFrame([(*r, "x") for r in rows], "frame_id long, content binary, status string")


def test_runs_of_masks(spark):
    masks = [[], [3], [0, 0, 0], [1, 1, 2, 2, 2, 1], [5, 4, 5, 4], None]
    df = spark.createDataFrame(list(enumerate(masks)), "id long, mask array<int>").withColumn("r", RN.to_runs("mask"))
    got = {r.id: r for r in df.select("*", RN.from_runs("r").alias("back"), RN.count_runs("r").alias("n"), CL.count_values("mask").alias("want"),
                                      RN.run_pixels("r").alias("all"), RN.run_pixels("r", 2).alias("two"),
                                      RN.from_runs(RN.map_runs("r", lambda v: v + 1)).alias("more")).collect()}
    assert [tuple(x) for x in got[3].r] == [(1, 2), (2, 3), (1, 1)] and got[0].r == [] and got[5].r is None
    for i, m in enumerate(masks[:-1]):
        assert got[i].back == m and got[i].n == got[i].want and got[i]["all"] == len(m) and got[i].two == m.count(2)
        assert got[i].more == [v + 1 for v in m]
    assert got[5].back is None and got[5].n is None


def test_decoded_pixels_and_error_rows(spark, monkeypatch, unpack):
    monkeypatch.setattr(PX, "OUT_BYTES", 300)  # many batches
    ok, bad = PX.split_decoded(PX.decode_pixels(contents(spark), unpack))
    rows = ok.collect()
    assert sorted(str(r.frame_id) for r in rows) == ["0", "0", "1", "2", "3", "None"]
    for r in rows:
        want = {1: image(0, 1, 1)}.get(r.height) if r.frame_id == 0 and r.height == 1 else image(7) if r.frame_id is None else image(r.frame_id, 5 + r.frame_id, 8)
        assert (r.height, r.width, r.channels) == want.shape and bytes(r.pixels) == want.tobytes()
    errors = {r.frame_id: r for r in bad.collect()}
    assert set(errors) == {4, 5, 6} and errors[5].error == "undecodable" and "reshape" in errors[6].error and errors[4].status == "error"
    assert PX.decode_pixels(contents(spark).limit(0), unpack).count() == 0


def test_preprocessed_images_equal_the_list_form(spark, unpack):
    def gray(b):
        a = unpack(b)
        return None if a is None else a[:, :, 0]
    crop = (0.1, 0.0, 0.9, 0.7)
    df = contents(spark)
    lists = {(r.frame_id, r.crop_y2): r for r in INF.preprocess_frames(df, gray, crop, 3, 2).collect()}
    got = {(r.frame_id, r.crop_y2): r for r in PX.preprocess_pixels(df, gray, lambda a: zlib.compress(a.tobytes()), crop, 3, 2).collect()}
    assert set(got) == set(lists)
    for key, r in got.items():
        old = lists[key]
        assert (r.status, r.error, r.crop_x1, r.crop_y1, r.crop_x2, r.processed_width) == (old.status, old.error, old.crop_x1, old.crop_y1, old.crop_x2, old.width)
        if r.status == "ok":
            out = np.frombuffer(zlib.decompress(r.processed_content), np.uint8)
            assert np.array_equal(out, np.rint(old.gray)) and r.norm_mean == pytest.approx(out.mean() / 255)

    def refuse(a):
        raise RuntimeError("Could not encode")
    assert {r.error for r in PX.preprocess_pixels(df, unpack, refuse, crop, 3, 2).filter("frame_id < 4").collect()} == {"Could not encode"}


@pytest.mark.parametrize("mode", K.PREDICTION_MODES)
def test_scored_runs_equal_the_list_form(spark, mode):
    channels = 1 if mode == K.PREDICTION_MODES[2] else 4
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(0, 5, 12 * (1 + i % 3)).astype(float) / 4, {1: 0.9, 6: [0.7, 0.1][i % 2], 9: 0.6}) for i in range(30)]
    df = spark.createDataFrame([(i, x.tolist(), s) for i, x, s in rows] + [(99, None, None)], "frame_id long, x array<double>, scores map<int,double>")
    more = dict(mode=mode, threshold=0.75, classifier_ids=[1, 6, 9])
    s = PX.score_runs(df, lambda: lambda x: x, "x", channels, keep=("frame_id", "scores"), batch_size=4, **more)
    got = {r.frame_id: r for r in PX.postprocess_runs(s, mode, "scores").withColumn("mask", RN.from_runs("runs")).collect()}
    probs = F.transform(F.sequence(F.lit(0), (F.size("x") / channels).cast("int") - 1), lambda p: F.slice("x", p * channels + 1, channels))
    lists = INF.postprocess(df.filter("x is not null").withColumn("probs", probs), scores="scores", **more).collect()
    assert got[99].runs is None
    for r in lists:
        for c in ("mask", "class_pixel_counts", "predicted_class_ids", "dominant_class_id", "class_pixel_ratios", "risk_score", "prediction_mode"):
            assert got[r.frame_id][c] == r[c], (r.frame_id, c)
    assert len({tuple(r.mask) for r in lists}) > 5


def test_scored_bytes_and_missing_ids(spark):
    """Pixels go to the model as bytes, no list of them is in the plan; two heads without any ids have no class."""
    df = spark.createDataFrame([(1, bytearray([9, 1, 2, 8, 0, 0])), (2, bytearray())], "frame_id long, pixels binary")
    s = PX.score_runs(df, lambda: lambda x: x / 9.0, "pixels", 2)
    assert "array<double>" not in s._jdf.queryExecution().analyzed().toString() and dict(s.dtypes)["runs"] == RN.RUNS
    got = {r.frame_id: [tuple(x) for x in r.runs] for r in s.collect()}
    assert got == {1: [(0, 1), (1, 1), (0, 1)], 2: []}
    none = PX.postprocess_runs(PX.score_runs(df, lambda: lambda x: x / 9.0, "pixels", 2, mode=K.PREDICTION_MODES[1]), K.PREDICTION_MODES[1])
    assert {r.frame_id: (r.class_pixel_counts, r.dominant_class_id) for r in none.collect()} == {1: ({0: 3}, 1), 2: ({}, 1)}
    assert PX.score_runs(df.limit(0), lambda: lambda x: x, "pixels", 2).count() == 0


def test_overlay_of_runs(spark):
    img = image(1, 4, 5)
    mask = [0] * 7 + [9] * 8 + [77] * 5
    rows = [(1, bytearray(img.tobytes()), 5, mask), (2, bytearray(img.tobytes()), 5, mask[:-1]), (3, None, 5, mask), (4, bytearray(img.tobytes()), 5, None)]
    df = spark.createDataFrame(rows, "frame_id long, pixels binary, width int, mask array<int>").withColumn("runs", RN.to_runs("mask"))
    got = {r.frame_id: r for r in PX.overlay_runs(df, lambda a: bytes([*a.shape]) + a.tobytes()).collect()}
    known = {c: rgb for c, _, rgb in K.CLASS_INFO}
    part = round(100 * K.OVERLAY_ALPHA)
    want = [(int(v) * (100 - part) + known.get(c, (0, 0, 0))[k] * part + 50) // 100
            for c, px in zip(mask, img.reshape(-1, 3), strict=True) for k, v in enumerate(px)]
    assert list(got[1].overlay_content) == [4, 5, 3, *want] and got[1].status == "ok"
    assert got[2].error == "the mask has 19 pixels, the image 20" and got[3].error == got[4].error == "no image or no mask"
