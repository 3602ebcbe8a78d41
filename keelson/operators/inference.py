"""Model plug-in surface.

Codecs and the network are not part of this library: a user passes batch
functions. Decoding runs in ``mapInPandas`` (one Arrow batch at a time, one
task per input split); scoring runs in ``predict_batch_udf`` (the model is
built once per Python worker and fed fixed-size batches). Everything after
the model output — masks, histograms, ratios, dominant class, risk — is
native Spark expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson import constants as K
from keelson.functions import classes as CL
from keelson.functions import frames as FR
from keelson.functions import risk as RK
from keelson.operators.classes import argmax_mask

DECODED = T.StructType([T.StructField("frame_id", T.LongType()), T.StructField("gray", T.ArrayType(T.DoubleType())),
                        T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
                        T.StructField("status", T.StringType()), T.StructField("error", T.StringType())])


def decode_frames(df: DataFrame, decode_fn: Callable[[bytes], np.ndarray | None], id_col: str = "frame_id",
                  bytes_col: str = "content") -> DataFrame:
    """Bytes -> gray pixels with status/error instead of failing.
    ``decode_fn`` returns a 2-D array or None (undecodable)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for fid, blob in zip(pdf[id_col], pdf[bytes_col]):
                try:
                    img = decode_fn(bytes(blob)) if blob is not None else None
                except Exception as exc:  # keep the row, report the error
                    out.append((fid, None, None, None, "error", str(exc)))
                    continue
                if img is None:
                    out.append((fid, None, None, None, "error", "undecodable"))
                else:
                    a = np.asarray(img, dtype=float)
                    out.append((fid, a.ravel().tolist(), int(a.shape[1]), int(a.shape[0]), "ok", None))
            yield pd.DataFrame(out, columns=[f.name for f in DECODED.fields])
    return df.select(F.col(id_col).cast("long").alias(id_col), bytes_col).mapInPandas(run, DECODED)


def _weights(n: int, m: int) -> np.ndarray:
    """m x n: how much of each of n cells lies in each of m equal boxes."""
    edge = np.linspace(0, n, m + 1)
    low, high = edge[:-1, None], edge[1:, None]
    cell = np.arange(n)[None, :]
    inside = np.clip(np.minimum(high, cell + 1) - np.maximum(low, cell), 0, None)
    return inside / inside.sum(axis=1, keepdims=True)


def _area_resize(a: np.ndarray, w: int, h: int) -> np.ndarray:
    """Area-weighted resize, a cell on a box's edge counts by its part; with
    or without a last axis of colour channels."""
    rows, cols = _weights(a.shape[0], h), _weights(a.shape[1], w)
    return np.einsum("yi,ij...,xj->yx...", rows, a, cols, optimize=True)


PREPROCESSED = T.StructType([T.StructField("frame_id", T.LongType()), T.StructField("gray", T.ArrayType(T.DoubleType())),
                             T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
                             T.StructField("crop_x1", T.IntegerType()), T.StructField("crop_y1", T.IntegerType()),
                             T.StructField("crop_x2", T.IntegerType()), T.StructField("crop_y2", T.IntegerType()),
                             T.StructField("norm_min", T.DoubleType()), T.StructField("norm_max", T.DoubleType()),
                             T.StructField("norm_mean", T.DoubleType()), T.StructField("status", T.StringType()),
                             T.StructField("error", T.StringType())])


def preprocess_frames(df: DataFrame, decode_fn: Callable[[bytes], np.ndarray | None],
                      crop: tuple[float, float, float, float] = (0.05, 0.10, 0.95, 0.90),
                      width: int = 256, height: int = 256, id_col: str = "frame_id",
                      bytes_col: str = "content") -> DataFrame:
    """Decode, crop (clamped box, at least one pixel), area-resize
    to ``width`` x ``height``, normalised min/max/mean; failures become rows
    with status 'error' and the message. Runs per Arrow batch in the
    executors; the crop ratios and size travel in the closure."""
    x1r, y1r, x2r, y2r = crop

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for fid, blob in zip(pdf[id_col], pdf[bytes_col]):
                try:
                    img = decode_fn(bytes(blob)) if blob is not None else None
                    if img is None:
                        raise ValueError("undecodable")
                    a = np.asarray(img, dtype=float)
                    hh, ww = a.shape[:2]
                    x1 = min(max(int(ww * x1r), 0), ww - 1)
                    y1 = min(max(int(hh * y1r), 0), hh - 1)
                    x2 = min(max(int(ww * x2r), x1 + 1), ww)
                    y2 = min(max(int(hh * y2r), y1 + 1), hh)
                    r = _area_resize(a[y1:y2, x1:x2], width, height)
                    n = r / 255.0
                    out.append((fid, r.ravel().tolist(), width, height, x1, y1, x2, y2,
                                float(n.min()), float(n.max()), float(n.mean()), "ok", None))
                except Exception as exc:
                    out.append((fid, None, None, None, None, None, None, None, None, None, None, "error", str(exc)))
            yield pd.DataFrame(out, columns=[f.name for f in PREPROCESSED.fields])
    return df.select(F.col(id_col).cast("long").alias(id_col), bytes_col).mapInPandas(run, PREPROCESSED)


MEASURED = T.StructType([T.StructField("frame_id", T.LongType()), T.StructField("width", T.IntegerType()),
                         T.StructField("height", T.IntegerType()), T.StructField("status", T.StringType()),
                         T.StructField("error", T.StringType()), T.StructField("brightness", T.DoubleType()),
                         T.StructField("laplacian_var", T.DoubleType()), T.StructField("dhash", T.StringType())])


def _laplacian_var(a: np.ndarray) -> float:
    p = np.pad(a, 1, mode="reflect") if min(a.shape) > 1 else np.pad(a, 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * a).var())


def _dhash(a: np.ndarray) -> str:
    grid = _area_resize(a, 9, 8)
    bits = "".join("1" if x else "0" for x in (grid[:, 1:] > grid[:, :-1]).ravel())
    return f"{int(bits, 2):016x}"


def measure_frames(df: DataFrame, decode_fn: Callable[[bytes], np.ndarray | None], id_col: str = "frame_id",
                   bytes_col: str = "content") -> DataFrame:
    """N1 for frames of any size: decode and take C6, C7 and C8 (9 x 8 grid, 64
    bits) in one NumPy pass per Arrow batch. Only the figures leave Python;
    pixels never become rows or lists. ``decode_fn`` gives a gray image."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for fid, blob in zip(pdf[id_col], pdf[bytes_col], strict=True):
                try:
                    img = decode_fn(bytes(blob)) if blob is not None else None
                    if img is None:
                        raise ValueError("undecodable")
                    a = np.asarray(img, dtype=float)
                    out.append((fid, a.shape[1], a.shape[0], "ok", None, float(a.mean()), _laplacian_var(a), _dhash(a)))
                except Exception as exc:  # the row stays and says why
                    out.append((fid, None, None, "error", str(exc), None, None, None))
            yield pd.DataFrame(out, columns=[f.name for f in MEASURED.fields]).astype({"width": "Int32", "height": "Int32"})
    return df.select(F.col(id_col).cast("long").alias(id_col), bytes_col).mapInPandas(run, MEASURED)


def frame_metrics(decoded: DataFrame, hash_grid: Column | None = None, hash_cols: int = 9) -> DataFrame:
    """N1 on decoded pixel arrays, natively (small images; :func:`measure_frames`
    takes large ones): brightness (C6), Laplacian variance (C7), hash (C8),
    size; null metrics for rows that did not decode. ``hash_grid`` is the area-resized
    gray grid for the hash (the decode plug-in's job); by default the gray
    pixels themselves are used."""
    ok = F.col("status") == "ok"
    grid = F.col("gray") if hash_grid is None else hash_grid
    return decoded.select(
        "frame_id", "width", "height", "status", "error",
        F.when(ok, FR.brightness("gray")).alias("brightness"),
        F.when(ok, FR.laplacian_var("gray", "width", "height")).alias("laplacian_var"),
        F.when(ok, FR.dhash_hex(grid, hash_cols)).alias("dhash"))


def softmax_stub(channels: int = 8) -> Callable:
    """A NumPy stand-in model factory for tests and the bindings: per-pixel
    softmax over ``channels`` interleaved values. Real models plug in the
    same way (``make_predict_fn`` returning a batch function)."""
    def make():
        def predict(x: np.ndarray) -> np.ndarray:
            z = x.reshape(x.shape[0], -1, channels)
            z = np.exp(z - z.max(axis=2, keepdims=True))
            return (z / z.sum(axis=2, keepdims=True)).reshape(x.shape[0], -1)
        return predict
    return make


def score_frames(df: DataFrame, make_predict_fn: Callable, input_col: str, channels: int,
                 batch_size: int = 64, input_size: int | None = None) -> DataFrame:
    """Batched inference; adds ``probs`` (pixels x channels, row-major)."""
    from pyspark.ml.functions import predict_batch_udf
    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size,
                            input_tensor_shapes=[[input_size]] if input_size else None)
    d = df.withColumn("_flat", udf(F.col(input_col)))   # the model runs once per row
    flat = F.col("_flat")
    n = (F.size(flat) / channels).cast("int")
    probs = F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.slice(flat, p * channels + 1, channels))
    return d.withColumn("probs", F.transform(probs, lambda a: F.transform(a, lambda v: v.cast("double")))).drop("_flat")


def binary_classes(df: DataFrame, total: Column, fore: Column, scores: str, score_threshold: float) -> DataFrame:
    """N5 with one foreground channel of ``fore`` pixels of ``total``: adds
    dominant_class_id, class_pixel_counts, predicted_class_ids (F8, F9)."""
    d = df.withColumn("_active", CL.active_classes(scores, score_threshold)).withColumn("_n", fore).withColumn("_total", total)
    defects, n = F.col("_active.defects"), F.col("_n")
    best = F.when(F.size(defects) > 0, F.get(defects, 0)).otherwise(F.lit(K.NORMAL_CLASS_ID))
    scored = F.transform(defects, lambda c: F.struct(c.cast("int").alias("id"), F.element_at(F.col(scores), c).alias("score")))
    some = (F.size(defects) > 0) & (n > 0)
    void = F.create_map(F.lit(0), F.col("_total") - n)
    counts = F.when(some, F.map_concat(void, CL.apportion(n, scored))).otherwise(F.create_map(F.lit(K.NORMAL_CLASS_ID), F.col("_total")))
    return (d.withColumn("dominant_class_id", best.cast("int")).withColumn("class_pixel_counts", counts)
             .withColumn("predicted_class_ids", defects).drop("_active", "_n", "_total"))


def counted_classes(df: DataFrame, mode: str) -> DataFrame:
    """Predicted and dominant class from class_pixel_counts; without classes the
    dominant one is 1 of two heads, else 0."""
    none = K.NORMAL_CLASS_ID if mode == K.PREDICTION_MODES[1] else 0
    return (df.withColumn("predicted_class_ids", CL.predicted_ids("class_pixel_counts"))
              .withColumn("dominant_class_id", CL.dominant_class("class_pixel_counts", none)))


def postprocess(df: DataFrame, mode: str = K.PREDICTION_MODES[0], threshold: float = K.TWO_HEAD_THRESHOLD,
                segmentation_ids: list[int] | None = None, scores: str = "classification_scores",
                score_threshold: float = K.ACTIVE_SCORE_THRESHOLD, classifier_ids: list[int] | None = None) -> DataFrame:
    """Mask, class counts, ratios, predicted and dominant class and risk
    from ``probs`` (pixels x channels), by the model's output:

    * multiclass: channel = class, argmax; dominant class 0 without classes.
    * two heads, several channels (F10): the best channel's class id
      (``segmentation_ids``, without them ``classifier_ids``) where it reaches
      ``threshold``, else 0; dominant class 1 without classes.
    * two heads, one channel: foreground where it is >= .5 takes the best
      active defect of the classifier's ``scores`` (F9); the foreground's
      pixels are shared among the defects by score (F8); without a defect all
      pixels are class 1.

    Masks as runs, for images of any size: ``pixels.postprocess_runs``.
    """
    d = df.withColumn("prediction_mode", F.lit(mode))
    if mode == K.PREDICTION_MODES[2]:
        d = d.withColumn("_fore", F.transform("probs", lambda p: F.get(p, 0) >= F.lit(K.FOREGROUND_THRESHOLD)))
        d = binary_classes(d, F.size("probs").cast("bigint"), F.size(F.filter("_fore", lambda f: f)).cast("bigint"), scores, score_threshold)
        d = d.withColumn("mask", F.transform("_fore", lambda f: F.when(f & (F.size("predicted_class_ids") > 0), F.col("dominant_class_id")).otherwise(F.lit(0)))).drop("_fore")
    else:
        ids = list(segmentation_ids or classifier_ids or [])
        d = d.withColumn("mask", argmax_mask(F.col("probs"), threshold, ids) if mode == K.PREDICTION_MODES[1] else argmax_mask(F.col("probs")))
        d = counted_classes(d.withColumn("class_pixel_counts", CL.count_values("mask")), mode)
    return (d.withColumn("class_pixel_ratios", CL.ratios("class_pixel_counts"))
             .withColumn("risk_score", RK.risk_score("class_pixel_ratios")))
