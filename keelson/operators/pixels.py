"""Images and masks that never become lists of numbers.

Pixels are binary columns (one byte a value, row-major, channels interleaved)
and masks are runs (``functions.runs``). Codecs and the model are plug-ins that
run in ``mapInArrow``: they see views of the Arrow buffers, and what they make
goes out in batches of at most ``OUT_BYTES``. Arriving batches are bounded by
``spark.sql.execution.arrow.maxBytesPerBatch``. A frame that can't be decoded,
cropped or encoded is a row with status ``error`` and the message; a null
image is ``undecodable``; no rows give no rows. Extra columns are left out,
but for those named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson import constants as K
from keelson.functions import classes as CL
from keelson.functions import risk as RK
from keelson.functions import runs as RN
from keelson.operators.inference import _area_resize, binary_classes, counted_classes

OUT_BYTES = 16_000_000

Decode = Callable[[bytes], "np.ndarray | None"]
Encode = Callable[[np.ndarray], bytes]
Box = tuple[float, float, float, float]

DECODED = "frame_id long, pixels binary, width int, height int, channels int, status string, error string"
PREPROCESSED = ("frame_id long, processed_content binary, crop_x1 int, crop_y1 int, crop_x2 int, crop_y2 int, processed_width int, "
                "processed_height int, norm_min double, norm_max double, norm_mean double, status string, error string")
OVERLAID = "frame_id long, overlay_content binary, status string, error string"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(","))])


def _per_row(df: DataFrame, make: Callable[..., dict], ddl: str) -> DataFrame:
    """One row of ``ddl`` per row of ``df``, whose first column is the frame's
    id; ``make`` gets the others and gives the fields, or raises."""
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):
                key, *given = (batch.column(c)[i] for c in range(batch.num_columns))
                row = {"frame_id": key.as_py()}
                try:
                    row |= make(*given) | {"status": "ok"}
                except Exception as exc:  # the row stays and says why
                    row |= {"status": "error", "error": str(exc)}
                rows.append(row)
                held += 200 + sum(len(v) for v in row.values() if isinstance(v, bytes))
                if held > OUT_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
    return df.mapInArrow(run, ddl)


def _image(decode_fn: Decode, content: pa.Scalar) -> np.ndarray:
    img = decode_fn(content.as_py()) if content.is_valid else None
    if img is None:
        raise ValueError("undecodable")
    return np.asarray(img)


def _whole(a: np.ndarray) -> np.ndarray:
    """Whole values from 0 to 255, halves to even as image libraries round."""
    return np.clip(np.rint(a), 0, 255).astype(np.uint8)


def decode_pixels(df: DataFrame, decode_fn: Decode, id_col: str = "frame_id", bytes_col: str = "content") -> DataFrame:
    """Encoded bytes -> pixels, size and channels, or an error row."""
    def make(content):
        a = _image(decode_fn, content)
        return {"pixels": _whole(a).tobytes(), "height": a.shape[0], "width": a.shape[1], "channels": a.shape[2] if a.ndim > 2 else 1}
    return _per_row(df.select(F.col(id_col).cast("long"), bytes_col), make, DECODED)


def split_decoded(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D3: the rows that decoded, and the error rows (id, status, error)."""
    ok = F.col("status") == "ok"
    return decoded.filter(ok), decoded.filter(~ok).select("frame_id", "status", "error")


def preprocess_pixels(df: DataFrame, decode_fn: Decode, encode_fn: Encode, crop: Box = (0.05, 0.10, 0.95, 0.90),
                      width: int = 256, height: int = 256, id_col: str = "frame_id", bytes_col: str = "content") -> DataFrame:
    """Decode, crop (the box is clamped, at least one pixel), area-resize
    to whole values, encode; with the crop box and min, max and mean of x / 255."""
    x1r, y1r, x2r, y2r = crop

    def make(content):
        a = _image(decode_fn, content)
        hh, ww = a.shape[:2]
        x1, y1 = min(max(int(ww * x1r), 0), ww - 1), min(max(int(hh * y1r), 0), hh - 1)
        x2, y2 = min(max(int(ww * x2r), x1 + 1), ww), min(max(int(hh * y2r), y1 + 1), hh)
        r = _whole(_area_resize(a[y1:y2, x1:x2].astype(float), width, height))
        n = r / 255.0
        return {"processed_content": bytes(encode_fn(r)), "crop_x1": x1, "crop_y1": y1, "crop_x2": x2, "crop_y2": y2,
                "processed_width": width, "processed_height": height,
                "norm_min": float(n.min()), "norm_max": float(n.max()), "norm_mean": float(n.mean())}
    return _per_row(df.select(F.col(id_col).cast("long"), bytes_col), make, PREPROCESSED)


def overlay_runs(df: DataFrame, encode_fn: Encode | None = None, alpha: float = K.OVERLAY_ALPHA,
                 id_col: str = "frame_id", pixels: str = "pixels", width: str = "width", runs: str = "runs") -> DataFrame:
    """Colours of a mask's runs laid over RGB pixels, encoded (raw
    bytes without ``encode_fn``). Runs that don't fill the image are an error."""
    known = {cid: rgb for cid, _, rgb in K.CLASS_INFO}

    def make(raw, w, mask):
        if not (raw.is_valid and w.is_valid and mask.is_valid):
            raise ValueError("no image or no mask")
        img = np.frombuffer(raw.as_buffer(), np.uint8).reshape(-1, 3)
        items = mask.as_py()
        lengths = np.array([r["length"] for r in items], np.int64)
        if lengths.sum() != len(img):
            raise ValueError(f"the mask has {lengths.sum()} pixels, the image {len(img)}")
        colors = np.array([known.get(r["value"], (0, 0, 0)) for r in items], float).reshape(-1, 3)
        mixed = img * (1 - alpha) + np.repeat(colors, lengths, axis=0) * alpha
        # halves go up; nine decimals first, as 0.45 is no binary fraction
        out = np.floor(np.round(mixed, 9) + 0.5).astype(np.uint8).reshape(-1, w.as_py(), 3)
        return {"overlay_content": out.tobytes() if encode_fn is None else bytes(encode_fn(out))}
    return _per_row(df.select(F.col(id_col).cast("long"), pixels, width, runs), make, OVERLAID)


def _inputs(column: pa.Array) -> list[np.ndarray | None]:
    """A view of every row's values: bytes of a binary, numbers of a list column."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return [np.frombuffer(v.as_buffer(), np.uint8) if v.is_valid else None for v in column]
    return [v.values.to_numpy(zero_copy_only=False) if v.is_valid else None for v in column]


def _masks(y: np.ndarray, mode: str, threshold: float, ids: Sequence[int]) -> np.ndarray:
    """Model output (frames, pixels, channels) -> mask values (frames, pixels)."""
    if mode == K.PREDICTION_MODES[2]:
        return (y[:, :, 0] >= K.FOREGROUND_THRESHOLD).astype(np.int32)
    best = y.argmax(axis=2)
    if mode != K.PREDICTION_MODES[1]:
        return best.astype(np.int32)
    of = np.zeros(max(y.shape[2], len(ids)), np.int32)  # a channel beyond the list has no class
    of[:len(ids)] = ids
    return np.where(y.max(axis=2) >= threshold, of[best], 0).astype(np.int32)


def _as_runs(masks: list[np.ndarray | None]) -> pa.Array:
    at, offsets, values, lengths = 0, [], [], []
    for m in masks:
        offsets.append(None if m is None else at)
        if m is not None and len(m):
            starts = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
            values.append(m[starts])
            lengths.append(np.diff(np.append(starts, len(m))).astype(np.int32))
            at += len(starts)
    both = [np.concatenate(x) if x else np.empty(0, np.int32) for x in (values, lengths)]
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in both], ["value", "length"])
    return pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), runs)


def score_runs(df: DataFrame, make_predict_fn: Callable, input_col: str, channels: int, mode: str = K.PREDICTION_MODES[0],
               threshold: float = K.TWO_HEAD_THRESHOLD, segmentation_ids: Sequence[int] | None = None,
               classifier_ids: Sequence[int] | None = None, keep: Sequence[str] = ("frame_id",), batch_size: int = 64) -> DataFrame:
    """The columns ``keep`` and ``runs``, the mask of the model's
    output; the probabilities stay in the worker. ``make_predict_fn`` builds the
    model once per task; its function maps (frames, values) to (frames, pixels x
    channels). Frames of equal size go together, at most ``batch_size`` at a
    time. Two heads without segmentation ids use the classifier's. In the
    binary mode a run's value is 1 for foreground. A null input has null runs."""
    ids = list(segmentation_ids or classifier_ids or [])
    kept = df.select(*keep, F.col(input_col).alias("_input"))
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("runs", T._parse_datatype_string(RN.RUNS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = make_predict_fn()
        for batch in batches:
            inputs = _inputs(batch.column(batch.num_columns - 1))
            masks: list[np.ndarray | None] = [None] * len(inputs)
            sizes: dict[int, list[int]] = {}
            for i, x in enumerate(inputs):
                if x is not None:
                    sizes.setdefault(len(x), []).append(i)
            for rows in sizes.values():
                for at in range(0, len(rows), batch_size):
                    some = rows[at:at + batch_size]
                    y = np.asarray(predict(np.stack([inputs[i] for i in some])))
                    for i, m in zip(some, _masks(y.reshape(len(some), -1, channels), mode, threshold, ids), strict=True):
                        masks[i] = m
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _as_runs(masks)], [*batch.schema.names[:-1], "runs"])
    return kept.mapInArrow(run, schema)


def postprocess_runs(df: DataFrame, mode: str = K.PREDICTION_MODES[0], scores: str = "classification_scores",
                     score_threshold: float = K.ACTIVE_SCORE_THRESHOLD, runs: str = "runs") -> DataFrame:
    """N5 on runs: the columns that ``inference.postprocess`` adds (without
    ``mask``), for the same three modes; in the binary mode the runs become
    those of the dominant class."""
    d = df.withColumn("prediction_mode", F.lit(mode))
    if mode == K.PREDICTION_MODES[2]:
        d = binary_classes(d, RN.run_pixels(runs), RN.run_pixels(runs, 1), scores, score_threshold)
        value = F.when(F.size("predicted_class_ids") > 0, F.col("dominant_class_id")).otherwise(F.lit(0))
        d = d.withColumn(runs, RN.map_runs(runs, lambda v: F.when(v == 1, value).otherwise(F.lit(0))))
    else:
        d = counted_classes(d.withColumn("class_pixel_counts", RN.count_runs(runs)), mode)
    return (d.withColumn("class_pixel_ratios", CL.ratios("class_pixel_counts"))
             .withColumn("risk_score", RK.risk_score("class_pixel_ratios")))
