"""Per-frame column functions: hashes, quality, pixel statistics, crops.

All return ``Column`` built from native Spark expressions (codegen /
JVM side). Pixel arrays are ``array<double|int>`` in row-major order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keelson.functions.num import brnd, rnd

from keelson import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- C8-C10: 64-bit perceptual hash --------------------------------------

def hex_to_hash(hex_col) -> Column:
    """16 hex chars -> signed 64-bit long (null/blank -> null)."""
    h = _c(hex_col)
    return F.when(F.length(F.trim(h)) > 0, F.conv(h, 16, -10).cast("bigint"))


def hash_to_hex(hash_col) -> Column:
    """signed 64-bit long -> 16 lowercase hex chars."""
    return F.lpad(F.lower(F.hex(_c(hash_col))), 16, "0")


def dhash_bits(gray, cols: int = 9) -> Column:
    """Difference hash of an already area-resized gray grid
    (rows x ``cols`` values, row-major): bit = right > left, row-major,
    then packed into a signed long. 9x8 gives 64 bits."""
    arr = _c(gray)
    idx = F.filter(F.sequence(F.lit(0), F.size(arr) - 1), lambda i: (i % cols) < (cols - 1))
    bits = F.transform(idx, lambda i: F.when(F.element_at(arr, i + 2) > F.element_at(arr, i + 1), "1").otherwise("0"))
    return F.conv(F.array_join(bits, ""), 2, -10).cast("bigint")


def dhash_hex(gray, cols: int = 9) -> Column:
    """C8 as 16 hex chars (the reference's stored form)."""
    return hash_to_hex(dhash_bits(gray, cols))


def hamming(a, b) -> Column:
    """C9 (and N2, the reference's Python UDF, replaced by this native
    expression): popcount(a xor b); null when either side is null."""
    return F.bit_count(_c(a).bitwiseXOR(_c(b))).cast("int")


def visual_distance(a, b) -> Column:
    """As hamming, but 64 when a hash is missing."""
    return F.coalesce(hamming(a, b), F.lit(64))


# ---- C11, D1: quality ------------------------------------------------------

def quality_score(brightness, laplacian) -> Column:
    """C11: 0.72 * laplacian + 100 * max(0, 1 - |b - 118| / 118); nulls as 0."""
    b = F.coalesce(_c(brightness).cast("double"), F.lit(0.0))
    lap = F.coalesce(_c(laplacian).cast("double"), F.lit(0.0))
    balance = F.greatest(F.lit(0.0), 1.0 - F.abs(b - K.BRIGHTNESS_CENTER) / K.BRIGHTNESS_CENTER)
    return lap * K.LAPLACIAN_WEIGHT + balance * 100.0


def is_good(brightness, laplacian, hash_col, min_b: float = K.MIN_BRIGHTNESS,
            max_b: float = K.MAX_BRIGHTNESS, min_lap: float = K.MIN_LAPLACIAN) -> Column:
    """Brightness in [min_b, max_b], laplacian >= min_lap, hash present."""
    b, lap = _c(brightness), _c(laplacian)
    return F.coalesce(b.between(min_b, max_b) & (lap >= min_lap) & _c(hash_col).isNotNull(), F.lit(False))


# ---- C6, C7, C12, C14-C16: pixel arrays -----------------------------------

def gray(rgb_pixels) -> Column:
    """array<array<r,g,b>> or flat r,g,b triplets -> gray values."""
    px = _c(rgb_pixels)
    r, g, b = K.GRAY_WEIGHTS
    return F.transform(px, lambda p: p[0] * r + p[1] * g + p[2] * b)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a one-element
    ``transform``): higher-order lambdas do not share repeated sub-expressions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def array_mean(arr) -> Column:
    a = _c(arr)
    total = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.when(F.size(a) > 0, total / F.size(a))


def brightness(gray_pixels) -> Column:
    """Mean of gray."""
    return array_mean(gray_pixels)


def norm_stats(pixels) -> Column:
    """Min, max, mean of x/255."""
    a = F.transform(_c(pixels), lambda x: x.cast("double") / 255.0)
    return F.struct(F.array_min(a).alias("norm_min"), F.array_max(a).alias("norm_max"),
                    array_mean(a).alias("norm_mean"))


def normalize_channels(pixels, channel_count: int = 3) -> Column:
    """C14: (x/255 - mean[c]) / std[c] over interleaved channels."""
    mean = F.array(*[F.lit(m) for m in K.IMAGENET_MEAN[:channel_count]])
    std = F.array(*[F.lit(s) for s in K.IMAGENET_STD[:channel_count]])
    return F.transform(_c(pixels), lambda x, i: (x.cast("double") / 255.0 - F.element_at(mean, i % channel_count + 1))
                       / F.element_at(std, i % channel_count + 1))


def class_color_map() -> Column:
    """map<int, array<int>> of the class dimension colours."""
    kv = []
    for cid, _, rgb in K.CLASS_INFO:
        kv += [F.lit(cid), F.array(*[F.lit(v) for v in rgb])]
    return F.create_map(*kv)


def colorize(mask) -> Column:
    """Class-id mask -> RGB triplets; black when the id is unknown."""
    m = class_color_map()
    black = F.array(F.lit(0), F.lit(0), F.lit(0))
    return F.transform(_c(mask), lambda c: F.coalesce(F.element_at(m, c), black))


def blend(img, mask, alpha: float = K.OVERLAY_ALPHA) -> Column:
    """round(img * (1 - a) + mask * a) element-wise."""
    return F.zip_with(_c(img), _c(mask), lambda a, b: rnd(a * (1 - alpha) + b * alpha).cast("int"))


def laplacian_var(gray_pixels, width, height) -> Column:
    """Population variance of the 3x3 Laplacian (0 1 0 / 1 -4 1 / 0 1 0),
    reflect-101 borders, on a row-major gray array. Small images only; large
    frames go through ``inference.measure_frames`` (NumPy in ``mapInPandas``)."""
    a, w, h = _c(gray_pixels), _c(width), _c(height)

    def at(y, x):
        yy = F.when(y < 0, -y).when(y >= h, 2 * h - 2 - y).otherwise(y)
        xx = F.when(x < 0, -x).when(x >= w, 2 * w - 2 - x).otherwise(x)
        return F.element_at(a, yy * w + xx + 1).cast("double")

    def lap(i):
        y, x = F.floor(i / w).cast("int"), (i % w).cast("int")
        return at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4.0 * at(y, x)

    vals = F.transform(F.sequence(F.lit(0), F.size(a) - 1), lap)
    # bind the Laplacian once, then its mean once: lambdas are not
    # de-duplicated, so a repeated sub-expression would be recomputed per element
    return let(vals, lambda v: let(array_mean(v), lambda m: F.aggregate(
        v, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)) / F.size(v)))


# ---- C2, C4, C5, C43: frame bookkeeping -------------------------------------

def frame_index(ordinal0, every_n) -> Column:
    """frame_idx = ordinal * max(n, 1)."""
    return (_c(ordinal0) * F.greatest(_c(every_n), F.lit(1))).cast("bigint")


def frame_timestamp(frame_idx, fps) -> Column:
    """Idx / fps, null when fps <= 0."""
    return F.when(_c(fps) > 0, _c(frame_idx) / _c(fps))


def parse_crop(text) -> Column:
    """C4: "a,b,c,d" -> struct of 4 doubles; raises unless exactly four."""
    parts = F.split(F.regexp_replace(_c(text), r"\s", ""), ",")
    checked = F.when(F.size(parts) == 4, parts).otherwise(
        F.raise_error(F.concat(F.lit("crop must have 4 values: "), _c(text))))
    return F.struct(*[checked[i].cast("double").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


def crop_box(width, height, crop, clamp: bool = False) -> Column:
    """Crop ratios -> pixel box. Plain form int(w*r); clamped form keeps
    at least one pixel and stays inside the image."""
    w, h, c = _c(width), _c(height), _c(crop)
    x1, y1 = F.floor(w * c.x1).cast("int"), F.floor(h * c.y1).cast("int")
    x2, y2 = F.floor(w * c.x2).cast("int"), F.floor(h * c.y2).cast("int")
    if clamp:
        x1 = F.least(F.greatest(x1, F.lit(0)), w - 1)
        y1 = F.least(F.greatest(y1, F.lit(0)), h - 1)
        x2 = F.least(F.greatest(x2, x1 + 1), w)
        y2 = F.least(F.greatest(y2, y1 + 1), h)
    return F.struct(x1.alias("crop_x1"), y1.alias("crop_y1"), x2.alias("crop_x2"), y2.alias("crop_y2"))


def trimmed_frames(total_frames, start_sec, fps) -> Column:
    """max(total - round_half_even(start * fps), 0); 0 without fps."""
    return F.when(_c(fps) > 0, F.greatest(_c(total_frames) - brnd(_c(start_sec) * _c(fps), 0).cast("bigint"),
                                          F.lit(0))).otherwise(F.lit(0)).cast("bigint")


def sample_plan(duration, start_sec, fps, every_n, max_frames) -> Column:
    """A4: ordinals of the frames to sample: 0 .. min(max_frames, ceil((dur-start)*sample_fps)) - 1,
    where fps defaults to 25 and sample_fps = max(fps / max(n, 1), 0.2)."""
    f = F.when(_c(fps) > 0, _c(fps)).otherwise(F.lit(25.0))
    sample_fps = F.greatest(f / F.greatest(_c(every_n), F.lit(1)), F.lit(0.2))
    n = F.least(_c(max_frames), F.ceil((_c(duration) - _c(start_sec)) * sample_fps)).cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def effective_start(start_sec, duration) -> Column:
    """A5: a start at or past the end falls back to 0."""
    return F.when((_c(duration) > 0) & (_c(start_sec) >= _c(duration)), F.lit(0)).otherwise(_c(start_sec))


def duration(frames, fps) -> Column:
    """A3: frames / fps, 0 when fps <= 0."""
    return F.when(_c(fps) > 0, _c(frames) / _c(fps)).otherwise(F.lit(0.0))
