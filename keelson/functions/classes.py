"""Class-dimension and class-map column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions.num import brnd, rnd

from keelson import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def class_dimension(spark: SparkSession) -> DataFrame:
    """The fixed 5-row class dimension with colour, hex, weight and the
    visible / sign flags. Its size is fixed, so it is safe to broadcast."""
    rows = []
    for cid, name, rgb in K.CLASS_INFO:
        rows.append((cid, name, list(rgb), "#{:02x}{:02x}{:02x}".format(*rgb),
                     K.RISK_WEIGHTS.get(cid, K.DEFAULT_RISK_WEIGHT),
                     cid not in K.VISIBLE_EXCLUDED_IDS, cid not in K.SIGN_EXCLUDED_IDS,
                     K.CLASS_TRANSLATIONS.get(name, name)))
    return spark.createDataFrame(
        rows, "class_id int, class_name string, color_rgb array<int>, color_hex string, "
              "risk_weight double, is_visible boolean, is_sign boolean, class_name_ru string")


def class_name_map() -> Column:
    kv = []
    for cid, name, _ in K.CLASS_INFO:
        kv += [F.lit(cid), F.lit(name)]
    return F.create_map(*kv)


def class_name(class_id) -> Column:
    """Name by id; 'Unknown' for ids outside the dimension (fixes the
    reference's KeyError on ids 3/4)."""
    return F.coalesce(F.element_at(class_name_map(), _c(class_id).cast("int")), F.lit("Unknown"))


def canonical_class(name) -> Column:
    """C22: 'Ship hull' is 'Normal'."""
    n = _c(name)
    return F.when(n == "Ship hull", F.lit("Normal")).otherwise(n)


def translate(name) -> Column:
    """Class name -> report label (unknown names pass through)."""
    kv = []
    for k, v in K.CLASS_TRANSLATIONS.items():
        kv += [F.lit(k), F.lit(v)]
    return F.coalesce(F.element_at(F.create_map(*kv), _c(name)), _c(name))


def class_color(name, default=None) -> Column:
    kv = []
    for k, v in K.CLASS_COLOR_MAP.items():
        kv += [F.lit(k), F.lit(v)]
    d = F.lit(K.UNKNOWN_COLOR) if default is None else _c(default)
    return F.coalesce(F.element_at(F.create_map(*kv), _c(name)), d)


def normalize_classes(classes) -> Column:
    """Canonical names, keep allowed, override colour, default list when
    nothing is left. ``classes``: array<struct<class_id, class_name, color_hex>>."""
    fixed = F.transform(_c(classes), lambda x: F.struct(
        x["class_id"].alias("class_id"),
        canonical_class(F.trim(x["class_name"])).alias("class_name"),
        class_color(canonical_class(F.trim(x["class_name"])), x["color_hex"]).alias("color_hex")))
    kept = F.filter(fixed, lambda x: x["class_name"].isin(*K.ALLOWED_CLASS_NAMES))
    default = F.array(*[F.struct(F.lit(i).alias("class_id"), F.lit(n).alias("class_name"), F.lit(h).alias("color_hex"))
                        for i, n, h in K.FALLBACK_CLASSES])
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(default)


def class_ids(names) -> Column:
    """Config names -> ids: trim, lower, '-' and ' ' -> '_', unknown dropped."""
    kv = []
    for cid, name, _ in K.CLASS_INFO:
        kv += [F.lit(name.lower().replace(" ", "_").replace("-", "_")), F.lit(cid)]
    m = F.create_map(*kv)
    ids = F.transform(_c(names), lambda x: F.element_at(m, F.translate(F.lower(F.trim(x)), "- ", "__")))
    return F.filter(ids, lambda x: x.isNotNull())


def ratios(counts) -> Column:
    """Class -> count map to class -> count / total, 6 decimals; keys kept."""
    from keelson.functions.frames import let
    c = _c(counts)
    total = F.aggregate(F.map_values(c), F.lit(0).cast("bigint"), lambda a, x: a + x)
    # the total is bound once, not re-summed for every entry
    return let(total, lambda t: F.transform_values(c, lambda k, v: F.when(t > 0, rnd(v / t, 6)).otherwise(F.lit(0.0))))


def visible_pixels(counts) -> Column:
    """sum of counts over visible classes."""
    vis = F.map_filter(_c(counts), lambda k, v: ~k.isin(*K.VISIBLE_EXCLUDED_IDS))
    return F.aggregate(F.map_values(vis), F.lit(0).cast("bigint"), lambda a, x: a + x)


def predicted_ids(counts) -> Column:
    """sorted ids with a positive non-void count."""
    return F.array_sort(F.map_keys(F.map_filter(_c(counts), lambda k, v: (k != 0) & (v > 0))))


def dominant_class(counts, default: int = 0) -> Column:
    """largest non-void count, ties -> lowest id; ``default`` when none."""
    entries = F.filter(F.map_entries(_c(counts)), lambda e: (e["key"] != 0) & (e["value"] > 0))
    best = F.array_max(F.transform(entries, lambda e: F.struct(e["value"].alias("n"), (-e["key"]).alias("neg"))))
    return F.coalesce((-best["neg"]).cast("int"), F.lit(default))


def count_values(mask) -> Column:
    """map of each value of an int array to how often it stands there, in
    order of the values: one sort of the array, then the runs' lengths."""
    m = F.array_sort(_c(mask).cast("array<int>"))
    kinds = F.array_distinct(m)
    # the place of a value's first element in the sorted array, and the end
    first = F.concat(F.transform(kinds, lambda v: F.array_position(m, v) - 1), F.array(F.size(m).cast("bigint")))
    counts = F.transform(kinds, lambda v, i: F.get(first, i + 1) - F.get(first, i))
    return F.map_from_arrays(kinds, counts)


def primary_sign(ids, dominant) -> Column:
    """First predicted id not in {0, 1}, else the dominant id."""
    signs = F.filter(_c(ids), lambda x: ~x.isin(*K.SIGN_EXCLUDED_IDS))
    return F.coalesce(F.get(signs, 0), _c(dominant)).cast("int")


def predicted_names(ids, excluded=K.SIGN_EXCLUDED_IDS) -> Column:
    """Names of predicted ids outside ``excluded`` ({0,1} video, {0} photo)."""
    return F.transform(F.filter(_c(ids), lambda x: ~x.isin(*excluded)), lambda x: class_name(x))


def active_classes(scores, threshold: float = K.ACTIVE_SCORE_THRESHOLD) -> Column:
    """class ids with score >= threshold sorted by score desc (ties: id
    asc); the single best when none passes; defects exclude class 1."""
    from keelson.functions.frames import let
    entries = F.map_entries(_c(scores))
    ranked = F.array_sort(F.transform(entries, lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("id"))))

    def chosen(r):
        best = F.transform(r, lambda e: e["id"])
        return F.when(F.exists(r, lambda e: -e["neg"] >= threshold),
                      F.transform(F.filter(r, lambda e: -e["neg"] >= threshold), lambda e: e["id"])).otherwise(F.slice(best, 1, 1))
    # sorted and chosen once, not for every use
    return let(let(ranked, chosen), lambda ids: F.struct(ids.alias("active"), F.filter(ids, lambda x: x != 1).alias("defects")))


def apportion(total, scored) -> Column:
    """F8: split ``total`` pixels among classes in proportion to score (the
    order given, best first); each share rounds half-even and the last class
    takes the rest, clamped at 0. ``scored``: array<struct<id:int, score:double>>."""
    from keelson.functions.frames import let

    def split(b):
        def step(acc, x):
            left = F.greatest(b["total"] - acc["used"], F.lit(0))
            share = F.when(b["sum"] > 0, brnd(b["total"] * (x["score"] / b["sum"]), 0)).otherwise(F.lit(0.0)).cast("bigint")
            take = F.when(acc["i"] == b["n"] - 1, left).otherwise(F.least(share, left)).cast("bigint")
            return let(take, lambda t: F.struct((acc["i"] + 1).alias("i"), (acc["used"] + t).alias("used"),
                                                F.map_concat(acc["out"], F.create_map(x["id"], t)).alias("out")))

        init = F.struct(F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("used"),
                        F.create_map().cast("map<int,bigint>").alias("out"))
        return F.aggregate(b["s"], init, step)["out"]

    # the list, its sum and the total are bound once, not worked out again for every class
    return let(let(_c(scored), lambda s: F.struct(
        s.alias("s"), F.aggregate(s, F.lit(0.0), lambda a, x: a + x["score"]).alias("sum"), F.size(s).alias("n"),
        _c(total).alias("total"))), split)


def json_map(text, value_type: str = "double") -> Column:
    """JSON object text -> map<int, value_type>; keys or values that do
    not cast are skipped."""
    raw = F.from_json(_c(text), "map<string,string>")
    cast = F.transform_keys(F.map_filter(raw, lambda k, v: k.try_cast("int").isNotNull() & v.try_cast(value_type).isNotNull()),
                            lambda k, v: k.cast("int"))
    return F.transform_values(cast, lambda k, v: v.cast(value_type))


def has_defect(ratios, primary_name, min_ratio: float = K.DEFECT_MIN_RATIO) -> Column:
    """Any visible non-normal class with ratio >= min_ratio; else the
    primary / dominant name is itself a defect."""
    names = class_name_map()
    hit = F.exists(F.map_entries(_c(ratios)), lambda e: (~F.coalesce(canonical_class(F.element_at(names, e["key"])),
                                                                     F.lit("")).isin("", "Normal", "Void"))
                   & (e["value"] >= min_ratio))
    named = ~F.coalesce(canonical_class(_c(primary_name)), F.lit("")).isin("", "Normal", "Void", "Ship hull")
    return F.coalesce(hit, F.lit(False)) | named


def is_visible(class_id) -> Column:
    """D6."""
    return ~_c(class_id).isin(*K.VISIBLE_EXCLUDED_IDS)


def is_sign(class_id) -> Column:
    """D6."""
    return ~_c(class_id).isin(*K.SIGN_EXCLUDED_IDS)
