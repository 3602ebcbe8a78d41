"""Hull hotspots: sensor lookup, photo assignment, wide-to-long sensors
(E5-E7, E10, G8, K2, L17, C48).

Sources are rows (one per photo file name, with an order column); the
hotspot dimension and matchers are fixed small tables (4 hotspots), so they
are applied as generated column expressions or broadcast.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson import constants as K
from keelson.operators.ordering import depth_chunks, ordinal


def hotspot_dimension(spark: SparkSession) -> DataFrame:
    rows = [(i, hid, text, key, list(pos), K.HOTSPOT_DESCRIPTIONS.get(text, K.HOTSPOT_DEFAULT_DESCRIPTION))
            for i, (hid, text, key, pos) in enumerate(K.HOTSPOTS)]
    return spark.createDataFrame(rows, "hotspot_order int, hotspot_id string, text string, data_key string, "
                                       "position array<double>, description string")


def describe(hotspots: DataFrame, text_col: str = "text") -> DataFrame:
    """Description by hotspot text; a default sentence when unknown."""
    kv = []
    for k, v in K.HOTSPOT_DESCRIPTIONS.items():
        kv += [F.lit(k), F.lit(v)]
    return hotspots.withColumn("description", F.coalesce(F.element_at(F.create_map(*kv), F.col(text_col)),
                                                         F.lit(K.HOTSPOT_DEFAULT_DESCRIPTION)))


def sensor_for(hotspots: DataFrame, sensors: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """E5: each hotspot's sensor values as text, 'n/a' when the key has no
    sensor row. Duplicate sensor keys keep one row (the smallest values, so
    the result does not depend on file order)."""
    first = sensors.groupBy(key).agg(F.min(F.struct(*metrics)).alias("_m")).select(key, "_m.*")
    j = hotspots.join(first, key, "left")
    return j.select(*hotspots.columns, *[F.coalesce(F.col(m).cast("string"), F.lit(K.SENSOR_MISSING)).alias(f"{m}_text")
                                         for m in metrics])


def sensors_long(sensors: DataFrame, key: str) -> DataFrame:
    """K2: wide numbered columns (``resistance1..10``) to rows
    (key, metric, idx, value)."""
    cols = [c for c in sensors.columns if c != key and re.search(r"\d+$", c)]
    long = sensors.unpivot([key], cols, "column", "value")
    return long.select(key, F.regexp_extract("column", r"^(.*?)(\d+)$", 1).alias("metric"),
                       F.regexp_extract("column", r"^(.*?)(\d+)$", 2).cast("int").alias("idx"),
                       F.col("value").cast("double").alias("value"))


def sensors_arrays(long: DataFrame, key: str) -> DataFrame:
    """K2: one ordered array per (key, metric); bounded by the column count."""
    g = long.groupBy(key, "metric").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("_a"))
    return g.select(key, "metric", F.transform("_a", lambda e: e["value"]).alias("values"))


def match_photos(sources: DataFrame, matchers: dict[str, str], name_col: str = "filename") -> DataFrame:
    """(hotspot_id, source row) for every matcher whose regex finds the
    name; a name may match several hotspots. Theta join on regex done as
    generated ``rlike`` columns (the matcher table is fixed), so no join."""
    hits = F.array_compact(F.array(*[F.when(F.col(name_col).rlike(p), F.lit(h)) for h, p in matchers.items()]))
    return sources.withColumn("hotspot_id", F.explode(hits))


def assign_hotspot_photos(sources: DataFrame, matchers: dict[str, str] | None = None,
                          fallbacks: dict[str, list[str]] | None = None, name_col: str = "filename",
                          order_col: str = "source_order") -> DataFrame:
    """L17 (E6 + E7 + G8): photos per hotspot as rows (hotspot_id, pos,
    photo_url, origin). Hotspots with a matcher take the matching names in
    source order, or their static list when nothing matches; the names no
    matcher took are split in even chunks (ceil(n / h)) over the hotspots
    without a matcher, in definition order."""
    spark = sources.sparkSession
    matchers = K.HOTSPOT_MATCHERS if matchers is None else matchers
    fallbacks = K.HOTSPOT_FALLBACK_FILES if fallbacks is None else fallbacks
    src = sources.select(F.col(name_col).alias("name"), F.col(order_col).alias("ord"))
    matched = match_photos(src, matchers, "name")
    matched = depth_chunks(matched, "hotspot_id", ["ord", "name"])
    matched = ordinal(matched, "hotspot_id", ["ord", "name"], name="pos", chunk=F.col("_depth"))
    matched = matched.select("hotspot_id", "pos", "name", F.lit("matched").alias("origin"))
    # Names taken by a matcher are removed before the even split
    remaining = src.join(matched.select("name").distinct(), "name", "left_anti")
    fb_rows = [(h, i + 1, n) for h in matchers for i, n in enumerate(fallbacks.get(h, []))]
    fb = spark.createDataFrame(fb_rows, "hotspot_id string, pos long, name string")
    hit = matched.select("hotspot_id").distinct()
    fb = fb.join(F.broadcast(hit), "hotspot_id", "left_anti").withColumn("origin", F.lit("fallback"))
    rest_ids = [h for h, _, _, _ in K.HOTSPOTS if h not in matchers]
    parts = [matched, fb.select("hotspot_id", "pos", "name", "origin")]
    if rest_ids:
        n = remaining.agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
        # Global position in source order (chunks of equal depth, so no single task)
        r = depth_chunks(remaining.withColumn("_one", F.lit(1)), "_one", ["ord", "name"])
        r = ordinal(r, "_one", ["ord", "name"], name="_i", chunk=F.col("_depth"))
        size = F.ceil(F.col("_n") / len(rest_ids))
        r = r.join(F.broadcast(n), "_one").withColumn("_h", F.floor((F.col("_i") - 1) / size).cast("int"))
        r = r.withColumn("hotspot_id", F.element_at(F.array(*[F.lit(h) for h in rest_ids]), F.col("_h") + 1))
        r = r.withColumn("pos", (F.col("_i") - F.col("_h") * size).cast("bigint"))
        parts.append(r.select("hotspot_id", "pos", "name", F.lit("chunk").alias("origin")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("photo_url", F.concat(F.lit(K.HOTSPOT_PHOTO_PREFIX), F.col("name")))


def hotspot_counts(spark: SparkSession, assignments: DataFrame) -> DataFrame:
    """Number of photos per hotspot, 0 for hotspots without any."""
    c = assignments.groupBy("hotspot_id").agg(F.count(F.lit(1)).alias("photos"))
    dim = hotspot_dimension(spark).select("hotspot_order", "hotspot_id", "text")
    return dim.join(c, "hotspot_id", "left").select("hotspot_id", "text",
                                                    F.coalesce("photos", F.lit(0)).cast("bigint").alias("photos"))


def hotspot_lists(spark: SparkSession, assignments: DataFrame) -> DataFrame:
    """Every hotspot keeps its (possibly empty) list, as rows; a hotspot
    without photos appears once with a null photo. The four-row dimension is
    broadcast to the photos (they aren't shuffled by hotspot, so a hotspot
    with most photos is no single task); the hotspots found empty are added."""
    dim = hotspot_dimension(spark).select("hotspot_id", "text")
    photos = assignments.select("hotspot_id", "pos", "photo_url")
    found = photos.join(F.broadcast(dim), "hotspot_id").select("hotspot_id", "text", "pos", "photo_url")
    seen = photos.select("hotspot_id").distinct()  # four rows at most
    empty = dim.join(seen, "hotspot_id", "left_anti")
    return found.unionByName(empty.withColumn("pos", F.lit(None).cast("bigint")).withColumn("photo_url", F.lit(None).cast("string")))
