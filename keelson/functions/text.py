"""Paths, names, labels, report text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keelson.functions.num import rnd

from keelson import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def with_constant(df, name: str, value):
    """Add a constant column (folded by Catalyst)."""
    return df.withColumn(name, F.lit(value))


def filename(path) -> Column:
    """Last path segment."""
    return F.regexp_extract(_c(path), r"([^/]+)$", 1)


def stem(path) -> Column:
    """File name without its last extension (the asset id)."""
    return F.regexp_replace(filename(path), r"\.[^.]*$", "")


def source_name(path, placeholder: str = K.SOURCE_PLACEHOLDER) -> Column:
    """Last part of a path-like source, trailing '/' ignored; placeholder when blank."""
    t = F.trim(F.coalesce(_c(path), F.lit("")))
    last = F.substring_index(F.regexp_replace(t, r"/+$", ""), "/", -1)
    return F.when(t == "", F.lit(placeholder)).when(F.instr(t, "/") > 0,
                                                      F.when(last == "", t).otherwise(last)).otherwise(t)


def rgb_hex(r, g, b) -> Column:
    """C17: '#rrggbb'."""
    return F.format_string("#%02x%02x%02x", _c(r), _c(g), _c(b))


def size_kb(length) -> Column:
    """Bytes / 1024, 2 decimals."""
    return rnd(_c(length) / 1024.0, 2)


def asset_id(*candidates, default="unknown") -> Column:
    """First non-blank of the candidates."""
    return F.coalesce(*[F.nullif(_c(c).cast("string"), F.lit("")) for c in candidates], F.lit(default))


def epoch_iso(ts) -> Column:
    """(epoch seconds, ISO text) of a timestamp."""
    t = _c(ts).cast("timestamp")
    return F.struct(F.unix_timestamp(t).alias("epoch"),
                    F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


def share_pct(share) -> Column:
    """Share * 100 rounded to 2; 0 when absent."""
    return rnd(F.coalesce(_c(share), F.lit(0.0)) * 100.0, 2)


def time_label(t) -> Column:
    """C35: 'x.x sec' or 'time not given'."""
    return F.when(_c(t).isNull(), F.lit(K.TIME_NOT_GIVEN)).otherwise(
        F.concat(F.format_string("%.1f", rnd(_c(t).cast("double"), 1)), F.lit(K.TIME_SUFFIX)))


def defect_comment(share_pct_col, frames) -> Column:
    """C36."""
    s, f = _c(share_pct_col), _c(frames)
    c = K.DEFECT_COMMENTS
    return F.when(s >= 25, F.lit(c[0])).when(s >= 10, F.lit(c[1])).when(f >= 10, F.lit(c[2])).otherwise(F.lit(c[3]))


def safe_name(c, fallback: str = "item") -> Column:
    """Keep letters, digits, '-', '_', '.'; others '_'; trim '._'; fallback."""
    cleaned = F.regexp_replace(F.coalesce(_c(c).cast("string"), F.lit("")), r"[^\p{L}\p{N}._-]", "_")
    trimmed = F.regexp_replace(cleaned, r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(trimmed, F.lit("")), F.lit(fallback))


def pct_text(x) -> Column:
    """C39: '%.2f %'."""
    return F.format_string("%.2f %%", _c(x))


def asset_path(root, rel) -> Column:
    """Manifest-relative path joined to its root."""
    return F.concat_ws("/", F.regexp_replace(_c(root), r"/+$", ""), F.regexp_replace(_c(rel), r"^/+", ""))


def summary_text(kind_label, dominant, band, score, urgency_col) -> Column:
    """The report's summary sentence."""
    return F.format_string(
        K.SUMMARY_TEXT, _c(kind_label), _c(dominant), F.lower(_c(band)), rnd(_c(score).cast("double"), 3), F.lower(_c(urgency_col)))


def conclusion_text(kind_label, dominant, band, score) -> Column:
    """The report's conclusion."""
    return F.format_string(K.CONCLUSION_TEXT, _c(kind_label), _c(dominant), F.lower(_c(band)), rnd(_c(score).cast("double"), 3))


def recommendations(score, corrosion_pct, peel_pct, growth_pct, extracted=None, segmented=None,
                    preset: str = "live") -> Column:
    """Up to four recommendations. Live preset: one by risk (.7/.45),
    then corrosion >= 10 %, peel >= 8 %, growth >= 12 %, filler when fewer
    than two. The strict preset uses 18/12/15 and adds a coverage rule
    (segmented / extracted < .2)."""
    texts = K.RECOMMENDATIONS_LIVE if preset == "live" else K.RECOMMENDATIONS_STRICT
    cuts = K.RECOMMENDATION_CUTS_LIVE if preset == "live" else K.RECOMMENDATION_CUTS_STRICT
    s = _c(score)
    first = F.when(s >= 0.7, F.lit(texts["high"])).when(s >= 0.45, F.lit(texts["medium"])).otherwise(F.lit(texts["low"]))
    items = [first,
             F.when(F.coalesce(_c(corrosion_pct), F.lit(0.0)) >= cuts["corrosion"], F.lit(texts["corrosion"])),
             F.when(F.coalesce(_c(peel_pct), F.lit(0.0)) >= cuts["peel"], F.lit(texts["peel"])),
             F.when(F.coalesce(_c(growth_pct), F.lit(0.0)) >= cuts["growth"], F.lit(texts["growth"]))]
    if preset != "live" and extracted is not None and segmented is not None:
        e, g = _c(extracted), _c(segmented)
        items.append(F.when((e > 0) & (g > 0) & (g / F.greatest(e, F.lit(1)) < cuts["coverage"]), F.lit(texts["coverage"])))
    arr = F.array_compact(F.array(*items))
    with_filler = F.when(F.size(arr) < 2, F.concat(arr, F.array(F.lit(texts["filler"])))).otherwise(arr)
    return F.slice(with_filler, 1, 4)


def primary_recommendation(recs) -> Column:
    """First item, default sentence when empty."""
    return F.coalesce(F.get(_c(recs), 0), F.lit(K.DEFAULT_RECOMMENDATION))
