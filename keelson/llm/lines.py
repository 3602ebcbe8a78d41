"""Line dedup by distinct-site spread.

A line that stands on many sites is boilerplate. Per line hash a HyperLogLog
sketch of its sites is built by aggregation, so the lines of a very common
line are merged before the shuffle. Lines whose estimate is clearly below the
limit are left alone, lines clearly above it are boilerplate, and lines near
the limit get an exact count of their distinct sites. The first document that
has a boilerplate line (smallest doc_id) keeps it; it goes from all others, so
nothing vanishes from the corpus.

Lines are \\n-split and compared without outer white space; blank lines are
never boilerplate. Defined results: a null text stays null, with no lines; a
null site is no site; a null doc_id comes last; equal rows are one document
and are treated alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, prepare, read

MIN_SITES = 10       # a line on so many sites is boilerplate
LG_K = 10            # sketch of 2^10 registers: about 3 % standard error
NEAR = 0.25          # estimates within so much of the limit are counted exactly
_TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _hash(line: Column) -> Column:
    """Hash of the trimmed line; null for a blank one."""
    bare = F.regexp_replace(line, _TRIM, "")
    return F.when(bare != "", F.xxhash64(bare))


def _exploded(docs: DataFrame, text: str, site: str, key: str) -> DataFrame:
    """One row per line that isn't blank: h, site, doc, pos; doc: id and text hash."""
    doc = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64(text).alias("t"))
    rows = docs.select(doc.alias("doc"), F.col(site).alias("site"), F.posexplode(_lines(F.col(text))).alias("pos", "line"))
    return rows.select(_hash(F.col("line")).alias("h"), "site", "doc", "pos").filter("h IS NOT NULL")


def boilerplate(docs: DataFrame, text: str, site: str, key: str, min_sites: int = MIN_SITES) -> DataFrame:
    """Rows (doc, pos) of the lines to remove."""
    rows = _exploded(docs, text, site, key)
    spread = rows.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    wide = cut(spread.filter(F.col("sites") >= (1 - NEAR) * min_sites))
    # of all lines, only those on many sites (by the sketches) go on
    found = cut(rows.join(wide, "h"))
    near = found.filter(F.col("sites") < (1 + NEAR) * min_sites)
    exact = near.select("h", "site").distinct().groupBy("h").agg(F.count("site").alias("n"))
    above = wide.filter(F.col("sites") >= (1 + NEAR) * min_sites).select("h")
    bad = above.union(exact.filter(F.col("n") >= min_sites).select("h"))
    first = found.groupBy("h").agg(F.min("doc").alias("first")).join(bad, "h", "left_semi")
    return found.join(first, "h").filter(F.col("doc") != F.col("first")).select("doc", "pos")


def remove_boilerplate(docs: DataFrame, text: str = "text", site: str = "source", key: str = "doc_id",
                       min_sites: int = MIN_SITES, prefix: str = "_line_") -> DataFrame:
    """``docs`` with the boilerplate lines out of ``text``, and with {prefix}all
    and {prefix}removed, the numbers of lines before and of lines removed."""
    gone = cut(boilerplate(docs, text, site, key, min_sites).groupBy("doc").agg(F.collect_set("pos").alias("_line_gone")))
    gone = gone.select(F.col("doc.id").alias("_line_id"), F.col("doc.t").alias("_line_t"), "_line_gone")
    out = docs.join(gone, docs[key].eqNullSafe(F.col("_line_id")) & (F.xxhash64(docs[text]) == F.col("_line_t")), "left")
    lines = _lines(F.col(text))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_line_gone"))
    left = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    removed = F.coalesce(F.size("_line_gone"), F.lit(0)).cast("long")
    return (out.withColumn(f"{prefix}all", F.coalesce(F.size(F.when(F.col(text).isNotNull(), lines)), F.lit(0)).cast("long"))
            .withColumn(f"{prefix}removed", F.when(F.col("_line_gone").isNull(), 0).otherwise(removed))
            .withColumn(text, F.when(F.col("_line_gone").isNull(), F.col(text)).otherwise(left))
            .drop("_line_id", "_line_t", "_line_gone"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without the lines that stand on ``MIN_SITES`` sources."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    out = remove_boilerplate(docs)
    return out.select("doc_id", F.col("_line_all").alias("n_lines"), F.col("_line_removed").alias("n_removed"),
                      F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


ORACLE_SQL = f"""
WITH docs AS (
  SELECT doc_id, source, text, md5(coalesce(text, '')) AS t FROM documents),
lines AS (
  SELECT doc_id, t, source, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM docs),
bare AS (
  SELECT doc_id, t, source, line, pos,
         trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS b FROM lines),
wide AS (
  SELECT b, min((doc_id, t)) AS first FROM bare WHERE b <> ''
  GROUP BY b HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (
  SELECT x.doc_id, x.t, x.line, x.pos, (w.b IS NOT NULL AND (x.doc_id, x.t) <> w.first) AS gone
  FROM bare x LEFT JOIN wide w ON x.b = w.b),
kept AS (
  SELECT doc_id, t, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS left_text
  FROM marked GROUP BY doc_id, t)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
       CAST(CASE WHEN d.text IS NULL THEN NULL ELSE length(k.left_text) END AS BIGINT) AS kept_chars,
       CASE WHEN d.text IS NULL THEN NULL ELSE md5(k.left_text) END AS kept_md5
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id AND d.t = k.t
"""
