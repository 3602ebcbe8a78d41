"""Filter interaction audit by truth-table survival words.

Five filters run one after another; which documents a filter removes depends
on the filters before it. A document fails some of the five, so it survives
exactly those subsets of filters that hold none of its failures: its *word*
has a bit for each of the 32 subsets. Adding up the bits of all words of a part
and label gives the survivors of every subset, and these tell everything about
every order: what stays after a step, what the step removes, which labelled
documents go, and a filter's share over all orders (Shapley value).

The words are added with carry-save adders: words are bit-wise added in planes
of ones, twos, fours and so on, three words to two at a time, so that bits are
counted only in the few planes left, not in every word.

What is shuffled: a document's id, part, failures and a 16-byte digest of its
text. The smallest id of a text is found by aggregation (copies meet before the
shuffle); texts of which there are very many copies, ``HOT`` at most, are
joined by broadcast, all others by their digest. The counts of a batch, 32 a
part and label, are summed.

Failures (words are runs of ``[^\\x20\\x09-\\x0D]``): A: under ``MIN_WORDS``
words; B: distinct words under half of the words; C: capitals A-Z over 3 % of
the code points; D: a sign of ``[#$%&*|]``; E: the text of a document of a
smaller id, in the whole table.

Defined results: a null text is an empty one (it fails A, and E as a copy of
other empty ones); a null ``part`` is the empty string; a null id is larger
than all others, and rows of one id are no copies of each other; an id that
has several rows of labels has the largest of each; ids without labels are
neither good nor toxic; an empty table gives no rows, a part always gives 600;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, prepare, read

FILTERS = "ABCDE"
MIN_WORDS = 200
SIGNS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))
SUBSETS = range(1 << len(FILTERS))
#: The word of a document by its failures: bit s is set if subset s holds none of them.
WORDS = [sum(1 << s for s in SUBSETS if not s & failed) for failed in SUBSETS]
HOT = 1024  # texts with over a 1,024th of the rows: there are fewer than so many of them
PLANES = 16  # words a carry-save round takes


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text (UTF-8) fails."""
    w = text.split()  # of bytes: at the six ASCII white spaces
    points = len(text) if text.isascii() else len(text.decode())
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return ((len(w) < MIN_WORDS) | (100 * len(set(w)) < 50 * len(w)) << 1 | (100 * capitals > 3 * points) << 2
            | (len(text.translate(None, SIGNS)) < len(text)) << 3)


def measured(docs: DataFrame, text: str, key: str, part: str) -> DataFrame:
    """id, part, failed (A to D), digest of every row."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts = b.column(2)
            for at in range(0, b.num_rows, 512):
                piece = texts.slice(at, 512).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, 512), b.column(1).slice(at, 512), pa.array([failures(t) for t in piece], pa.int32()),
                     pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in piece], pa.binary())],
                    names=["id", "part", "failed", "digest"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInArrow(run, "id long, part string, failed int, digest binary")


def survival_words(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "lang") -> DataFrame:
    """id, part, label (1: good, 2: toxic, their sum: both) and word of every row of ``docs``."""
    rows = cut(measured(docs, text, key, part))
    order = F.struct(F.col("id").isNull().alias("none"), "id")
    firsts = cut(rows.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n"), F.max(order).alias("last"))
                 .filter("first <> last"))  # copies of one id alone are no copies
    most = rows.count() / HOT
    hot = firsts.filter(F.col("n") > most).select(F.col("digest").alias("_hot"), F.col("first").alias("_hot_first"))
    rest = firsts.filter(F.col("n") <= most).select(F.col("digest").alias("_digest"), F.col("first").alias("_first"))
    met = rows.join(F.broadcast(hot), F.col("digest") == F.col("_hot"), "left")  # fewer than HOT rows
    seen = (met.filter("_hot IS NULL").join(rest, F.col("digest") == F.col("_digest"), "left").drop("_digest")
            .unionByName(met.filter("_hot IS NOT NULL"), allowMissingColumns=True))
    first = F.coalesce("_hot_first", "_first")
    copy = F.coalesce(first < order, F.lit(False)).cast("int")
    marks = labels.groupBy(F.col("doc_id").alias("_id")).agg(
        (F.max((F.col("quality") == 1).cast("int")) + 2 * F.max((F.col("toxic") == 1).cast("int"))).alias("_label"))
    found = seen.select("id", "part", (F.col("failed") + 16 * copy).alias("failed")).join(marks, F.col("id") == F.col("_id"), "left")
    word = F.get(F.array(*[F.lit(w) for w in WORDS]), F.col("failed"))
    return found.select("id", "part", F.coalesce("_label", F.lit(0)).alias("label"), word.cast("long").alias("word"))


def popcounts(words) -> list[int]:
    """How many of the 32-bit ``words`` have each bit: carry-save adders fold
    three words of a weight into one of that weight and one of the next, until
    few words of every weight are left; only those are looked at bit by bit."""
    import numpy as np

    bits = np.arange(32, dtype=np.uint32)
    total = np.zeros(32, np.int64)
    planes, weight = np.asarray(words, np.uint32), 1
    while len(planes):
        carries = []
        while len(planes) >= PLANES:
            third = len(planes) // 3
            a, b, c = planes[:third], planes[third:2 * third], planes[2 * third:3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            planes = np.concatenate([half ^ c, planes[3 * third:]])
        total += weight * ((planes[:, None] >> bits) & 1).sum(0, dtype=np.int64)
        planes, weight = np.concatenate(carries) if carries else planes[:0], 2 * weight
    return total.tolist()


def survivors(words: DataFrame) -> DataFrame:
    """part, label, kept: the number of survivors of each of the 32 subsets."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            parts = b.column(0).dictionary_encode()
            label, word = b.column(1).to_numpy(), b.column(2).to_numpy().astype(np.uint32)
            group = parts.indices.to_numpy().astype(np.int64) * 4 + label
            order = np.argsort(group, kind="stable")
            own, starts = np.unique(group[order], return_index=True)
            counts = [popcounts(w) for w in np.split(word[order], starts[1:])]
            yield pa.RecordBatch.from_arrays(
                [parts.dictionary.take(pa.array(own // 4)), pa.array((own % 4).astype(np.int32)),
                 pa.array(counts, pa.list_(pa.int64()))], names=["part", "label", "kept"])

    made = words.select("part", "label", "word").mapInArrow(run, "part string, label int, kept array<long>")
    return made.groupBy("part", "label").agg(F.array(*[F.sum(F.col("kept")[s]) for s in SUBSETS]).alias("kept"))


def audit(counts: DataFrame) -> DataFrame:
    """The rows of every part, order and step from the survivors of the subsets."""
    def of(label: Column) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(label, F.col("kept")[s])), F.lit(0)) for s in SUBSETS])
    parts = counts.groupBy("part").agg(of(F.lit(True)).alias("_all"), of(F.col("label").isin(1, 3)).alias("_good"),
                                       of(F.col("label").isin(2, 3)).alias("_toxic"))
    n, orders = len(FILTERS), ["".join(p) for p in permutations(FILTERS)]
    held = [[sum(1 << FILTERS.index(x) for x in o[:k]) for k in range(n + 1)] for o in orders]

    def constant(values: list) -> Column:
        return F.array(*[F.lit(v) for v in values])
    at = parts.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(len(orders) * n - 1))))
    at = at.select("*", F.get(constant(orders), (F.col("_i") / n).cast("int")).alias("filter_order"), (F.col("_i") % n + 1).alias("step"),
                   F.get(constant([m for h in held for m in h[:-1]]), F.col("_i")).alias("_before"),
                   F.get(constant([m for h in held for m in h[1:]]), F.col("_i")).alias("_after"))
    own = F.col("_after") - F.col("_before")  # the bit of the step's filter
    everyone, everything = F.col("_all")[0], len(SUBSETS) - 1

    def share(x: int) -> Column:
        """Removed by filter x over all orders: a subset is before it in |s|! (n - 1 - |s|)! of them."""
        return sum(F.lit(factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) * (F.col("_all")[s] - F.col("_all")[s | x])
                   for s in SUBSETS if not s & x)

    def lost(kept: str) -> Column:
        return F.get(F.col(kept), F.col("_before")) - F.get(F.col(kept), F.col("_after"))
    at = at.withColumn("_own", own)
    out = at.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), F.get("_all", F.col("_after")).alias("kept"), lost("_all").alias("removed"),
        (everyone - F.get("_all", F.col("_own")) - lost("_all")).alias("redundant"),
        (F.get("_all", F.lit(everything) - F.col("_own")) - F.col("_all")[everything]).alias("unique_fails"),
        lost("_good").alias("good_lost"), lost("_toxic").alias("toxic_lost"),
        F.coalesce(*[F.when(F.col("_own") == (1 << i), share(1 << i)) for i in range(n)]).alias("shapley"))
    return out


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters over all ``documents``."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return audit(survivors(survival_words(docs, read(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY text) AS first FROM docs),
fails AS (
  SELECT d.part, (len(w) < 200) AS fa, (100 * len(list_distinct(w)) < 50 * len(w)) AS fb,
         (100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text)) AS fc,
         regexp_matches(text, '[#$%&*|]') AS fd, (first < d.doc_id) AS fe,
         coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM words d LEFT JOIN (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l
    ON d.doc_id = l.doc_id),
bits AS (
  SELECT part, good, toxic, fa::INT + 2 * fb::INT + 4 * fc::INT + 8 * fd::INT + 16 * fe::INT AS failed, count(*) AS n
  FROM fails GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bs
  FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31
    AND len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, step, bs[step] AS own, coalesce(list_sum(bs[1:step - 1]), 0)::INT AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
told AS (
  SELECT b.part, s.filter_order, s.step, s.own,
         sum(CASE WHEN failed & (before + own) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN failed & own <> 0 AND failed & before = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN failed & own <> 0 AND failed & before <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN failed = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN failed & own <> 0 AND failed & before = 0 AND good THEN n ELSE 0 END) AS good_lost,
         sum(CASE WHEN failed & own <> 0 AND failed & before = 0 AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM bits b, steps s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM told
"""
