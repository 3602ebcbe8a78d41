"""Substring dedup by content-defined chunking.

A gear hash rolls over the text's UTF-8 bytes and a chunk ends where its top
bits are zero, so chunk ends follow the content: an insertion moves only the
chunks around it. Chunks are deduplicated by digest: the first document that
has a chunk (smallest doc_id, then text hash, first place in it) keeps it, all other places
are duplicates, and adjacent duplicates are joined to passages. A passage of
at least ``LEAST_RUN`` bytes is removed; shorter ones are chance.

Digests are aggregated before the shuffle (the smallest document and a count), so a
chunk in a third of all documents is one row per task; the places of repeated
chunks then meet their digest in a join whose large side Spark can split.

Defined results: null and empty texts have no chunks; a null doc_id comes
after all others; a document is a doc_id and a text hash, so rows with equal
doc_id and other texts (or without one) are deduplicated against each other, and
a chunk that equal rows have first stays in each; long texts are cut whole;
other columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, read

LEAST, MOST = 16, 128  # bytes of a chunk
BITS = 4               # top bits of the hash that are zero at a chunk's end: 2^4 bytes after the least size on average
LEAST_RUN = 64         # bytes of duplicate chunks in a row that make a passage
SEED = b"gear"
_LAST = (1 << 63) - 1


def gear(seed: bytes = SEED):
    """A random 16-bit value for every byte; a place's hash is a matter of its last 16 bytes."""
    import numpy as np

    return np.array([int.from_bytes(hashlib.blake2b(seed + bytes([b]), digest_size=2).digest(), "little") for b in range(256)], np.uint16)


def ends(data: bytes, table) -> list[int]:
    """The ends of a text's chunks."""
    import numpy as np

    h = table[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8):  # h[i] = sum of table[byte i-j] << j over j < 16
        h[step:] = h[step:] + (h[:-step] << step)
    out, start = [], 0
    for end in (np.flatnonzero(h >> (16 - BITS) == 0) + 1).tolist():
        while end - start > MOST:
            start += MOST
            out.append(start)
        if end - start >= LEAST:
            out.append(end)
            start = end
    while len(data) - start > MOST:
        start += MOST
        out.append(start)
    if start < len(data):
        out.append(len(data))
    return out


def chunks(docs: DataFrame, text: str, key: str) -> DataFrame:
    """One row per chunk: hi, lo (digest), id, th (text's hash), at: packed
    start, size and whether the document has the digest already."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        table, digest = gear(), hashlib.blake2b
        for b in batches:
            ids, hashes, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2)
            for first in range(0, b.num_rows, 128):
                found, at, sizes = [], [], []
                for t in texts.slice(first, 128).to_pylist():
                    data, start, seen, n = t.encode(), 0, set(), len(found)
                    for end in ends(data, table):
                        d = digest(data[start:end], digest_size=16).digest()
                        found.append(d)
                        at.append(start << 9 | (end - start) << 1 | (d in seen))
                        seen.add(d)
                        start = end
                    sizes.append(len(found) - n)
                both = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.repeat(ids[first:first + 128], sizes)),
                     pa.array(np.repeat(hashes[first:first + 128], sizes)), pa.array(np.array(at, np.int64))],
                    names=["hi", "lo", "id", "th", "at"])

    rows = docs.filter(F.length(text) > 0).select(F.coalesce(F.col(key), F.lit(_LAST)).cast("long").alias("id"),
                                                  F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "hi long, lo long, id long, th long, at long")


def passages(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST_RUN) -> DataFrame:
    """Repeated passages to remove: id, th, start, end (bytes), first: the smallest
    id of a document that keeps a part of it."""
    all_chunks = chunks(docs, text, key)
    known = cut(all_chunks.groupBy("hi", "lo").agg(F.min(F.struct("id", "th")).alias("doc"), F.count("*").alias("n"))
                .filter("n > 1").select("hi", "lo", F.col("doc.id").alias("first"), F.col("doc.th").alias("first_th")))
    again = all_chunks.join(known, ["hi", "lo"]).filter((F.col("id") != F.col("first")) | (F.col("th") != F.col("first_th")) | (F.col("at") % 2 == 1))
    again = again.select("id", "th", "first", F.shiftright("at", 9).alias("start"),
                         (F.shiftright("at", 9) + F.shiftright("at", 1) % 256).alias("end"))
    again = again.distinct()  # of equal rows
    doc = W.partitionBy("id", "th").orderBy("start")
    new = F.when(F.lag("end").over(doc) == F.col("start"), 0).otherwise(1)
    runs = again.withColumn("new", new).withColumn("run", F.sum("new").over(doc))
    return (runs.groupBy("id", "th", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("first").alias("first"))
            .filter(F.col("end") - F.col("start") >= least).drop("run"))


def remove_passages(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST_RUN) -> DataFrame:
    """``docs`` without the repeated passages in ``text``."""
    spans = cut(passages(docs, text, key, least).groupBy(F.col("id").alias("_chunk_id"), F.col("th").alias("_chunk_th"))
                .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_chunk_spans")))

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(texts, spans, strict=True):
            data, parts, at = t.encode(), [], 0
            for s in own:
                parts.append(data[at:s["start"]])
                at = s["end"]
            out.append(b"".join([*parts, data[at:]]).decode(errors="ignore"))  # a character cut by a chunk's end goes
        return pd.Series(out)

    same = (F.coalesce(docs[key], F.lit(_LAST)) == F.col("_chunk_id")) & (F.xxhash64(docs[text]) == F.col("_chunk_th"))
    out = docs.join(spans, same, "left")
    return (out.withColumn(text, F.when(F.col("_chunk_spans").isNull(), F.col(text))
                           .otherwise(without(F.coalesce(text, F.lit("")), F.coalesce("_chunk_spans", F.array().cast("array<struct<start:bigint,end:bigint>>")))))
            .drop("_chunk_id", "_chunk_th", "_chunk_spans"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per repeated passage that goes from ``documents``."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    null = F.lit(None).cast("long")
    return passages(docs).select(F.when(F.col("id") == _LAST, null).otherwise(F.col("id")).alias("doc_id"),
                                 F.when(F.col("first") == _LAST, null).otherwise(F.col("first")).alias("first_doc_id"),
                                 F.col("start").alias("start_byte"), F.col("end").alias("end_byte"))
