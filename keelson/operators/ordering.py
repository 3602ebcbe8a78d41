"""Ordering primitives that stay parallel when one key holds most rows.

A plain ``Window.partitionBy(video_id).orderBy(...)`` sends every row of a
video to one task; if one video carries a third of the data, one task does a
third of the work. The helpers here cut each key into *chunks* by a column
that is monotone in the sort order (the hour of a timestamp, ``frame_idx div
65536``), work inside ``(key, chunk)`` groups, and stitch the chunks together
from exact per-chunk summaries (one row per chunk, so the stitching window
over a key's chunks is small):

* :func:`ordinal` — row_number per key = row_number inside the chunk + the
  number of the key's rows in earlier chunks.
* :func:`last_before` — ``last(x, ignorenulls) over (rows unbounded
  preceding .. 1 preceding)`` per key = the value inside the chunk, else the
  last non-null tail of an earlier chunk.

Both are deterministic (no partition ids), need no
materialisation, and when two steps use the same chunk column the second
window reuses the first one's partitioning (no extra shuffle).

A column that is even enough (hours of a stream, positions of a dense index)
is the cheapest chunk. Where nothing is known of how a key's rows lie, e.g.
most of them in one minute, or an index with wide gaps, :func:`depth_chunks`
cuts keys at splitters taken from the data, so that chunks hold about equally
many rows and a key has at most ``MAX_CHUNKS`` of them; the window over a
key's summaries is then bounded too.

The order columns must make rows unique within a key. A null key is a key of
its own; rows with a null order value come first within their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHUNK_ROWS = 1 << 16
HOUR_MICROS = 3_600_000_000
FIRST_CHUNK = -(1 << 62)  # of rows whose order value is null
MAX_CHUNKS = 8192         # of all keys that are cut by splitters
OVERSAMPLE = 32           # rows drawn per chunk: chunk sizes then vary by a sixth


def time_chunk(ts: Column | str, micros: int = HOUR_MICROS) -> Column:
    """Chunk of a timestamp: whole periods of ``micros`` since the epoch."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(t.cast("timestamp")) / micros).cast("bigint")


def index_chunk(idx: Column | str, rows: int = DEFAULT_CHUNK_ROWS) -> Column:
    """Chunk of a dense integer position: blocks of ``rows``."""
    i = F.col(idx) if isinstance(idx, str) else idx
    return F.floor(i / rows).cast("bigint")


def depth_chunks(df: DataFrame, key: str, order: list[str], name: str = "_depth", rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Add ``name``: the chunk of each row, non-decreasing along ``order``
    within ``key``. Keys of more than ``rows`` rows (or than a ``MAX_CHUNKS``-th
    of the table, if that is more) are cut at splitters, whole ``order`` tuples,
    so rows that tie in the first order column are cut as well. Splitters come
    from a sample by hash, the same on every run: they decide how even the
    chunks are, never the result. At most ``MAX_CHUNKS`` splitters exist for any
    table, so they are broadcast; a row finds its chunk by binary search."""
    k, place = F.struct(F.col(key).alias("k")), F.struct(*[F.col(c) for c in order])
    counted = df.groupBy(k.alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    total = counted.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    target = max(rows, -(-total // MAX_CHUNKS))
    big = counted.where(F.col("_n") > target).select("_k")  # fewer than MAX_CHUNKS keys
    drawn = (df.where(F.pmod(F.xxhash64(*order), F.lit(target)) < OVERSAMPLE).select(k.alias("_k"), place.alias("_p"))
             .join(F.broadcast(big), "_k"))
    splits = drawn.groupBy("_k").agg(F.array_sort(F.collect_list("_p")).alias("_all"))
    splits = splits.select("_k", F.filter("_all", lambda _, i: i % OVERSAMPLE == OVERSAMPLE - 1).alias("_splits"))
    steps = F.array(*[F.lit(1 << b) for b in range(MAX_CHUNKS.bit_length(), -1, -1)])
    below = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get("_splits", at + step - 1) <= place, step).otherwise(0))
    out = df.withColumn("_k", k).join(F.broadcast(splits), "_k", "left")
    return out.withColumn(name, below.cast("bigint")).drop("_k", "_splits")


def chunk_of(key: str, chunk: Column | None) -> Column:
    """The (key, chunk) a row belongs to, as one struct. A struct is never
    null and compares its null fields as equal, so rows with a null key or a
    null order value (sorted first, like in a window) join like all others."""
    c = F.lit(0) if chunk is None else F.coalesce(chunk, F.lit(FIRST_CHUNK))
    return F.struct(F.col(key).alias("k"), c.cast("bigint").alias("c"))


def _earlier(partition: str = "_chunk.k"):
    return Window.partitionBy(partition).orderBy("_chunk.c").rowsBetween(Window.unboundedPreceding, -1)


def ordinal(df: DataFrame, key: str, order: list[str], name: str = "rn", start: int = 1,
            chunk: Column | None = None, group_min: list[str] | None = None,
            keep_chunk: str | None = None, total: str | None = None, group_max: list[str] | None = None) -> DataFrame:
    """Add ``name`` = position of each row within ``key`` by ``order``
    (starting at ``start``; nulls first). ``chunk`` must be non-decreasing
    along ``order`` within a key; without it the whole key is one chunk (a
    plain window). ``group_min`` columns get a ``<col>_first`` companion:
    their minimum over the key, ``group_max`` columns a ``<col>_last``, their
    maximum; ``total`` names a column for the key's row
    count (both come from the chunk summaries, so the big side keeps its
    partitioning). ``keep_chunk`` keeps the chunk column under that name so a
    following step can reuse the partitioning."""
    group_min, group_max = group_min or [], group_max or []
    d = df.withColumn("_chunk", chunk_of(key, chunk))
    sizes = d.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(f"_m_{c}") for c in group_min],
                                    *[F.max(c).alias(f"_x_{c}") for c in group_max])
    whole = Window.partitionBy("_chunk.k")
    extra = [f"{c}_first" for c in group_min] + [f"{c}_last" for c in group_max]
    sizes = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(_earlier()), F.lit(0)).cast("bigint"))
    for c in group_min:
        sizes = sizes.withColumn(f"{c}_first", F.min(f"_m_{c}").over(whole))
    for c in group_max:
        sizes = sizes.withColumn(f"{c}_last", F.max(f"_x_{c}").over(whole))
    if total:
        sizes = sizes.withColumn(total, F.sum("_n").over(whole).cast("bigint"))
        extra.append(total)
    sizes = sizes.select("_chunk", "_off", *extra)
    inside = Window.partitionBy("_chunk").orderBy(*order)
    d = d.withColumn("_local", F.row_number().over(inside))
    # merge join on the chunk: the big side keeps the window's partitioning
    # and order (no shuffle, no sort), so a hot key stays spread; the summary
    # side is never assumed small enough to broadcast
    out = d.join(sizes.hint("shuffle_merge"), "_chunk")
    out = out.withColumn(name, (F.col("_local") + F.col("_off") + F.lit(start - 1)).cast("bigint")).drop("_local", "_off")
    return out.withColumnRenamed("_chunk", keep_chunk) if keep_chunk else out.drop("_chunk")


def last_before(df: DataFrame, key: str, rn: str, value: Column | str, name: str,
                chunk_rows: int = DEFAULT_CHUNK_ROWS, chunk: str | None = None) -> DataFrame:
    """``name`` = ``value`` of the nearest row with smaller ``rn`` in the same
    ``key`` where ``value`` is not null. ``chunk`` names a column that
    :func:`ordinal` kept; without it chunks are blocks of ``chunk_rows``
    positions of a dense ``rn``."""
    v = F.col(value) if isinstance(value, str) else value
    ch = F.col(chunk) if chunk else chunk_of(key, index_chunk(F.col(rn) - 1, chunk_rows))
    d = df.withColumn("_chunk", ch).withColumn("_v", v)
    inside = Window.partitionBy("_chunk").orderBy(rn).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_local", F.last("_v", ignorenulls=True).over(inside))
    # one summary row per chunk (its last non-null value, maybe null); carry
    # the latest earlier tail forward over the key's chunks
    tails = d.groupBy("_chunk").agg(
        F.max(F.when(F.col("_v").isNotNull(), F.struct(F.col(rn).alias("r"), F.col("_v").alias("v"))))["v"].alias("_tail"))
    carry = tails.withColumn("_carry", F.last("_tail", ignorenulls=True).over(_earlier())).select("_chunk", "_carry")
    d = d.join(carry.hint("shuffle_merge"), "_chunk", "left")
    return d.withColumn(name, F.coalesce("_local", "_carry")).drop("_chunk", "_v", "_local", "_carry")


def running_sum(df: DataFrame, key: str, order: list[str], value: Column | str, name: str,
                chunk: Column | str | None = None) -> DataFrame:
    """``name`` = sum of ``value`` over the key's rows up to and including
    this one (by ``order``), chunked like :func:`ordinal`; a ``chunk`` given
    by name is a column that :func:`ordinal` kept."""
    v = F.col(value) if isinstance(value, str) else value
    ch = F.col(chunk) if isinstance(chunk, str) else chunk_of(key, chunk)
    d = df.withColumn("_chunk", ch).withColumn("_v", v)
    sums = d.groupBy("_chunk").agg(F.sum("_v").alias("_s"))
    sums = sums.withColumn("_off", F.coalesce(F.sum("_s").over(_earlier()), F.lit(0))).select("_chunk", "_off")
    inside = Window.partitionBy("_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_local", F.sum("_v").over(inside)).join(sums.hint("shuffle_merge"), "_chunk")
    return d.withColumn(name, F.coalesce("_local", F.lit(0)) + F.col("_off")).drop("_chunk", "_v", "_local", "_off")
