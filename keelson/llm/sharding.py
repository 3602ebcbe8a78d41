"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring is a circle of cells; every shard has virtual nodes at hashed cells
and a cell belongs to the next virtual node clockwise. Rows are counted by
cell (an aggregation), and the plan, whose size depends on the parameters
only (``CELLS``), is made from these counts: a shard takes the rows of its own
cells in ring order up to its capacity; what is over goes on clockwise to the
next virtual node whose shard has room. Capacities are as tight as they can
be, so the law is ``rows``: the counts of two shards are at most one apart.

Defined results: a null text has no bytes (size 1, CRC 0); a null doc_id is a
key like another; equal rows are counted together and told apart by their
number, so a run of them splits, and tasks make them by ``RUN`` rows; no rows
give no rows; other columns are left out (join on doc_id to get them).
"""

from __future__ import annotations

import hashlib
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, read

CELL_BITS = 14
CELLS = 1 << CELL_BITS  # bound of the plan that the driver makes
VNODES = 512            # virtual nodes of a shard
RUN = 4096              # equal rows told apart at a time


def ring(n_shards: int, vnodes: int = VNODES) -> list[int]:
    """Owner of every cell. The same shard has the same nodes on every ring,
    so one more shard takes cells but gives none away."""
    at: dict[int, tuple[bytes, int]] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            h = hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=16).digest()
            cell = int.from_bytes(h[:8], "little") % CELLS
            at[cell] = min(at.get(cell, (b"\xff" * 17, 0)), (h[8:], shard))
    owner, nxt = [0] * CELLS, at[min(at)][1]
    for cell in range(CELLS - 1, -1, -1):
        nxt = at[cell][1] if cell in at else nxt
        owner[cell] = nxt
    return owner


def capacities(own: list[int]) -> list[int]:
    """Floor or ceiling of the mean; the ceilings go to the shards that own most."""
    q, r = divmod(sum(own), len(own))
    most = sorted(range(len(own)), key=lambda s: (-own[s], s))[:r]
    return [q + (s in most) for s in range(len(own))]


def plan(counts: dict[int, int], n_shards: int, vnodes: int = VNODES) -> list[tuple[int, int, int, int, int]]:
    """Ranges (cell, first, end, shard, slot of the first): the rows of a cell
    with numbers first..end-1 go to the shard."""
    owner = ring(n_shards, vnodes)
    own = [0] * n_shards
    for cell, n in counts.items():
        own[owner[cell]] += n
    room = capacities(own)
    out, over = [], {}
    for cell in sorted(counts):
        take = min(room[owner[cell]], counts[cell])
        room[owner[cell]] -= take
        if take:
            out.append((cell, 0, take, owner[cell]))
        if take < counts[cell]:
            over[cell] = (take, counts[cell])
    waiting: deque[tuple[int, int, int]] = deque()
    for step in range(2 * CELLS):
        cell = step % CELLS
        if step < CELLS and cell in over:
            waiting.append((cell, *over[cell]))
        shard = owner[cell]
        while waiting and room[shard]:
            src, first, end = waiting.popleft()
            take = min(room[shard], end - first)
            room[shard] -= take
            out.append((src, first, first + take, shard))
            if first + take < end:
                waiting.appendleft((src, first + take, end))
    slot, ranges = [0] * n_shards, []
    for cell, first, end, shard in sorted(out):
        ranges.append((cell, first, end, shard, slot[shard]))
        slot[shard] += end - first
    return ranges


def shard(rows: DataFrame, key: list[str], n_shards: int, vnodes: int = VNODES) -> DataFrame:
    """The columns ``key`` of every row, with home (the ring's shard without
    bounds), shard and slot. Equal keys are interchangeable."""
    spark = rows.sparkSession
    place = F.xxhash64(*[F.col(c) for c in key])
    runs = cut(rows.groupBy(*key).agg(F.count("*").alias("_n"))
               .withColumn("_place", place)
               .withColumn("_cell", F.shiftrightunsigned("_place", 64 - CELL_BITS)))
    counts = {r["_cell"]: r["n"] for r in runs.groupBy("_cell").agg(F.sum("_n").alias("n")).collect()}  # CELLS rows at most
    owner = ring(n_shards, vnodes)
    ranges = spark.createDataFrame([(c, a, b, s, k, owner[c]) for c, a, b, s, k in plan(counts, n_shards, vnodes)],
                                   "_c long, _first long, _end long, shard int, _slot long, home int")
    w = W.partitionBy("_cell").orderBy("_place", *[F.col(c).asc_nulls_first() for c in key])
    numbered = runs.withColumn("_from", F.sum("_n").over(w) - F.col("_n"))
    first = F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(RUN).cast("long"))
    each = numbered.withColumn("_i", F.explode(first))  # by RUN rows, so that no array is long
    # a cell is one task up to here; the runs of its keys go to many
    each = each.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_place", "_i")
    last = F.least(F.col("_n"), F.col("_i") + RUN) - 1
    each = each.withColumn("_j", F.explode(F.sequence("_i", last))).withColumn("_nth", F.col("_from") + F.col("_j"))
    hit = (F.col("_cell") == F.col("_c")) & (F.col("_nth") >= F.col("_first")) & (F.col("_nth") < F.col("_end"))
    # the plan has at most a few ranges a cell: its size is bounded by CELLS
    return each.join(F.broadcast(ranges), hit).select(
        *key, "home", "shard", (F.col("_slot") + F.col("_nth") - F.col("_first")).alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards 0 to 7, law ``rows``."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
                       F.coalesce(F.crc32("text"), F.lit(0).cast("long")).alias("text_crc32"),
                       F.xxhash64("text").alias("text_hash"))
    out = shard(rows, ["doc_id", "size", "text_crc32", "text_hash"], 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "home")
