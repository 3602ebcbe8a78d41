"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample (``SAMPLE`` vectors, those with the
smallest hashes): a node splits its vectors at the median of their projection
on the difference of two of them. Every vector is then put in a leaf of every
tree. A query walks all trees with one priority queue, ordered by the smallest
margin on the way to a node, and takes leaves until they hold ``EFFORT`` of
the index; the vectors of these leaves are its candidates, reranked by exact
cosine in double precision.

Vectors aren't copied for every tree: one row per vector, with its leaf in
every tree, goes to a block of rows that the first tree's leaves make. A query
goes to the blocks that hold a candidate (a bit matrix of which leaves meet
which leaves of the first tree tells) and each block returns its best ones. A
block lies once in one task, sorted before its queries, which stream past it:
only queries are copied, to their blocks, and no task holds more than a block
and a batch of queries. Of a block, the candidates of a query are scored; if
those are most of its rows, as with vectors without any structure, one product
of the batch with the block is cheaper and the others' scores are dropped.

Equal vectors are one class with its smallest ids, as many as an answer can
need, so a very common vector is one row; a leaf with many rows is split over
blocks of ``BLOCK`` rows.

Defined results: vectors that are null, zero, hold null or non-finite
components, have a null id or another length than most take no part; equal
scores go by smaller id; rows of one id are one candidate, equal rows one
query, and a query never finds its own id; fewer candidates give fewer rows; no vectors give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, read

SAMPLE = 16_384  # vectors that the trees are fitted on, at most
TREES = 16
LEAF = 32        # sample vectors of a leaf, at most
EFFORT = 1.0     # of the index that the leaves of a query hold, counted with repeats over all trees
BLOCK = 4_096    # rows of a block
WALKING = 128    # queries whose walks are a task
DENSE = 0.25     # share of a block's rows above which a product with the whole block is the cheaper way to their scores
PARTS = 16       # parts by which the meeting leaves are gathered
SPARE = 16       # candidates of a block whose scores are taken again by one fixed sum


class Forest:
    """Trees as arrays: node -> normal, threshold, children; a child below 0 is leaf ~child."""

    def __init__(self, sample, trees: int = TREES, leaf: int = LEAF, seed: int = 1):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.trees: list[tuple] = []
        self.held: list[list[int]] = []  # sample vectors of every leaf
        for _ in range(trees):
            normals, cuts, kids, held = [], [], [], []

            def grow(rows) -> int:
                if len(rows) <= leaf:
                    held.append(len(rows))
                    return ~(len(held) - 1)
                a, b = rng.choice(len(rows), 2, replace=False)
                normal = sample[rows[a]] - sample[rows[b]]
                at = sample[rows] @ normal
                cut_at = float(np.median(at))
                low = at <= cut_at
                if low.all():  # no split by this plane: halves by number
                    held.append(len(rows))
                    return ~(len(held) - 1)
                me = len(cuts)
                size = float(np.linalg.norm(normal)) or 1.0
                normals.append(normal / size)
                cuts.append(cut_at / size)
                kids.append([0, 0])
                kids[me] = [grow(rows[low]), grow(rows[~low])]
                return me

            root = grow(np.arange(len(sample)))
            dim = sample.shape[1]
            self.trees.append((np.array(normals, np.float32).reshape(-1, dim), np.array(cuts, np.float32), kids, root))
            self.held.append(held)
        self.leaves = max(map(len, self.held))  # of a tree, at most

    def leaf_of(self, x):
        """x: unit vectors -> their leaf in every tree."""
        import numpy as np

        out = np.empty((len(x), len(self.trees)), np.int16)
        for t, (normals, cuts, kids, root) in enumerate(self.trees):
            stack = [(root, np.arange(len(x)))]
            while stack:
                node, rows = stack.pop()
                if node < 0:
                    out[rows, t] = ~node
                    continue
                low = x[rows] @ normals[node] <= cuts[node]
                stack += [(kids[node][0], rows[low]), (kids[node][1], rows[~low])]
        return out

    def search(self, q, effort: float = EFFORT):
        """Leaves (tree x leaf, boolean) that a query takes, by one queue over all trees."""
        import numpy as np

        taken = np.zeros((len(self.trees), self.leaves), bool)
        margins = [normals @ q - cuts for normals, cuts, _, _ in self.trees]
        queue = [(-np.inf, t, tree[3]) for t, tree in enumerate(self.trees)]
        heapq.heapify(queue)
        left = effort * sum(self.held[0])
        while queue and left > 0:
            worst, t, node = heapq.heappop(queue)
            if node < 0:
                taken[t, ~node] = True
                left -= self.held[t][~node]
                continue
            margin = float(margins[t][node])
            low, high = self.trees[t][2][node]
            heapq.heappush(queue, (max(worst, margin), t, low))    # wrong side by the margin
            heapq.heappush(queue, (max(worst, -margin), t, high))
        return taken


def _vectors(column):
    import numpy as np

    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64) if len(column) else np.empty((0, 0))


def _unit(x):
    import numpy as np

    return (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)


def valid(table: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v of the rows that take part."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter(F.col("id").isNotNull() & v.isNotNull()).filter(fine)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.filter(F.size("v") == (lengths[0]["d"] if lengths else 0))


def nearest(table: DataFrame, queries, key: str = "vec_id", vector: str = "embedding", k: int = 5,
            trees: int = TREES, effort: float = EFFORT, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of every row of
    ``table`` whose id meets the condition ``queries`` (of the column id)."""
    import numpy as np

    rows = valid(table, key, vector)
    nth = F.row_number().over(W.partitionBy("v").orderBy("id"))  # Spark limits it before the shuffle
    ids = rows.distinct().withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    index = cut(ids.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    some = index.select("v", F.xxhash64("v").alias("h")).orderBy("h", F.col("v").cast("string")).limit(sample).collect()
    if not some:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    forest = Forest(_unit(np.array([r["v"] for r in some], np.float64)), trees)
    n_leaves = forest.leaves

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            leaf = forest.leaf_of(_unit(_vectors(b.column(0))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf[:, 0].astype(np.int64)),
                                              pa.array([x.tobytes() for x in leaf], pa.binary())], names=["v", "ids", "leaf", "leaves"])

    kind = index.schema["v"].dataType.simpleString()
    placed = cut(index.select("v", "ids").mapInArrow(place, f"v {kind}, ids array<long>, leaf long, leaves binary"))

    def meet(table):
        import pyarrow as pa

        leaves = np.stack([np.frombuffer(x, np.int16) for x in table.column("leaves").to_pylist()])
        bits = np.zeros((leaves.shape[1], n_leaves), bool)
        for t in range(leaves.shape[1]):
            bits[t, leaves[:, t]] = True
        n = int(table.column("n").to_numpy().sum())
        return pa.table({"leaf": table.column("leaf").slice(0, 1), "n": pa.array([n]), "bits": pa.array([np.packbits(bits).tobytes()])})

    # by parts, so that a leaf with many rows is no large group; equal rows of leaves are one
    part = F.pmod(F.xxhash64("leaves"), F.lit(PARTS))
    met = placed.groupBy("leaf", "leaves").agg(F.count("*").alias("n")).withColumn("part", part).groupBy("leaf", "part").applyInArrow(meet, "leaf long, n long, bits binary")
    counts, meets = np.zeros(n_leaves, np.int64), np.zeros((n_leaves, trees * n_leaves), bool)
    for r in met.collect():  # PARTS rows a leaf of the first tree at most
        counts[r["leaf"]] += r["n"]
        meets[r["leaf"]] |= np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=trees * n_leaves).astype(bool)
    # leaves of the first tree -> blocks: small neighbours share one, a large one has several
    first_block, blocks_of, held, block = np.zeros(n_leaves, np.int64), np.ones(n_leaves, np.int64), 0, 0
    for leaf in range(n_leaves):
        if held and held + counts[leaf] > BLOCK:
            block, held = block + 1, 0
        first_block[leaf] = block
        held += counts[leaf]
        if held > BLOCK:
            blocks_of[leaf] = -(-int(held) // BLOCK)
            block, held = block + int(blocks_of[leaf]), 0
    spark = table.sparkSession
    plan = spark.createDataFrame([(i, int(first_block[i]), int(blocks_of[i])) for i in range(n_leaves)], "leaf long, first long, parts long")
    # a row per leaf of the first tree: bounded by the sample
    held_rows = placed.join(F.broadcast(plan), "leaf").select(
        (F.col("first") + F.pmod(F.xxhash64("v"), F.col("parts"))).alias("block"), "v", "ids", "leaves")

    asking = cut(rows.filter(queries).groupBy("v").agg(F.min("id").alias("rep")))

    def walk(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                found = [forest.search(q, effort) for q in _unit(_vectors(part.column(0)))]
                where = [np.unique(np.concatenate([np.arange(first_block[i], first_block[i] + blocks_of[i])
                                                   for i in np.flatnonzero((meets & f.ravel()).any(1))] + [np.empty(0, np.int64)])) for f in found]
                row = np.repeat(np.arange(len(found)), [len(w) for w in where])
                bits = pa.array([np.packbits(f).tobytes() for f in found], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(where).astype(np.int64)), part.column(1).take(pa.array(row)), part.column(0).take(pa.array(row)), bits.take(pa.array(row))], names=["block", "rep", "v", "bits"])

    walks = -(-asking.count() // WALKING) or 1
    asked = asking.select("v", "rep").repartition(walks, "rep").mapInArrow(walk, f"block long, rep long, v {kind}, bits binary")

    def scored(q, x, size, mine):
        """Cosines (times the query's length) of the candidates, -inf elsewhere."""
        if mine.mean() > DENSE:
            return np.where(mine, (q @ x.T) / size, -np.inf)
        rough = np.full(mine.shape, -np.inf)
        for i, own in enumerate(mine):
            at = np.flatnonzero(own)
            rough[i, at] = (x[at] @ q[i]) / size[at]
        return rough

    def best_of(held, q, reps, bits):
        """(rep, vec_id, score) of the best of a block for a batch of queries."""
        x, size, ids, leaves = held
        took = np.stack([np.unpackbits(np.frombuffer(b, np.uint8), count=trees * n_leaves).reshape(trees, n_leaves) for b in bits]).astype(bool)
        mine = np.zeros((len(q), len(x)), bool)
        for t in range(trees):
            mine |= took[:, t][:, leaves[:, t]]
        rough = scored(q, x, size, mine)
        for i in range(len(q)):
            best = np.argpartition(-rough[i], SPARE)[:SPARE] if len(x) > SPARE else np.arange(len(x))
            edge = np.sort(rough[i][best])[max(0, len(best) - k - 1)] - 1e-9 * np.sqrt((q[i] * q[i]).sum())
            best = np.flatnonzero(rough[i] >= edge) if np.isfinite(edge) else best[np.isfinite(rough[i][best])]
            score = (x[best] * q[i]).sum(1) / (np.sqrt((q[i] * q[i]).sum()) * size[best])
            yield from ((reps[i], v, -s) for s, v in sorted((-s, v) for s, j in zip(score.tolist(), best, strict=True) for v in ids[j])[:k + 1])

    def rank(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, parts, held = None, [], None  # the block at hand: its pieces, then its arrays
        for b in batches:
            block, asks = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), b.num_rows]
            for first, end in zip(cuts[:-1], cuts[1:], strict=True):
                if first == end:
                    continue
                if block[first] != now:
                    now, parts, held = block[first], [], None
                if not asks[first]:
                    parts.append(b.slice(first, end - first))
                    continue
                if not parts and held is None:
                    continue  # nobody in this block
                if held is None:
                    x = np.concatenate([_vectors(p.column(2)) for p in parts])
                    leaves = np.stack([np.frombuffer(c, np.int16) for p in parts for c in p.column(4).to_pylist()])
                    held, parts = (x, np.sqrt((x * x).sum(1)), [i for p in parts for i in p.column(3).to_pylist()], leaves), []
                for start in range(first, end, 256):
                    piece = b.slice(start, min(256, end - start))
                    rows = list(best_of(held, _vectors(piece.column(2)), [r[0] for r in piece.column(3).to_pylist()], piece.column(4).to_pylist()))
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                                      pa.array([r[2] for r in rows], pa.float64())], names=["rep", "vec_id", "score"])

    both = (held_rows.select("block", F.lit(False).alias("asks"), "v", "ids", F.col("leaves").alias("bits"))
            .unionByName(asked.select("block", F.lit(True).alias("asks"), "v", F.array("rep").alias("ids"), "bits")))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), block + 1)
    best = both.repartition(tasks, "block").sortWithinPartitions("block", "asks").mapInArrow(rank, "rep long, vec_id long, score double")
    # rows of one id with different vectors: the id's best score
    best = best.groupBy("rep", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    top = best.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1)
    lists = top.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("found"))
    members = rows.filter(queries).distinct().join(asking.select(F.col("v").alias("_v"), "rep"), F.col("v") == F.col("_v")).select("id", "rep")
    others = members.join(lists, "rep").select(F.col("id").alias("query_id"), F.slice(
        F.filter("found", lambda f: f["vec_id"] != F.col("id")), 1, k).alias("found"))
    return others.select("query_id", F.posexplode("found").alias("pos", "f")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the rows of ``embeddings`` whose id is divisible by 50."""
    table = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return nearest(table, F.col("id") % 50 == 0)
