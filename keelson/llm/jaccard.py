"""N-gram Jaccard join with a token-group matrix.

Two texts link when the Jaccard similarity of their shingle sets reaches a
limit; the result is every row's component of links. It is exact:

1. ``sets``: a text's set is an array of 64-bit shingle hashes; equal sets have
   one ``sid`` and are one class from here on.
2. ``fronts``: with all shingles in one global order, sets that link share a
   shingle among their first n - need + 1. The order puts a hashed zone of
   shingles first and, in it, those that only one class has, then the rarer
   ones. A class whose first shingles are all its own has no partner, which
   ends most classes here. Only the zone's shingles are shuffled.
   The classes that are left go through it again with all their shingles: now
   all of a class's own shingles come first, so texts of one template, which
   share common shingles but link with none, end here. Of a pair, the shorter
   set must have the shared shingle in a still shorter prefix (the ``early``
   entries), so two classes meet only if one of them has it there.
3. Groups: what is left is partitioned into groups of similar classes, by the
   commonest shingle of the prefix, and large groups into blocks of bounded
   size. Within a block all pairs are compared (a matrix product). Two
   partitions into blocks make two rounds; their links give first components.
4. Matrix: its rows are shingles, its columns the blocks of the first
   partition, and an entry says that a member has the shingle among its first
   ones. A class asks for blocks with members of another, larger component. The
   token union of every block that is asked is stored; it
   bounds how many of the class's shingles any member can
   share. Only blocks whose bound reaches the class's need are opened: members
   are shuffled to them alone and compared exactly. The links join the components for good.

Large groups: copies are one class; near copies that have become one component
don't ask for each other's blocks; blocks and their questions are split by
count and by shingles, and tasks are made for the shingles asked with.
No pairs of rows are made but (class, block) and links.

Defined results: null and empty texts and texts of white space have an empty
set, which links with nothing; a text shorter than a shingle is one shingle;
repeated rows are in one component; a null id is no candidate for the
smallest id; an empty table gives no rows; other columns stay out of the way.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, read

MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
REMEMBERED = 200_000   # words whose hashes a worker holds, then it starts anew
FRONT = 2              # the zone has so many times the shingles that a prefix needs
BLOCK_ROWS = 256       # classes of a block, about
BLOCK_TOKENS = 1 << 18  # shingles of a block, about (one class may have more)
ASKING = 2048          # classes that ask a copy of a block, about
TASK_TOKENS = 1 << 20  # shingles that a task holds, about
WIDTH = 8192           # columns of a matrix product at a time


def need(n, percent: int):
    """Words in common that a set of n must have with any partner: ceil(percent/100 * n)."""
    return -(-n * percent // 100)


class Shingler:
    """64-bit hashes of a text's distinct shingles, sorted."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def word(self, w: bytes) -> int:
        import xxhash

        if len(self.known) >= REMEMBERED:
            self.known.clear()
        h = self.known[w] = xxhash.xxh3_64_intdigest(w)
        return h

    def __call__(self, text: str | None):
        import numpy as np

        words = (text or "").encode().lower().split()  # of bytes: A-Z and the six white spaces
        if not words:
            return np.empty(0, np.uint64)
        get, word = self.known.get, self.word
        h = np.fromiter((get(w) or word(w) for w in words), np.uint64, len(words))
        k = min(self.size, len(words))
        out = np.full(len(words) - k + 1, k, np.uint64)
        for i in range(k):
            out = mix(out * np.uint64(MIX[2]) + h[i:len(h) - k + 1 + i])
        return np.unique(out)


def set_id(s) -> int:
    """Hash of a set; the order of its members doesn't matter."""
    import numpy as np

    return int((mix(s + np.uint64(MIX[0])).sum(dtype=np.uint64) ^ np.uint64(len(s))).astype(np.int64))


def mix(x):
    """Spread the bits of unsigned 64-bit numbers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def sets(docs: DataFrame, text: str, key: str, size: int, percent: int, front: float) -> DataFrame:
    """Per row: id, th (text's hash), n (shingles), sid (hash of the set), the tokens that may be in
    its prefix: those of the front zone, then as many more as a prefix needs."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        shingles, edge = Shingler(size), np.uint64(min(int(front * 2 ** 64), 2 ** 64 - 1))
        for b in batches:
            for first in range(0, b.num_rows, 256):
                part = b.slice(first, 256)
                texts = part.column(2).to_pylist()
                ns, sids, fronts, parts = [], [], [], []
                for t in texts:
                    s = shingles(t)
                    inside = int(np.searchsorted(s, edge))
                    prefix = len(s) - need(len(s), percent) + 1 if len(s) else 0
                    ns.append(len(s))
                    sids.append(set_id(s))
                    fronts.append(inside)
                    parts.append(s[:max(inside, prefix)].view(np.int64))
                at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(ns, pa.int64()), pa.array(sids, pa.int64()), pa.array(fronts, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts)))],
                    names=["id", "th", "n", "sid", "inside", "tokens"])

    return docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text")).mapInArrow(
        run, "id long, th long, n long, sid long, inside long, tokens array<long>")


def fronts(rows: DataFrame, percent: int) -> DataFrame:
    """Per class that may have a partner: sid, n, prefix (the shingles of its
    prefix that other classes have too, rare ones first), early (how many of
    them are in the prefix that the shorter of two sets must share), hub (the one in most prefixes)."""
    each = rows.select("sid", F.explode("tokens").alias("token"))
    # most shingles stand in one row: only counts are shuffled to tell them
    again = cut(each.groupBy("token").count().filter("count > 1").select("token"))
    met = cut(each.join(again, "token"))
    shared = (met.groupBy("token").agg(F.min("sid").alias("a"), F.max("sid").alias("b"), F.count("*").alias("rows"))
              .filter("a <> b").select("token", "rows"))
    # collect_set: repeated rows of a class are one; a class is at most a text long
    found = met.join(shared, "token").groupBy("sid").agg(F.array_sort(F.collect_set(F.struct("rows", "token"))).alias("shared"))
    found = found.join(rows.select("sid", "n", "inside").distinct(), "sid")
    length = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1  # of the prefix
    own = F.greatest("inside", length) - F.size("shared")                 # shingles that no other class has come first
    # sets of n and m >= n shingles that link have p / (100 + p) * (n + m) in common, so 2 p / (100 + p) * n at least
    shorter = F.col("n") - F.floor((2 * percent * F.col("n") + 99 + percent) / (100 + percent)) + 1
    early = F.greatest(F.lit(0), F.least(length, shorter) - own).cast("int")
    front = cut(found.withColumn("rest", (length - own).cast("int")).filter("rest > 0")
                .select("sid", "n", F.transform(F.slice("shared", F.lit(1), F.col("rest")), lambda x: x["token"]).alias("prefix"), early.alias("early")))
    discard(again, met)
    entry = front.select("sid", "early", F.posexplode("prefix").alias("pos", "token")).withColumn("soon", (F.col("pos") < F.col("early")).cast("long"))
    common = entry.groupBy("token").agg(F.count("*").alias("classes"), F.sum("soon").alias("soons"))
    # a shingle counts if one of two classes has it early
    met = entry.join(common, "token").filter((F.col("classes") > 1) & (F.col("soons") > 0) & ((F.col("soon") == 1) | (F.col("soons") > F.col("soon"))))
    hub = met.groupBy("sid").agg(F.max(F.struct("classes", "token")).alias("hub"))
    return front.join(hub.select("sid", F.col("hub.token").alias("hub")), "sid")


def linked(n_a, n_b, both, percent: int):
    return 100 * both >= percent * (n_a + n_b - both)


def common(a: list, b: list):
    """Sizes of the intersections of two lists of sorted arrays, as a matrix."""
    import numpy as np

    out = np.zeros((len(a), len(b)), np.float32)
    ta, tb = np.concatenate(a), np.concatenate(b)
    vocabulary = np.intersect1d(ta, tb)
    sides = []
    for tokens, parts in ((ta, a), (tb, b)):
        row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        at = np.searchsorted(vocabulary, tokens)
        ok = (at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] == tokens) if len(vocabulary) else np.zeros(len(tokens), bool)
        order = np.argsort(at[ok], kind="stable")
        sides.append((row[ok][order], at[ok][order], len(parts)))
    for first in range(0, len(vocabulary), WIDTH):
        made = []
        for row, at, n in sides:
            lo, hi = np.searchsorted(at, [first, first + WIDTH])
            m = np.zeros((n, WIDTH), np.float32)
            m[row[lo:hi], at[lo:hi] - first] = 1
            made.append(m)
        out += made[0] @ made[1].T
    return out.astype(np.int64)


def _arrays(table, column: str) -> list:
    """An Arrow table's list column as numpy arrays."""
    import numpy as np

    out: list = []
    for c in table.column(column).chunks:
        offsets, values = c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
        out += [values[s:e] for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
    return out


def _by(values) -> dict:
    import numpy as np

    order = np.argsort(values, kind="stable")
    ordered = values[order]
    cuts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]).tolist() + [len(ordered)]
    return {int(ordered[s]): order[s:e] for s, e in zip(cuts[:-1], cuts[1:], strict=True)} if len(values) else {}


def blocks_of(full: DataFrame, turn: int) -> DataFrame:
    """``full`` (sid, n, hub, tokens) with block: the class's part of its group."""
    sizes = full.groupBy("hub").agg(F.count("*").alias("k"), F.sum("n").alias("t"))
    parts = F.greatest(F.ceil(F.col("k") / BLOCK_ROWS), F.ceil(F.col("t") / BLOCK_TOKENS))
    return (full.join(sizes.select("hub", parts.alias("parts")), "hub")
            .withColumn("block", F.xxhash64("hub", F.pmod(F.xxhash64(F.lit(turn), "sid"), F.col("parts")))).drop("parts"))


def _tasks(total_tokens: int, spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), total_tokens // TASK_TOKENS + 1)


def within(blocks: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Links (a, b) that join what is connected within each block."""
    def run(table):
        import numpy as np
        import pyarrow as pa

        sid, tokens = table.column("sid").to_numpy(), _arrays(table, "tokens")
        out_a, out_b = [], []
        for rows in _by(table.column("block").to_numpy()).values():
            if len(rows) < 2:
                continue
            own = [tokens[i] for i in rows]
            n = np.array([len(t) for t in own])
            near = linked(n[:, None], n[None, :], common(own, own), percent)
            label = np.arange(len(rows))
            while True:
                low = np.where(near, label[None, :], len(rows)).min(1)
                if (low == label).all():
                    break
                label = low
            moved = np.flatnonzero(label != np.arange(len(rows)))
            out_a.append(sid[rows[moved]])
            out_b.append(sid[rows[label[moved]]])
        none = [np.empty(0, np.int64)]
        return pa.table({"a": np.concatenate(out_a + none), "b": np.concatenate(out_b + none)})

    return (blocks.select("sid", "tokens", "block", F.pmod(F.xxhash64("block"), F.lit(tasks)).alias("task"))
            .groupBy("task").applyInArrow(run, "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node of each one's component. Rounds of the
    smallest neighbouring label, each with a shortcut over the label's label."""
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(seen, labels["node"] == seen["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = low.select(F.col("node").alias("via"), F.col("label").alias("further"))
        nxt = cut(low.join(jump, low["label"] == jump["via"]).select("node", "old", F.least("label", "further").alias("label")))
        labels = nxt.select("node", "label")
        if nxt.filter("old <> label").isEmpty():
            return labels


def across(blocks: DataFrame, front: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes of different components, by the matrix."""
    spark = blocks.sparkSession
    named = blocks.select("sid", "n", "block").join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn(
        "label", F.coalesce("label", "sid"))
    size = named.groupBy("label").agg(F.count("*").alias("size"))
    named = cut(named.join(size, "label"))
    soon = F.col("pos") < F.col("early")
    entry = cut(front.select("sid", "early", F.posexplode("prefix").alias("pos", "token")).select("sid", "token", soon.alias("soon")).join(named, "sid"))
    top = (entry.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("soon").alias("any"),
                                      F.max(F.struct("size", "label")).alias("top")).filter("lo <> hi AND any").select("token", "top"))
    live = cut(entry.join(top, "token"))  # rows of the matrix with more than one component
    asks = live.filter(F.struct("size", "label") != F.col("top")).select("sid", "n", "label", "size", "token", "soon")
    # an entry holds the range of its members' sizes and its largest components (two, so that one differs)
    columns = live.groupBy("token", "block").agg(F.max(F.struct("size", "label")).alias("most"), F.min("n").alias("least_n"), F.max("n").alias("most_n"),
                                                 F.max("soon").alias("any"))
    hit = asks.join(columns, "token").filter(
        (F.struct("size", "label") < F.col("most")) & (F.col("soon") | F.col("any"))
        & (F.col("least_n") * percent <= F.col("n") * 100) & (F.col("n") * percent <= F.col("most_n") * 100))
    pairs = cut(hit.select("sid", "n", "block").distinct())
    full = blocks.select("sid", "tokens").join(named.select("sid", "label"), "sid")
    asked = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = _tasks(asked, spark)
    opened = cut(bounded(pairs, full.select("sid", "tokens"), unions(blocks, pairs), percent, tasks))
    copies = opened.groupBy("block").agg(F.ceil(F.count("*") / ASKING).alias("copies"))
    asking = (opened.join(copies, "block").withColumn("copy", F.pmod(F.xxhash64("sid"), F.col("copies")))
              .join(full, "sid").select("block", "copy", "sid", "label", "tokens"))
    members = (blocks.select("sid", "tokens", "block").join(copies, "block").join(named.select("sid", "label"), "sid")
               .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
               .select("block", "copy", "sid", "label", "tokens"))

    def run(asking, held):
        import numpy as np
        import pyarrow as pa

        sides = [(t.column("sid").to_numpy(), t.column("label").to_numpy(), _arrays(t, "tokens"), _by(t.column("place").to_numpy()))
                 for t in (asking, held)]
        (sid_a, label_a, tok_a, by_a), (sid_b, label_b, tok_b, by_b) = sides
        out_a, out_b = [], []
        for place, rows_b in by_b.items():
            rows_a = by_a.get(place, np.empty(0, np.int64))
            for first in range(0, len(rows_a), BLOCK_ROWS):
                part = rows_a[first:first + BLOCK_ROWS]
                a, b = [tok_a[i] for i in part], [tok_b[i] for i in rows_b]
                n_a, n_b = np.array([len(t) for t in a]), np.array([len(t) for t in b])
                near = linked(n_a[:, None], n_b[None, :], common(a, b), percent)
                near &= label_a[part][:, None] != label_b[rows_b][None, :]
                x, y = np.nonzero(near)
                # one link a class and component is enough
                _, one = np.unique(np.stack([x, label_b[rows_b[y]]]), axis=1, return_index=True) if len(x) else (None, np.empty(0, np.int64))
                out_a.append(sid_a[part[x[one]]])
                out_b.append(sid_b[rows_b[y[one]]])
        none = [np.empty(0, np.int64)]
        return pa.table({"a": np.concatenate(out_a + none), "b": np.concatenate(out_b + none)})

    place = F.xxhash64("block", "copy")

    def tasked(df: DataFrame):
        rows = df.withColumn("place", place).withColumn("task", F.pmod(F.xxhash64("place"), F.lit(tasks)))
        return rows.select("sid", "label", "tokens", "place", "task").toDF("sid", "label", "tokens", "place", "task").groupBy("task")
    return tasked(asking).cogroup(tasked(members)).applyInArrow(run, "a long, b long")


def unions(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """block, tokens: the stored union of the shingles of every block that is asked."""
    def run(table):
        import numpy as np
        import pyarrow as pa

        own = np.unique(np.concatenate(_arrays(table, "tokens")))
        return pa.table({"block": table.column("block").slice(0, 1), "tokens": pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(own))})

    asked = blocks.select("block", "tokens").join(pairs.select("block").distinct(), "block", "left_semi")
    return cut(asked.groupBy("block").applyInArrow(run, "block long, tokens array<long>"))


def bounded(pairs: DataFrame, sets: DataFrame, stored: DataFrame, percent: int, tasks: int) -> DataFrame:
    """The (sid, block) of ``pairs`` whose bound, the class's shingles in the
    block's union, reaches the class's need. Blocks that many ask are asked by parts."""
    copies = pairs.groupBy("block").agg(F.ceil(F.count("*") / ASKING).alias("copies"))
    place = F.xxhash64("block", "copy")

    def tasked(df: DataFrame):
        return df.withColumn("place", place).withColumn("task", F.pmod(F.xxhash64("place"), F.lit(tasks))).groupBy("task")
    asking = (pairs.select("sid", "block").join(copies, "block").withColumn("copy", F.pmod(F.xxhash64("sid"), F.col("copies"))).join(sets, "sid")
              .select("block", "copy", "sid", "tokens"))
    held = (stored.join(copies, "block").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
            .select("block", "copy", "tokens"))

    def run(asking, held):
        import numpy as np
        import pyarrow as pa

        sid, block, own, by = (asking.column("sid").to_numpy(), asking.column("block").to_numpy(), _arrays(asking, "tokens"),
                               _by(asking.column("place").to_numpy()))
        found = []
        for place, union in zip(held.column("place").to_pylist(), _arrays(held, "tokens"), strict=True):
            for i in by.get(place, []):
                at = np.minimum(np.searchsorted(union, own[i]), len(union) - 1)
                if (union[at] == own[i]).sum() >= need(len(own[i]), percent):
                    found.append(i)
        return pa.table({"sid": sid[found], "block": block[found]})

    return tasked(asking).cogroup(tasked(held)).applyInArrow(run, "sid long, block long")


def own_texts(docs: DataFrame, text: str, key: str, rows: DataFrame, front: DataFrame) -> DataFrame:
    """sid, hub, text of the classes of ``front``: the text of one of a class's rows (smallest id, which
    isn't null if one isn't, and text hash). Rows of that id with other texts aren't met."""
    row = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    one = (rows.join(front.select("sid", "hub"), "sid").groupBy("sid", "hub").agg(F.min(row).alias("row"))
           .select("sid", "hub", F.col("row.id").alias("_jac_id"), F.col("row.th").alias("_jac_th")))
    texts = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return texts.join(one, F.col("id").eqNullSafe(F.col("_jac_id")) & (F.col("th") == F.col("_jac_th"))).select("sid", "hub", "text")


def full_sets(docs: DataFrame, text: str, key: str, rows: DataFrame, front: DataFrame, size: int) -> DataFrame:
    """sid, n, hub, tokens (all) of the classes of ``front``."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        shingles = Shingler(size)
        for b in batches:
            for first in range(0, b.num_rows, 256):
                part = b.slice(first, 256)
                sid = part.column(0).to_pylist()
                made = [shingles(t) for t in part.column(2).to_pylist()]
                right = [i for i, s in enumerate(made) if set_id(s) == sid[i]]  # texts of one hash may differ
                if not right:
                    continue
                own = [np.sort(made[i].view(np.int64)) for i in right]
                at = np.concatenate([[0], np.cumsum([len(s) for s in own])]).astype(np.int32)
                taken = part.take(pa.array(right))
                yield pa.RecordBatch.from_arrays(
                    [taken.column(0), pa.array([len(s) for s in own], pa.int64()), taken.column(1),
                     pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(own)))], names=["sid", "n", "hub", "tokens"])

    made = own_texts(docs, text, key, rows, front).mapInArrow(run, "sid long, n long, hub long, tokens array<long>")
    return made.dropDuplicates(["sid"])


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of ``docs``: id, th (text's hash), n (distinct shingles), sid, label (the
    same for all rows of a component, also without ids; null for an empty set), component
    (smallest id linked with it, over any number of links)."""
    spark = docs.sparkSession
    whole = cut(sets(docs, text, key, size, percent, min(1.0, FRONT * (100 - percent) / 100)))
    rows = cut(whole.drop("tokens"))
    front = cut(fronts(whole, percent))
    discard(whole)
    some = cut(full_sets(docs, text, key, rows, front, size))
    # again over whole sets; classes whose partners have gone drop out here
    front = cut(fronts(some.select("sid", "n", F.col("n").alias("inside"), "tokens"), percent))
    full = cut(some.drop("hub").join(front.select("sid", "hub"), "sid").select("sid", "n", "hub", "tokens"))
    discard(some)
    tasks = _tasks(full.agg(F.sum("n")).first()[0] or 0, spark)
    first, second = cut(blocks_of(full, 1)), blocks_of(full, 2)
    links = cut(within(first, percent, tasks).union(within(second, percent, tasks)))
    discard(full)
    labels = components(links)
    more = cut(across(first, front, labels, percent))
    if not more.isEmpty():
        labels = components(links.union(more))
    per = rows.groupBy("sid").agg(F.min("id").alias("least")).join(labels.withColumnRenamed("node", "sid"), "sid", "left")
    least = per.filter("label IS NOT NULL").groupBy("label").agg(F.min("least").alias("all_least"))
    per = per.join(least, "label", "left").select("sid", F.coalesce("label", "sid").alias("label"), F.coalesce("all_least", "least").alias("least"))
    out = rows.select("id", "th", "n", "sid").join(per, "sid")
    return out.select("id", "th", "n", "sid", F.when(F.col("n") > 0, F.col("label")).alias("label"),
                      F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("least")).alias("component"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` at 3-word shingles and 90 %."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return classes(docs).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
