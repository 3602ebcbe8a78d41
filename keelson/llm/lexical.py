"""Ranked lexical search: hybrid of term-at-a-time and document-at-a-time.

Every document is ranked for every item of a stated set of queries:

1. ``index``: one pass over the documents. A task cuts its documents into
   blocks of bounded size and writes a block's inverted lists of the items'
   terms as one row; documents aren't shuffled. The row also has how many
   documents with a term the block has seen, and of how many terms.
2. ``weights``: these sums and the lists' lengths give N, L and df of the whole
   table, and with them every term's weight.
3. ``search``: each block is searched for all items, and a task carries each
   item's best ``k`` from block to block, so the score to beat rises. The
   item's short lists are taken term at a time: their scores are summed into
   accumulators. These, sorted by document and with a bound of their own, are
   from then on one iterator among the long lists, which are walked document
   at a time, in windows of ``WINDOW`` documents: a window whose bounds don't
   reach the score to beat is skipped in all lists; in an open one, only lists
   that together can reach it give candidates, the others are looked up for
   candidates that still can. Bounds count ties, so no document is lost.
4. The tasks' best are merged in two steps, so that no task merges those of all.

Items are searched in slices of ``SLICE_TERMS`` terms (an expected size, since
they are dealt by hash), so that what a task holds of them is bounded; every
slice reads the documents once. Scores are 64-bit integers.

Terms are maximal runs of ASCII digits and letters and of all characters
beyond ASCII; only A-Z are lower-cased. Defined results: a null text or one
without terms matches nothing and doesn't count; an item without terms has no
rows; repeated rows of documents are ranked each; repeated rows of items are
one item, rows of one id and of different texts are different items; a null
document id ranks behind its equals; texts are read whole; an empty table on
either side gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, discard, prepare, read, settings

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BEST = 50
SLICE_TERMS = 500_000    # terms of the items that are searched in one pass
BLOCK_DOCS = 8192        # documents in a block
BLOCK_POSTS = 1_000_000  # a block is closed when its lists are so long
WINDOW = 512             # documents that are walked together
SHORT = 16               # a list with under a 16th of the block's documents is short

#: In UTF-8: letters lower-cased, digits and bytes beyond ASCII kept, all others a space.
_FOLD = bytes(b if b >= 128 or chr(b).isdigit() or chr(b) in LOWER else b + 32 if chr(b) in UPPER else 32 for b in range(256))

INDEX = ("n_docs long, n_terms long, ids array<long>, sizes array<long>, terms array<int>, lengths array<int>, "
         "posts binary, counts binary")


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def item_terms(text: Column) -> Column:
    folded = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0)))


def index(docs: DataFrame, vocab: dict[bytes, int], text: str, key: str) -> DataFrame:
    """One row per block of documents, with the lists of the terms in ``vocab``."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
                            ("terms", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("posts", pa.binary()), ("counts", pa.binary())])

        def closed():
            term, count = np.array(terms, np.int32), np.array(counts, np.int32)
            post = np.repeat(np.arange(len(ids), dtype=np.int32), held)
            order = np.argsort(term, kind="stable")
            own, lengths = np.unique(term, return_counts=True)
            row = [[n_docs], [n_terms], [ids], [sizes], [own], [lengths.astype(np.int32)], [post[order].tobytes()], [count[order].tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        n_docs = n_terms = 0
        ids, sizes, held, terms, counts = [], [], [], [], []
        for b in batches:
            for at in range(0, b.num_rows, 512):
                keys, texts = (b.column(i).slice(at, 512).to_pylist() for i in (0, 1))
                for i, t in zip(keys, texts, strict=True):
                    words = terms_of(t)
                    if not words:
                        continue
                    n_docs, n_terms, before = n_docs + 1, n_terms + len(words), len(terms)
                    for word, n in Counter(words).items():
                        if word in vocab:
                            terms.append(vocab[word])
                            counts.append(n)
                    if len(terms) > before:
                        ids.append(i)
                        sizes.append(len(words))
                        held.append(len(terms) - before)
                    if len(ids) >= BLOCK_DOCS or len(terms) >= BLOCK_POSTS:
                        yield closed()
                        n_docs = n_terms = 0
                        ids, sizes, held, terms, counts = [], [], [], [], []
        if n_docs:
            yield closed()

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInArrow(run, INDEX)


class Block:
    """A block's lists with the score of every entry, and their bounds."""

    def __init__(self, row: dict, n: int, length: int):
        import numpy as np

        self.size = len(row["ids"])
        self.ids = row["ids"]
        norm = np.array([20 * (100 - 50 + 50 * s * n // length) for s in row["sizes"]], np.int64)
        self.post = np.frombuffer(row["posts"], np.int32)
        count = np.frombuffer(row["counts"], np.int32).astype(np.int64)
        self.part = 1_000_000_000 * count // (1000 * count + norm[self.post])
        ends = np.cumsum(row["lengths"], dtype=np.int64) if len(row["lengths"]) else np.zeros(0, np.int64)
        starts = ends - np.asarray(row["lengths"], np.int64)
        self.at = {t: (int(a), int(b)) for t, a, b in zip(row["terms"], starts, ends, strict=True)}
        most = np.maximum.reduceat(self.part, starts) if len(starts) else starts
        self.most = dict(zip(row["terms"], most.tolist(), strict=True))
        self.edges = np.arange(0, self.size + WINDOW, WINDOW)
        self._windows: dict[int, tuple] = {}

    def windows(self, term: int):
        """Where each window of a long list starts, and the window's largest entry."""
        if term not in self._windows:
            a, b = self.at[term]
            self._windows[term] = bounded(self.post[a:b], self.part[a:b], self.edges)
        return self._windows[term]


def bounded(post, part, edges):
    """Places of ``edges`` in the sorted ``post``, and the largest ``part`` of each window."""
    import numpy as np

    cuts = np.searchsorted(post, edges)
    most = np.zeros(len(edges) - 1, np.int64)
    filled = np.flatnonzero(cuts[1:] > cuts[:-1])
    if len(filled):
        most[filled] = np.maximum.reduceat(part, cuts[filled])
    return cuts, most


class Best:
    """An item's best ``k`` documents so far: larger scores first, then smaller ids, null ids last."""

    def __init__(self, k: int):
        self.k, self.floor, self.rows = k, 1, []

    def add(self, scores: list[int], ids: list) -> None:
        self.rows += [(-s, i is None, i or 0) for s, i in zip(scores, ids, strict=True)]
        if len(self.rows) > self.k:
            self.rows.sort()
            del self.rows[self.k:]
        if len(self.rows) == self.k:
            self.floor = max(self.floor, -max(self.rows)[0])


def search_block(block: Block, weights: list[tuple[int, int]], best: Best) -> int:
    """Add the block's documents that can be among the item's best; the number of windows opened."""
    import numpy as np

    here = [(t, w) for t, w in weights if t in block.at]
    if sum(w * block.most[t] for t, w in here) < best.floor:
        return 0
    short = [(t, w) for t, w in here if SHORT * (block.at[t][1] - block.at[t][0]) < block.size]
    long = [(t, w) for t, w in here if SHORT * (block.at[t][1] - block.at[t][0]) >= block.size]
    # iterators of the walk: (documents, scores, window starts, window bounds)
    walk = []
    if short:  # term at a time
        total = np.zeros(block.size, np.int64)
        for t, w in short:
            a, b = block.at[t]
            total[block.post[a:b]] += w * block.part[a:b]
        docs = np.flatnonzero(total)
        walk.append((docs, total[docs], 1, *bounded(docs, total[docs], block.edges)))
    for t, w in long:
        a, b = block.at[t]
        cuts, most = block.windows(t)
        walk.append((block.post[a:b], block.part[a:b], w, cuts, w * most))
    bounds, opened = np.array([x[4] for x in walk]), 0
    whole = bounds.sum(0)
    for i in np.flatnonzero(whole >= best.floor).tolist():
        if whole[i] < best.floor:  # it has risen since
            continue
        opened += 1
        order = np.argsort(bounds[:, i], kind="stable")
        reach = np.cumsum(bounds[order, i])
        first = int(np.searchsorted(reach, best.floor))  # lists before it can't reach the score to beat together
        base = int(block.edges[i])
        total = np.zeros(WINDOW, np.int64)
        for j in order[first:]:
            docs, part, w, cuts, _ = walk[j]
            a, b = cuts[i], cuts[i + 1]
            total[docs[a:b] - base] += w * part[a:b]
        cand = np.flatnonzero(total)
        score = total[cand]
        for x in range(first - 1, -1, -1):
            able = score + reach[x] >= best.floor
            cand, score = cand[able], score[able]
            if not len(cand):
                break
            docs, part, w, cuts, _ = walk[order[x]]
            a, b = cuts[i], cuts[i + 1]
            if a < b:
                place = np.minimum(a + np.searchsorted(docs[a:b], cand + base), b - 1)
                score = score + np.where(docs[place] == cand + base, w * part[place], 0)
        able = score >= best.floor
        if able.any():
            best.add(score[able].tolist(), [block.ids[d + base] for d in cand[able].tolist()])
    return opened


def search(blocks: DataFrame, items: list[list[tuple[int, int]]], n: int, length: int, k: int) -> DataFrame:
    """item (its number in ``items``), doc_id, score: each task's best ``k`` of every item."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        best = [Best(k) for _ in items]
        for b in batches:
            for i in range(b.num_rows):
                block = Block(b.slice(i, 1).to_pylist()[0], n, length)
                for weights, own in zip(items, best, strict=True):
                    search_block(block, weights, own)
        rows = [(i, None if none else d, -s) for i, own in enumerate(best) for s, none, d in own.rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                                          pa.array([r[2] for r in rows], pa.int64())], names=["item", "doc_id", "score"])

    return blocks.mapInArrow(run, "item int, doc_id long, score long")


def ranked(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    w = W.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rank(docs: DataFrame, items: DataFrame, k: int = BEST, text: str = "text", key: str = "doc_id", item_text: str = "text",
         item_key: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` highest-scoring ``docs`` of every row of ``items``."""
    spark = docs.sparkSession
    asked = items.select(F.col(f"`{item_key}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text")).distinct()
    asked = cut(asked.select("item_id", F.xxhash64("text").alias("_h"), item_terms(F.col("text")).alias("terms")).filter(F.size("terms") > 0))
    total = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    slices = max(1, math.ceil(total / SLICE_TERMS))
    out = None
    for s in range(slices):
        own = asked.filter(F.pmod(F.xxhash64("item_id", "_h"), F.lit(slices)) == s).collect()  # SLICE_TERMS terms
        vocab = {t: i for i, t in enumerate(sorted({t for r in own for t in r.terms}))}
        with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="1000"):
            blocks = cut(index(docs, {t.encode(): i for t, i in vocab.items()}, text, key))
        n, length, held = blocks.agg(F.sum("n_docs"), F.sum("n_terms"), F.count("*")).first()
        lists = blocks.select(F.explode(F.arrays_zip("terms", "lengths")).alias("x")).groupBy("x.terms").agg(F.sum("x.lengths").alias("df"))
        df = {r.terms: r.df for r in lists.collect()}  # as long as the slice's vocabulary
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
        weights = [[(vocab[t], weight[vocab[t]]) for t in r.terms if weight.get(vocab[t], 0) > 0] for r in own]
        with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="4"):
            found = cut(search(blocks, weights, n or 0, length or 0, k))
        discard(blocks)
        few = ranked(found.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, math.isqrt(held))))), ["item", "_salt"], k)
        named = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(own)], "_item int, item_id long")  # the slice's items
        made = ranked(few.drop("rank", "_salt"), ["item"], k).join(F.broadcast(named), F.col("item") == F.col("_item"))
        made = made.select("item_id", "rank", "doc_id", "score")
        out = made if out is None else out.unionByName(made)
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` ranked for every item of ``benchmark``."""
    prepare(spark)
    return rank(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))


ORACLE_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
counted AS (SELECT row, doc_id, terms, len(terms) AS n FROM docs WHERE len(terms) > 0),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM counted),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
posts AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM counted)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM posts GROUP BY term), corpus),
scored AS (
  SELECT item_id, row, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms))))) AS BIGINT) AS score
  FROM asked JOIN posts USING (term) JOIN weights USING (term), corpus GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= {BEST}
"""
