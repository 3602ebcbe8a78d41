"""Quality rules on repetition, by suffix arrays.

The words of a text get a suffix array with longest-common-prefix lengths.
The longest prefix that a suffix shares with a neighbour in the array is the
longest repeat that starts at its word, so the repeated substrings that can't
be made longer are the spans [i, i + lcp). Their union gives the covered
fraction, their maximum the longest repeat. The same intervals give the
5-word windows found twice: a word is in one if and only if a span of at least
5 words covers it.

The words of long repeats are among those of the base rule's windows, so their
limit is stricter than its 20 %: a tenth, as the rules published for Gopher
(Rae et al., 2021) allow for repeated 10-grams.

The arrays are made for many texts at once, by prefix doubling on numpy
arrays: a suffix's first key is (text, word), so suffixes of different texts
never tie, and only tied suffixes are sorted again. A task holds one block of
texts at a time; a very long text is a block of its own.

Defined results: a null or empty text has no words and fails the base rule;
texts are used whole; equal texts get equal results; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, read

WINDOW = 5            # words of the windows of the base rule
LEAST_WORDS = 10      # base rule: fewer words fail
MOST_REPEATED = 20    # base rule: percent of words in repeated windows
LONG_REPEAT = 10      # words of a repeat that counts for the method's verdict
MOST_COVERED = 0.1   # fraction of the words that such repeats may cover
LONGEST = 50         # words that the longest repeat may have
BLOCK = 400_000       # words of a block of texts
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"),
          ("n_repeat_words", "long"), ("base_failed", "boolean"), ("covered_words", "long"),
          ("longest_repeat", "long"), ("kept", "boolean")]
SCHEMA = ", ".join(f"{n} {t}" for n, t in FIELDS)


def repeats(ids, owner):
    """ids: word numbers of texts one after another; owner: each word's text.
    Returns for every word the length of the longest repeat that starts there
    (0 if its word stands once in its text)."""
    import numpy as np

    n = len(ids)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    end = np.searchsorted(owner, owner, side="right")  # where each word's text ends
    key = owner.astype(np.int64) * (int(ids.max()) + 1) + ids
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    head = np.r_[True, ordered[1:] != ordered[:-1]]
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = start
    levels = [rank.copy()]  # levels[k]: equal where 2^k words are equal
    step = 1
    while True:
        alone = head & np.r_[head[1:], True]
        tied = np.flatnonzero(~alone)  # places of the array whose suffixes tie
        if not len(tied):
            break
        pos = sa[tied]
        after = pos + step
        nxt = np.where(after < end[pos], rank[np.minimum(after, n - 1)] + 1, 0)
        old = rank[pos]
        order = np.argsort(old * (n + 1) + nxt, kind="stable")  # within ranges of the array, that is
        pos, old, nxt = pos[order], old[order], nxt[order]
        sa[tied] = pos
        new = np.r_[True, (old[1:] != old[:-1]) | (nxt[1:] != nxt[:-1])]
        # two suffixes that end at the text's end aren't equal further on
        new |= nxt == 0
        head[tied] = new
        rank[pos] = np.maximum.accumulate(np.where(new, tied, 0))
        levels.append(rank.copy())
        step *= 2
    a, b = sa[:-1], sa[1:]
    pair = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[pair], b[pair]
    lcp = np.zeros(len(pair), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        inside = (x < end[a]) & (y < end[b])
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        lcp += same * (1 << k)
    np.maximum.at(out, a, lcp)
    np.maximum.at(out, b, lcp)
    return out


def covered(lengths, least: int):
    """Words in the union of the spans [i, i + lengths[i]) of at least ``least`` words."""
    import numpy as np

    at = np.flatnonzero(lengths >= least)
    reach = np.zeros(len(lengths) + 1, np.int64)
    np.add.at(reach, at, 1)
    np.add.at(reach, at + lengths[at], -1)
    return reach[:-1].cumsum() > 0


def measure(texts: list[str | None]) -> dict[str, list]:
    """The rules' figures and verdicts of a list of texts."""
    import numpy as np

    numbers: dict[bytes, int] = {}
    rows: dict[str, list] = {name: [] for name, _ in FIELDS}

    def finish(block: list[list[bytes]]) -> None:
        sizes = np.array([len(w) for w in block])
        numbers.clear()
        flat = np.fromiter((numbers.setdefault(x, len(numbers)) for w in block for x in w), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(block)), sizes)
        length = repeats(flat, owner)
        n = len(block)
        window = np.bincount(owner[covered(length, WINDOW)], minlength=n)
        cover = np.bincount(owner[covered(length, LONG_REPEAT)], minlength=n)
        longest = np.zeros(n, np.int64)
        np.maximum.at(longest, owner, length)
        failed = (sizes < LEAST_WORDS) | (100 * window > MOST_REPEATED * sizes)
        good = ~failed & (cover <= MOST_COVERED * sizes) & (longest <= LONGEST)
        for name, values in (("n_words", sizes), ("n_repeat_words", window), ("base_failed", failed),
                             ("covered_words", cover), ("longest_repeat", longest), ("kept", good)):
            rows[name] += values.tolist()

    block: list[list[bytes]] = []
    held = 0
    for text in texts:
        text = text if isinstance(text, str) else ""
        split = text.encode().split()  # bytes are split at the six ASCII white spaces
        rows["word_chars"].append(len(text) - sum(map(text.count, SPACES)))
        rows["n_symbols"].append(sum(map(text.count, SYMBOLS)))
        lines = [x for x in text.split("\n") if x.encode().split()]
        rows["n_dup_lines"].append(len(lines) - len(set(lines)))
        if block and held + len(split) > BLOCK:
            finish(block)
            block, held = [], 0
        block.append(split)
        held += len(split)
    if block:
        finish(block)
    return rows


def rules(text: Column) -> Column:
    """Struct of the rules' figures (``FIELDS``) of a text column."""
    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = [measure(texts.iloc[i:i + 512].tolist()) for i in range(0, len(texts), 512)]
            yield pd.DataFrame({name: [x for p in parts for x in p[name]] for name, _ in FIELDS})

    return run(text)


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` by the rules."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", rules(F.col("text")).alias("_r")).select("doc_id", "_r.*")


def keep_good(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text the rules keep."""
    prepare(spark)
    return (docs.withColumn("_rules_verdict", rules(F.col(text))["kept"]).filter("_rules_verdict")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
