"""Ranked lexical search against scores computed document by document."""

import math
import random
import re
from collections import Counter

import pytest
from llm_helpers import docs

from keelson.llm import catalog, lexical
from keelson.llm.lexical import Best, Block, rank, search_block
from keelson.plans.compare import compare, duck

SMOKE = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id string, score string"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(rows, items, k):
    """rows: (doc_id, text); items: (item_id, text)."""
    counted = [(i, Counter(terms(t))) for i, t in rows if terms(t)]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c in counted:
            m = 100 - 50 + (50 * sum(c.values()) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in set(terms(text)) if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=str)


def corpus(n, seed, words=60):
    r = random.Random(seed)
    names = [f"t{i}" for i in range(words)] + ["É", "é", "ßx", "the"]
    weight = [1 / (1 + i) for i in range(len(names))]
    made = [(i, r.choice([" ", ".", "-", "\n"]).join(x.upper() if r.random() < .2 else x for x in r.choices(names, weight, k=r.randint(1, 40))))
            for i in range(n)]
    return made, names, r


def items_of(names, r, n):
    return [(i, " ".join(r.choices(names, k=r.randint(1, 12)))) for i in range(n)]


@pytest.mark.parametrize("slices", [10, 500_000])
def test_ranks_match_plain_scores(spark, monkeypatch, slices):
    """Several blocks and slices; copies (ties), null and empty texts, null and
    repeated ids, repeated items, items without terms, clashing columns."""
    monkeypatch.setattr(lexical, "SLICE_TERMS", slices)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 16)
    rows, names, r = corpus(200, 1)
    rows += [(500 + i, rows[i % 3][1]) for i in range(60)] + [(None, rows[4][1]), (None, None), (7, rows[8][1]), (900, ""), (901, ".!?"), (902, "the " * 30_000)]
    items = items_of(names, r, 6) + [(50, "the"), (50, "the"), (50, "t1 t2"), (51, None), (52, "?"), (53, "unheard"), (None, "t3")]
    frame = spark.createDataFrame([(i, t, "a", "b") for i, t in items], ITEMS)
    got = rank(docs(spark, rows, extra=True), frame, k=8)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    own = sorted(((x.item_id, x.rank, x.doc_id, x.score) for x in got.collect()), key=str)
    assert own == plain(rows, items, 8)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a", "", "")], ITEMS)
    assert rank(docs(spark, []), items).count() == 0
    assert rank(docs(spark, [(1, None), (2, "b")]), items).count() == 0
    assert rank(docs(spark, [(1, "a")]), items.limit(0)).count() == 0


def test_windows_that_cannot_reach_the_score_are_skipped(spark, monkeypatch):
    """The walk by itself, with small windows: equal to all scores, few windows opened."""
    for name, value in (("BLOCK_DOCS", 400), ("WINDOW", 8), ("SHORT", 8)):
        monkeypatch.setattr(lexical, name, value)
    rows, names, r = corpus(1200, 2, words=300)
    items = items_of(names, r, 25)
    vocab = {t.encode(): i for i, t in enumerate(sorted({t for _, x in items for t in terms(x)}))}
    blocks = [b.asDict() for b in lexical.index(docs(spark, rows).coalesce(1), vocab, "text", "doc_id").collect()]
    assert len(blocks) >= 3
    n, length = sum(b["n_docs"] for b in blocks), sum(b["n_terms"] for b in blocks)
    df = Counter()
    for b in blocks:
        df.update(dict(zip(b["terms"], b["lengths"], strict=True)))
    held, opened, got = [Block(b, n, length) for b in blocks], 0, []
    for item, text in items:
        w = [(vocab[t.encode()], math.floor(1000 * math.log((2 * n + 2) / (2 * df[vocab[t.encode()]] + 1)))) for t in sorted(set(terms(text)))]
        best = Best(5)
        opened += sum(search_block(b, w, best) for b in held)
        got += [(item, at, i, -s) for at, (s, _, i) in enumerate(sorted(best.rows), 1)]
    assert sorted(got, key=str) == plain(rows, items, 5)
    assert opened < 0.6 * len(items) * sum(len(b.edges) - 1 for b in held)


def test_query_matches_sql(spark):
    r = compare(catalog.QUERIES["op11_lexical_search"](spark, SMOKE), duck(SMOKE), catalog.ORACLE["op11_lexical_search"])
    assert r["hash_match"] and r["rows"][0] == r["rows"][1] > 0, r
