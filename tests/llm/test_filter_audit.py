"""Filter interaction audit against plain runs of every order of the filters."""

import random
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from llm_helpers import docs

from keelson.llm import catalog, filter_audit
from keelson.llm.filter_audit import audit, popcounts, survival_words, survivors
from keelson.plans.compare import compare, duck

SMOKE = "/root/testdata/sf0.001"


def plain(rows, labels):
    """rows: (id, text, part). Every order is run filter by filter."""
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    cases = defaultdict(list)
    for i, text, part in rows:
        text = text or ""
        w = text.encode().split()
        first = least.get(text)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
               "D": any(c in "#$%&*|" for c in text), "E": first is not None and (i is None or first < i)}
        cases[part or ""].append(({x for x, v in bad.items() if v}, i in good, i in toxic))
    out = []
    for part, each in cases.items():
        removed_by, made = Counter(), []
        for order in permutations("ABCDE"):
            left = list(each)
            for step, x in enumerate(order, 1):
                gone = [c for c in left if x in c[0]]
                failing = sum(x in c[0] for c in each)
                left = [c for c in left if x not in c[0]]
                removed_by[x] += len(gone)
                made.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(c[0] == {x} for c in each),
                             sum(c[1] for c in gone), sum(c[2] for c in gone)))
        out += [(*m, removed_by[m[1][m[2] - 1]]) for m in made]
    return sorted(out)


COLS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def run(frame, labels):
    return sorted(tuple(r) for r in audit(survivors(survival_words(frame, labels))).select(*COLS).collect())


def random_rows(n, seed):
    r = random.Random(seed)
    texts = [None, "", "   ", "x" * 5000, "a " * 250, " ".join(map(str, range(300))), " ".join(map(str, range(260))) + " #", "ABC " * 3, "é Ü",
             "word " * 120 + " ".join(f"w{i}" for i in range(130)), "UPPER " + " ".join(f"w{i}" for i in range(230)), "a | b"]
    return [(r.choice([None, *range(n)]), r.choice(texts), r.choice(["en", "de", "", None])) for _ in range(n)]


@pytest.mark.parametrize("hot", [1, 1024])
def test_orders_match_plain_runs(spark, monkeypatch, hot):
    """Ties, repeated ids, null ids, texts and parts; with HOT = 1 no text is
    common enough, and with 1024 every repeated one is joined by broadcast."""
    monkeypatch.setattr(filter_audit, "HOT", hot)
    rows = random_rows(150, 4)
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 150, 2)] + [(4, 1, 1), (4, None, None), (None, 1, 1), (999, 1, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    frame = spark.createDataFrame([(i, t, p, "x", 1, "y") for i, t, p in rows],
                                  "doc_id long, text string, lang string, part string, failed int, digest string")
    assert run(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")) == plain(rows, labels)


def test_no_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert run(docs(spark, []), none) == []
    got = run(docs(spark, [(1, "a")]), none)
    assert len(got) == 600 and {r[3] for r in got} == {0, 1} and sum(r[4] for r in got) == 120


@pytest.mark.parametrize("n", [0, 1, 2, 15, 16, 17, 47, 48, 1000, 12345])
def test_popcounts(n):
    r = random.Random(n)
    words = [r.getrandbits(32) for _ in range(n)]
    assert popcounts(words) == [sum(w >> b & 1 for w in words) for b in range(32)]


def test_words_hold_the_surviving_subsets(spark):
    got = survival_words(docs(spark, [(1, "#"), (2, "#")]), spark.createDataFrame([(2, 1, 1)], "doc_id long, quality int, toxic int"))
    rows = {r.id: r for r in got.collect()}
    assert rows[1].word == sum(1 << s for s in range(32) if not s & 0b01001)  # A and D
    assert rows[2].word == sum(1 << s for s in range(32) if not s & 0b11001) and rows[2].label == 3


def test_query_matches_sql(spark):
    r = compare(catalog.QUERIES["op12_filter_audit"](spark, SMOKE), duck(SMOKE), catalog.ORACLE["op12_filter_audit"])
    assert r["hash_match"] and r["rows"][0] == r["rows"][1] > 0, r
