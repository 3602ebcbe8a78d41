"""Small tables and brute-force versions for the operators of keelson.llm."""

import re
from collections import Counter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["id", "n", "size", "kept", "sid", "taken", "line", "pos", "h", "doc", "tokens", "src", "k"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def docs(spark, rows, extra=False):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    if not extra:
        return spark.createDataFrame(full, DOCS)
    schema = DOCS + "".join(f", {c} string" for c in CLASH)
    return spark.createDataFrame([r + tuple(f"x{i}" for i in range(len(CLASH))) for r in full], schema)


def shingles(text, size):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def components(rows, size, percent):
    """rows: (id, text) -> component of every row by comparing all pairs."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                label[find(a)] = find(b)
    least = {}
    for i, (key, _) in enumerate(sets):
        least.setdefault(find(i), []).append(key)
    out = []
    for i, (key, s) in enumerate(sets):
        own = [k for k in least[find(i)] if k is not None]
        out.append((key, len(s), key if not s else min(own, default=None)))
    return Counter(out)


def repetition(text):
    """The rules' figures from all pairs of positions."""
    w = words(text)
    n = len(w)
    length = [max((next((k for k in range(n - max(i, j)) if w[i + k] != w[j + k]), n - max(i, j))
                   for j in range(n) if j != i), default=0) for i in range(n)]

    def cover(least):
        return len({k for i in range(n) if length[i] >= least for k in range(i, i + length[i])})
    windows = Counter(tuple(w[i:i + 5]) for i in range(n - 4))
    repeat = {k for i in range(n - 4) if windows[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = n < 10 or 100 * len(repeat) > 20 * n
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat),
            failed, cover(10), max(length, default=0), not failed and 100 * cover(10) <= 10 * n and max(length, default=0) <= 50)
