"""Secret scans against a plain scan, and random strings against names, digests and prose."""

import hashlib
import random
import re
import string

import pytest
from llm_helpers import docs

from keelson.llm import catalog, secret_scan
from keelson.llm.secret_scan import KINDS, Scanner, find_secrets, vocabulary

SMOKE = "/root/testdata/sf0.001"


def plain(text):
    """Base spans as the contract words them: every match, then the short ones dropped."""
    text, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def listed(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def strings(n, seed=5):
    """Random strings of several alphabets with a digit or mixed capitals."""
    r, out = random.Random(seed), []
    alphabets = [string.ascii_letters + string.digits, string.ascii_letters, string.ascii_lowercase + string.digits,
                 string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "_-"]
    while len(out) < n:
        s = "".join(r.choices(r.choice(alphabets), k=r.choice([24, 32, 40, 64])))
        if not s.isalpha() or (s.lower() != s and s.upper() != s):
            out.append(s)
    return out


@pytest.fixture(scope="module")
def scan():
    return Scanner(*vocabulary(), None, secret_scan.MOST_RATIO)


def test_random_strings_are_found(scan):
    found = [s for s in strings(2000) if scan.random(s)]
    assert len(found) >= 0.97 * 2000


@pytest.mark.parametrize("run", [
    "550e8400-e29b-41d4-a716-446655440000", "2024-01-15T10-30-00Z/2025-02-16", "getElementsByTagName2", "my_long_variable_name_here_2",
    "CONFIG_MAX_BUFFER_SIZE_BYTES_64", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B", "sha256-" + "ab" * 32, "4917-4844-1752-8035-1547",
    "application/octet-stream/v2", "thatertionbleingtionerthereinand", "KEITEINAUSCHAFTLICHKEITEN", "ThisIsACamelCaseIdentifier",
    "path/to/2024/some/file_name_with_words", "0" * 64])
def test_names_and_digests_are_not(scan, run):
    assert not scan.random(run)


def test_spans_match_the_plain_scan(scan):
    r = random.Random(3)
    bits = ["password", "Token", "API_KEY", "apikey", '"', "'", " ", "  ", "=", ":", ".", "\n", "é", "ſecret", "ıtoken", "İ", "AKIA", "AKIAAKIA",
            "ABCDEFGHIJ0123456789", "deadbeef0123", "secret=token=", "abcdefghijkl", "0123456789abcdef" * 3, "x", "-", "K", "passwd"]
    for _ in range(3000):
        text = "".join(r.choices(bits, k=r.randint(0, 14)))
        assert [s for s in scan.spans(text) if s[1] < 3] == plain(text), text


def test_a_run_inside_a_base_span_is_that_spans(scan):
    key = strings(1)[0]
    assert [k for _, k, _ in scan.spans(f"see token = {key} and")] == [0]
    assert [k for _, k, _ in scan.spans(f"see {key} and")] == [3]
    # a run that goes on behind a base span is random as a whole
    assert [(s, k) for s, k, _ in scan.spans("0123456789abcdef" + "G7kQzT" * 6)] == [(0, 2), (0, 3)]


def test_query_rows(spark):
    got = {r.doc_id: r for r in catalog.QUERIES["op13_secret_scan"](spark, SMOKE).collect()}
    rows = spark.read.parquet(f"{SMOKE}/documents.parquet").collect()
    assert len(got) == len(rows)
    scan = Scanner(*vocabulary(), None, secret_scan.MOST_RATIO)
    for row in rows:
        base, mine = plain(row.text), got[row.doc_id]
        assert (mine.n_assign, mine.n_access, mine.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert mine.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        assert mine.spans == listed(scan.spans(row.text))


def test_defined_cases(spark):
    key = strings(1)[0]
    long = "word " * 200_000 + key + " " + "Zq7" * 200_000
    rows = [(None, f"a {key}"), (1, None), (2, ""), (3, long), (4, "é" * 10 + key), (4, "é" * 10 + key)]
    got = find_secrets(docs(spark, rows, extra=True).withColumnRenamed("k", "secrets"))
    assert got.columns[-1] == "secrets" and "text" not in got.columns and "kept" in got.columns
    found = sorted(((r.doc_id, [(s.kind, s.start, s.end, s.found[:40]) for s in r.secrets]) for r in got.collect()), key=str)
    one = [("random", 10, 10 + len(key), key[:40])]
    assert found[0] == (1, []) and found[1] == (2, []) and found[3:5] == [(4, one), (4, one)]
    assert [s[:2] for s in found[2][1]] == [("random", 1_000_000), ("random", 1_000_001 + len(key))]
    assert found[5] == (None, [("random", 2, 2 + len(key), key[:40])])
    assert find_secrets(docs(spark, [])).count() == 0
    known = find_secrets(docs(spark, [(1, key)]), known=re.escape(key)).first()
    assert known.secrets == []
