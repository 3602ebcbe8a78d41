"""Repetition rules, line dedup, chunks, pieces, chat formatting on small tables."""

import hashlib
import random
from collections import Counter

import pytest
from llm_helpers import docs, repetition as brute_repetition
from pyspark.sql import functions as F

from keelson.llm import chat, chunks, lines, pieces, repetition, stages
from keelson.plans.compare import compare, duck

SMOKE = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t ", "a", "É è", "x " * 300, "a b c d e " * 30, "\x85  b", "z" * 5000]


def same(got, want):
    assert Counter(got) == Counter(want)


# --- repetition -------------------------------------------------------------------------

def test_repetition_matches_brute_force(spark):
    rnd = random.Random(5)
    texts = ODD + [" ".join(rnd.choice("abcdefgh#é"[:rnd.choice([3, 10])]) for _ in range(rnd.randint(0, 60))) + rnd.choice(["", "\nx y", "\n \nx y\nx y"])
                   for _ in range(120)]
    texts += [" ".join(map(str, [*range(60), *range(60), *range(100, 600)]))]  # one repeat of 60 words
    # a phrase twice among other words: 15, 10 and 9 percent covered, at most 20 by windows of five
    texts += [" ".join([*(f"p{i}" for i in range(k)), *(f"x{i}" for i in range(200 - 2 * k)), *(f"p{i}" for i in range(k))]) for k in (15, 10, 9)]
    kept = [brute_repetition(t)[-1] for t in texts[-3:]]
    assert kept == [False, True, True]
    df = docs(spark, list(enumerate(texts)), extra=True)
    got = df.select("doc_id", repetition.rules(F.col("text")).alias("r")).select("doc_id", "r.*").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {i: brute_repetition(t) for i, t in enumerate(texts)}


def test_repetition_covered_fraction_decides():
    """Texts that pass the base rule and the longest repeat: 15 % and 10 % of the words in repeats of ten or more."""
    over = " ".join(map(str, [*range(15), *range(100, 270), *range(15)]))
    edge = " ".join(map(str, [*range(10), *range(100, 280), *range(10)]))
    got = repetition.measure([over, edge])
    assert got["base_failed"] == [False] * 2 and got["longest_repeat"] == [15, 10] and got["n_words"] == [200] * 2
    assert got["covered_words"] == [30, 20] and got["kept"] == [False, True]


def test_quality_stage_keeps_columns_and_clean_rows(spark):
    clean = " ".join(f"w{i}" for i in range(40))
    df = docs(spark, [(1, clean), (1, clean), (2, "too short"), (None, None), (3, "a b c d e " * 9), (None, clean)], extra=True)
    out = stages.quality_rules(spark, df, "")
    assert out.columns == df.columns
    same([r.doc_id for r in out.collect()], [1, 1, None])
    assert stages.quality_rules(spark, df.limit(0), "").count() == 0


# --- line dedup -------------------------------------------------------------------------

def test_lines_match_sql(spark):
    assert compare(lines.op4_line_dedup(spark, SMOKE), duck(SMOKE), lines.ORACLE_SQL)["hash_match"]


def test_lines_cases(spark):
    common = "all rights reserved here"
    rows = [(i, f"own line {i}\n  {common} \nown end {i}", f"s{i}") for i in range(12)]
    rows += [(20, common, "s1"), (21, "\n\n", "s1"), (22, None, "s2"), (None, f"a\n{common}", None), (23, "", "s3"), (0, rows[0][1], "s0"),
             *[(40 + i, "nine sites only", f"s{i}") for i in range(9)], *[(60 + i, "one site", "s1") for i in range(30)]]
    df = docs(spark, rows, extra=True)
    out = lines.remove_boilerplate(df)
    got = Counter((r.doc_id, r.text, r._line_removed) for r in out.collect())
    want = Counter()
    for i, t, _ in rows:
        if i == 0 or not t or common not in t:
            want[(i, t, 0)] += 1  # the first document keeps the line, twice since it stands twice
        else:
            want[(i, "\n".join(x for x in t.split("\n") if x.strip() != common), 1)] += 1
    assert got == want
    stage = stages.line_dedup(spark, df, "")
    assert stage.columns == df.columns
    assert 20 not in {r.doc_id for r in stage.collect()}  # nothing of it is left
    assert lines.remove_boilerplate(df.limit(0)).count() == 0


def test_lines_exact_count_decides_near_the_limit(spark):
    rows = [(i, "ten", f"s{i}") for i in range(10)] + [(20 + i, "eight", f"s{i % 8}") for i in range(30)]
    gone = lines.boilerplate(docs(spark, rows), "text", "source", "doc_id").select("doc.id").collect()
    assert sorted(r.id for r in gone) == list(range(1, 10))


# --- chunks -----------------------------------------------------------------------------

def text_of(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 8))) for _ in range(n))


def test_chunk_ends_cover_and_shift():
    table = chunks.gear()
    for n in (0, 1, 15, 16, 17, 200, 5000):
        data = text_of(n, n).encode()
        ends = chunks.ends(data, table)
        sizes = [b - a for a, b in zip([0, *ends], ends)]
        assert sum(sizes) == len(data) and all(chunks.LEAST <= s <= chunks.MOST for s in sizes[:-1])
    data = text_of(1, 400).encode()

    def pieces_of(d):
        ends = chunks.ends(d, table)
        return {d[a:b] for a, b in zip([0, *ends], ends)}
    moved = pieces_of(b"inserted " + data)
    assert len(pieces_of(data) & moved) > 0.9 * len(moved)
    assert chunks.ends(b"a" * 1000, table)[-1] == 1000


def test_passages_found_and_clean_rows_left(spark):
    passage = text_of("p", 55)
    rows = [(i, f"{text_of(i, 40 + i)} {passage} {text_of(100 + i, 30)}") for i in range(8)]
    clean = [(100 + i, text_of(1000 + i, 80)) for i in range(10)]
    rows += [*clean, (200, None), (201, ""), (None, f"{text_of(77, 20)} {passage}"), (300, "x" * 4000), clean[0]]
    df = docs(spark, rows, extra=True)
    spans = chunks.passages(df).collect()
    found = {r.id for r in spans}
    assert set(range(1, 8)) <= found and 0 not in found and not found & {i for i, _ in clean}
    assert {r.first for r in spans if r.id in range(1, 8)} == {0}
    out = chunks.remove_passages(df)
    assert out.columns == df.columns and out.count() == len(rows)
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept[0] == rows[0][1] and kept[200] is None and all(kept[i] == t for i, t in clean)
    assert all(len(kept[i]) < len(rows[i][1]) - 150 for i in range(1, 8))
    assert chunks.passages(df.limit(0)).count() == 0


def test_passages_of_null_and_repeated_ids(spark):
    """A passage that only documents without ids, or of one id, share stays in one of them."""
    none, same = text_of("n", 55), text_of("s", 55)
    rows = [(None, f"{text_of(i, 30 + i)} {none} {text_of(50 + i, 30)}") for i in range(4)]
    rows += [(5, f"{text_of(100 + i, 30 + i)} {same} {text_of(150 + i, 30)}") for i in range(4)] + [(5, text_of(200, 80))]
    rows += [rows[0], rows[4]]  # equal rows are one document
    left = {(r.doc_id, r.text) for r in chunks.remove_passages(docs(spark, rows)).collect()}
    for key in (None, 5):
        whole = [t for i, t in left if i == key and (i, t) in rows[:8]]
        assert len(whole) == 1 and len([t for i, t in left if i == key and len(t) < 560]) >= 3
    assert rows[8] in left and len(left) == 9


def test_chunks_match_a_plain_scan(spark):
    """Spans against a dictionary of all chunks."""
    rnd = random.Random(3)
    parts = [text_of(f"x{i}", 30) for i in range(6)]
    rows = [(i, " ".join([text_of(i, 25), rnd.choice(parts), text_of(-i, 10), rnd.choice(parts)])) for i in range(25)]
    table, first, cut = chunks.gear(), {}, {}
    for i, t in rows:
        data, start, cut[i] = t.encode(), 0, []
        for end in chunks.ends(data, table):
            cut[i].append((start, end, data[start:end]))
            start = end
    for i in sorted(cut):
        for _, _, c in cut[i]:
            first.setdefault(c, i)
    want = set()
    for i in cut:
        seen, run = set(), []
        for s, e, c in [*cut[i], (None, None, None)]:
            again = c is not None and (first[c] != i or c in seen)
            seen.add(c)
            if again:
                run.append((s, e, first[c]))
            elif run:
                if run[-1][1] - run[0][0] >= chunks.LEAST_RUN:
                    want.add((i, run[0][0], run[-1][1], min(r[2] for r in run)))
                run = []
    got = {(r.id, r.start, r.end, r.first) for r in chunks.passages(docs(spark, rows)).collect()}
    assert got == want and want


# --- pieces -----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_match_the_library(library):
    p, rnd = pieces.loaded(pieces.model_bytes()), random.Random(1)
    pool = [*" \n\t.,eeethtinoashr é▁日本語ж😀ÅßΩ0129-_=/<>s\x00", "  ", "     ", "the", "ing", "<s>", "</s>", "<0x0A>", "\r\n"]
    names = list(p.ids)
    texts = [*(t or "" for t in ODD), *("".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30))) for _ in range(4000)),
             *("".join(rnd.choice(names) for _ in range(rnd.randint(1, 6))).replace("▁", " ") for _ in range(4000)), "ab" * 20_000]
    for t in texts:
        ids = library.encode(t, add_bos=True, add_eos=True)
        coded = p.encode_bytes(t)
        assert [int.from_bytes(coded[i:i + 4], "little") for i in range(0, len(coded), 4)] == ids, t
        assert p.decode(ids) == library.decode(ids), t
    for _ in range(4000):  # ids that no text has
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(300)]) for _ in range(rnd.randint(0, 8))]
        assert p.decode(ids) == library.decode(ids), ids


def test_pieces_query(spark, library):
    got = {r.doc_id: r for r in pieces.op6_pieces(spark, SMOKE).collect()}
    for r in spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        mine = got[r.doc_id]
        assert mine.n_tokens == len(ids)
        assert mine.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert mine.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_cases(spark):
    df = docs(spark, [(i, t) for i, t in enumerate(ODD)] + [(None, "a"), (0, None)], extra=True).withColumn("ids", F.lit("x"))
    out = pieces.encode(df)
    assert [c for c in out.columns if c not in ("n_tokens", "ids")] == [c for c in df.columns if c not in ("text", "ids")]
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].ids == [1, 2] and rows[0].n_tokens == 2 and out.count() == len(ODD) + 2
    assert pieces.encode(df.limit(0)).count() == 0


# --- chat formatting --------------------------------------------------------------------

def test_chat_matches_sql(spark):
    assert compare(chat.op5_chat_formatting(spark, SMOKE), duck(SMOKE), chat.ORACLE_SQL)["hash_match"]


def test_chat_cases(spark):
    a, u = "assistant", "user"

    def text(*ts):
        return "".join(f"<|{r or 'unknown'}|>\n{t or ''}<|end|>\n" for r, t in ts)
    pairs = [
        (1, [(u, "q"), (a, "x")], [(u, "q"), (a, "y")], 1),
        (2, [(u, "q"), (a, "x")], [(u, "q"), (a, "x")], 2),
        (3, [(u, "q")], None, 0),
        (4, [(u, None), (a, "")], [(u, ""), (a, "")], 0),
        (5, [(None, "q"), (a, "z" * 20000)], [(None, "q")], 1),
        (None, None, None, 0),
        (6, [(u, "q"), (u, "q"), (a, "1")], [(u, "q"), (u, "q"), (a, "2"), (u, "3")], 2),
    ]
    kind = "array<struct<role:string,text:string>>"
    df = spark.createDataFrame([p[:3] + ("x",) for p in pairs], f"pair long, chosen {kind}, rejected {kind}, prompt string")
    got = {r.pair: r for r in chat.format_preferences(df, "pair").collect()}
    for key, c, r, n in pairs:
        c, r, g = c or [], r or [], got[key]
        assert g.n_prefix_turns == n
        assert (g.prompt, g.chosen, g.rejected) == (text(*c[:n]), text(*c[n:]), text(*r[n:]))
        assert g.usable == (len(c) > n and len(r) > n)
        for ts, s, mask in ((c[n:], g.chosen, g.chosen_mask), (r[n:], g.rejected, g.rejected_mask)):
            runs = [x.split(":") for x in mask.split(",") if x]
            assert sum(int(x) for x, _ in runs) == len(s)
            at, trained = 0, ""
            for size, on in runs:
                trained += s[at:at + int(size)] * (on == "1")
                at += int(size)
            assert trained == "".join((t or "") + chat.END for role, t in ts if role == a)
    assert chat.format_preferences(df.limit(0), "pair").count() == 0


def test_turns_order_ties_and_nulls(spark):
    rows = [(1, 1, "b", "x"), (1, 0, None, None), (1, 1, "a", "y"), (1, 1, "a", "y"), (None, 0, "a", "z"), (1, None, "c", "w")]
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.turns(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[None] == [("a", "z")]
    assert got[1] == [("c", "w"), (None, None), ("a", "y"), ("a", "y"), ("b", "x")]  # a null turn comes first


def test_chat_query_cases(spark, tmp):
    """The query on nulls, clashing columns and nothing: as the SQL says."""
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "q"), (2, 1, "assistant", "b" * 50_000), (None, 0, "user", "n"),
            (None, 1, "assistant", "m"), (3, None, "assistant", None), (3, None, None, "x"), (4, 0, "user", "only"), (6, 0, "assistant", "")]
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame([(*r, "x", "y") for r in rows], schema + ", turns string, chosen string").write.parquet(f"{tmp}/conversations.parquet")
    out = chat.op5_chat_formatting(spark, tmp)
    import duckdb
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp}/conversations.parquet/*.parquet'")
    assert out.count() == 6 and compare(out, con, chat.ORACLE_SQL)["hash_match"]
    spark.createDataFrame([], schema).write.parquet(f"{tmp}/none/conversations.parquet")
    assert chat.op5_chat_formatting(spark, f"{tmp}/none").count() == 0
