"""Secret scans: fixed patterns, and random strings by token efficiency.

Three patterns find credentials of a known form (``assign``, ``access``,
``hex``). The method finds the rest: a vocabulary of byte pairs was learnt from
text that people write, so it spends few tokens on words and names and many on
random strings. A run of key characters that gets fewer than ``MOST_RATIO``
characters per token is random (kind ``random``), unless it is a digest (its
form is that of a common hash sum) or an identifier (a UUID, or words, numbers
and dates joined by signs). Digests and identifiers of the caller's own can be
given as one more pattern. A run inside a span of a pattern is that span's.

On 4,000 random strings of each of seven alphabets and of 20 to 64 characters
the highest ratio was 1.5 to 2.1 for 95 % of them (hex and plain letters are
the high ones); joined words of code have 2.2 and more. A run needs a digit or
mixed capitals, since invented or foreign words of letters alone can be as
costly to spell as random ones; the base pattern ``hex`` has no such condition.

Offsets are code points, ends exclusive. Texts are read whole, one at a time;
no rows are shuffled. Defined results: a null or empty text has no spans;
repeated rows have the same spans; a run of any length is encoded in pieces of
``PIECE`` characters, so that its cost is linear; an empty table gives no rows;
other columns stay, but one of the name of the result's column gives way.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read

#: Fixed patterns, in the order that breaks ties between spans of one start.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}  # characters: of group 2, of the match, of the match
CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")

RUN = r"[A-Za-z0-9+/_=-]{20,}"  # shorter runs are too short to tell
MOST_RATIO = 2.0                # characters per token
PIECE = 512
#: Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512; base64 characters of the last three.
DIGEST = (r"(?:md5|sha1|sha224|sha256|sha384|sha512)?[-_=]?(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
          r"|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128})"
          r"|(?:sha256-[A-Za-z0-9+/]{43}=|sha384-[A-Za-z0-9+/]{64}|sha512-[A-Za-z0-9+/]{86}==)")
UUID = r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
#: A part of a name: a number with a letter or two beside it (sizes, versions), a day and an hour, or a word in one of three spellings.
NAME_PART = r"(?:[A-Za-z]{0,2}[0-9]+[A-Za-z]{0,2}|[0-9]{2,8}T[0-9]{2,6}Z?|[A-Z]?[a-z]+|[A-Z]+)"
IDENTIFIER = rf"{UUID}|[+/_=-]*{NAME_PART}(?:[+/_=-]+{NAME_PART})*[+/_=-]*"

SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType(), False), T.StructField("start", T.LongType(), False),
    T.StructField("end", T.LongType(), False), T.StructField("found", T.StringType(), False)]), False)


def vocabulary(path: str | None = None) -> tuple[bytes, str]:
    """A tiktoken file's bytes (the driver reads it; tasks get them) and the pattern that cuts words."""
    import public_tokenizers
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


class Scanner:
    """``spans(text)``: all spans of one text, by start and kind."""

    def __init__(self, vocab: bytes, pattern: str, known: str | None, most_ratio: float):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocab.splitlines())}
        self.tokens = tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
        # a run of at least so many characters is the maximal run that the fixed pattern finds
        self.access = re.compile(ACCESS[:-1] + f"{{{LEAST['access'] - 4},}}")
        self.hex = re.compile(HEX[:-1] + f"{{{LEAST['hex']},}}")
        self.run = re.compile(RUN)
        self.known = [re.compile(x, re.ASCII) for x in (DIGEST, IDENTIFIER, known) if x]
        self.most_ratio = most_ratio

    def random(self, run: str) -> bool:
        mixed = run.lower() != run and run.upper() != run and not run.istitle()
        if not (mixed or any("0" <= c <= "9" for c in run)):
            return False
        tokens = sum(len(self.tokens(run[i:i + PIECE])) for i in range(0, len(run), PIECE))
        return len(run) < self.most_ratio * tokens and not any(x.fullmatch(run) for x in self.known)

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        if not text:
            return []
        low, out = text.lower(), []
        if any(cue in low for cue in CUES):
            out += [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if len(m[2]) >= LEAST["assign"]]
        out += [(m.start(), 1, m.end()) for m in self.access.finditer(text)]
        out += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        out.sort()
        base, covered, i = list(out), 0, 0
        for m in self.run.finditer(text):
            while i < len(base) and base[i][0] <= m.start():
                covered = max(covered, base[i][2])
                i += 1
            if m.end() > covered and self.random(m[0]):
                out.append((m.start(), 3, m.end()))
        return sorted(out)


_LOADED: dict[tuple, Scanner] = {}


def loaded(*key) -> Scanner:
    """A worker makes the tables of a vocabulary once."""
    if key not in _LOADED:
        _LOADED[key] = Scanner(*key)
    return _LOADED[key]


def find_secrets(docs: DataFrame, text: str = "text", known: str | None = None, most_ratio: float = MOST_RATIO,
                 path: str | None = None, name: str = "secrets") -> DataFrame:
    """``docs`` without ``text`` but with ``name``, an array of (kind, start,
    end, found) by start and kind. ``known``: a regular expression of digests
    and identifiers that are no secrets, matched against whole runs."""
    vocab, pattern = vocabulary(path)
    keep = [c for c in docs.columns if c not in (text, name)]
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(name, SPANS)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scan = loaded(vocab, pattern, known, most_ratio)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("found", pa.string())])
        for b in batches:
            texts = b.column(len(keep))
            for at in range(0, b.num_rows, 512):
                found = []
                for t in texts.slice(at, 512).to_pylist():
                    found.append([{"kind": KINDS[k], "start": s, "end": e, "found": t[s:e]} for s, k, e in scan.spans(t)])
                part = b.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [pa.array(found, pa.list_(kind))],
                                                 names=[*keep, name])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_scan_text")).mapInArrow(run, schema)


def _listed(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``."""
    found = find_secrets(read(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] != "random")

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("secrets")).alias("spans"))
