"""SentencePiece encoding and decoding for merge-type (BPE) models.

A text is cut where no piece of the vocabulary can cross, and each part is
encoded by backtracking: an Aho-Corasick automaton gives the longest piece at
every position; the longest one is tried first, then its shorter prefixes; a
piece may follow another only if merging the two's characters again yields
just these two; positions from which no way leads on are marked in a bitfield
and never tried again. The result is the merge order's own result, so it is
exact. Parts are remembered in a bounded table, since words repeat.

The model file's bytes (about 0.5 MB) go to the tasks with the function.
Defined results: a null text is an empty text, and an empty text is only the
begin and end ids; characters that the vocabulary lacks become their UTF-8
bytes' pieces; texts of any length are encoded whole; other columns stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read

SPACE = "▁"
REMEMBERED = 300_000  # parts held by each of a worker's two tables
LONGEST = 64          # longer parts aren't held


class Pieces:
    """A BPE model: encode(text) and decode(ids) as the sentencepiece library has them."""

    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        m.ParseFromString(model)
        spec = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only merge-type models that don't normalise their text")
        self.dummy = spec.add_dummy_prefix
        kinds = [p.type for p in m.pieces]
        self.names = [p.piece for p in m.pieces]
        self.scores = {p.piece: p.score for p in m.pieces if p.type == 1}
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 1}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.bos, self.eos, self.unk = self.names.index("<s>"), self.names.index("</s>"), kinds.index(2)
        self.surface = [b"" if k == 3 else bytes([int(n[3:5], 16)]) if k == 6 else m.trainer_spec.unk_surface.encode() if k == 2
                        else n.replace(SPACE, " ").encode() for n, k in zip(self.names, kinds, strict=True)]
        self.is_byte = [k == 6 for k in kinds]
        if any(SPACE in n.lstrip(SPACE) for n in self.ids):
            raise ValueError("only models whose pieces don't cross words")
        self.alphabet = {c for n in self.ids for c in n}
        self.pairs = {n[i:i + 2] for n in self.ids for i in range(len(n) - 1)}
        order = sorted(self.ids, key=lambda n: -self.scores[n])
        # twice the turn at which a piece is merged, equal for equal scores; single characters aren't merged
        self.turn, turn = {}, 0
        for before, n in zip([None, *order], order):
            turn += before is not None and self.scores[before] != self.scores[n]
            if len(n) > 1:
                self.turn[n] = 2 * turn
        # the two parts that a piece's last merge joins; pieces that merging
        # doesn't reach never stand in a result
        self.parts = {n: (n, n) for n in self.alphabet}
        self.machine = ahocorasick.Automaton()
        for n in sorted(self.ids, key=len):
            if len(n) > 1:
                two = self._merge(n, 2)
                if len(two) != 2 or self._merge(n) != [n]:
                    continue
                self.parts[n] = two[0], two[1]
            self.machine.add_word(n, len(n))
        self.machine.make_automaton()
        self.shorter = {n: next((i for i in range(len(n) - 1, 0, -1) if n[:i] in self.parts), 0) for n in self.parts}
        self.fits: dict[tuple[str, str], bool] = {}
        self.memory: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # a text's parts: cut before spaces, at line ends, and before a stop or
        # comma if no piece has it after the character before it
        newline = "" if "\n" in self.alphabet else "\n"
        rest = f"[^{SPACE}{newline}.,]"
        after = {c: "".join(re.escape(x) for x, y in self.pairs if y == c) or "\0" for c in ".,"}
        on = f"(?:(?:(?<=[{after['.']}])\\.|(?<=[{after[',']}]),){rest}*)*"
        self.cuts = re.compile(f"{SPACE}*{rest}+{on}|{SPACE}*[.,]+[^{SPACE}{newline}]*|{SPACE}+" + "|\n+" * bool(newline)).findall

    def _merge(self, text: str, until: int = 1) -> list[str]:
        """Merge adjacent symbols, the best score first, leftmost among equals,
        while there are more than ``until``."""
        parts, score = list(text), self.scores.get
        while len(parts) > until:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fit(self, a: str, b: str) -> bool:
        """Whether merging the characters of a and b again yields a and b. The
        merges are undone from the last one: at no time may the parts that
        meet at the border merge sooner than the merge undone before."""
        turn, parts = self.turn.get, self.parts
        soonest = 1 << 60
        while True:
            both = turn(a + b)
            if both is not None and both < soonest:
                return False
            at_a, at_b = turn(a, -1), turn(b, -1)
            if at_a > at_b:
                soonest, a = at_a, parts[a][1]
            elif at_b >= 0:  # of equal turns the left one comes first
                soonest, b = at_b + 1, parts[b][0]
            else:
                return True

    def _backtrack(self, text: str) -> list[str]:
        """text: characters of the alphabet only."""
        if text in self.parts:
            return [text]
        longest = [1] * len(text)
        for end, n in self.machine.iter(text):
            longest[end + 1 - n] = n  # ends grow, so lengths do
        fits, shorter = self.fits, self.shorter
        failed = bytearray(len(text) // 8 + 1)  # bit i: no way leads on from position i
        out: list[str] = []
        at, size = 0, longest[0]
        while at < len(text):
            while True:
                piece = text[at:at + size]
                to = at + size
                if not failed[to >> 3] >> (to & 7) & 1:
                    fit = not out or fits.get((out[-1], piece))
                    if fit is None:
                        if len(fits) >= REMEMBERED:
                            fits.clear()
                        fit = fits[out[-1], piece] = self._fit(out[-1], piece)
                    if fit:
                        out.append(piece)
                        at = to
                        size = longest[at] if at < len(text) else 0
                        break
                size = shorter[piece]
                if not size:  # go back and try the last piece's prefixes
                    failed[at >> 3] |= 1 << (at & 7)
                    size = len(out.pop())
                    at -= size
                    break
        return out

    def _ids(self, part: str) -> list[int]:
        if all(c in self.alphabet for c in part):
            out: list[int] = []
            for piece in self._backtrack(part):
                i = self.ids.get(piece)
                out += [i] if i is not None else [self.byte_ids[b] for b in piece.encode()]
            return out
        return [i for c in part for i in (self._ids(c) if c in self.alphabet else [self.byte_ids[b] for b in c.encode()])]

    def _known(self, part: str) -> bytes:
        """The part's ids as little-endian 32-bit integers."""
        got = self.memory.get(part)
        if got is not None:
            return got
        got = self.old.get(part)
        if got is not None:
            self._remember(part, got)
            return got
        pairs, start, inner = self.pairs, 0, []
        for i in range(1, len(part)):  # no piece crosses a pair of characters that none has
            if part[i - 1:i + 1] not in pairs:
                inner.append(part[start:i])
                start = i
        if inner:
            got = b"".join([self._known(x) for x in [*inner, part[start:]]])
        else:
            got = b"".join([i.to_bytes(4, "little") for i in self._ids(part)])
        if len(part) <= LONGEST:
            self._remember(part, got)
        return got

    def _remember(self, part: str, got: bytes) -> None:
        """Two generations: when the young table is full it becomes the old
        one, and parts that are met again move to the young one."""
        if len(self.memory) >= REMEMBERED:
            self.old, self.memory = self.memory, {}
        self.memory[part] = got

    def encode_bytes(self, text: str | None, ends: bool = True) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        text = (text or "").replace(" ", SPACE)
        if text and self.dummy:
            text = SPACE + text
        memory, known = self.memory.get, self._known  # of the table as it is when the text begins
        inner = b"".join([memory(x) or known(x) for x in self.cuts(text)])
        return self.bos.to_bytes(4, "little") + inner + self.eos.to_bytes(4, "little") if ends else inner

    def decode(self, ids: list[int]) -> str:
        out = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if self.names[i] not in ("<s>", "</s>")), None)
        if self.dummy and first is not None and self.names[first].startswith(SPACE):
            out = out[1:]
        try:
            return out.decode()
        except UnicodeDecodeError:
            return self._decode_runs(ids)

    def _decode_runs(self, ids: list[int]) -> str:
        """Ids with byte pieces that aren't whole characters: each stray byte is U+FFFD."""
        out, run, start = [], b"", True
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.surface[i]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode())
                        run = run[n:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    run = run[1:]
            if i is not None:
                name = self.surface[i].decode()
                start = start and not "".join(out)
                out.append(name[1:] if start and self.dummy and self.names[i].startswith(SPACE) else name)
                start = start and not self.names[i].startswith(SPACE)
        return "".join(out)


_LOADED: dict[bytes, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """A worker makes the tables of a model once."""
    key = hashlib.blake2b(model, digest_size=16).digest()
    if key not in _LOADED:
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def model_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:  # on the driver; tasks get the bytes
        return f.read()


def encode(docs: DataFrame, text: str = "text", path: str | None = None, ids: bool = True, digests: bool = False) -> DataFrame:
    """``docs`` without ``text`` but with n_tokens, ids (if asked for) and the
    digests of the ids and of the decoded text (if asked for)."""
    model = model_bytes(path)
    keep = [c for c in docs.columns if c != text]
    made = {"n_tokens": T.LongType()}
    if ids:
        made["ids"] = T.ArrayType(T.IntegerType())
    if digests:
        made |= {"ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    keep = [c for c in keep if c not in made]  # a column of such a name gives way
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    for name, kind in made.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        p = loaded(model)
        for b in batches:
            column = b.column(b.schema.get_field_index("_piece_text"))
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                coded = [p.encode_bytes(t) for t in column.slice(start, 256).to_pylist()]
                sizes = np.array([len(c) // 4 for c in coded], np.int64)
                out = [part.column(part.schema.get_field_index(c)) for c in keep] + [pa.array(sizes)]
                names = [*keep, "n_tokens"]
                if ids:
                    flat = pa.array(np.frombuffer(b"".join(coded), "<i4"))
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], sizes.cumsum()]).astype("i4")), flat))
                    names.append("ids")
                if digests:
                    out.append(pa.array([hashlib.sha256(c).hexdigest() for c in coded]))
                    texts = (p.decode(np.frombuffer(c, "<u4").tolist()) for c in coded)
                    out.append(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]))
                    names += ["ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("_piece_text")).mapInArrow(run, schema)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, encoded and decoded again."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return encode(docs, ids=False, digests=True)
