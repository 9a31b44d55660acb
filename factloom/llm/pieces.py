"""SentencePiece encoding and decoding of merge-type (BPE) models by backtracking (operator 7).

A text is cut where no piece of the model can span (before a run of the space mark that follows another character, between
a letter and a mark that no piece has after one, and around line ends if no piece has them). In each part an Aho-Corasick automaton finds all pieces;
from the left the longest one is taken that is compatible with the piece before it, that is, merging their joined text
anew gives these two again. Where none fits, the position is marked in a bitfield and the last piece is taken back. As
the encoding of every prefix is unique, a marked position never needs another look, so time grows with the length only.
Short parts are remembered in each Python worker, up to a bound, as words come again and again.

Only models with byte fallback, identity normalisation and a leading space mark are of this kind; any other is refused when it
is read, as its ids of some probes would be others. Null texts count as empty; an empty text has no ids and decodes to an empty text. Repeated rows, extra columns and empty
tables need no care: each row is encoded alone, without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
PROBES = ("a", " a", "  two  blanks ", "ﬁ ① Å é", "\u3000x\u200b", "𝄞漢字", "Tab\tand\nline", "▁x")  # a model that normalises or has other marks encodes some of these otherwise


class PieceModel:
    """Vocabulary of a BPE model file with byte fallback, identity normalisation and a leading space mark."""

    def __init__(self, path: str, keep: int = 500_000, keep_length: int = 48):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)  # only to read the vocabulary
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.byte_of = {i: int(self.piece[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        self.special = special = self.control | self.byte_of.keys() | {self.unknown}
        self.id = {self.piece[i]: i for i in range(n) if i not in special}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            self.automaton.add_word(p, (len(p) - 1, p))
        self.automaton.make_automaton()
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id), None) for p in self.id}
        self.fits: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        self.parts: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        self.keep, self.keep_length = keep, keep_length
        self.chars = {p for p in self.id if len(p) == 1}
        pairs = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        inner = {c for x in pairs for c in x}
        letter = re.compile(r"[^\W\d_]").match
        joined = {x[1] for x in pairs if letter(x[0])}
        ends = re.escape("".join(c for c in ".,;:!?|" if c not in joined))  # marks that no piece has right after a letter
        own = re.escape("".join(c for c in "\n\r\t" if c not in inner))
        if any(MARK in p.lstrip(MARK) for p in self.id):
            self.cut = re.compile("(?s).+")  # a piece spans words: texts are encoded whole
        else:
            self.cut = re.compile(rf"{MARK}*[^\W\d_]+(?=[{ends}])|" * bool(ends) + f"{MARK}*[^{MARK}{own}]+|{MARK}+" + f"|[{own}]" * bool(own))

        if any(self.encode(t) != sp.encode(t) for t in PROBES):
            raise ValueError(f"{path} is no merge-type model with byte fallback, identity normalisation and a leading space mark")

    def merged(self, text: str) -> list[str]:
        """Merging as defined: again and again the best-scored adjacent pair, the leftmost of equals."""
        s, score = list(text), self.score
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                v = score.get(s[i] + s[i + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, i
            if best is None:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def compatible(self, a: str, b: str) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > self.keep:
                self.fits.clear()
            known = self.fits[a, b] = self.whole(b) and self._apart(a, b)
        return known

    def _apart(self, a: str, b: str) -> bool:
        """Whether merging a + b anew ends in these two: stops at the first merge across them."""
        s, score, m = list(a + b), self.score, len(a)  # m: symbols of a
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                v = score.get(s[i] + s[i + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, i
            if best is None or at == m - 1:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
            m -= at < m
        return s == [a, b] and (a + b) not in score

    def whole(self, a: str) -> bool:
        known = self.alone.get(a)
        if known is None:
            known = self.alone[a] = len(a) == 1 or self.merged(a) == [a]
        return known

    def split(self, part: str) -> list[str]:
        """Pieces of a part; a character without a piece stands alone."""
        n = len(part)
        longest: list = [None] * n
        for end, (back, p) in self.automaton.iter(part):
            longest[end - back] = p  # ends come in order: the last at a start is the longest
        if not self.chars.issuperset(part):
            for i in range(n):
                if longest[i] is None:
                    longest[i] = part[i]
                elif part[i] not in self.chars:  # its shortest candidate is the character alone
                    self.shorter.setdefault(part[i], None)
                    p = longest[i]
                    while (q := self.shorter[p]) is not None and q != part[i]:
                        p = q
                    if len(p) > 1:
                        self.shorter[p] = part[i]
        failed, fits, shorter = bytearray(n // 8 + 1), self.fits, self.shorter
        out: list[str] = []
        last, pos, p = None, 0, longest[0]
        while pos < n:
            while p is not None:
                e = pos + len(p)
                if not failed[e >> 3] >> (e & 7) & 1:
                    if last is None:
                        if self.whole(p):
                            break
                    else:
                        ok = fits.get((last, p))
                        if ok or ok is None and self.compatible(last, p):
                            break
                p = shorter.get(p)
            if p is not None:
                out.append(p)
                last, pos = p, e
                if pos < n:
                    p = longest[pos]
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                p = out.pop()
                pos -= len(p)
                last = out[-1] if out else None
                p = shorter.get(p)
        return out

    def ids(self, part: str) -> list[int]:
        pieces = self.split(part)
        try:
            return [self.id[p] for p in pieces]
        except KeyError:
            return [i for p in pieces for i in ([self.id[p]] if p in self.id else [self.byte_id[b] for b in p.encode()])]

    def _text(self, ids: list[int]) -> str:
        if self.special.isdisjoint(ids):
            return "".join([self.piece[i] for i in ids]).replace(MARK, " ")
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.control:
                out.append(" ⁇ " if i == self.unknown else self.piece[i].replace(MARK, " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def part(self, part: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, their text."""
        known = self.older.get(part)
        if known is not None:
            self.parts[part] = known
            return known
        ids = self.ids(part)
        known = len(ids), ",".join(map(str, ids)), self._text(ids)
        if len(part) <= self.keep_length:
            if len(self.parts) >= self.keep // 2:  # the older half goes
                self.older, self.parts = self.parts, {}
            self.parts[part] = known
        return known

    def encode(self, text: str) -> list[int]:
        return [i for p in self.cut.findall(MARK + text.replace(" ", MARK)) for i in self.ids(p)] if text else []

    def decode(self, ids: list[int]) -> str:
        return self._text(ids).removeprefix(" ") if ids and self.piece[ids[0]].startswith(MARK) else self._text(ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text)."""
        if not text:
            return 0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest()
        parts = self.cut.findall(MARK + text.replace(" ", MARK))
        got = list(map(self.parts.get, parts))
        if None in got:
            got = [g or self.part(p) for g, p in zip(got, parts, strict=True)]
        n, ids, out = zip(*got, strict=True)
        return sum(n), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256("".join(out).removeprefix(" ").encode()).hexdigest()


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model, read once in each Python worker."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array, decoded text of each row."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [m.encode(t.as_py() or "") for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([m.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return src.mapInArrow(work, src.select("doc_id").schema.simpleString()[7:-1] + ", ids array<int>, decoded string")


def piece_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            n, ids, out = [], [], []
            for t in batch.column("text"):
                a, b, c = m.digest(t.as_py() or "")
                n.append(a)
                ids.append(b)
                out.append(c)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return src.mapInArrow(work, src.select("doc_id").schema.simpleString()[7:-1] + ", n_tokens long, ids_sha256 string, decoded_sha256 string")
