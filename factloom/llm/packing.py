"""Harmonic packing of token sequences (operator 9).

A document's ids are cut into full pieces of the capacity and a rest; the rest is cut into halves, quarters, ... of the
capacity down to `least` ids, and what then remains is a piece as it is. A piece of length in (C/(j+1), C/j] is of class j,
and each bin of class j takes exactly j pieces. Every task fills its own bins, so nothing is shuffled, and a lost task is
simply run again: a sequence's number holds the partition's number. The pieces left in a task's open bins, under j for
each class, are joined end to end and cut at the capacity, and the last sequence into powers of two, which need no padding.

Null texts count as empty: such a document is the end id alone. Repeated rows are documents of their own; an empty table
gives no pieces; other columns are ignored. Long texts are cut like others.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

STAYS = "\u180e"  # white space to some pattern engines
MARKS = ".,;:!?|"
KEEP = 700_000  # words remembered by a worker
FIELDS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class ByteTokens:
    """Ids of a byte-level BPE tokenizer file; words are remembered, up to a bound.

    The tokenizer never joins what stands on both sides of the last space before a character that isn't white space, so a
    text is cut there, and parts that were met before needn't be encoded again. Where the same vocabulary lies in a file of
    ranks beside it, new parts are encoded by tiktoken, which gives the same ids faster.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None, keep: int = KEEP, keep_length: int = 48):
        whole = Tokenizer.from_file(path)
        special = [str(t) for t in whole.get_added_tokens_decoder().values()]
        self.path, self.whole, self.encode = path, whole, self.slow
        if ranks:
            self.whole = None  # read again only for texts with marks: it takes more memory than all else here
            rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=rank, special_tokens={}).encode_ordinary
            marks = [x for x in ["<|"] if all(x in t for t in special)]
            self.encode = lambda text: self.slow(text) if not marks or marks[0] in text else fast(text)
        self.known: dict[str, bytes] = {}  # a word: ids of a space and the word; a line end and a word: theirs
        self.tails: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.keep, self.keep_length = keep, keep_length

    def slow(self, text: str) -> list[int]:
        if self.whole is None:
            self.whole = Tokenizer.from_file(self.path)
        return self.whole.encode(text, add_special_tokens=False).ids

    def one(self, text: str) -> bytes:
        return array("I", self.encode(text)).tobytes()

    def tail(self, marks: str) -> bytes:
        if marks not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[marks] = self.one(marks)
        return self.tails[marks]

    def word(self, w: str) -> bytes:
        got = self.older.get(w)
        if got is None:
            core = w.rstrip(MARKS)
            if core and core != w and core[-1].isalnum():  # letters and digits never join what follows but apostrophes
                got = (self.known.get(core) or self.word(core)) + self.tail(w[len(core) :])
            else:
                got = self.one(w if w[:1] == "\n" else " " + w)
            if len(w) > self.keep_length:
                return got
        if len(self.known) >= self.keep // 2:  # the older half goes
            self.older, self.known = self.known, {}
        self.known[w] = got
        return got

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        words = text.replace("\n", " \n").split(" ")
        first, rest = words[0], words[1:]
        got = list(map(self.known.get, rest))
        if None in got:
            for k, g in enumerate(got):
                if g is None:
                    w = rest[k]
                    if len(w.strip("\n")) == 0 or len(w.split()) != 1 or w.lstrip("\n")[0].isspace() or w[-1].isspace() or w[0] in STAYS:
                        return self.odd(text)  # white space beside white space
                    got[k] = self.word(w)
        if first != first.strip() or not first or len(first.split()) > 1:
            return self.odd(text)
        return self.one(first) + b"".join(got)

    def odd(self, text: str) -> bytes:
        """The same for any text: white space after a space stays with what comes before it."""
        words = text.split(" ")
        parts = [words[0]]
        for w in words[1:]:
            if not w or w[0].isspace() or w[0] in STAYS:
                parts[-1] += " " + w
            else:
                parts.append(" " + w)
        return b"".join([self.one(parts[0]), *(self.one(p) if p != " " + p.strip() or len(p.split()) > 1 else self.known.get(p[1:]) or self.word(p[1:]) for p in parts[1:])])


_TOKENS: dict[tuple, ByteTokens] = {}


def tokens(*files: str | None, keep: int = KEEP) -> ByteTokens:
    """The tokenizer, read once in each Python worker, which remembers so many words."""
    if files not in _TOKENS:
        _TOKENS[files] = ByteTokens(*files)
    _TOKENS[files].keep = keep
    return _TOKENS[files]


def cuts(n: int, capacity: int, least: int) -> list[int]:
    """Lengths of a document's pieces."""
    out = [capacity] * (n // capacity)
    rest, size = n % capacity, capacity // 2
    while rest and size >= least:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return [*out, rest] if rest else out


class Bins:
    """The open bins of one task."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.open: dict[int, list] = {}

    def add(self, piece: list) -> list[list]:
        """Takes a piece [doc, start, ids, doc_tokens]; returns the pieces of the bin that it fills, else none."""
        j = self.capacity // (len(piece[2]) // 4)
        held = self.open.setdefault(j, [])
        held.append(piece)
        if len(held) < j:
            return []
        del self.open[j]
        return self.close(held)

    def close(self, held: list) -> list[list]:
        at, out = 0, []
        for doc, start, ids, total in held:
            out.append([doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next, at])
            at += len(ids) // 4
        self.next += 1
        return out

    def rest(self) -> Iterator[list]:
        """The pieces left over, end to end, cut at the capacity and then at powers of two."""
        held = [p for j in sorted(self.open) for p in self.open[j]]
        left = sum(len(p[2]) // 4 for p in held)
        size, filled, bin_ = 0, 0, []
        for doc, start, ids, total in held:
            at = 0
            while at < len(ids):
                if not bin_ and not filled:
                    size = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                take = min(size - filled, len(ids) // 4 - at // 4)
                bin_.append([doc, start + at // 4, ids[at : at + 4 * take], total])
                at, filled = at + 4 * take, filled + take
                if filled == size:
                    left -= size
                    yield from self.close(bin_)
                    bin_, filled = [], 0


def pack(docs: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None, capacity: int = 1024, end_id: int = 0, least: int = 64, keep: int = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    path: the tokenizer's file; ranks, pattern: the same vocabulary as ranks with its splitting pattern, if there is one.
    keep: words that a Python worker remembers (some 200 bytes each), for speed only.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.select("doc_id").schema.simpleString()[7:-1]
    end = array("I", [end_id]).tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, bins = tokens(path, ranks, pattern, keep=keep), Bins(capacity, TaskContext.get().partitionId() << 33)
        types = None

        def batch_of(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], types), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", *FIELDS])

        out: list = []
        for batch in batches:
            types = batch.schema.field("doc_id").type
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = t.ids(text.as_py() or "") + end
                total, at = len(ids) // 4, 0
                for n in cuts(total, capacity, least):
                    out += bins.add([doc, at, ids[4 * at : 4 * (at + n)], total])
                    at += n
                if len(out) > 20_000:
                    yield batch_of(out)
                    out = []
        out += bins.rest()
        if out:
            yield batch_of(out)

    return src.mapInArrow(work, f"{kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def padding(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """n_sequences, n_ids, n_padding: a sequence whose length is a power of two needs none."""
    s = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    pad = F.when(F.bit_count("n") == 1, 0).otherwise(F.lit(capacity) - F.col("n"))
    return s.agg(F.count("*").alias("n_sequences"), F.sum("n").alias("n_ids"), F.sum(pad).alias("n_padding"))

