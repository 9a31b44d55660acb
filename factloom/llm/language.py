"""Language identification by cross-parsing entropy (operator 1).

For each language a suffix automaton is built of the whole texts of a bounded number of labelled rows. A text is parsed from the left into the
longest phrases that occur in the language's labelled text: the automaton is followed until it has no way on, then a phrase
ends. The language whose text needs the fewest phrases wins, each phrase counted with log2 of the size of the labelled text,
its price as a pointer.

Many stretches of many texts are followed at once. A stretch that isn't the first of its text is followed from its start and,
a second time, from where the stretch before it really ends, until both are in the same state of the automaton; so phrases
cross the ends of stretches and are those of the text read in one go.

Case is folded; what isn't a letter counts as one blank, runs of them as one. Letters of any script and number have symbols
of their own; a letter that no labelled text has is a phrase by itself. Null texts and texts without a letter are
`und` with score 0; ties go to the language first in the alphabet. Each row is scored alone (repeated rows alike, empty
tables give none), from its whole text and nothing else. The driver builds the automata, once; tasks get them as a broadcast.
Labelled rows with null id, text or language are not learned from. Of a language, rows are taken in the order of a hash while LETTERS
characters last, so none is too long in itself but one that alone is above that; only a language that has no other rows is learned from the
first LETTERS characters of its shortest one. Without any labelled row, all is `und`. More than LANGUAGES labels are refused.

A text is in no learned language where even the best one costs more bits a character than `limit`, which is MARGIN times the
dearest of some labelled rows that the automata don't hold. One phrase is free, so a few letters never decide it.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.store import bounded_sample
from factloom.llm.words import slices

LANE = 4096  # characters of a stretch
DOCS = 100  # labelled rows of each language, at most
LETTERS = 2_000_000  # characters of the labelled rows of a language that are learned from, at most
LANGUAGES = 1000  # labels, at most: the automata of all are sent to every task
CALIBRATED = 5  # one of so many labelled rows sets the limit instead of being learned from
MARGIN = 2.0
SLICE = 1 << 21  # bytes of texts that are followed at once: some 30 bytes of memory for each
NONE = (1 << 32) - 1  # the symbol of a state without a way on
FEW = 63  # symbols below have a bit in a state's ways; ways by others are listed apart


def _folded() -> np.ndarray:
    """The folded letter of each code point, 0 for what isn't a letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


_FOLDED: list[np.ndarray] = []


def folded(points: np.ndarray) -> np.ndarray:
    if not _FOLDED:
        _FOLDED.append(_folded())
    return _FOLDED[0][points]


def normal(text: str) -> str:
    """Folded letters, all else as single blanks between them."""
    f = folded(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32))
    return " ".join(np.where(f, f, 32).astype("<u4").tobytes().decode("utf-32-le").split())


@dataclass
class LanguageModel:
    """Labelled text by language, all that is needed to build the automata, and the most bits a character of a known language."""

    text: dict[str, str]
    limit: float = float("inf")

    @cached_property
    def parser(self) -> Parser:
        return Parser(self.text)


def fit(docs: DataFrame, labelled: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learns from the whole texts of a bounded sample of the labelled rows: DOCS of each language and LETTERS of their characters at most, by hash.

    What reaches the driver is chosen by sizes first: LETTERS characters a language, whatever the length of its rows.
    """
    lang = F.col(lang_col)
    src = docs.where(labelled & lang.isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), lang.alias("lang"))
    src = src.withColumns({"size": F.length("text"), "print": F.xxhash64("text")})
    if src.select("lang").distinct().count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages can't be learned")
    chosen, left = [], {}
    for r in bounded_sample(src.where("size > 0").drop("text"), "id", DOCS, F.col("lang")):  # ids, sizes and prints alone
        if r["size"] <= left.setdefault(r["_by"], LETTERS):
            left[r["_by"]] -= r["size"]
            chosen.append((r["_by"], r["id"], r["print"]))
    # of a language whose sampled rows are all longer, the shortest row is learned from, up to LETTERS of its characters
    long = []
    if lacking := sorted(left.keys() - {k for k, *_ in chosen}):
        d = src.where((F.col("size") > 0) & F.col("lang").isin(lacking))
        few = [(r["lang"], r["s"]["print"]) for r in d.groupBy("lang").agg(F.min(F.struct("size", "print")).alias("s")).collect()]
        few = docs.sparkSession.createDataFrame(few, f"lang {dict(src.dtypes)['lang']}, print long")
        long = src.join(F.broadcast(few), ["lang", "print"]).groupBy("lang").agg(F.first(F.left("text", F.lit(LETTERS))).alias("text")).collect()
    by: dict[str, list[str]] = {}
    keys = docs.sparkSession.createDataFrame(chosen, f"lang {dict(src.dtypes)['lang']}, id {dict(src.dtypes)['id']}, print long")  # DOCS a language at most
    order = {k: i for i, k in enumerate(chosen)}
    rows = src.join(F.broadcast(keys), ["lang", "id", "print"], "left_semi").dropDuplicates(["lang", "id", "print"]).collect() if chosen else []
    for r in sorted(rows, key=lambda r: order[r["lang"], r["id"], r["print"]]):
        by.setdefault(r["lang"], []).append(normal(r["text"]))
    for r in long:
        by.setdefault(r["lang"], [normal(r["text"])])
    by = {k: some for k in sorted(by) if (some := [t for t in by[k] if t])}
    apart = {k: ts[::CALIBRATED] if len(ts) >= CALIBRATED else [] for k, ts in by.items()}
    m = LanguageModel({k: " ".join(t for i, t in enumerate(ts) if not apart[k] or i % CALIBRATED) for k, ts in by.items()})
    rest = [t for ts in apart.values() for t in ts]
    if rest:
        m.limit = MARGIN * float(m.parser.predict(pa.array(rest, pa.string()))[2].max())
    return m


class Automaton(NamedTuple):
    """The suffix automaton of a text. States with several ways on come first, the root before all; the others have one or none.

    Of state s among the first, the ways on by the symbols under FEW are the set bits of ways[s], their targets from to[at[s]] on
    in order of the symbols; those by other symbols are in rare: s * 2^32 + symbol, in order, with rare_to.
    Of the i-th of the others, the way on is only[i] and its target to[i - len(only)]. root: targets from the root, by symbol.
    """

    ways: np.ndarray
    at: np.ndarray
    only: np.ndarray
    to: np.ndarray
    root: np.ndarray
    rare: np.ndarray
    rare_to: np.ndarray


def automaton(codes: np.ndarray, symbols: int) -> Automaton:
    """Of the text's symbols; an unknown one is a phrase by itself and leads to the root."""
    # A state's first way on is only and target; from the second on, more has them all.
    only, target, more = array("I", [NONE]), array("I", [0]), [None]
    link, length, last = array("i", [-1]), array("i", [0]), 0
    for c in codes.tolist():
        cur = len(only)
        only.append(NONE)
        target.append(0)
        more.append(None)
        length.append(length[last] + 1)
        link.append(0)
        p, q = last, -1
        while p != -1:
            d = more[p]
            if d is not None:
                q = d.get(c, -1)
                if q != -1:
                    break
                d[c] = cur
            elif only[p] == c:
                q = target[p]
                break
            elif only[p] == NONE:
                only[p], target[p] = c, cur
            else:
                more[p] = {only[p]: target[p], c: cur}
            p = link[p]
        if p != -1:
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(only)
                only.append(only[q])
                target.append(target[q])
                more.append(None if more[q] is None else dict(more[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1:
                    d = more[p]
                    if d is not None:
                        if d.get(c) != q:
                            break
                        d[c] = clone
                    elif only[p] == c and target[p] == q:
                        target[p] = clone
                    else:
                        break
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    if more[0] is None:
        more[0] = {only[0]: target[0]} if only[0] != NONE else {}
    many = np.fromiter((d is not None for d in more), bool, len(more))
    new = np.where(many, np.cumsum(many) - 1, many.sum() + np.cumsum(~many) - 1).astype(np.uint32)
    ways, at, to = np.zeros(many.sum(), np.uint64), np.zeros(many.sum(), np.uint32), array("I")
    rare, rare_to = array("Q"), array("I")
    root = np.zeros(symbols, np.uint32)
    for c, s in more[0].items():
        root[c] = new[s]
    for i, d in enumerate(d for d in more if d is not None):
        at[i], bits = len(to), 0
        for c in sorted(d) if i else ():  # the root has no ways on of its own: whatever comes there starts a phrase
            if c < FEW:
                bits |= 1 << c
                to.append(d[c])
            else:
                rare.append(i << 32 | c)
                rare_to.append(d[c])
        ways[i] = bits
    rest = ~many
    renamed = lambda *xs: new[np.concatenate([np.frombuffer(x, np.uint32) for x in xs])] if any(len(x) for x in xs) else np.zeros(0, np.uint32)
    targets = renamed(to, np.frombuffer(target, np.uint32)[rest].tobytes())
    return Automaton(ways, at, np.frombuffer(only, np.uint32)[rest], targets, root, np.frombuffer(rare, np.uint64).copy(), renamed(rare_to))


def _before(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many are set before each place."""
    count = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=count[1:])
    return count[at].astype(np.int64)


class Parser:
    """The automata of labelled texts put together as one, with a root for each language, and a symbol for each character."""

    def __init__(self, text: dict[str, str]):
        self.langs = sorted(text)
        count: Counter = Counter()
        for t in text.values():
            count.update(t)
        letters = sorted((c for c in count if c != " "), key=lambda c: (-count[c], c))
        self.symbols = len(letters) + 2
        self.symbol = np.zeros(0x110000, np.uint32)  # by folded letter; 0 is the blank
        self.symbol[1:] = self.symbols - 1
        for i, c in enumerate(letters):
            self.symbol[ord(c)] = i + 1
        self.symbol[32] = 0
        own = [automaton(self.symbol[np.frombuffer(text[k].encode("utf-32-le"), np.uint32)], self.symbols) for k in self.langs]
        self.price = np.array([np.log2(len(text[k]) + 1) for k in self.langs])
        firsts, others = [len(a.ways) for a in own], [len(a.only) for a in own]
        first_at, other_at = np.cumsum([0, *firsts]), np.cumsum([0, *others])
        to_at = np.cumsum([0, *(len(a.to) - len(a.only) for a in own)])
        self.first = int(first_at[-1])
        joined = lambda xs, kind: np.concatenate([*xs, np.zeros(0, kind)]).astype(kind)
        named = lambda k, s: np.where(s < firsts[k], s + first_at[k], s.astype(np.int64) - firsts[k] + self.first + other_at[k])
        self.ways, self.only = joined([a.ways for a in own], np.uint64), joined([*(a.only for a in own), [NONE]], np.uint32)
        self.at = joined([a.at + to_at[k] for k, a in enumerate(own)], np.uint32)
        ends = [len(a.to) - len(a.only) for a in own]
        self.to = joined([*(named(k, a.to[: ends[k]]) for k, a in enumerate(own)), *(named(k, a.to[ends[k] :]) for k, a in enumerate(own)), [0]], np.uint32)
        self.singles = int(to_at[-1])
        self.root = joined([named(k, a.root) for k, a in enumerate(own)], np.uint32)
        self.rare = joined([a.rare + (np.uint64(first_at[k]) << np.uint64(32)) for k, a in enumerate(own)], np.uint64)
        self.rare_to = joined([named(k, a.rare_to) for k, a in enumerate(own)], np.uint32)
        self.roots = first_at[:-1].astype(np.uint32)

    def step(self, state: np.ndarray, c: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase starts: a character that doesn't fit starts one from the root."""
        bit = np.uint64(1) << np.minimum(c, FEW).astype(np.uint64)
        many = state < self.first
        s, i = np.where(many, state, 0), np.where(many, np.uint32(len(self.only) - 1), state - np.uint32(self.first))
        ways = self.ways[s]
        fits = np.where(many, ways & bit != 0, self.only[i] == c)
        to = np.where(many, self.at[s] + np.bitwise_count(ways & (bit - np.uint64(1))), self.singles + i)
        to = self.to[np.where(fits, to, 0)]
        if len(self.rare) and (c >= FEW).any():
            at = np.nonzero(many & (c >= FEW))
            if len(at[0]):
                key = state[at].astype(np.uint64) << np.uint64(32) | np.broadcast_to(c, state.shape)[at].astype(np.uint64)
                place = np.minimum(np.searchsorted(self.rare, key), len(self.rare) - 1)
                fits[at], to[at] = self.rare[place] == key, self.rare_to[place]
        return np.where(fits, to, self.root[base + c]), ~fits

    def phrases(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Phrases by language and row; codes: of all rows, first[i]:first[i+1] those of row i."""
        n = np.diff(first)
        lanes = -(-n // LANE)
        total, k = int(lanes.sum()), len(self.langs)
        out = np.zeros((k, len(n)), np.int64)
        if not total or not k:
            return out
        row = np.repeat(np.arange(len(n)), lanes)
        place = np.arange(total) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = first[:-1][row] + LANE * place
        size = np.minimum(LANE, first[1:][row] - start)
        order = np.argsort(-size, kind="stable")  # longest first: the lanes still going are a prefix
        begin, left = start[order], size[order]
        going = np.searchsorted(-left, -np.arange(1, LANE + 1), "right")
        state, count = np.repeat(self.roots[:, None], total, 1), np.zeros((k, total), np.int32)
        base = (np.arange(k, dtype=np.uint32) * self.symbols)[:, None]
        for t in range(int(left[0])):
            m = going[t]
            state[:, :m], new = self.step(state[:, :m], codes[begin[:m] + t], base)
            count[:, :m] += new
        back = np.argsort(order)
        state, count = state[:, back], count[:, back]
        if total > len(n):
            count += self._joined(codes, start, size, place, state)
        for x in range(k):
            out[x] = np.bincount(row, count[x], len(n))
        return out

    def _joined(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray, place: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """What each lane's count is off by, as it doesn't start where a text does; ends: each lane's last state, mended on the way."""
        off = np.zeros(ends.shape, np.int64)
        lang, lane = map(np.ravel, np.meshgrid(np.arange(len(ends)), np.flatnonzero(place > 0), indexing="ij"))
        own_ends = ends.copy()
        while len(lane):
            real, own = ends[lang, lane - 1].copy(), self.roots[lang].copy()
            change, live = np.zeros(len(lane), np.int64), np.flatnonzero(real != own)
            met = np.ones(len(lane), bool)
            t = 0
            while len(live):
                c, base = codes[start[lane[live]] + t], lang[live].astype(np.uint32) * np.uint32(self.symbols)
                real[live], a = self.step(real[live], c, base)
                own[live], b = self.step(own[live], c, base)
                change[live] += a.astype(np.int64) - b
                t += 1
                same, over = real[live] == own[live], size[lane[live]] == t
                met[live[over & ~same]] = False
                live = live[~same & ~over]
            off[lang, lane] = change
            end = np.where(met, own_ends[lang, lane], real)
            moved = end != ends[lang, lane]
            ends[lang, lane] = end
            nxt = moved & (lane + 1 < len(place))
            nxt[nxt] = place[lane[nxt] + 1] > 0
            lang, lane = lang[nxt], lane[nxt] + 1  # the lanes after those whose end is another one now
        return off

    def predict(self, col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and bits a character of each text; 0 bits where there is no letter."""
        langs, scores, costs = [], [], []
        for i, j, data, off in slices(col, SLICE):
            text = folded(np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32))
            lead = _before((data & 0xC0) != 0x80, off)
            letter = _before(text > 0, lead)
            begin = np.zeros(len(text) + 1, bool)
            begin[lead] = True
            keep = (text > 0) | np.concatenate([[True], text[:-1] > 0]) | begin[:-1]  # one blank of each run
            first = _before(keep, lead)
            if not self.langs:
                langs += ["und"] * (j - i)
                scores.append(np.zeros(j - i))
                costs.append(np.zeros(j - i))
                continue
            got, n = self.phrases(self.symbol[text[keep]], first), np.maximum(np.diff(first), 1)
            bits = got * self.price[:, None] / n
            best = bits.argmin(0)
            weight = np.exp2(-8 * (bits - bits.min(0)))
            some = np.diff(letter) > 0
            langs += [self.langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)]
            scores.append(np.where(some, 1 / weight.sum(0), 0.0))
            costs.append(np.where(some, bits.min(0) - self.price[best] / n, 0.0))  # one phrase is free
        return langs, *(np.concatenate(x) if x else np.zeros(0) for x in (scores, costs))


def shared(docs: DataFrame, model: LanguageModel) -> Broadcast:
    """The parser of a model, built on the driver and read once by each Python worker."""
    return docs.sparkSession.sparkContext.broadcast(model.parser)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, known (whether the text is in a learned language) of each row."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    own, limit = shared(docs, model), model.limit

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = own.value
        for batch in batches:
            langs, scores, costs = p.predict(batch.column("text"))
            known = (costs <= limit) & np.array([x != "und" for x in langs], bool)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(known, pa.bool_())], names=["doc_id", "lang_pred", "score", "known"])

    return src.mapInArrow(work, src.select("doc_id").schema.simpleString()[7:-1] + ", lang_pred string, score double, known boolean")


def keep_known(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows whose text is in a learned language; where the language is NULL it becomes the one found, all else is as it was."""
    own, limit = shared(docs, model), model.limit

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = own.value
        for batch in batches:
            langs, _, costs = p.predict(batch.column(text_col))
            at = batch.schema.get_field_index(lang_col)
            found = pc.coalesce(batch.column(at), pa.array(langs, batch.schema.field(at).type))
            known = (costs <= limit) & np.array([x != "und" for x in langs], bool)
            yield batch.set_column(at, batch.schema.field(at), found).filter(pa.array(known))

    return docs.mapInArrow(work, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
