"""Substring dedup: repeated runs of 20 words, found through recompression.

Documents are packed into chunks, and each round puts what a chunk holds before one global table, dealt
over the cluster by hash:

* Words are named first.  A word's name is a hash; the table sees the words themselves, and words that
  meet in one hash are numbered and named by hash and number.
* A step names every run of equal symbols, and then every pair whose left and right symbol fall into the
  two halves of a hash partition, by a hash of its definition (symbol and count, or left and right).  Every
  symbol keeps the words that its making depended on; inside equal windows, symbols that depend on nothing
  outside are equal.
* A round takes as many steps as it needs to make symbols that are rare, and puts their definitions before
  the table, which counts them by what they are and not by name.  A symbol that stands once in the corpus
  kills all windows that hold what it depends on.  What remains are runs of windows that share these
  symbols with other places; other words are dropped.  Rounds end when symbols come near to the window's width.
* Each window that remains is anchored at the least symbol of the highest level inside it.  Neighbouring
  windows of one anchor are an entry; entries with the same symbol and the same words around it are equal,
  and all but the earliest are settled by that.  The windows of the earliest entries are then held against
  each other, as they may overlap another entry in part.

Words are compared by their names, windows and entries by 128 bits over the names of their words.  Chunks
settle what they hold twice before they send, so a passage that all documents share sends one item for
each chunk.

Windows are judged on the input; earlier means a smaller doc_id or, in one document, an earlier start.
Cases: null and empty texts and those of fewer words than a window have nothing removed; rows with one
doc_id and equal text are one document and each get its result; different texts under one doc_id are
documents of their own, in the order of a hash; a null doc_id counts as the smallest; an empty table gives
no rows; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachbase.llm import repeats, wordhash
from reachbase.llm.checkpoints import discard, stored

_RUN, _PAIR, _OTHER = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1B54A32D192ED03)
#: Odd multipliers whose top bit deals symbols into left and right ones; names are mixed already.
_HALVES = tuple(np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63))
#: Words of the input for each part of a table.
TABLE_WORDS = 8_000_000
#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK = 4 << 20


@dataclass(frozen=True)
class Level:
    """Symbols in order: name, first word, the words from..to (exclusive) that each depends on, and the definition of new ones."""

    name: np.ndarray
    first: np.ndarray
    low: np.ndarray
    high: np.ndarray
    new: np.ndarray
    left: np.ndarray  # the symbol of a run, the left one of a pair
    right: np.ndarray  # the count of a run, the right one of a pair


def words_level(names: np.ndarray) -> Level:
    at = np.arange(len(names), dtype=np.int64)
    return Level(names, at, at, at + 1, np.zeros(len(at), bool), names, names)


def runs_named(level: Level, n: int) -> Level:
    """Runs of one symbol become one symbol; where a run ends shows only beside its neighbours.

    Bounds rise from symbol to symbol, so a neighbour's are the wider ones.
    """
    head = np.flatnonzero(np.r_[True, level.name[1:] != level.name[:-1]])
    tail = np.r_[head[1:], len(level.name)] - 1
    symbol, count = level.name[head], (tail - head + 1).astype(np.uint64)
    several = np.flatnonzero(count > 1)
    name = symbol.copy()
    with np.errstate(over="ignore"):
        name[several] = wordhash.mix(symbol[several] * _RUN + count[several])
    return Level(name, level.first[head], np.r_[-1, level.low[tail[:-1]]], np.r_[level.high[head[1:]], n + 1], count > 1, symbol, count)


def pairs_named(level: Level, n: int, number: int) -> Level:
    """A left symbol and the right symbol that follows it become one symbol; others show beside one neighbour."""
    with np.errstate(over="ignore"):
        is_left = (level.name * _HALVES[number % len(_HALVES)]) >> np.uint64(63) == 0
    joined = np.r_[is_left[:-1] & ~is_left[1:], False]
    low = np.where(is_left, level.low, np.r_[-1, level.low[:-1]])
    high = np.where(is_left, np.r_[level.high[1:], n + 1], level.high)
    left = np.flatnonzero(joined)
    name, after = level.name.copy(), np.zeros(len(level.name), np.uint64)
    after[left] = level.name[left + 1]
    with np.errstate(over="ignore"):
        name[left] = wordhash.mix(level.name[left] * _PAIR + after[left] + np.uint64(number))
    keep = np.flatnonzero(~np.r_[False, joined[:-1]])
    return Level(name[keep], level.first[keep], low[keep], high[keep], joined[keep], level.name[keep], after[keep])


def step_of(names: np.ndarray, step: int) -> list[Level]:
    """The runs and pairs of one step, after those before it."""
    level = words_level(names)
    for k in range(1, step + 1):
        runs = runs_named(level, len(names))
        level = pairs_named(runs, len(names), k)
    return [runs, level]


def levels_of(names: np.ndarray, steps: int) -> list[Level]:
    """Words, and what each step leaves."""
    out = [words_level(names)]
    for step in range(1, steps + 1):
        out.append(pairs_named(runs_named(out[-1], len(names)), len(names), step))
    return out


def anchors(levels: list[Level], windows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window (its first word): where its anchor stands and the key, both fixed by the window's words."""
    anchor, key = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.uint64)
    missing = np.ones(len(windows), bool)
    for number, level in reversed(list(enumerate(levels))):
        lo = np.searchsorted(level.low, windows, "left")
        hi = np.searchsorted(level.high, windows + width, "right")
        at = np.flatnonzero(missing & (hi > lo))
        if not len(at):
            continue
        lo, size = lo[at], hi[at] - lo[at]
        value = (wordhash.mix(level.name + np.uint64(number)) >> np.uint64(32) << np.uint64(32)) | np.arange(len(level.name), dtype=np.uint64)
        tables = [value]
        while 2 ** len(tables) <= size.max():
            half = 2 ** (len(tables) - 1)
            tables.append(np.minimum(tables[-1][:-half], tables[-1][half:]))
        step = np.frexp(size)[1] - 1
        least = np.empty(len(at), np.uint64)
        for k, table in enumerate(tables):
            on = step == k
            least[on] = np.minimum(table[lo[on]], table[lo[on] + size[on] - 2**k])
        symbol = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        anchor[at], key[at] = level.first[symbol], wordhash.mix(level.name[symbol] ^ np.uint64(number + 1))
        missing[at] = False
        if not missing.any():
            break
    return anchor, key


def _pack(values: np.ndarray) -> bytes:
    """Compressed, bytes of one weight on end."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(held: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(held[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(held[8:], n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


TEXTS = "chunk long, words long, doc binary, size binary, word binary, vocabulary binary"
RUNS = "chunk long, doc binary, start binary, windows binary, word binary, name binary, later binary"


@dataclass(frozen=True)
class Texts:
    """The words of some documents on end, as places in ``vocabulary`` (bytes, a space after each word)."""

    doc: np.ndarray
    size: np.ndarray
    word: np.ndarray
    vocabulary: np.ndarray

    @staticmethod
    def read(row: dict) -> Texts:
        return Texts(_unpack(row["doc"], np.int64), _unpack(row["size"], np.int64), _unpack(row["word"], np.int32), _unpack(row["vocabulary"], np.uint8))

    @property
    def ends(self) -> np.ndarray:
        return np.flatnonzero(self.vocabulary == 32)


@dataclass(frozen=True)
class Runs:
    """Runs of neighbouring windows on end: document, first word and number of windows of each, the names of their words, and which windows are known to start earlier."""

    width: int
    doc: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    name: np.ndarray
    later: np.ndarray

    @staticmethod
    def read(row: dict, width: int) -> Runs:
        name = _unpack(row["name"], np.uint64)[_unpack(row["word"], np.int32)]
        return Runs(width, _unpack(row["doc"], np.int64), _unpack(row["start"], np.int64), _unpack(row["windows"], np.int64), name, _unpack(row["later"], bool))

    def row(self, chunk: int) -> tuple:
        name, word = np.unique(self.name, return_inverse=True)
        return chunk, _pack(self.doc), _pack(self.start), _pack(self.windows), _pack(word.astype(np.int32)), _pack(name), _pack(self.later)

    @property
    def base(self) -> np.ndarray:
        """Where each run begins among the words."""
        size = self.windows + self.width - 1
        return np.cumsum(size) - size

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Run, and place among the words, of every window."""
        run = np.repeat(np.arange(len(self.windows)), self.windows)
        return run, np.arange(len(run)) + run * (self.width - 1)

    def without(self, low: np.ndarray, high: np.ndarray) -> Runs:
        """The runs of windows that hold none of the stretches of words low to high."""
        run, place = self.places()
        edge = np.zeros(len(self.name) + 1, np.int64)
        np.add.at(edge, np.maximum(high - self.width, 0), 1)
        np.add.at(edge, low + 1, -1)
        live = (np.cumsum(edge) == 0)[place]
        head = np.flatnonzero(live & np.r_[True, ~live[:-1] | (np.diff(run) != 0)])
        tail = np.flatnonzero(live & np.r_[~live[1:] | (np.diff(run) != 0), True])
        windows = tail - head + 1
        size = windows + self.width - 1
        at = np.arange(size.sum()) + np.repeat(place[head] - np.cumsum(size) + size, size)
        return Runs(self.width, self.doc[run[head]], self.start[run[head]] + place[head] - self.base[run[head]], windows, self.name[at], self.later[at])


@dataclass(frozen=True)
class Items:
    """What a chunk puts before a table: figures (equal items have equal ones), and a mark for each."""

    deal: np.ndarray
    figures: np.ndarray
    mark: np.ndarray


#: Bits of an item's mark.
_AGAIN, _IS_RUN = np.uint8(1), np.uint8(2)
_PUT = "chunk long, part long, figures binary, mark binary"
_SAID = "chunk long, part long, said binary"
Verdict = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _once(figures: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """1 for items that stand once in the corpus."""
    columns = (mark & _IS_RUN, *figures.T)
    order = np.lexsort(columns)
    head = np.r_[True, np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])]
    alone = head & np.r_[head[1:], True]
    said = np.zeros(len(mark), np.uint8)
    said[order] = alone
    return said & ~(mark & _AGAIN)


def _not_first(figures: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """1 for items whose digest an earlier document or place has."""
    order = np.lexsort((figures[:, 3], figures[:, 2], figures[:, 1], figures[:, 0]))
    said = np.zeros(len(mark), np.uint8)
    said[order] = np.r_[False, (figures[order[1:], :2] == figures[order[:-1], :2]).all(axis=1)] if len(order) else False
    return said


def _rows(rows: list[tuple], layout: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in layout.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def _words(held: np.ndarray) -> pa.Array:
    """Words with a space after each, as an array."""
    at = np.r_[0, np.flatnonzero(held == 32) + 1].astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(held)])


def _bytes(words: pa.Array) -> np.ndarray:
    """The bytes of a large binary array on end."""
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]


def _part(deal: np.ndarray, bits: int) -> np.ndarray:
    return (deal >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(deal), np.int64)


def told(chunks: DataFrame, items: Callable[[dict], Items | None], verdict: Verdict, bits: int, change: Callable[[dict, np.ndarray], tuple | None], layout: str) -> DataFrame:
    """One round: chunks put items before the table and are changed by what it says about each, in their order."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = items(row)
                if x is None or not len(x.mark):
                    continue
                part = _part(x.deal, bits)
                order = np.argsort(part, kind="stable")
                edges = [0, *(np.flatnonzero(np.diff(part[order])) + 1).tolist(), len(order)]
                out = []
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    at = order[lo:hi]
                    out.append((row["chunk"], int(part[at[0]]), x.figures[at].tobytes(), _pack(x.mark[at])))
                yield _rows(out, _PUT)

    def say(table: pa.Table) -> pa.Table:
        marks = [_unpack(m.as_py(), np.uint8) for m in table["mark"]]
        mark = np.concatenate(marks)
        figures = np.frombuffer(b"".join(x.as_py() for x in table["figures"]), np.int64)
        figures = figures.reshape(len(mark), len(figures) // len(mark))
        said = np.split(verdict(figures, mark), np.cumsum([len(m) for m in marks])[:-1])
        return pa.table({"chunk": table["chunk"], "part": table["part"], "said": pa.array([_pack(s) for s in said], pa.binary())})

    def hear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = items(row)
                said = np.zeros(0 if x is None else len(x.mark), np.uint8)
                if len(said):
                    part = _part(x.deal, bits)
                    order = np.argsort(part, kind="stable")
                    heard = {s["part"]: s["said"] for s in row["heard"]}
                    said[order] = np.concatenate([_unpack(heard[k], np.uint8) for k in sorted(heard)])
                out = change(row, said)
                if out is not None:
                    yield _rows([out], layout)

    said = chunks.mapInArrow(put, _PUT).groupBy("part").applyInArrow(say, _SAID)
    heard = said.groupBy("chunk").agg(F.collect_list(F.struct("part", "said")).alias("heard"))
    return stored(chunks.join(heard, "chunk", "left").mapInArrow(hear, layout))


def chunked(rows: DataFrame) -> DataFrame:
    """``rows`` (doc, text) as TEXTS."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            doc = batch.column(0).to_numpy()
            for w in wordhash.words(batch.column(1), False, CHUNK):
                held, at = _spaced(w.data, w.start, w.stop)
                places = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(held)]).dictionary_encode()
                yield _rows([(number, len(w.start), _pack(doc[w.first : w.first + w.rows]), _pack(np.diff(w.bounds)), _pack(places.indices.to_numpy().astype(np.int32)), _pack(_bytes(places.dictionary)))], TEXTS)
                number += 1

    return rows.mapInArrow(pack, TEXTS)


def _spaced(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words on end with one space after each, and where each begins; the last bound is the end."""
    length = stop - start + 1
    at = np.r_[0, np.cumsum(length)]
    if not len(length):
        return data[:0], at
    out = data[np.minimum(np.arange(at[-1]) + np.repeat(start - at[:-1], length), len(data) - 1)]
    out[at[1:] - 1] = 32
    return out, at


def _hashes(words: np.ndarray, bits: int = 64, seed: int = 0) -> np.ndarray:
    """A hash of each word of some (a space after each); fewer bits for tests."""
    stop = np.flatnonzero(words == 32)
    return wordhash.hashes(words, np.r_[0, stop[:-1] + 1][: len(stop)], stop, seed) >> np.uint64(64 - bits)


def _definitions(levels: list[Level], n: int, width: int) -> tuple[Items, np.ndarray, np.ndarray, np.ndarray]:
    """Of a round's levels (runs, pairs): the definitions of new symbols that fit a window; which item each is (-1: none), and what each depends on."""
    fits = [np.flatnonzero(x.new & (x.low >= 0) & (x.high <= n) & (x.high - x.low <= width)) for x in levels]
    name, left, right, low, high = (np.concatenate([getattr(x, field)[at] for x, at in zip(levels, fits, strict=True)]) for field in ("name", "left", "right", "low", "high"))
    kind = np.repeat(np.array([_IS_RUN, 0], np.uint8), [len(at) for at in fits])
    names, at, item, count = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
    # Two definitions under one name in a chunk: neither is put before the table, so neither kills a window.
    clash = np.unique(item[(left != left[at][item]) | (right != right[at][item]) | (kind != kind[at][item])])
    stay = np.ones(len(names), bool)
    stay[clash] = False
    number = np.where(stay, np.cumsum(stay) - 1, -1)
    at = at[stay]
    return Items(wordhash.mix(names[stay]), np.stack([left[at], right[at]], axis=1).view(np.int64), kind[at] | (count[stay] > 1).astype(np.uint8)), number[item], low, high


class Digests:
    """128 bits of any stretch of words, by two polynomial hashes of prefixes."""

    def __init__(self, names: np.ndarray):
        self.sides = []
        for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            with np.errstate(over="ignore"):
                weighted = wordhash.mix(names ^ np.uint64(base)) * wordhash.powers(len(names), np.uint64(base))
                back = wordhash.powers(len(names), np.uint64(pow(base, -1, 1 << 64)))
                self.sides.append((np.r_[np.uint64(0), np.cumsum(weighted, dtype=np.uint64)], back))

    def of(self, start: np.ndarray, stop: np.ndarray, salt: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.stack([wordhash.mix((sums[stop] - sums[start]) * back[start] + salt) for sums, back in self.sides], axis=1).view(np.int64)


def _firsts(digest: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[Items, np.ndarray]:
    """The earliest of each digest as items, and which item each row is (-1: a later one)."""
    order = np.lexsort((place, doc, digest[:, 0]))
    # Two digests that agree in their first half alone may break a group up; the table then decides.
    head = order[np.r_[True, (digest[order[1:]] != digest[order[:-1]]).any(axis=1)]] if len(order) else order
    item = np.full(len(doc), -1)
    item[head] = np.arange(len(head))
    return Items(digest[head, 0].view(np.uint64), np.column_stack([digest[head], doc[head], place[head]]), np.zeros(len(head), np.uint8)), item


Read = Callable[[dict], Runs | None]


@dataclass(frozen=True)
class Scheme:
    """``rounds`` has the last step of each.

    Two steps make symbols of two or three words, most of which stand once in running text; three make symbols that
    depend on two thirds of a window of 20 words, and a fourth would make half of them depend on more than it has.
    """

    width: int = 20
    rounds: tuple[int, ...] = (2, 3)
    hash_bits: int = 64

    def texts(self, clashing: dict[bytes, int], seed: int = 0) -> Read:
        """All windows of a row of TEXTS; a word of ``clashing`` is named by its hash and its seat among the words of that hash."""

        def read(row: dict) -> Runs | None:
            texts = Texts.read(row)
            long = texts.size >= self.width
            if not long.any():
                return None
            name = _hashes(texts.vocabulary, self.hash_bits, seed)
            if clashing:
                seat = np.array([clashing.get(w.as_py(), -1) for w in _words(texts.vocabulary)], np.int64)
                with np.errstate(over="ignore"):
                    apart = wordhash.mix(wordhash.mix(name ^ _OTHER) + seat.astype(np.uint64))
                name = np.where(seat < 0, name, apart)
            word = texts.word[np.repeat(long, texts.size)]
            return Runs(self.width, texts.doc[long], np.zeros(long.sum(), np.int64), texts.size[long] - self.width + 1, name[word], np.zeros(len(word), bool))

        return read

    def runs(self, row: dict) -> Runs:
        return Runs.read(row, self.width)

    def symbol_items(self, step: int, read: Read) -> Callable[[dict], Items | None]:
        def items(row: dict) -> Items | None:
            runs = read(row)
            return None if runs is None else _definitions(step_of(runs.name, step), len(runs.name), self.width)[0]

        return items

    def pruned(self, step: int, read: Read) -> Callable[[dict, np.ndarray], tuple | None]:
        """The runs of windows without a symbol that stands once."""

        def change(row: dict, said: np.ndarray) -> tuple | None:
            runs = read(row)
            if runs is None:
                return None
            _, item, low, high = _definitions(step_of(runs.name, step), len(runs.name), self.width)
            dead = (item >= 0) & (np.r_[said, 0][item] == 1)
            left = runs.without(low[dead], high[dead])
            return left.row(row["chunk"]) if len(left.doc) else None

        return change

    def entries(self, runs: Runs) -> tuple[Items, np.ndarray, np.ndarray, np.ndarray]:
        """The earliest entries, which item each entry is, and places of the first and last window of each."""
        run, place = runs.places()
        anchor, key = anchors(levels_of(runs.name, max(self.rounds)), place, self.width)
        head = np.flatnonzero(np.r_[True, (np.diff(anchor) != 0) | (np.diff(run) != 0)])
        first, last = place[head], place[np.r_[head[1:], len(place)] - 1]
        with np.errstate(over="ignore"):
            salt = key[head] + wordhash.mix((anchor[head] - first).astype(np.uint64) * np.uint64(1 << 20) + (last - first).astype(np.uint64))
        digest = Digests(runs.name).of(first, last + self.width, salt)
        items, item = _firsts(digest, runs.doc[run[head]], runs.start[run[head]] + first - runs.base[run[head]])
        return items, item, first, last

    def entry_items(self, row: dict) -> Items:
        return self.entries(Runs.read(row, self.width))[0]

    def settled(self, row: dict, said: np.ndarray) -> tuple:
        runs = Runs.read(row, self.width)
        _, item, first, last = self.entries(runs)
        later = (item < 0) | (np.r_[said, 0][item] == 1)
        edge = np.zeros(len(runs.later) + 1, np.int64)
        np.add.at(edge, first[later], 1)
        np.add.at(edge, last[later] + 1, -1)
        return replace(runs, later=np.cumsum(edge)[:-1] > 0).row(row["chunk"])

    def windows(self, runs: Runs) -> tuple[Items, np.ndarray, np.ndarray]:
        """Of the windows that are still open: the earliest, which item each is, and their places."""
        run, place = runs.places()
        at = ~runs.later[place]
        run, place = run[at], place[at]
        items, item = _firsts(Digests(runs.name).of(place, place + self.width, np.uint64(0)), runs.doc[run], runs.start[run] + place - runs.base[run])
        return items, item, place

    def window_items(self, row: dict) -> Items:
        return self.windows(Runs.read(row, self.width))[0]

    def spans(self, row: dict, said: np.ndarray) -> tuple:
        """chunk, doc, start, stop: the first and last of neighbouring windows that also start earlier."""
        runs = Runs.read(row, self.width)
        _, item, place = self.windows(runs)
        later = runs.later.copy()
        later[place[(item < 0) | (np.r_[said, 0][item] == 1)]] = True
        run, place = runs.places()
        later = later[place]
        head = np.flatnonzero(later & np.r_[True, ~later[:-1] | (np.diff(run) != 0)])
        tail = np.flatnonzero(later & np.r_[~later[1:] | (np.diff(run) != 0), True])
        shift = runs.start[run[head]] - runs.base[run[head]]
        return row["chunk"], _pack(runs.doc[run[head]]), _pack(place[head] + shift), _pack(place[tail] + shift)


#: Words of one hash are expected in fewer than one of 10^9 distinct ones; beyond so many the driver turns to another hash.
MOST_CLASHES = 100_000


def clashing_words(texts: DataFrame, bits: int, hash_bits: int, seed: int = 0) -> dict[bytes, int]:
    """Words whose hash another word of the corpus has, compared as words, each with its seat among those; at most MOST_CLASHES + 1."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = _unpack(row["vocabulary"], np.uint8)
                part = _part(wordhash.mix(_hashes(words, hash_bits, seed)), bits)
                order = np.argsort(part, kind="stable")
                held = _words(words).take(pa.array(order))
                edges = [0, *(np.flatnonzero(np.diff(part[order])) + 1).tolist(), len(order)]
                yield _rows([(int(part[order[lo]]), _pack(_bytes(held[lo:hi]))) for lo, hi in zip(edges[:-1], edges[1:], strict=True) if hi > lo], "part long, words binary")

    def met(table: pa.Table) -> pa.Table:
        words = _words(np.concatenate([_unpack(x.as_py(), np.uint8) for x in table["words"]])).unique()
        _, same, count = np.unique(_hashes(_bytes(words), hash_bits, seed), return_inverse=True, return_counts=True)
        many = count[same] > 1
        order = np.lexsort((np.arange(int(many.sum())), same[many]))
        group = same[many][order]
        head = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]][: len(group)], np.arange(len(group)), 0))
        seats = np.empty(len(group), np.int64)
        seats[order] = np.arange(len(group)) - head
        return pa.table({"word": words.filter(pa.array(many)).cast(pa.binary()), "seat": pa.array(seats)})

    rows = texts.mapInArrow(put, "part long, words binary").groupBy("part").applyInArrow(met, "word binary, seat long").limit(MOST_CLASHES + 1).collect()
    return {bytes(r["word"]): r["seat"] for r in rows}


def found(texts: DataFrame, scheme: Scheme) -> DataFrame:
    """chunk, from_doc, start, stop (packed) for TEXTS."""
    words = texts.agg(F.sum("words")).first()[0] or 0
    bits = int(words // TABLE_WORDS).bit_length()
    seed = 0
    while len(clashing := clashing_words(texts, bits, scheme.hash_bits, seed)) > MOST_CLASHES:
        seed += 1
    read, runs = scheme.texts(clashing, seed), texts
    for step in scheme.rounds:
        held, runs = runs, told(runs, scheme.symbol_items(step, read), _once, bits, scheme.pruned(step, read), RUNS)
        if held is not texts:
            discard(held)
        read = scheme.runs
    held, runs = runs, told(runs, scheme.entry_items, _not_first, bits, scheme.settled, RUNS)
    discard(held)
    held, spans = runs, told(runs, scheme.window_items, _not_first, bits, scheme.spans, "chunk long, from_doc binary, start binary, stop binary")
    discard(held)
    return spans


_DONE = "doc long, kept string, n_words long, n_removed long, spans array<struct<start: long, stop: long>>"
_DONE_TYPES = pa.schema([("doc", pa.int64()), ("kept", pa.large_string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])


def _covered(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of stretches of each document, in order."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    # Stretches of one document may overlap: their greatest end so far, over all documents on end.
    far = int(stop.max(initial=0)) + 2
    number = np.cumsum(np.r_[0, np.diff(doc) != 0]) if len(doc) else doc
    most = np.maximum.accumulate(number * far + stop) if len(doc) else stop
    head = np.flatnonzero(np.r_[True, number[1:] * far + start[1:] > most[:-1]]) if len(doc) else np.zeros(0, np.int64)
    tail = np.r_[head[1:], len(doc)] - 1 if len(doc) else head
    return doc[head], start[head], most[tail] - number[tail] * far


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", scheme: Scheme = Scheme()) -> DataFrame:
    """``key``, kept (the words that stay, joined by one space), n_words, n_removed and spans (bounds, in words, of what goes)."""
    rows, ids = repeats.numbered(docs, key, text)
    texts = stored(chunked(rows))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = Texts.read(row)
                if row["from_doc"] is None:
                    seat, start, stop = (np.zeros(0, np.int64) for _ in range(3))
                else:
                    by = np.argsort(x.doc, kind="stable")
                    seat = by[np.searchsorted(x.doc, _unpack(row["from_doc"], np.int64), sorter=by)]
                    seat, start, stop = _covered(seat, _unpack(row["start"], np.int64), _unpack(row["stop"], np.int64) + scheme.width)
                bounds = np.r_[0, np.cumsum(x.size)]
                edge = np.zeros(len(x.word) + 1, np.int64)
                np.add.at(edge, bounds[seat] + start, 1)
                np.add.at(edge, bounds[seat] + stop, -1)
                stays = np.cumsum(edge)[:-1] == 0
                left = np.r_[0, np.cumsum(stays)][bounds]
                begin = np.r_[0, x.ends[:-1] + 1][: len(x.ends)]
                word = x.word[stays]
                held, at = _spaced(x.vocabulary, begin[word], x.ends[word])
                # The space after a document's last word is left out.
                kept = [held[at[a] : max(at[a], at[b] - 1)].tobytes().decode() for a, b in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
                spans: list[list[dict]] = [[] for _ in kept]
                for k, a, b in zip(seat.tolist(), start.tolist(), stop.tolist(), strict=True):
                    spans[k].append({"start": a, "stop": b})
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip([x.doc, kept, x.size, x.size - np.diff(left), spans], _DONE_TYPES.types, strict=True)], schema=_DONE_TYPES)

    done = texts.join(found(texts, scheme), "chunk", "left").mapInArrow(cut, _DONE)
    return repeats.with_ids(done, ids).select(F.col("id").alias(key), "kept", "n_words", "n_removed", "spans")
