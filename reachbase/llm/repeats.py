"""Windows of fixed width that also start earlier.

A scheme gives every window of a document an anchor: a place inside the window, and a key, both fixed by
the window's content alone, so equal windows have equal keys and equal distances to their anchors.  Runs
of windows with one anchor are entries.  Entries whose key stands once in the corpus are dropped; the
others travel with the text that their windows cover, dealt by key, and the scheme says which of their
windows also start earlier.  Entries with equal text are settled where they first meet, so copies of a
passage shrink to one entry for each batch before they travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachbase.llm import wordhash
from reachbase.llm.checkpoints import stored

#: Bytes of text for each partition of the keys.
PARTITION_BYTES = 24 << 20
#: Entries that are sorted at once; keys stay whole.
SORTED = 20_000
_NULL_ID = -(1 << 63)


class Scheme(Protocol):
    width: int
    reach: int  # greatest distance from a window's start to its anchor

    def chunks(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, object]]:
        """For some neighbouring rows: the first, their units on end, the bounds of each, and what text() needs."""

    def anchors(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchor and key of every window."""

    def text(self, held: object, start: int, stop: int) -> bytes:
        """The text of units start to stop."""

    def units(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The units of several texts on end, and their bounds."""

    def later(self, key: np.ndarray, left: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """[entry, distance]: whether the window at that distance before the anchor stands in an earlier entry of its key."""


@dataclass(frozen=True)
class Entries:
    """Of some rows: row, key, anchor, first and last window of each entry, in order; places count from ``base`` on."""

    row: np.ndarray
    key: np.ndarray
    anchor: np.ndarray
    first: np.ndarray
    last: np.ndarray
    base: np.ndarray
    held: object


def _entries(scheme: Scheme, column: pa.Array) -> Iterator[Entries]:
    """Anchors are found over several documents at once; windows that reach into the next one are no windows."""
    for start, units, bounds, held in scheme.chunks(column):
        if len(units) < scheme.width:
            continue
        anchor, key = scheme.anchors(units)
        size = np.maximum(np.diff(bounds) - scheme.width + 1, 0)
        row = np.repeat(np.arange(len(size)), size)
        window = np.arange(len(row)) + np.repeat(bounds[:-1] - np.cumsum(size) + size, size)
        if not len(row):
            continue
        head = np.flatnonzero(np.r_[True, (np.diff(anchor[window]) != 0) | (np.diff(row) != 0)])
        tail = np.r_[head[1:], len(row)] - 1
        first, base = window[head], bounds[row[head]]
        yield Entries(start + row[head], key[first].view(np.int64), anchor[first] - base, first - base, window[tail] - base, base, held)


def prefix_hashes(units: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of each row of a matrix, made comparable by weighting from the start."""
    with np.errstate(over="ignore"):
        weighted = (wordhash.mix(units.astype(np.uint64) + np.uint64(1))) * wordhash.powers(units.shape[1])[None, :]
        return np.concatenate([np.zeros((len(units), 1), np.uint64), np.cumsum(weighted, axis=1, dtype=np.uint64)], axis=1)


class SuffixOrder:
    """Sequences sorted within groups by merging; two compare through their longest common extension.

    The extension is found by binary search over prefix hashes, so a comparison takes a number of steps
    that is logarithmic in the length; ``lcp`` then holds the extension of neighbours, checked against
    the units themselves.
    """

    def __init__(self, group: np.ndarray, units: np.ndarray, length: np.ndarray):
        self.units, self.length, self.hashes = units, length, prefix_hashes(units)
        self.order = np.argsort(group, kind="stable")
        sizes = np.unique(group, return_counts=True)[1]
        base = np.repeat(np.cumsum(sizes) - sizes, sizes)
        seat, size = np.arange(len(group)) - base, np.repeat(sizes, sizes)
        width = 1
        while width < (sizes.max() if len(sizes) else 0):
            self.order = self._merged(base, seat, size, width)
            width *= 2
        self.lcp = np.zeros(len(group), np.int64)
        near = np.flatnonzero(seat > 0)
        a, b = self.order[near - 1], self.order[near]
        self.lcp[near] = self.extension(a, b)
        self.first = seat == 0
        if not self._holds(a, b, self.lcp[near]):
            self._exact(group)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a), np.int64), np.minimum(self.length[a], self.length[b]).astype(np.int64)
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            same = self.hashes[a, mid] == self.hashes[b, mid]
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low

    def _less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self.extension(a, b)
        ended = at >= np.minimum(self.length[a], self.length[b])
        column = np.minimum(at, self.units.shape[1] - 1)
        return np.where(ended, self.length[a] < self.length[b], self.units[a, column] < self.units[b, column])

    def _merged(self, base: np.ndarray, seat: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
        """One round: every element finds its rank in the run beside its own."""
        run = seat // width
        left = run % 2 == 0
        other = np.where(left, run + 1, run - 1) * width
        low, high = np.minimum(other, size), np.minimum(other + width, size)
        start = low.copy()
        while (open_ := low < high).any():
            at = np.flatnonzero(open_)
            mid = (low[at] + high[at]) // 2
            mine, theirs = self.order[at], self.order[base[at] + mid]
            # An element of the left run goes before equal ones of the right run.
            before = np.where(left[at], self._less(theirs, mine), ~self._less(mine, theirs))
            low[at], high[at] = np.where(before, mid + 1, low[at]), np.where(before, high[at], mid)
        place = base + np.where(left, seat, seat - width) + (low - start)
        out = np.empty_like(self.order)
        out[place] = self.order
        return out

    def _holds(self, a: np.ndarray, b: np.ndarray, lcp: np.ndarray) -> bool:
        columns = np.arange(self.units.shape[1])[None, :]
        if ((self.units[a] != self.units[b]) & (columns < lcp[:, None])).any():
            return False
        ended = lcp >= np.minimum(self.length[a], self.length[b])
        at = np.minimum(lcp, self.units.shape[1] - 1)
        return bool((ended | (self.units[a, at] < self.units[b, at])).all())

    def _exact(self, group: np.ndarray) -> None:
        """Two different sequences met in one hash: the same order from the units alone."""
        rows = [self.units[i, : self.length[i]].tolist() for i in range(len(group))]
        self.order = np.array(sorted(range(len(group)), key=lambda i: (group[i], rows[i])), np.int64)
        for k in range(1, len(group)):
            a, b = self.order[k - 1], self.order[k]
            if not self.first[k]:
                both = min(self.length[a], self.length[b])
                differs = np.flatnonzero(self.units[a, :both] != self.units[b, :both])
                self.lcp[k] = differs[0] if len(differs) else both

    def classes(self, at_least: int) -> np.ndarray:
        """Equal numbers for sequences of a group that agree in their first ``at_least`` units."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.first | (self.lcp < at_least))
        return out


def later_by_suffixes(scheme: Scheme, key: np.ndarray, left: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Scheme.later: suffixes sorted forwards and backwards from their anchors."""
    units, bounds = scheme.units(texts)
    total = np.diff(bounds)
    right = total - left
    n, most_left, most_right = len(texts), int(left.max(initial=0)), int(right.max())
    row = np.repeat(np.arange(n), total)
    column = np.arange(len(units)) - np.repeat(bounds[:-1], total) - np.repeat(left, total)
    ahead, behind = np.zeros((n, most_right), units.dtype), np.zeros((n, max(1, most_left)), units.dtype)
    on = column >= 0
    ahead[row[on], column[on]] = units[on]
    behind[row[~on], -1 - column[~on]] = units[~on]
    forward, backward = SuffixOrder(key, ahead, right), SuffixOrder(key, behind, left)
    out = np.zeros((n, most_left + 1), bool)
    for distance in range(most_left + 1):
        there = np.flatnonzero((left >= distance) & (right >= scheme.width - distance))
        if len(there) > 1:
            same = forward.classes(scheme.width - distance)[there] * np.int64(n + 2) + backward.classes(distance)[there]
            order = np.argsort(same, kind="stable")  # entries come in the order of their documents and places
            again = np.r_[False, np.diff(same[order]) == 0]
            out[there[order[again]], distance] = True
    return out


def _settled(scheme: Scheme, table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """doc, from, to: runs of windows that also start earlier, from all entries of a partition's keys."""
    key, doc, anchor, first, last, mark = (table[c].to_numpy() for c in ("key", "doc", "anchor", "first", "last", "mark"))
    text = table["text"].combine_chunks()
    order = np.lexsort((first, doc, mark, anchor - first, key))
    key, doc, anchor, first, last, mark = (x[order] for x in (key, doc, anchor, first, last, mark))
    same = np.r_[False, (np.diff(key) == 0) & (np.diff(mark) == 0) & (np.diff(anchor - first) == 0)]
    twice = np.r_[False, same[1:] & (np.diff(doc) == 0) & (np.diff(first) == 0)]
    heads = np.flatnonzero(~same)
    head = heads[np.cumsum(~same) - 1] if len(same) else heads
    texts = text.take(pa.array(order))
    copies = np.flatnonzero(same & ~twice)
    if len(copies):
        equal = pc.equal(texts.take(pa.array(copies)), texts.take(pa.array(head[copies]))).to_numpy(zero_copy_only=False)
        yield doc[copies[equal]], first[copies[equal]], last[copies[equal]]
        same[copies[~equal]] = False  # other text under the same hash: an entry of its own
    lone = np.flatnonzero(~same)
    lone = lone[np.lexsort((first[lone], doc[lone], key[lone]))]
    group = np.unique(key[lone], return_inverse=True)[1] if len(lone) else lone
    sizes = np.bincount(group) if len(lone) else np.zeros(0, np.int64)
    lone, group = lone[sizes[group] > 1], group[sizes[group] > 1]
    ends = np.flatnonzero(np.r_[np.diff(group) != 0, True]) + 1 if len(lone) else []
    start = 0
    for k, end in enumerate(ends):
        if end - start < SORTED and k + 1 < len(ends):
            continue
        part = lone[start:end]
        later = scheme.later(group[start:end], (anchor - first)[part], [x.as_py() for x in texts.take(pa.array(part))])
        entry, distance = np.nonzero(later)
        window = anchor[part][entry] - distance
        by = np.lexsort((window, entry))
        entry, window = entry[by], window[by]
        cut = np.flatnonzero((np.diff(entry) != 0) | (np.diff(window) != 1)) + 1
        if len(entry):
            lo, hi = np.r_[0, cut], np.r_[cut, len(entry)] - 1
            yield doc[part][entry[lo]], window[lo], window[hi]
        start = end


_SPAN = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
_ENTRY = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("anchor", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("mark", pa.int64()), ("text", pa.binary())])


def numbered(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """(doc, text), text not null and doc a number that rises with the id, a null id first; and (doc, id) of every row where they differ.

    Rows with equal id and text are one document.  Different texts under one id, or under none, are documents
    of their own, in the order of a hash of the text.  Where no id repeats, it is the number.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    number = F.coalesce("id", F.lit(_NULL_ID))
    if rows.groupBy(number.alias("doc")).agg(F.count("*").alias("n"), F.max("id").alias("id")).where((F.col("n") > 1) | (F.col("id") == _NULL_ID)).isEmpty():
        return rows.select(number.alias("doc"), "text"), None
    hashed = rows.withColumn("hash", F.sha2("text", 256))
    # Partitions of a sort come in its order, and so do the numbers that they give.
    numbers = stored(hashed.groupBy("id", "hash").agg(F.count("*").alias("n")).orderBy("id", "hash").withColumn("doc", F.monotonically_increasing_id()))
    own = numbers.select("doc", F.col("id").alias("_id"), F.col("hash").alias("_hash"), "n")
    met = hashed.join(own, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")))
    # Only rows that do repeat are gathered by their document.
    unique = met.where("n = 1").select("doc", "text").unionByName(met.where("n > 1").select("doc", "text").dropDuplicates(["doc"]))
    return stored(unique), numbers.select("doc", "id", F.explode(F.sequence(F.lit(1), "n")).alias("_n")).drop("_n")


def with_ids(done: DataFrame, ids: DataFrame | None) -> DataFrame:
    """``done`` (doc, ...) with the id of each row."""
    return done.withColumn("id", F.when(F.col("doc") != _NULL_ID, F.col("doc"))) if ids is None else done.join(ids, "doc")


def spans(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """doc, runs: array of (start, stop), the first and last of neighbouring windows that also start earlier.

    ``docs`` has doc (long, not null) and text.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, size // PARTITION_BYTES, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy()
            for e in _entries(scheme, batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(e.key), pa.array(doc[e.row]), pa.array(e.first.astype(np.int32))], ["key", "doc", "first"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            table = pa.Table.from_batches(held)
            key, doc, first = (table[c].to_numpy() for c in ("key", "doc", "first"))
            order = np.argsort(key, kind="stable")
            changes = np.diff(key[order]) != 0
            again = order[~(np.r_[True, changes] & np.r_[changes, True])]
            for i in range(0, len(again), 100_000):
                at = again[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(first[at])], ["doc", "first"])

    shared = docs.mapInArrow(keys, "key long, doc long, first int").repartition(parts, "key").mapInArrow(repeated, "doc long, first int")
    wanted = stored(shared.groupBy("doc").agg(F.collect_list("first").alias("wanted")))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, lists = batch.column(0).to_numpy(), batch.column(2)
            out: list[tuple] = []
            ends, asked = lists.offsets.to_numpy(), lists.values.to_numpy().astype(np.int64)
            for e in _entries(scheme, batch.column(1)):
                # Both sides are numbers of (row, first window), which rise with the entries.
                lo, hi = int(e.row[0]), int(e.row[-1]) + 1
                rows = np.repeat(np.arange(lo, hi), np.diff(ends[lo : hi + 1]))
                at = np.flatnonzero(np.isin((e.row << 32) | e.first, (rows << 32) | asked[ends[lo] : ends[hi]]))
                for k, d, a, f, z, b in zip(*(x[at].tolist() for x in (e.key, docs_[e.row], e.anchor, e.first, e.last, e.base)), strict=True):
                    out.append((k, d, a, f, z, scheme.text(e.held, b + f, b + z + scheme.width)))
            # Repeated rows of a document give its entries twice; one of each place is enough.
            out = list({(x[1], x[3]): x for x in out}.values())
            out.sort(key=lambda x: (x[1], x[3]))
            met: dict[tuple, int] = {}
            for n, (key, _, anchor, first, _, text) in enumerate(out):
                if met.setdefault((key, anchor - first, text), n) != n:
                    # An earlier entry of this batch has its text: all its windows start earlier.  It is done, and
                    # travels under its place instead of its key, which may be a very common one.
                    out[n] = (first * 0x9E3779B1 + out[n][1], *out[n][1:5], None)
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            marks = [int.from_bytes(_digest(t), "little", signed=True) if t is not None else 0 for t in columns[5]]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(marks, pa.int64()), pa.array(columns[5], pa.binary())], schema=_ENTRY)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            done = batch.filter(batch.column(6).is_null())
            yield pa.RecordBatch.from_arrays([done.column(1), done.column(3), done.column(4)], schema=_SPAN)
            held.append(batch.filter(batch.column(6).is_valid()))
        if held and sum(map(len, held)):
            for doc, start, stop in _settled(scheme, pa.Table.from_batches(held)):
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array(stop)], schema=_SPAN)

    texts = docs.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(entries, "key long, doc long, anchor long, first long, last long, mark long, text binary")
    found = texts.repartition(parts, "key").mapInArrow(settle, "doc long, start long, stop long")
    return found.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))


def _digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=8).digest()


def covered(run_list: list[dict], width: int, n: int) -> list[tuple[int, int]]:
    """The union of the units that the windows of some runs cover, as bounds in order."""
    out: list[list[int]] = []
    for run in sorted(run_list or [], key=lambda x: x["start"]):
        start, stop = run["start"], min(n, run["stop"] + width)
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]
