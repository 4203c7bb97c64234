"""Byte-level BPE by prefix dynamic programming.

For each prefix of a byte string the encoding of that prefix ends in one token.  A token that ends at a
position is that last token exactly if the encoding of what stands before it ends in a token that stays
unmerged beside it.  So one entry for each prefix, filled from left to right, holds the encodings of all
prefixes: appending bytes continues the table, and after an edit it is refilled from the edit on until
as many entries as the longest token agree with the old ones.

Texts are split by the tokenizer's pattern first and the pieces are encoded each for itself; Spark deals
the texts, and the workers keep the ids of pieces that they met.  Cases: a null text is the empty one
and has no ids; very long texts and pieces are encoded whole; special tokens are ordinary text; rows,
repeated or not, keep their other columns, except one that has the result's name, which is replaced.
Of a short piece only those prefixes are encoded that the last token of a longer one asks about.
"""

from __future__ import annotations

import base64
import re
import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces, and pairs of tokens, that a worker keeps.  A full store makes way for a new one, and what
#: is still in use moves over.
KEPT_PIECES = 100_000
#: Bytes up to which a piece is encoded from its end down, and its ids are kept.
SHORT = 256
_NEVER = 1 << 40


class Vocabulary:
    """Tokens by bytes and by id, and which token may follow which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self._edges: tuple[dict, ...] = ({}, {})  # by side: 0 and -1 index it
        self.pairs: dict[int, bool] = {}  # what beside() has found, by left << 32 | right

    def merged(self, piece: bytes, until: int = 1) -> list[bytes]:
        """The parts left by merging the pair of least rank, again and again, down to ``until`` parts."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > until:
            rank, k = min((self.ids.get(a + b, _NEVER), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == _NEVER:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """What stood at the left (0) or right (-1) edge while the token came to be, each with the rank that ended it."""
        if (known := self._edges[side].get(token)) is None:
            known = [(token, _NEVER)]
            if len(token) > 1:
                part = self.merged(token, until=2)[side]
                known = [(b, self.ids[token] if b == part else end) for b, end in self._edge(part, side)] + known
            self._edges[side][token] = known
        return known

    def beside(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens stay unmerged side by side.

        Ranks rise as parts grow, so what meets at the border over time follows from both edges; the
        pair is broken if a merge across the border comes before the edge on either side moves on.
        """
        a, b = self._edge(left, -1), self._edge(right, 0)
        i = j = 0
        while True:
            (x, x_end), (y, y_end) = a[i], b[j]
            rank = self.ids.get(x + y, _NEVER)
            if rank < x_end and rank <= y_end and rank != _NEVER:
                return False
            if x_end == y_end == _NEVER:
                return True
            if x_end <= y_end:
                i += 1
            else:
                j += 1


    def encoded(self, data: bytes) -> list[int]:
        """The tokens of a short piece: the table of its prefixes, filled only where an entry is asked for."""
        get, names, pairs, longest, last = self.ids.get, self.bytes, self.pairs, self.longest, [-1] * (len(data) + 1)

        def fill(stop: int) -> int:
            for start in range(stop - longest if stop > longest else 0, stop):
                if (token := get(part := data[start:stop])) is None:
                    continue
                if start:
                    if (left := last[start]) < 0:
                        left = fill(start)
                    if (fits := pairs.get(left << 32 | token)) is None:
                        if len(pairs) >= KEPT_PIECES:
                            pairs.clear()
                        fits = pairs[left << 32 | token] = self.beside(names[left], part)
                    if not fits:
                        continue
                last[stop] = token
                return token
            raise ValueError("a byte has no token")

        out, end = [], len(data)
        while end:
            out.append(last[end] if last[end] >= 0 else fill(end))
            end -= len(names[out[-1]])
        return out[::-1]


class PrefixTable:
    """The last token of the encoding of every prefix of some bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", array("l")
        self.append(data)

    def _extend(self, end: int) -> Iterator[int]:
        """Fills the table from its end up to ``end`` bytes, and yields after each."""
        v, data, last = self.vocabulary, self.data, self.last
        get, names, pairs, longest = v.ids.get, v.bytes, v.pairs, v.longest
        for stop in range(len(last) + 1, end + 1):
            for start in range(stop - longest if stop > longest else 0, stop):
                token = get(part := data[start:stop])
                if token is None:
                    continue
                if start:
                    left = last[start - 1]
                    if (fits := pairs.get(left << 32 | token)) is None:
                        if len(pairs) >= KEPT_PIECES:
                            pairs.clear()
                        fits = pairs[left << 32 | token] = v.beside(names[left], part)
                    if not fits:
                        continue
                last.append(token)
                break
            else:
                raise ValueError("a byte has no token")
            yield stop

    def append(self, more: bytes) -> None:
        self.data += more
        for _ in self._extend(len(self.data)):
            pass

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Puts ``new`` in the place of bytes start to stop."""
        old_tail = self.last[stop:]
        self.data = self.data[:start] + new + self.data[stop:]
        del self.last[start:]
        agreed = 0
        for end in self._extend(len(self.data)):
            behind = end - start - len(new)
            agreed = agreed + 1 if behind > 0 and old_tail[behind - 1] == self.last[-1] else 0
            if agreed >= self.vocabulary.longest:
                self.last.extend(old_tail[behind:])
                break

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes[out[-1]])
        return out[::-1]


#: The letters, numbers and white space of Unicode below U+0250.
_CLASSES = {r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-\u024f", r"\p{N}": "0-9²³¹¼½¾", r"\s": "\\t-\\r \x85\xa0"}
_BEYOND = re.compile("[^\x00-\u024f]")


def _latin(pattern: str) -> str:
    """The pattern with its classes spelt out for characters below U+0250, where the faster ``re`` serves."""
    inside = re.sub(r"\[[^\]]*\]", lambda m: re.sub(r"\\p\{[LN]\}|\\s", lambda c: _CLASSES[c[0]], m[0]), pattern)
    return re.sub(r"\\p\{[LN]\}|\\s|\\S", lambda c: f"[^{_CLASSES[chr(92) + 's']}]" if c[0] == r"\S" else f"[{_CLASSES[c[0]]}]", inside)


class Codec:
    """Encodes and decodes texts; keeps the packed ids of pieces."""

    def __init__(self, ranks_file: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
        self.vocabulary, self.pieces, self.latin = Vocabulary(ranks), regex.compile(pattern), re.compile(_latin(pattern))
        self.packed: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _pack(self, piece: str) -> bytes:
        if (out := self.older.get(piece)) is not None:
            self.packed[piece] = out
            return out
        data = piece.encode()
        whole = self.vocabulary.ids.get(data)
        short = len(data) <= SHORT
        tokens = [whole] if whole is not None else self.vocabulary.encoded(data) if short else PrefixTable(self.vocabulary, data).tokens()
        out = struct.pack(f"<{len(tokens)}I", *tokens)
        if short:
            self.packed[piece] = out
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if len(self.packed) >= KEPT_PIECES:
            self.packed, self.older = {}, self.packed
        get, pack = self.packed.get, self._pack
        if not text:
            return b""
        pieces = self.pieces if _BEYOND.search(text) else self.latin
        return b"".join([get(p) or pack(p) for p in pieces.findall(text)])

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, memoryview(ids).cast("I"))) if ids else b""


_codecs: dict[str, Codec] = {}


def _codec(shared: Broadcast, pattern: str, name: str) -> Codec:
    """One codec for each vocabulary and Python worker."""
    if (key := f"{name}\0{pattern}") not in _codecs:
        _codecs[key] = Codec(shared.value, pattern)
    return _codecs[key]


def _shared(docs: DataFrame, ranks_path: str) -> tuple[Broadcast, str]:
    with open(ranks_path, "rb") as file:  # a vocabulary has a fixed size; the driver sends it to the executors
        data = file.read()
    return docs.sparkSession.sparkContext.broadcast(data), f"{ranks_path}:{len(data)}"


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """Adds ``to``: the token ids as little-endian unsigned 32-bit integers."""
    shared, name = _shared(docs, ranks_path)

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(shared, pattern, name)
        for batch in batches:
            yield pa.array((codec.encode(x.as_py()) for x in batch), pa.binary(), size=len(batch))

    return docs.withColumn(to, ids(F.col(text)))


def decode(docs: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds ``to``: the bytes that the ids stand for."""
    shared, name = _shared(docs, ranks_path)

    @F.arrow_udf("binary")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(shared, pattern, name)
        for batch in batches:
            yield pa.array((codec.decode(x.as_py()) for x in batch), pa.binary(), size=len(batch))

    return docs.withColumn(to, text(F.col(ids)))
