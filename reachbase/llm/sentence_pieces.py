"""SentencePiece encoding and decoding of a BPE model by vectorised merge rounds.

A text, with its spaces and the dummy prefix as the model has them, is cut where no piece of the model
reaches across: before a space mark that follows something else, and around characters that only stand
alone in pieces.  Merges never cross such a cut, so every part (a word, mostly) is encoded for itself and
each distinct one once.  The words that a worker has not met yet are encoded together: their symbols
lie in one flat numpy array; a round looks up the rank of every adjacent pair, takes the least rank of
each word, merges the leftmost pairs of that rank in all words at once, and closes the gaps.  Rounds go on
until no pair is left; finished words leave after each round.

One by one, the pair of least rank and furthest left is merged first, and a merge can make a pair that
goes before others of the old rank.  So a round merges a word's occurrences from the left up to the first
one that makes a pair of the same or a lesser rank, and leaves the rest to the next round.  Runs of space
marks, whose pieces all share one rank, would so take a round for every mark; where nothing but that rank
is left in a word, a cursor walks over it once.

Characters without a piece become byte pieces.  Cases: a null text is the empty one, which has the end
id alone; very long texts and words are encoded whole; rows, repeated or not, keep their other columns,
except one that has the result's name, which is replaced; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections import ChainMap, Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import chain, filterfalse, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from reachbase.llm.wordhash import mix

#: Words that a worker keeps, and those up to so many characters only.
KEPT_WORDS = 200_000
KEPT_LENGTH = 64
#: Characters that are cut into words, and symbols that are merged, at once; a longer text or word is taken alone.
BLOCK = 1 << 19
_NEVER = np.int64(1 << 40)
_MARK = "▁"
#: The kinds of pieces in a model file.
_NORMAL, _UNKNOWN, _USER, _UNUSED, _BYTE = 1, 2, 4, 5, 6


def _spec(data: bytes) -> sentencepiece_model_pb2.ModelProto:
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(data)
    return spec


class Model:
    """Pieces and, for pairs of symbols, what they merge to.

    A symbol is a piece or a character that a piece holds; another character has a number below 0.
    """

    def __init__(self, data: bytes):
        spec = _spec(data)
        norm, train = spec.normalizer_spec, spec.trainer_spec
        kinds = [p.type for p in spec.pieces]
        if train.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.treat_whitespace_as_suffix or _USER in kinds or not train.byte_fallback or spec.denormalizer_spec.precompiled_charsmap:
            raise ValueError("only BPE models with byte fallback and no normalisation")
        self.prefix = _MARK if norm.add_dummy_prefix else ""
        self.end = next(i for i, p in enumerate(spec.pieces) if p.piece == train.eos_piece)
        merged = {p.piece: (i, p.score) for i, p in enumerate(spec.pieces) if p.type in (_NORMAL, _UNUSED)}
        self.first_byte = kinds.index(_BYTE)
        chars = sorted({c for p in merged for c in p} - set(merged))
        symbol = {p: i for p, (i, _) in merged.items()} | {c: len(kinds) + k for k, c in enumerate(chars)}
        self.n_pieces, self.n_symbols = len(kinds), len(kinds) + len(chars)
        self.spelling = {i: p for p, i in symbol.items()}
        ranks = {s: r for r, s in enumerate(sorted({s for _, s in merged.values()}, reverse=True))}
        pairs = [(symbol[p[:k]] * self.n_symbols + symbol[p[k:]], i, ranks[s]) for p, (i, s) in merged.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        pairs.sort()
        self.keys, self.to, self.ranks = (np.array(x, np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), (), ())))
        self.shared = np.array([x > 1 for _, x in sorted(Counter(ranks[s] for _, s in merged.values()).items())])
        self.of_char = np.full(0x110000, -1, np.int32)
        for s, i in symbol.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        joined = {c for p in merged if len(p) > 1 for c in p} - {_MARK}
        inner = any(_MARK in p.lstrip(_MARK) for p in merged)
        within = f"[{re.escape(''.join(sorted(joined)))}{_MARK if inner else ''}]+" if joined else "(?!)"
        self.words = re.compile(f"{_MARK}*{within}|{_MARK}+|[\\s\\S]")
        self.table = self._table()

    def _table(self) -> np.ndarray:
        """Places of the pairs in an open table of eight times their number at least, for lookups without a search."""
        bits = max(4, int(8 * max(len(self.keys), 1)).bit_length())
        seats = np.full(1 << bits, -1, np.int32)
        left, at, self.steps = np.arange(len(self.keys)), self._seat(self.keys, bits), 0
        while len(left):
            free = seats[at] < 0
            seats[at[free]] = left[free]
            wait = seats[at] != left
            left, at = left[wait], (at[wait] + 1) & ((1 << bits) - 1)
            self.steps += 1
        return seats

    @staticmethod
    def _seat(keys: np.ndarray, bits: int) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The number of each pair in the list of merges, or -1."""
        out = np.full(len(left), -1, np.int64)
        if not len(self.keys):
            return out
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        key, last = left[open_] * self.n_symbols + right[open_], len(self.table) - 1
        at = self._seat(key, last.bit_length())
        for _ in range(self.steps):
            held = self.table[at]
            hit = (held >= 0) & (self.keys[held] == key)
            out[open_[hit]] = held[hit]
            more = np.flatnonzero((held >= 0) & ~hit)  # the seat is another pair's
            if not len(more):
                break
            open_, key, at = open_[more], key[more], (at[more] + 1) & last
        return out

    def rank(self, pair: np.ndarray) -> np.ndarray:
        return np.where(pair >= 0, self.ranks[pair], _NEVER) if len(self.ranks) else np.full(len(pair), _NEVER)

    def merge(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``symbol`` and, in rising order, the word that each belongs to, merged until no pair is left."""
        done = []
        while len(symbol):
            same = np.r_[word[1:] == word[:-1], False]  # whether the next symbol is of the same word
            pair = np.full(len(symbol), -1, np.int64)
            spot = np.flatnonzero(same)
            pair[spot] = self.pair(symbol[spot], symbol[spot + 1])
            rank = self.rank(pair)
            starts = np.r_[True, ~same[:-1]]
            begins = np.flatnonzero(starts)
            least = np.minimum.reduceat(rank, begins)[np.cumsum(starts) - 1]
            live = least < _NEVER
            done.append((symbol[~live], word[~live]))
            symbol, word, same, pair, rank, least = (x[live] for x in (symbol, word, same, pair, rank, least))
            if not len(symbol):
                break
            if (walked := self._walk(symbol, word, same, rank, least)) is not None:
                symbol, word = walked
                continue
            at = np.flatnonzero(rank == least)
            # of pairs that overlap every second one, from the left
            alone = np.r_[True, np.diff(at) != 1]
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(alone, np.arange(len(at)), 0))) % 2 == 0]
            home = word[at]
            fresh = np.r_[True, home[1:] != home[:-1]]
            take = fresh.copy()
            many = np.flatnonzero(~(fresh & np.r_[fresh[1:], True]))  # of words with several pairs to merge
            if len(many):
                take[many] = self._before_sooner(symbol, same, at[many], self.to[pair[at[many]]], rank[at[many]], home[many])
            new = self.to[pair[at]]
            symbol[at[take]] = new[take]
            keep = np.ones(len(symbol), bool)
            keep[at[take] + 1] = False
            symbol, word = symbol[keep], word[keep]
        if not done:
            return symbol, word
        symbol, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbol[order], word[order]

    def _before_sooner(self, symbol: np.ndarray, same: np.ndarray, at: np.ndarray, new: np.ndarray, limit: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Whether each merge comes no later in its word than the first that makes a pair of the same or a lesser rank."""
        before = np.where((at > 0) & same[at - 1], symbol[at - 1], -1)
        after = np.where(same[at + 1], symbol[np.minimum(at + 2, len(symbol) - 1)], -1)
        joined = np.r_[False, (np.diff(at) == 2) & (home[1:] == home[:-1])]
        beside = np.where(joined, np.r_[-1, new[:-1]], -1)
        soon = np.minimum.reduce([self.rank(self.pair(*x)) for x in ((before, new), (new, after), (beside, new))]) <= limit
        stops = np.cumsum(soon) - soon
        first = np.maximum.accumulate(np.where(np.r_[True, home[1:] != home[:-1]], np.arange(len(at)), 0))
        return stops == stops[first]

    def _walk(self, symbol: np.ndarray, word: np.ndarray, same: np.ndarray, rank: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Merges, in words whose pairs all have one shared rank, from the left with a stack; None if there are none."""
        starts = np.flatnonzero(np.r_[True, ~same[:-1]])
        most = np.maximum.reduceat(np.where(rank < _NEVER, rank, -1), starts)
        picked = np.flatnonzero((most == least[starts]) & self.shared[least[starts]])
        ends, cut, change = np.r_[starts[1:], len(symbol)], np.ones(len(symbol), bool), False
        for k in picked.tolist():
            if (out := self._stack(symbol[starts[k] : ends[k]].tolist(), int(most[k]))) is not None:
                symbol[starts[k] : starts[k] + len(out)] = out
                cut[starts[k] + len(out) : ends[k]] = False
                change = True
        return (symbol[cut], word[cut]) if change else None

    def _stack(self, symbols: list[int], rank: int) -> list[int] | None:
        out: list[int] = []
        for s in symbols:
            out.append(s)
            while len(out) > 1 and (found := self.merges.get((out[-2], out[-1]))) is not None:
                if found[1] != rank:  # another rank would go first or last: a round decides
                    return None
                out[-2:] = found[:1]
        return out

    @cached_property
    def merges(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(left, right) to (symbol, rank) of pairs whose rank others share, and of all pairs with a symbol that these make."""
        left, right = np.divmod(self.keys, self.n_symbols)
        shared = self.shared[self.ranks]
        at = np.flatnonzero(shared | np.isin(left, self.to[shared]) | np.isin(right, self.to[shared]))
        return {(int(left[k]), int(right[k])): (int(self.to[k]), int(self.ranks[k])) for k in at}

    def ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word as packed 32-bit integers."""
        out: list[bytes] = []
        begin = 0
        while begin < len(words):
            end, size = begin, 0
            while end < len(words) and (end == begin or size + len(words[end]) <= BLOCK):
                size += len(words[end])
                end += 1
            part = words[begin:end]
            points = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32)
            word = np.repeat(np.arange(len(part)), [len(w) for w in part])
            symbol = self.of_char[points].astype(np.int64)
            symbol = np.where(symbol < 0, -2 - points.astype(np.int64), symbol)  # no symbol, but which character
            symbol, word = self.merge(symbol, word)
            out += self._packed(symbol, word, len(part))
            begin = end
        return out

    def _packed(self, symbol: np.ndarray, word: np.ndarray, n: int) -> list[bytes]:
        plain = (symbol >= 0) & (symbol < self.n_pieces)
        if not plain.all():
            spelt = [[s] if p else [self.first_byte + b for b in (chr(-2 - s) if s < 0 else self.spelling[s]).encode()] for s, p in zip(symbol.tolist(), plain.tolist(), strict=True)]
            word = np.repeat(word, [len(x) for x in spelt])
            symbol = np.array([i for x in spelt for i in x], np.int64)
        data, bounds = symbol.astype("<i4").tobytes(), np.searchsorted(word, np.arange(n + 1)) * 4
        return [data[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


class Encoder:
    """Encodes texts; keeps the packed ids of words."""

    def __init__(self, data: bytes):
        self.model = Model(data)
        self.packed: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, the end id last, as little-endian 32-bit integers; the words of all these texts are held at once."""
        if len(self.packed) >= KEPT_WORDS:
            self.packed, self.older = {}, self.packed
        model, packed, older = self.model, self.packed, self.older
        cut = [model.words.findall(model.prefix + text.replace(" ", _MARK)) if text else [] for text in texts]
        missing = dict.fromkeys(filterfalse(packed.__contains__, chain.from_iterable(cut)))
        packed.update((w, older[w]) for w in missing if w in older)
        new = [w for w in missing if w not in older]
        found = dict(zip(new, model.ids(new), strict=True))
        packed.update((w, ids) for w, ids in found.items() if len(w) <= KEPT_LENGTH)
        both = ChainMap(found, packed) if any(len(w) > KEPT_LENGTH for w in found) else packed
        end = model.end.to_bytes(4, "little")
        return [b"".join([*map(both.__getitem__, words), end]) for words in cut]


class Decoder:
    """Decodes ids."""

    def __init__(self, data: bytes):
        spec = _spec(data)
        kinds, names = [p.type for p in spec.pieces], [p.piece for p in spec.pieces]
        self.prefix, first, unknown = spec.normalizer_spec.add_dummy_prefix, kinds.index(_BYTE), spec.trainer_spec.unk_surface.encode()
        self.is_byte = [k == _BYTE for k in kinds]
        self.is_marked = [k in (_NORMAL, _UNUSED) and n.startswith(_MARK) for k, n in zip(kinds, names, strict=True)]
        self.spelt = [bytes([i - first]) if k == _BYTE else unknown if k == _UNKNOWN else n.replace(_MARK, " ").encode() if k in (_NORMAL, _UNUSED) else b"" for i, (k, n) in enumerate(zip(kinds, names, strict=True))]

    def decode(self, ids: list[int]) -> str:
        """The text of some ids: control pieces are nothing, and bytes that are no UTF-8 become U+FFFD each."""
        spelt = self.spelt
        try:
            text = b"".join(map(spelt.__getitem__, ids)).decode()
        except UnicodeDecodeError:
            runs = groupby(ids, self.is_byte.__getitem__)
            text = "".join(_lenient(b"".join(map(spelt.__getitem__, run))) for _, run in runs)
        if self.prefix:  # the mark before the first word is not the text's own
            lead = next((i for i in ids if spelt[i]), None)
            if lead is not None and self.is_marked[lead]:
                return text[1:]
        return text


def _lenient(data: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that begins no character."""
    out, k = [], 0
    while k < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[k : k + size].decode())
                break
            except UnicodeDecodeError:
                size = 0
        out += [] if size else ["\ufffd"]
        k += size or 1
    return "".join(out)


_kept: dict[tuple, Encoder | Decoder] = {}


def _coder(kind: type, shared: Broadcast, name: str) -> Encoder | Decoder:
    """One coder of a kind for each model and Python worker."""
    if (kind, name) not in _kept:
        _kept[kind, name] = kind(shared.value)
    return _kept[kind, name]


def _parts(batch: pa.Array) -> Iterator[pa.Array]:
    """Slices of a column of about BLOCK bytes, so that few texts are Python objects at once."""
    sizes, begin = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy()), 0
    while begin < len(batch):
        done = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, done + BLOCK, "right")))
        yield batch[begin:end]
        begin = end


def _shared(docs: DataFrame, model_path: str) -> tuple[Broadcast, str]:
    with open(model_path, "rb") as file:  # a model has a fixed size; the driver sends it to the executors
        data = file.read()
    return docs.sparkSession.sparkContext.broadcast(data), f"{model_path}:{len(data)}"


def encode(docs: DataFrame, model_path: str, text: str = "text", to: str = "ids") -> DataFrame:
    """Adds ``to``: the ids of the text, an array of integers that ends with the end id."""
    shared, name = _shared(docs, model_path)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _coder(Encoder, shared, name)
        for batch in batches:
            data, bounds = bytearray(), [0]
            for part in _parts(batch):
                for packed in encoder.encode([x or "" for x in part.to_pylist()]):
                    data += packed
                    bounds.append(len(data) // 4)
            yield pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.Array.from_buffers(pa.int32(), bounds[-1], [None, pa.py_buffer(data)]))

    return docs.withColumn(to, ids(F.col(text)))


def decode(docs: DataFrame, model_path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds ``to``: the text that the ids stand for; null ids are none."""
    shared, name = _shared(docs, model_path)

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = _coder(Decoder, shared, name)
        for batch in batches:
            data, bounds = bytearray(), [0]
            for x in batch:
                data += decoder.decode(x.values.to_pylist() if x.is_valid else []).encode()
                bounds.append(len(data))
            yield pa.StringArray.from_buffers(len(batch), pa.py_buffer(np.array(bounds, np.int32)), pa.py_buffer(data))

    return docs.withColumn(to, text(F.col(ids)))
