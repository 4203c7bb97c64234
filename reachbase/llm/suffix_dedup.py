"""Suffix-array dedup: byte strings that repeat, by a sorted set of sampled suffixes.

Every window of 100 bytes names, by its content alone, one suffix to stand for it: the one at the least
hash of 24 bytes in the window.  Suffixes are dealt by that hash, and those that share it are sorted by
mergesort, forwards and backwards from it.  Comparisons find the longest common extension by binary
search over prefix polynomial hashes; neighbours' extensions are checked byte by byte, and an order from
the bytes themselves replaces the hashed one if they ever disagree.  Windows whose two extensions cover
them are equal; all but the first are removed with every byte that they cover.

Windows are judged on the input; earlier means a smaller doc_id or, in one document, an earlier start.
Cases: a null text is empty; texts shorter than a window are kept whole; rows with one doc_id and equal
text are one document and each get its result; different texts under one doc_id are documents of their
own, in the order of a hash; a null doc_id counts as the smallest; an empty table gives no rows; other
columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reachbase.llm import repeats, wordhash



def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring values, by doubling."""
    out, have = values, 1
    while 2 * have <= width:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


@dataclass(frozen=True)
class ByteScheme:
    width: int = 100
    gram: int = 24

    @property
    def reach(self) -> int:
        return self.width - self.gram

    def chunks(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        data, offsets = wordhash.byte_rows(column)
        for i, j in wordhash.chunks(offsets):
            part = data[offsets[i] : offsets[j]]
            yield i, part, offsets[i : j + 1] - offsets[i], part

    def anchors(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            hashed = _GRAM_BYTES[units]
            total = np.zeros(len(units) - self.gram + 1, np.uint64)
            # Horner by doubling: hashes of 1, 2, 4, ... bytes join to one of ``gram``.
            block, length, done = hashed, 1, 0
            for bit in range(self.gram.bit_length()):
                if self.gram >> bit & 1:
                    total = total * np.uint64(pow(_BASE, length, 1 << 64)) + block[done : done + len(total)]
                    done += length
                if 2 * length <= self.gram:
                    block = block[:-length] * np.uint64(pow(_BASE, length, 1 << 64)) + block[length:]
                    length *= 2
        key = wordhash.mix(total)
        place = np.arange(len(key), dtype=np.uint64)
        least = sliding_least(((key >> np.uint64(32)) << np.uint64(32)) | place, self.width - self.gram + 1)
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return anchor, key[anchor]

    def text(self, held: np.ndarray, start: int, stop: int) -> bytes:
        return held[start:stop].tobytes()

    def units(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]

    def later(self, key: np.ndarray, left: np.ndarray, texts: list[bytes]) -> np.ndarray:
        return repeats.later_by_suffixes(self, key, left, texts)


_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM_BYTES = wordhash.mix(np.arange(1, 257, dtype=np.uint64))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", scheme: ByteScheme = ByteScheme()) -> DataFrame:
    """``key``, kept (binary: the bytes that stay), n_bytes, n_removed, n_spans and spans (bounds of what goes)."""
    rows, ids = repeats.numbered(docs, key, text)
    found = repeats.spans(rows, scheme)
    width = scheme.width
    bound = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])

    @F.arrow_udf(T.StructType([T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(bound))]))
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, run_lists in batches:
            out = []
            for value, run_list in zip(texts, run_lists, strict=True):
                data = value.as_py().encode()
                bounds = repeats.covered(run_list.as_py(), width, len(data))
                edges = [0, *[x for b in bounds for x in b], len(data)]
                out.append({"kept": b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), "n_bytes": len(data), "spans": [{"start": a, "stop": b} for a, b in bounds]})
            yield pa.array(out, pa.struct([("kept", pa.binary()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]))

    done = rows.join(found, "doc", "left").withColumn("_c", cut("text", "runs"))
    return repeats.with_ids(done, ids).select(F.col("id").alias(key), "_c.kept", "_c.n_bytes", (F.col("_c.n_bytes") - F.octet_length("_c.kept")).cast("long").alias("n_removed"), F.size("_c.spans").cast("long").alias("n_spans"), "_c.spans")
