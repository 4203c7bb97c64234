"""Periodic runs of words in linear time, from the Lyndon arrays of both orders.

A run is a longest stretch whose words repeat with some least period.  Its period is the length of a Lyndon
word that is the longest one at its start, in one of two opposite orders of the words; so the
candidates of a text are the pairs (i, next smaller suffix of i) of both orders, fewer than two a word.
For each pair two extensions count: how far the suffixes at its ends agree, and how far what stands before
them does.

The next smaller suffixes come from one pass with a stack.  Suffix i is compared with the suffixes on the
stack; how far neighbours on the stack agree is known, so each comparison goes on where the one before it
ended or needs none.  Between chains the furthest match (j, i, end) is kept: up to ``end`` the text after i repeats the
text after j, so a pair inside takes its extension from the pair i - j words earlier, and words are
only compared from ``end`` on.  Every comparison that succeeds moves ``end``: the pass is linear for any
order of the words, without suffix arrays or hashes of substrings; words are ordered by first appearance.

Spark deals the documents; none is shared between tasks.  Cases: null and blank texts have no words and no
runs; a very long text is one row and takes memory in proportion to it; rows, repeated or not, keep
their other columns, except those that have a result's name, which are replaced; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachbase.llm.words import unused

#: A run is reported from so many words on.
SHORTEST = 12


def candidates(tokens: list[int], shortest: int) -> list[tuple[int, int, int]]:
    """(i, k, agreement) for the next smaller suffix k of each i where a run of ``shortest`` words can come of it.

    Suffixes end in something smaller than any word.
    """
    n = len(tokens)
    t = [*tokens, -1]
    before, after, gap, drop = [-1] * n, [0] * n, [0] * n, [0] * n  # previous and next smaller suffix, their agreements
    out = []
    base, shift, end = 0, 0, 0  # t[base:end] equals the text ``shift`` earlier
    for i in range(1, n):
        c, j, agree, gate = t[i], i - 1, 0, 0  # gate: how far j agrees with the suffix compared before it
        while j >= 0:
            x = t[j]
            if x > c:
                after[j], drop[j] = i, 0
                j = before[j]
                continue
            if x < c:
                agree = 0
                break
            if gate < agree:  # j differs from the one before where that still agrees with i
                agree = gate
                break
            if gate == agree:
                known = -1
                if i < end and j >= base:
                    a, b = j - shift, i - shift
                    if after[a] == b:
                        known = drop[a]
                    elif before[b] == a:
                        known = gap[b]
                    elif b == base and j == base:
                        known = end - base
                if 0 <= known < end - i:
                    agree = known
                else:
                    if known >= 0 and agree < end - i:
                        agree = end - i
                    if agree < 1:
                        agree = 1
                    while t[i + agree] == t[j + agree]:
                        agree += 1
                    if i + agree >= end:
                        base, shift, end = i, i - j, i + agree
                if t[j + agree] < t[i + agree]:
                    break
            # suffix j is greater; so it is where it agrees further with the one before, which is greater
            after[j], drop[j] = i, agree
            if agree + 2 * (i - j) > shortest:
                out.append((j, i, agree))
            gate = gap[j]
            j = before[j]
        before[i], gap[i] = j, agree
    return out


def runs(tokens: list[int], shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``shortest`` words, by start and then period."""
    if len(tokens) < max(shortest, 2):
        return []
    found = set()
    top = max(tokens) + 1
    for order in (tokens, [top - w for w in tokens]):
        for i, k, right in candidates(order, shortest):
            p = k - i
            need = max(p, shortest - p) - right  # words that must agree on the left
            if need >= p:
                continue  # a run has its first root where fewer than a period stand before
            if need > 0 and (i < need or tokens[i - need : i] != tokens[k - need : k]):
                continue
            left = max(need, 0)
            while left < p and left < i and tokens[i - left - 1] == tokens[k - left - 1]:
                left += 1
            if left < p:
                found.add((i - left, left + p + right, p))
    return sorted(found)


def kept(n: int, found: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each of n words stays: not one that a run holds after its first period."""
    change = [0] * (n + 1)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    out, depth = [], 0
    for step in change[:n]:
        depth += step
        out.append(depth == 0)
    return out


def _judged(text: str | None, shortest: int) -> tuple[list[tuple[int, int, int]], str]:
    tokens = (text or "").encode().split()  # bytes split at ASCII white space alone
    names: dict[bytes, int] = {}
    found = runs([names.setdefault(w, len(names)) for w in tokens], shortest)
    stay = [w for w, keep in zip(tokens, kept(len(tokens), found), strict=True) if keep] if found else tokens
    return found, b" ".join(stay).decode()


def collapse(docs: DataFrame, text: str = "text", shortest: int = SHORTEST, to: str = "runs", left: str = "collapsed") -> DataFrame:
    """Adds ``to``, the runs of the text's words by start and period, and ``left``, the words outside repeats joined by one space."""

    @F.arrow_udf("runs array<struct<start: long, length: long, period: long>>, left string")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fields = [pa.field(c, pa.int64()) for c in ("start", "length", "period")]
        kind = pa.list_(pa.struct(fields))
        for batch in batches:
            rows = [_judged(x.as_py(), shortest) for x in batch]
            found = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs_] for runs_, _ in rows]
            yield pa.StructArray.from_arrays([pa.array(found, kind), pa.array([x for _, x in rows], pa.string())], ["runs", "left"])

    (both,) = unused(docs, "judged")
    done = docs.withColumn(both, judged(F.col(text)))
    return done.withColumns({to: F.col(f"{both}.runs"), left: F.col(f"{both}.left")}).drop(both)


def _tiled(doc_id: str | None, text: str | None) -> str | None:
    h = 1 if doc_id is None else crc32(doc_id.encode())
    if h % 10 or not text or not (tokens := text.encode().split()):
        return text
    n, g = len(tokens), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(tokens[:a] + (tokens[a : a + p] * -((a - n) // p))[: n - a]).decode()


def tiled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Plants runs: in one of ten documents, by the checksum of its id, the words from a place on repeat.  Others, and those without an id, stay."""

    @F.arrow_udf("string")
    def planted(ids: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array((_tiled(i, t) for i, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True)), pa.string(), size=len(ids))

    return docs.withColumn(text, planted(F.col(doc_id).cast("string"), F.col(text)))


def digests(rows: DataFrame, runs_: str = "runs", left: str = "collapsed") -> DataFrame:
    """The greatest run of each row (the first and then the shortest period among equals) and digests of all runs and of what is left."""
    r = F.col(runs_)
    best = F.array_max(F.transform(r, lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    lines = F.transform(r, lambda x: F.concat_ws(",", x["start"], x["length"], x["period"]))
    return rows.select(
        "doc_id",
        F.size(r).cast("long").alias("n_runs"),
        (-best["start"]).alias("start"),
        best["length"].alias("length"),
        (-best["period"]).alias("period"),
        (1000 * best["length"] / -best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size(r) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2(F.col(left), 256).alias("collapsed_sha256"),
    )
