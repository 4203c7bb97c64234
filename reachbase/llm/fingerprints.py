"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit packing.

Every shingle of five lower-cased words (the whole sequence where a text has fewer) is hashed once to
64 bits.  The top bits name one of ``2**bin_bits`` bins and each bin keeps its least hash.  An empty bin
takes the value of the first bin with one along a pseudo-random tour of all bins that belongs to the
empty bin.  Of each value the low eight bits are stored, as two hexadecimal digits.  The share of equal
positions, corrected for chance agreement of eight bits, estimates the Jaccard likeness.

All of it is expressions over one row.  Cases: null and empty texts, and texts of white space, share the
fingerprint of no shingle (all zero); two of those are alike to 1, and one of them and any other text
to 0; repeated rows get equal fingerprints; an empty table gives no rows.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reachbase.llm.checkpoints import checkpoint
from reachbase.llm.words import ascii_lower, let, unused, words

SHINGLE_WORDS = 5
BIN_BITS = 8
STORED_BITS = 8
#: Bytes of text in a block of neighbours; there is one cut for each in the plan.
BLOCK_BYTES = 32 << 20
#: Up to this number of blocks, the places of their first rows are sent to every executor.
BROADCAST_BLOCKS = 50_000


def _first_on_tour(values: str, bins: int) -> Column:
    """The value of the first filled bin on bin i's tour: an odd step visits every residue of a power of two.

    Later stretches of the tour are looked at only while the earlier ones hold empty bins alone.
    """
    draw = random.Random(bins)
    starts = ",".join(str(draw.randrange(bins)) for _ in range(bins))
    steps = ",".join(str(draw.randrange(1, bins, 2)) for _ in range(bins))
    stretches, lo = [], 1
    while lo <= bins:
        hi = min(bins, 4 * lo - 1)
        stretches.append(f"get(filter(transform(sequence({lo}, {hi}), t -> get(vs, (array({starts})[i] + t * array({steps})[i]) % {bins})), y -> y IS NOT NULL), 0)")
        lo = hi + 1
    return F.expr(let(values, "vs", f"transform(vs, (x, i) -> coalesce(x, {', '.join(stretches)}))"))


def with_fingerprint(docs: DataFrame, text: str = "text", to: str = "fingerprint", bin_bits: int = BIN_BITS) -> DataFrame:
    """Adds ``to``: the packed fingerprint of the text as hexadecimal digits, two for each bin."""
    bins, shift = 1 << bin_bits, 64 - bin_bits
    n = SHINGLE_WORDS
    w, h, s, m, v, f = unused(docs, "_w", "_h", "_s", "_m", "_v", "_f")
    parts = ", ".join(f"ws[i + {k}]" for k in range(n))
    rows = docs.withColumn(w, words(ascii_lower(F.col(text))))
    rows = rows.withColumn(h, F.expr(let(w, "ws", f"CASE WHEN size(ws) >= {n} THEN transform(sequence(0, size(ws) - {n}), i -> xxhash64({parts})) WHEN size(ws) > 0 THEN array(xxhash64(array_join(ws, ' '))) ELSE array() END")))
    # One sentinel for each bin, greater than any hash of the bin, makes the first of each bin its minimum.
    rows = rows.withColumn(s, F.expr(f"CASE WHEN size({h}) > 0 THEN sort_array(concat({h}, transform(sequence({-bins // 2}, {bins // 2 - 1}), b -> shiftleft(cast(b as bigint), {shift}) + {(1 << shift) - 1}))) END"))
    rows = rows.withColumn(m, F.expr(let(s, "hs", f"filter(hs, (x, i) -> i = 0 OR shiftright(x, {shift}) <> shiftright(hs[i - 1], {shift}))")))
    rows = rows.withColumn(v, F.expr(f"transform({m}, x -> CASE WHEN (x & {(1 << shift) - 1}) <> {(1 << shift) - 1} THEN cast(x & {(1 << STORED_BITS) - 1} as int) END)"))
    rows = rows.withColumn(f, F.when(F.exists(v, lambda x: x.isNull()), _first_on_tour(v, bins)).otherwise(F.col(v)))
    packed = F.array_join(F.transform(f, lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")
    return rows.withColumn(to, F.coalesce(packed, F.lit("00" * bins))).drop(w, h, s, m, v, f)


def likeness(a: Column, b: Column, bin_bits: int = BIN_BITS) -> Column:
    """The estimated Jaccard likeness of two fingerprints, 0 to 1; null with a null one."""
    bins, chance = 1 << bin_bits, 2.0**-STORED_BITS
    none = F.lit("00" * bins)
    pairs = F.zip_with(F.regexp_extract_all(a, F.lit("(..)"), F.lit(1)), F.regexp_extract_all(b, F.lit("(..)"), F.lit(1)), lambda x, y: x == y)
    share = F.size(F.filter(pairs, lambda x: x)) / F.lit(float(bins))
    estimate = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (share - chance) / (1 - chance)))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(a == b, 1.0).when((a == none) | (b == none), 0.0).otherwise(estimate)


def _cuts(places: DataFrame, blocks: int) -> list[tuple]:
    """The least place of each block, rising; there are at most ``blocks``."""
    if blocks < 2:
        return [tuple(r[0]) for r in places.agg(F.min("place")).collect() if r[0] is not None]
    dealt = places.repartitionByRange(blocks, "place").withColumn("block", F.spark_partition_id())
    return sorted(tuple(r["place"]) for r in dealt.groupBy("block").agg(F.min("place").alias("place")).collect())


def _block_of(place: str, cuts: list[tuple]) -> Column:
    """How many cuts are not above the place, less one, found by halving."""
    listed = json.dumps([{"known": bool(k), "at": at, "hash": h} for k, at, h in cuts])
    steps = max(1, len(cuts).bit_length())
    half = "cast((s.lo + s.hi) div 2 as int)"
    table = f"from_json('{listed}', 'array<struct<known: boolean, at: bigint, hash: bigint>>')"
    narrowed = f"CASE WHEN s.lo >= s.hi THEN s WHEN get(cuts, {half}) <= {place} THEN named_struct('lo', {half} + 1, 'hi', s.hi) ELSE named_struct('lo', s.lo, 'hi', {half}) END"
    return F.expr(f"transform(array({table}), cuts -> aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', {len(cuts)}), (s, i) -> {narrowed}, s -> s.lo))[0] - 1")


def with_next(docs: DataFrame, make: Callable[[DataFrame], DataFrame], columns: list[str], order: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, prefix: str = "next_") -> DataFrame:
    """``make(docs)``, which adds columns row by row, with each of ``columns`` of the next row in descending ``order``.

    A null ``order`` goes last, equal ones by a hash of the text; the last row's next is the first.  Rows are
    dealt once, as they are, into blocks of neighbouring places, of about ``block_bytes`` of text, and ``make`` runs after that;
    a window looks ahead inside a block.  A block's last row is followed by the first one of the block below it;
    these first rows, one for each block, are made apart.
    """
    place, block, ahead, head = unused(docs, "_place", "_block", "_next", "_head")
    key = F.struct(F.col(order).isNotNull().alias("known"), F.coalesce(F.col(order), F.lit(0)).cast("long").alias("at"), F.xxhash64(text).alias("hash"))
    placed = docs.withColumn(place, key)
    blocks = int((docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // block_bytes) + 1
    cuts = _cuts(placed.select(F.col(place).alias("place")), blocks)
    dealt = placed.withColumn(block, _block_of(place, cuts))
    first = dealt.groupBy(block).agg(F.max(place).alias(place))
    # One row of four numbers for each block.
    heads = dealt.join(F.broadcast(first) if len(cuts) <= BROADCAST_BLOCKS else first, [block, place], "left_semi").dropDuplicates([block])
    made_heads = checkpoint(make(heads.select(*docs.columns, block)).select(((F.col(block) + 1) % max(1, len(cuts))).alias(block), F.struct(*columns).alias(head)))
    parts = max(len(cuts), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = make(dealt.repartition(parts, block))
    down = Window.partitionBy(block).orderBy(F.col(place).desc())
    rows = rows.withColumn(ahead, F.lead(F.struct(*columns)).over(down)).join(made_heads, block, "left")
    follows = F.coalesce(F.col(ahead), F.col(head))
    return rows.withColumns({prefix + c: follows[c] for c in columns}).drop(place, block, ahead, head)


def edited_text(text: Column, following: Column) -> Column:
    """The text with its last third replaced by as many first characters of the following text."""
    third = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - third), F.substring(following, F.lit(1), third))
