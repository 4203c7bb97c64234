"""N-gram Jaccard join with a token-group matrix.

A document's set holds the distinct shingles of five words.  Documents with equal sets form one class
and the classes are joined exactly, in these steps:

1. Shingle hashes are dealt by value in packed blocks; each block counts how many owners a token has,
   and tokens of two or more go back to their owners.  Tokens of one owner alone only count: they can't
   be shared.
2. A class keeps its rarest tokens as prefix: two classes that link must share one of these.  A class
   whose prefix holds no shared token has no link and is done.
3. Classes are partitioned into groups of similar ones: each is compared with the leader of those that
   share a least hash, under three hash functions, and verified links are closed into groups.  Where
   many groups still share a least hash, their classes meet several new leaders, again and again while
   that joins a share of them.  Groups of many classes are cut into units of bounded size.
4. The token-group matrix says for each prefix token in which units it stands, and how many tokens of
   a class follow it at most.  Units of different groups that share a token, may be of like size and
   have tokens enough from there on are bounded by the overlap of their token unions; only pairs of
   units that could hold a link are opened, and their classes compared until one links, which joins
   the two groups.
5. Links close the groups into components.

No step needs all pairs of a group: inside a group links are found through leaders, which is enough for
its component.  Tokens keep 40 bits beside their block's number, a class is named by 64 bits.

Cases: null and empty texts and texts without words have no set and link with nothing; with fewer words
than a shingle the whole sequence is the one shingle; repeated rows share a class; rows with one doc_id
are one document if their texts are equal and are each judged by their own text otherwise; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reachbase.llm import wordhash
from reachbase.llm.checkpoints import checkpoint, stored
from reachbase.llm.components import components

SHINGLE = 5
PERCENT = 75
#: Bytes of text whose shingles one block counts; classes in a unit.
BLOCK_BYTES = 8 << 20
UNIT = 16
#: Pairs of units that one task compares.
PAIRS = 2_000
#: New leaders of a least hash that more than UNIT groups share, and the share of groups that a round must join to be repeated.
LEADERS = 4
JOINED = 0.05
_LOW = np.uint64((1 << 40) - 1)


def _sets(w: wordhash.Words) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each row of a chunk, sorted."""
    grams = wordhash.grams(w.hash, SHINGLE)
    for lo, hi in zip(w.bounds[:-1], w.bounds[1:], strict=True):
        if hi - lo >= SHINGLE:
            yield np.unique(grams[lo : hi - SHINGLE + 1])
        elif hi > lo:
            yield wordhash.grams(w.hash[lo:hi], int(hi - lo))
        else:
            yield np.zeros(0, np.uint64)


def _class(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(wordhash.mix(wordhash.mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(keepdims=True) + np.uint64(len(tokens))).view(np.int64)[0])


@F.arrow_udf(T.StructType([T.StructField("cls", T.LongType()), T.StructField("n", T.IntegerType())]))
def _members(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in batches:
        cls, n = np.zeros(len(column), np.int64), np.zeros(len(column), np.int32)
        for w in wordhash.words(column, fold=True):
            for i, tokens in enumerate(_sets(w)):
                if len(tokens):
                    cls[w.first + i], n[w.first + i] = _class(tokens), len(tokens)
        yield pa.StructArray.from_arrays([pa.array(cls), pa.array(n)], ["cls", "n"])


_PACKED = "block long, chunk long, owners binary, counts binary, tokens binary, classes binary"
_SENT = "chunk long, block long, owners binary, counts binary, tokens binary, df binary, classes binary"
_PACKED_TYPES = (pa.int64(), pa.int64(), *[pa.binary()] * 4)
_SENT_TYPES = (pa.int64(), pa.int64(), *[pa.binary()] * 5)


def _rows(rows: list[tuple], names: str, kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [n.split()[0] for n in names.split(", ")])


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted values: each once, and how often."""
    head = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return values[head], np.diff(np.r_[head, len(values)])


def _five(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _wide(five: np.ndarray) -> np.ndarray:
    out = np.zeros((len(five) // 5, 8), np.uint8)
    out[:, :5] = five.reshape(-1, 5)
    return out.view(np.int64)[:, 0]


def _packed(docs: DataFrame, bits: int) -> DataFrame:
    """For each chunk of documents and block of tokens: owners (numbers in the chunk), their counts, tokens in five bytes.

    One more row for each chunk, under a negative block, names the chunk's classes and their sizes.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in wordhash.words(batch.column(0), fold=True):
                # Chunks of the same classes have one name, so they must number their owners alike.
                sets = dict(sorted({_class(s): s for s in _sets(w) if len(s)}.items()))
                if not sets:
                    continue
                names, sizes = np.fromiter(sets, np.int64, len(sets)), np.array([len(s) for s in sets.values()], np.int64)
                chunk = _class(names.view(np.uint64))
                tokens = np.concatenate(list(sets.values()))
                owner = np.repeat(np.arange(len(sets)), sizes)
                block = (tokens >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(tokens), np.int64)
                order = np.argsort(block, kind="stable")
                block, tokens, owner = block[order], tokens[order] & _LOW, owner[order]
                out: list[tuple] = [(-1 - chunk % (1 << max(bits, 4)), chunk, None, None, None, np.r_[names, sizes].tobytes())]
                edges = np.flatnonzero(np.diff(block)) + 1
                for at, part, who in zip(block[np.r_[0, edges]], np.split(tokens, edges), np.split(owner, edges), strict=True):
                    here, counts = _runs(who)
                    out.append((int(at), chunk, here.astype(np.uint32).tobytes(), counts.astype(np.uint32).tobytes(), _five(part), None))
                yield _rows(out, _PACKED, _PACKED_TYPES)

    return docs.mapInArrow(pack, _PACKED)


def _join(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _shared(table: pa.Table) -> pa.Table:
    """For one block: tokens with two owners or more, packed again by the chunk that holds them."""
    block = table["block"][0].as_py()
    if block < 0:
        none = pa.nulls(len(table), pa.binary())
        return pa.Table.from_arrays([table["chunk"], table["block"], none, none, none, none, table["classes"]], names=[n.split()[0] for n in _SENT.split(", ")])
    chunk, number = np.unique(table["chunk"].to_numpy(), return_inverse=True)
    counts = _join(table["counts"], np.uint32)
    owner = np.concatenate([np.repeat((k << 32) | o.astype(np.int64), c) for k, o, c in zip(number, _join(table["owners"], np.uint32), counts, strict=True)])
    tokens = _wide(np.concatenate(_join(table["tokens"], np.uint8)))
    order = np.lexsort((owner, tokens))
    tokens, owner = tokens[order], owner[order]
    new = np.r_[True, (np.diff(tokens) != 0) | (np.diff(owner) != 0)]
    tokens, owner = tokens[new], owner[new]
    _, df = _runs(tokens)
    df = np.repeat(df, df)
    keep = df >= 2
    tokens, owner, df = tokens[keep], owner[keep], np.minimum(df[keep], 255).astype(np.uint8)
    order = np.argsort(owner, kind="stable")
    tokens, owner, df = tokens[order], owner[order], df[order]
    home = owner >> 32
    edges = np.flatnonzero(np.diff(home)) + 1
    out = []
    for k, t, o, d in zip(home[np.r_[0, edges]] if len(home) else [], np.split(tokens, edges), np.split(owner & 0xFFFFFFFF, edges), np.split(df, edges), strict=False):
        here, runs = _runs(o)
        out.append((int(chunk[k]), block, here.astype(np.uint32).tobytes(), runs.astype(np.uint32).tobytes(), _five(t), d.tobytes(), None))
    return pa.Table.from_batches([_rows(out, _SENT, _SENT_TYPES)])


def _least(tokens: np.ndarray) -> list[int]:
    """The least hash of the tokens under three functions."""
    return [int(wordhash.mix(tokens.view(np.uint64) + np.uint64(seed)).min().view(np.int64)) for seed in (1, 2, 3)]


def _assemble(table: pa.Table) -> pa.Table:
    """For the classes of one chunk: n, all shared tokens (sorted), and the shared ones among the prefix."""
    named = [c for c in table["classes"] if c.is_valid]
    names, sizes = np.frombuffer(named[0].as_buffer(), np.int64).reshape(2, -1)
    table = table.filter(pc.is_valid(table["tokens"]))
    parts = []
    for owners, counts, five, df, block in zip(_join(table["owners"], np.uint32), _join(table["counts"], np.uint32), _join(table["tokens"], np.uint8), _join(table["df"], np.uint8), table["block"].to_pylist(), strict=True):
        parts.append((np.repeat(owners.astype(np.int64), counts), _wide(five) | (block << 40), df))
    rows = []
    if parts:
        owner, token, df = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((token, df, owner))
        owner, token = owner[order], token[order]
        edges = np.r_[0, np.flatnonzero(np.diff(owner)) + 1, len(owner)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            n = int(sizes[owner[lo]])
            prefix = n - -(-PERCENT * n // 100) + 1 - (n - (hi - lo))
            if prefix > 0:
                own = token[lo:hi]
                rows.append((int(names[owner[lo]]), n, np.sort(own).tobytes(), own[:prefix].tolist(), _least(own)))
    return pa.Table.from_batches([_rows(rows, "cls, n, tokens, prefix, least", (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())))])


def _tokens(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.int64)


@F.arrow_udf(T.BooleanType())
def _linked(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b, na, nb in batches:
        out = []
        for x, y, n, m in zip(a, b, na.to_pylist(), nb.to_pylist(), strict=True):
            both = len(np.intersect1d(_tokens(x), _tokens(y), assume_unique=True))
            out.append(100 * both >= PERCENT * (n + m - both))
        yield pa.array(out, pa.bool_())


def _opens(a: list[np.ndarray], na: list[int], b: list[np.ndarray], nb: list[int]) -> bool:
    """Whether two units hold a link; they are opened only if their unions overlap enough for one."""
    if len(a) > 1 or len(b) > 1:
        both = len(np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True))
        if 100 * both < PERCENT * max(min(na), min(nb)):
            return False
    for x, n in zip(a, na, strict=True):
        for y, m in zip(b, nb, strict=True):
            if 100 * min(n, m, len(x), len(y)) >= PERCENT * max(n, m):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= PERCENT * (n + m - both):
                    return True
    return False


@F.arrow_udf(T.BooleanType())
def _units_link(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, na, b, nb in batches:
        yield pa.array([_opens([_tokens(t) for t in x], n.as_py(), [_tokens(t) for t in y], m.as_py()) for x, n, y, m in zip(a, na, b, nb, strict=True)], pa.bool_())


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs of classes (a, b), those that link."""
    side = lambda x: sets.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")
    return both.where(_linked("t_a", "t_b", "n_a", "n_b")).select("a", "b")


def _grouped(sets: DataFrame, near: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All verified links, and the classes with the root of their group.

    Leaders come out of partial aggregates, so a least hash that a third of all classes share is spread
    over the cluster, and each round compares a class with a fixed number of leaders.
    """
    turn = 0
    while True:
        roots = components(links).withColumnRenamed("node", "cls")
        rooted = lambda rows: rows.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))  # noqa: E731, B023
        live = rooted(near)
        drawn = [F.min(F.struct(F.xxhash64(F.lit(LEADERS * turn + i), "round", "cls"), "cls", "root", "n")) for i in range(LEADERS)]
        crowded = live.groupBy("round", "hash", "root").agg(*[d.alias(f"l{i}") for i, d in enumerate(drawn)]).groupBy("round", "hash")
        crowded = crowded.agg(F.count("*").alias("groups"), *[F.min(f"l{i}").alias(f"l{i}") for i in range(LEADERS)]).where(f"groups > {UNIT}")
        crowded = checkpoint(crowded.select("round", "hash", F.explode(F.array_distinct(F.array(*[F.struct(f"l{i}.cls", f"l{i}.root", f"l{i}.n") for i in range(LEADERS)]))).alias("leader")))
        if crowded.isEmpty():
            return links, rooted(sets)
        met = live.join(crowded, ["round", "hash"]).where(f"root <> leader.root AND 100 * least(n, leader.n) >= {PERCENT} * greatest(n, leader.n)")
        pairs = checkpoint(met.select(F.least("cls", "leader.cls").alias("a"), F.greatest("cls", "leader.cls").alias("b"), "root").distinct())
        new = checkpoint(_verified(pairs.select("a", "b").distinct(), sets))
        before = pairs.agg(F.count_distinct("root")).first()[0]
        links = checkpoint(links.unionByName(new))
        joined = new.select("a").union(new.select("b")).distinct().withColumnRenamed("a", "cls")
        gone = rooted(joined).agg(F.count_distinct("root")).first()[0]
        turn += 1
        if gone <= JOINED * before:
            roots = components(links).withColumnRenamed("node", "cls")
            return links, rooted(sets)


def classed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with cls, the class of each row, and n_shingles; a row without a set has 0 of these."""
    return docs.withColumn("_m", _members(F.col(text))).withColumns({"cls": F.col("_m.cls"), "n_shingles": F.col("_m.n").cast("long")}).drop("_m")


def link(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_shingles, cls (the class), digest (SHA-256 of the text), root (a class that names the component) and component_id for every row of ``docs``.

    Components of rows without an id, or with different texts under one, may share a component_id but never a root.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(size // BLOCK_BYTES)).bit_length()
    members = checkpoint(classed(docs).select("doc_id", "cls", "n_shingles", F.sha2("text", 256).alias("digest")))
    shared = _packed(docs.select("text"), bits).groupBy("block").applyInArrow(_shared, _SENT)
    held = shared.groupBy("chunk").applyInArrow(_assemble, "cls long, n int, tokens binary, prefix array<long>, least array<long>")
    sets = stored(held.dropDuplicates(["cls"]))

    near = sets.select("cls", "n", F.posexplode("least").alias("round", "hash"))
    led = near.groupBy("round", "hash").agg(F.min("cls").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = near.join(led, ["round", "hash"]).where("cls <> a").select("a", F.col("cls").alias("b")).distinct()
    inside, grouped = _grouped(sets, near, checkpoint(_verified(stars, sets)))
    count = grouped.groupBy("root").agg(F.count("*").alias("classes")).where(f"classes > {UNIT}")
    unit = F.when(F.col("classes").isNull(), F.col("root")).otherwise(F.xxhash64("root", F.pmod("cls", F.ceil(F.col("classes") / UNIT))))
    units = stored(grouped.join(count, "root", "left").select("cls", "n", "tokens", "prefix", "root", unit.alias("unit")))

    # Tokens stand in one order everywhere, so a pair's first common token bounds its overlap by what follows.
    matrix = units.select("unit", "root", "n", (F.octet_length("tokens") / 8).cast("int").alias("shared"), F.posexplode("prefix").alias("pos", "token"))
    matrix = matrix.groupBy("token", "unit", "root").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("shared") - F.col("pos")).alias("rest"))
    several = matrix.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token")
    matrix = stored(matrix.join(several, "token", "left_semi"))
    left, right = (matrix.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("unit", "root", "lo", "hi", "rest")]) for s in "ab")
    like = F.expr(f"root_a < root_b AND 100 * hi_a >= {PERCENT} * lo_b AND 100 * hi_b >= {PERCENT} * lo_a AND {100 + PERCENT} * least(rest_a, rest_b) >= {PERCENT} * (lo_a + lo_b)")
    met = checkpoint(left.join(right, "token").where(like).select("unit_a", "unit_b").distinct())
    wanted = met.select(F.col("unit_a").alias("unit")).union(met.select("unit_b")).distinct()
    opened = units.join(wanted, "unit", "left_semi").groupBy("unit", "root").agg(F.collect_list(F.struct("tokens", "n")).alias("c")).select("unit", "root", "c.tokens", "c.n")
    at = lambda s: opened.select(*[F.col(c).alias(f"{c}_{s}") for c in ("unit", "root", "tokens", "n")])
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), met.count() // PAIRS)
    both = met.join(at("a"), "unit_a").join(at("b"), "unit_b").repartition(parts, "unit_a", "unit_b")
    across = both.where(_units_link("tokens_a", "n_a", "tokens_b", "n_b")).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))

    roots = components(inside.unionByName(across)).withColumnRenamed("node", "cls")
    rooted = members.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = rooted.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = rooted.join(least, "root", "left")
    return out.select(F.col("doc_id").alias(key), "n_shingles", "cls", "digest", "root", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
