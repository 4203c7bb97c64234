"""Grouping spelling variants: an even-partition pigeonhole join of words that are one edit apart.

A word that the index holds is cut into two even segments, whose bounds follow from its length; one edit leaves one
of the two as it is.  So a word meets its near words of the same length and of one letter less where it has
one of their segments: before the edit in the same place, behind an inserted letter one place further.  Where
more words share a segment than ``BUCKET``, the other half, which holds the edit, is cut evenly again, and so
on down to one letter, so that no group of words pairs with itself; what remains in a bucket then is
bounded by the alphabet.  Pairs found twice count once and are verified by their edit distance.

Words are counted by the tasks that read the texts, per batch and with memory for ``HELD`` words, and summed by Spark,
so frequent words and hot sources are summed before they are shuffled.  Cases: null and empty texts have no words; very
long texts and words are taken whole; the same id and text twice count twice; other columns are not read; an
empty table gives no words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reachbase.llm.checkpoints import checkpoint
from reachbase.llm.words import LOWER, UPPER

#: Different words that a task counts before it passes their counts on.
HELD = 200_000
#: Index entries times probes that a bucket pairs directly.
BUCKET = 1024
#: A run of letters: ASCII and Latin-1 from U+00C0.
LETTERS = "[A-Za-zÀ-ÿ]+"
_LOWER = str.maketrans(UPPER, LOWER)
SHORTEST, LEAST, FACTOR, EDITED = 5, 3, 2, 97


def counts(docs: DataFrame, one_in: int | None = EDITED) -> DataFrame:
    """(word, n) of all runs of letters, A-Z lower-cased.

    With ``one_in``, a word lacks one of its letters in one of so many pairs of document and word, by their
    checksum: misspellings planted for tests.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, total = re.compile(LETTERS), Counter()

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = Counter(runs.findall(text.translate(_LOWER))) if text else {}
                if one_in is None:
                    total.update(own)
                else:
                    begun = crc32(f"{doc_id}:".encode())
                    for word, n in own.items():
                        h = crc32(word.encode(), begun)
                        if h % one_in == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1 :]
                        total[word] += n
                if len(total) >= HELD:
                    yield passed()
                    total.clear()
        if total:
            yield passed()

    partial = docs.select("doc_id", "text").mapInArrow(counted, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def _probes(words: DataFrame) -> DataFrame:
    """Each word as index entry (role 0), as probe of its own length (1) and of one letter less (2), whole: a to b is unknown."""
    size = F.char_length("word")
    return words.select("word", F.explode(F.array(*(F.lit(r) for r in range(3)))).alias("role"), size.alias("size")).select(
        "word", "role", F.when(F.col("role") == 2, F.col("size") - 1).otherwise(F.col("size")).alias("size")
    ).select("word", "role", "size", F.lit(0).alias("a"), F.col("size").alias("b"))


def _cut(rows: DataFrame) -> DataFrame:
    """Both halves of the unknown part a to b, with the key that a word and a probe have in common if the edit is in that half."""
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    halves = F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b").alias("b")))
    rows = rows.select("word", "role", "size", F.explode(halves).alias("half")).select("word", "role", "size", "half.a", "half.b")
    longer = F.when(F.col("role") == 2, 1).otherwise(0)
    known = F.concat(F.substring(F.col("word"), F.lit(1), F.col("a")), F.lit("\0"), F.substring(F.col("word"), F.col("b") + longer + 1, F.col("size")))
    return rows.where("a < b").withColumn("key", known)


def near_pairs(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b) for every two words of the column ``word`` (distinct, no nulls) that one inserted, deleted or replaced letter parts, once."""
    spot, found = ["size", "a", "b", "key"], []
    rows = _cut(_probes(words.select("word")))
    while True:
        rows = checkpoint(rows)
        held = rows.groupBy(*spot).agg(F.count_if(F.expr("role = 0")).alias("n_index"), F.count_if(F.expr("role > 0")).alias("n_probe"), F.count_if(F.expr("role = 2")).alias("n_longer"))
        # alone in a bucket, or only with itself: nothing to pair
        held = held.where("n_index > 0 and n_probe > 0 and (n_index > 1 or n_longer > 0)").withColumn("ready", (F.col("n_index") * F.col("n_probe") <= bucket) | (F.col("b") - F.col("a") <= 1))
        met = rows.join(held.select(*spot, "ready"), spot)
        index = met.where("ready and role = 0").select(*spot, F.col("word").alias("x"))
        probe = met.where("ready and role > 0").select(*spot, F.col("word").alias("y"), "role")
        pairs = index.join(probe, spot).where("role = 2 or x < y").select("x", "y")
        found.append(checkpoint(pairs.where(F.levenshtein("x", "y", 1) == 1).distinct()))
        rows = checkpoint(met.where(~F.col("ready")).select("word", "role", "size", "a", "b"))
        if rows.isEmpty():
            break
        rows = _cut(rows.distinct())
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct().select(F.col("x").alias("a"), F.col("y").alias("b"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root) by doubling: each round follows twice as many forms; forms never lead back."""
    step = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = checkpoint(step.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        step = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return step


def variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, factor: int = FACTOR, one_in: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n: each word of enough letters and occurrences, and the usual form that it varies.

    The form is the near word that occurs most (of equals the first in code-point order), if it occurs
    ``factor`` times as often as the word; the root is where forms lead in the end.
    """
    words = checkpoint(counts(docs, one_in).where((F.char_length("word") >= shortest) & (F.col("n") >= least)))
    pairs = near_pairs(words)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("word").alias("b"), F.col("n").alias("m"))
    best = both.join(other, "b").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("b"))).alias("first"))
    best = best.select("word", "n_near", F.col("first.b").alias("form"), (-F.col("first.less")).alias("form_n"))
    joined = words.join(best, "word", "left")
    usual = F.coalesce(F.col("form_n") >= factor * F.col("n"), F.lit(False))
    rows = checkpoint(joined.select("word", F.when(usual, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(usual, F.col("form_n")).alias("form_n")))
    end = roots(rows.where("form is not null"))
    return rows.join(end, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: Near words meet where they agree once one letter is left out: at the same place in both, or in the longer one alone.
ORACLE_SQL = f"""
with recursive crc_table as materialized (
  select list_transform(range(256), lambda c: list_reduce(list_prepend(c, range(8)), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) as t
), runs as materialized (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{UPPER}', '{LOWER}') as run from documents
), grouped as materialized (
  select doc_id, run, count(*) as k from runs group by doc_id, run
), bytes as materialized (
  select doc_id, run, k, list_transform(range(1, (octet_length(b) + 1)::bigint), lambda i: ('0x' || substr(hex(b), 2 * i - 1, 2))::bigint) as list
  from (select *, encode(coalesce(doc_id::varchar, 'None') || ':' || run) as b from grouped)
), hashed as materialized (
  select run, k, xor(list_reduce(list_prepend(4294967295::bigint, list), lambda x, y: xor(x >> 8, t[1 + (xor(x, y) & 255)])), 4294967295) as h
  from bytes, crc_table
), counted as materialized (
  select case when h % {EDITED} = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, sum(k)::bigint as n
  from hashed group by 1
), words as materialized (
  select word, n from counted where length(word) >= {SHORTEST} and n >= {LEAST}
), left_out as materialized (
  select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, unnest(range(1, length(word) + 1)) as i from words)
), near as materialized (
  select a.word as a, b.word as b from left_out a join left_out b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select w.word, x.word from left_out x join words w on w.word = x.rest
  union select x.word, w.word from left_out x join words w on w.word = x.rest
), best as materialized (
  select a as word, count(*) as n_near, first(b order by w.n desc, b) as form, max(w.n) as form_n from near join words w on w.word = b group by a
), rows_ as materialized (
  select w.word, case when form_n >= {FACTOR} * w.n then form end as form, w.n, coalesce(n_near, 0) as n_near, case when form_n >= {FACTOR} * w.n then form_n end as form_n
  from words w left join best using (word)
), walk as (
  select word, word as root from rows_
  union all select walk.word, r.form from walk join rows_ r on r.word = walk.root where r.form is not null
), ends as materialized (
  select walk.word, walk.root from walk join rows_ r on r.word = walk.root where r.form is null
)
select word, form, root, n, n_near, form_n from rows_ join ends using (word)
"""
