"""Quality rules: a learned decision list over text statistics.

The statistics are Spark expressions over one row, so nothing is shuffled for them.  A bounded sample
of labelled rows is brought to the driver; sequential covering grows conjunctions of thresholds on two
thirds of it, prunes each on the rest, and removes what a rule covers before the next is grown.  The
list becomes one chain of conditional expressions that Spark applies to every row.

Cases: null and empty texts have no words and fail the base test; a text shorter than three words has
no window; repeated rows are judged alike; an empty table gives no rows; without usable labels the list
is empty and only the base test decides.  Other input columns pass through unless a result has that name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachbase.llm.words import SPACE_CHARS, UPPER, let, unused, whole, words

SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "bang_share", "distinct_share", "words_per_line")


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base statistics and the features that rules may test.

    Windows of three words are sorted by hash, position and words inside the row; neighbours of one hash
    and the same words mark the windows that stand twice, and the union of their words is counted.
    """
    kept = docs.drop(*STATS, *FEATURES)
    t, w, l, h, s, p, u, b, d, n = unused(kept, *(f"_{c}" for c in "twlhspubdn"))
    rows = kept.withColumns({t: whole(F.col(text)), w: words(F.col(text))})
    rows = rows.withColumn(l, F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != ""))
    rows = rows.withColumn(h, F.expr(let(w, "ws", "CASE WHEN size(ws) >= 3 THEN transform(sequence(0, size(ws) - 3), i -> xxhash64(ws[i], ws[i + 1], ws[i + 2])) ELSE array() END")))
    # Sorted by hash; of one hash by words, so equal windows are neighbours whatever hashes they share.
    entries = let(w, "ws", f"transform({h}, (x, i) -> named_struct('h', x, 'w', array(ws[i], ws[i + 1], ws[i + 2]), 'at', i))")
    rows = rows.withColumn(s, F.expr(f"CASE WHEN size(array_distinct({h})) < size({h}) THEN array_sort({entries}) END"))
    same = lambda k: f"(get(es, {k}).h = x.h AND get(es, {k}).w = x.w)"
    rows = rows.withColumn(p, F.expr(let(s, "es", f"sort_array(transform(filter(es, (x, i) -> (i > 0 AND {same('i - 1')}) OR (i + 1 < size(es) AND {same('i + 1')})), x -> x.at))")))
    covered = F.expr(f"coalesce(aggregate({p}, named_struct('n', 0, 'last', -3), (a, p) -> named_struct('n', a.n + least(3, p - a.last), 'last', p), a -> a.n), 0)")
    rows = rows.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.char_length(F.translate(t, SPACE_CHARS, "")).cast("long"),
            "n_symbols": (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size(l) - F.size(F.array_distinct(l))).cast("long"),
            "n_repeat_words": covered.cast("long"),
            u: F.char_length(t) - F.char_length(F.translate(t, UPPER, "")),
            b: F.char_length(t) - F.char_length(F.translate(t, "!", "")),
            d: F.size(F.array_distinct(w)),
            n: F.size(l),
        }
    )
    per = lambda x, y: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(y)), F.lit(0.0))
    return rows.withColumns(
        {
            "chars_per_word": per("word_chars", "n_words"),
            "symbols_per_word": per("n_symbols", "n_words"),
            "dup_line_share": per("n_dup_lines", n),
            "repeat_share": per("n_repeat_words", "n_words"),
            "upper_share": per(u, "word_chars"),
            "bang_share": per(b, "n_words"),
            "distinct_share": per(d, "n_words"),
            "words_per_line": per("n_words", n),
        }
    ).drop(t, w, l, h, s, p, u, b, d, n)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.threshold) if self.above else F.col(self.feature) <= F.lit(self.threshold)

    def mask(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.feature] > self.threshold if self.above else table[self.feature] <= self.threshold


@dataclass(frozen=True)
class Rule:
    """Rows that pass every test are rejected."""

    tests: tuple[Test, ...]

    def column(self) -> Column:
        out = self.tests[0].column()
        for test in self.tests[1:]:
            out = out & test.column()
        return out

    def mask(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([t.mask(table) for t in self.tests])

    def __str__(self) -> str:
        return " and ".join(f"{t.feature} {'>' if t.above else '<='} {t.threshold:.4g}" for t in self.tests)


def _best_test(table: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray, cuts: dict[str, np.ndarray]) -> tuple[float, Test | None]:
    """The test with the largest FOIL gain for the rows inside."""
    p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
    best: tuple[float, Test | None] = (1e-9, None)
    for name, edges in cuts.items():
        at = np.searchsorted(edges, table[name][inside], side="left")
        p = np.bincount(at[bad[inside]], minlength=len(edges) + 1)
        n = np.bincount(at[~bad[inside]], minlength=len(edges) + 1)
        low_p, low_n = p.cumsum()[:-1], n.cumsum()[:-1]
        for above, pp, nn in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
            gain = np.where(pp > 0, pp * (np.log2(np.maximum(pp, 1e-9) / np.maximum(pp + nn, 1)) - np.log2(p0 / (p0 + n0))), -1)
            k = int(gain.argmax()) if len(gain) else -1
            if k >= 0 and gain[k] > best[0]:
                best = (float(gain[k]), Test(name, above, float(edges[k])))
    return best


def learn_rules(table: dict[str, np.ndarray], bad: np.ndarray, least_precision: float = 0.95, least_cover: int = 3, most_rules: int = 16, most_tests: int = 4, bins: int = 64, seed: int = 7) -> list[Rule]:
    """Sequential covering: grow on two thirds, prune on a third, accept while the pruned rule stays precise."""
    rules: list[Rule] = []
    if not bad.any() or bad.all():
        return rules
    part = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    cuts = {k: np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[:-1])) for k, v in table.items()}
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules and (bad & left & part).any():
        tests: list[Test] = []
        inside = left & part
        while len(tests) < most_tests and (~bad & inside).any():
            _, test = _best_test(table, bad, inside, cuts)
            if test is None:
                break
            tests.append(test)
            inside &= test.mask(table)
        if not tests:
            break

        def worth(k: int, tests: list[Test] = tests) -> tuple[float, int]:
            hit = Rule(tuple(tests[:k])).mask(table) & left & ~part
            p, n = int((bad & hit).sum()), int((~bad & hit).sum())
            return ((p - n) / max(1, p + n), p)

        rule = Rule(tuple(tests[: max(range(1, len(tests) + 1), key=lambda k: (worth(k), -k))]))
        hit = rule.mask(table) & left
        if (bad & hit).sum() < least_cover or (bad & hit).sum() < least_precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, label_rows: int = 20_000, key: str = "doc_id") -> list[Rule]:
    """Learns from at most ``label_rows`` labelled rows, chosen by the hash of their key."""
    known = labels.where("quality IS NOT NULL").groupBy(key).agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64(key), key).limit(label_rows)
    chosen_docs = docs.select(key, "text").join(F.broadcast(chosen), key)
    rows = with_stats(chosen_docs).select("quality", base_failed().alias("failed"), *FEATURES).collect()
    rows = [r for r in rows if not r["failed"]]
    if not rows:
        return []
    table = {k: np.array([r[k] for r in rows], float) for k in FEATURES}
    return learn_rules(table, np.array([r["quality"] == 0 for r in rows]))


def apply_rules(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed, rule_no (the first rule that rejects the row, else null) and kept."""
    first = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        first = F.when(rule.column(), F.lit(i)).otherwise(first)
    out = stats.drop("base_failed", "rule_no", "kept").withColumn("base_failed", base_failed())
    return out.withColumn("rule_no", F.when(~F.col("base_failed"), first)).withColumn("kept", ~F.col("base_failed") & F.col("rule_no").isNull())
