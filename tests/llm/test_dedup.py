import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reachbase.llm import jaccard_join, recompression, repeats, suffix_dedup
from tests.llm.fixture import documents, frame


def brute(units, width):
    seen, marks = set(), []
    for u in units:
        mark = [False] * len(u)
        for s in range(len(u) - width + 1):
            w = tuple(u[s : s + width])
            if w in seen:
                mark[s : s + width] = [True] * width
            seen.add(w)
        marks.append(mark)
    return marks


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def test_suffix_dedup_equals_brute_force(spark):
    rows = documents()
    got = {r["doc_id"]: r for r in suffix_dedup.dedup(frame(spark)).collect()}
    data = [(t or "").encode() for _, t, _ in rows]
    for (i, _, _), u, mark in zip(rows, data, brute(data, 100), strict=True):
        assert bytes(got[i]["kept"]) == bytes(b for b, m in zip(u, mark, strict=True) if not m)
        assert got[i]["n_removed"] == sum(mark) and got[i]["n_bytes"] == len(u)
        assert got[i]["n_spans"] == sum(m and not (k and mark[k - 1]) for k, m in enumerate(mark))


def test_recompression_equals_brute_force(spark):
    rows = documents()
    got = {r["doc_id"]: r for r in recompression.dedup(frame(spark)).collect()}
    data = [words(t) for _, t, _ in rows]
    for (i, _, _), u, mark in zip(rows, data, brute(data, 20), strict=True):
        assert got[i]["kept"] == " ".join(w for w, m in zip(u, mark, strict=True) if not m)
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(u), sum(mark))


def anchored(operator, u, width):
    if operator is suffix_dedup:
        return suffix_dedup.ByteScheme(width=width, gram=4).anchors(u)
    return recompression.anchors(recompression.levels_of(u, 3), np.arange(len(u) - width + 1), width)


@pytest.mark.parametrize("operator", [suffix_dedup, recompression])
@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 4))
def test_equal_windows_have_equal_anchors(operator, seed, letters):
    draw, width = random.Random(seed), 12
    dtype = np.uint8 if operator is suffix_dedup else np.uint64
    where = {}
    for _ in range(3):
        u = np.array([draw.randrange(letters) for _ in range(draw.randrange(width, 80))], dtype)
        anchor, key = anchored(operator, u, width)
        for s in range(len(u) - width + 1):
            assert s <= anchor[s] < s + width
            w = u[s : s + width].tobytes()
            assert where.setdefault(w, (anchor[s] - s, key[s])) == (anchor[s] - s, key[s])


@pytest.mark.parametrize("bits", [64, 4])
def test_recompression_of_many_small_repeats(spark, monkeypatch, bits):
    """Few words, small windows, tables in several parts, and word hashes of four bits, which nearly all meet."""
    monkeypatch.setattr(recompression, "TABLE_WORDS", 200)
    draw = random.Random(8)
    texts = [" ".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randrange(0, 60))) for _ in range(60)]
    texts += [t + " z" for t in texts[:20]] + [texts[3]] * 5
    data = [words(t) for t in texts]
    for width in (4, 7):
        scheme = recompression.Scheme(width=width, rounds=(1, 2), hash_bits=bits)
        got = {r["doc_id"]: r["kept"] for r in recompression.dedup(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), scheme=scheme).collect()}
        assert [got[i] for i in range(len(texts))] == [" ".join(w for w, m in zip(u, mark, strict=True) if not m) for u, mark in zip(data, brute(data, width), strict=True)]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_suffix_order_sorts(seed):
    draw = random.Random(seed)
    n, m = draw.randrange(1, 40), draw.randrange(1, 12)
    units = np.array([[draw.randrange(2) for _ in range(m)] for _ in range(n)], np.uint8)
    length = np.array([draw.randrange(0, m + 1) for _ in range(n)])
    group = np.array([draw.randrange(3) for _ in range(n)])
    order = repeats.SuffixOrder(group, units, length)
    rows = [(group[i], units[i, : length[i]].tolist()) for i in order.order]
    assert rows == sorted(rows)
    exact = repeats.SuffixOrder(group, units, length)
    exact._exact(group)
    assert [rows[k] for k in range(n)] == [(group[i], units[i, : length[i]].tolist()) for i in exact.order] and (exact.lcp == order.lcp).all()


def components(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def test_jaccard_components_equal_brute_force(spark):
    draw = random.Random(5)
    base = [" ".join(str(draw.randrange(10**6)) for _ in range(60)) for _ in range(4)]
    rows = [t for _, t, _ in documents()]
    for b in base:
        for _ in range(12):
            w = b.split()
            for _ in range(draw.randrange(0, 4)):
                w[draw.randrange(len(w))] = str(draw.randrange(10**6))
            rows.append(" ".join(w))
    sets = []
    for t in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    want = components(sets)
    got = {r["doc_id"]: r for r in jaccard_join.link(frame(spark, [(i, t, "s") for i, t in enumerate(rows)])).collect()}
    assert [got[i]["component_id"] for i in range(len(rows))] == want
    assert [got[i]["n_shingles"] for i in range(len(rows))] == [len(s) for s in sets]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert suffix_dedup.dedup(none).count() == recompression.dedup(none).count() == jaccard_join.link(none).count() == 0


def test_repeated_rows_and_null_id(spark):
    text = " ".join(str(i) for i in range(200))
    rows = frame(spark, [(1, text, "a"), (1, text, "a"), (None, text, "b"), (2, text, None)])
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in recompression.dedup(rows).collect())
    assert got == [(0, 0), (1, 200), (1, 200), (2, 200)]
    assert sorted((r["doc_id"] or 0, r["n_removed"] > 0) for r in suffix_dedup.dedup(rows).collect()) == [(0, False), (1, True), (1, True), (2, True)]


@pytest.mark.parametrize("operator", [recompression, suffix_dedup])
def test_repeated_rows_without_an_earlier_copy(spark, operator):
    text, other = (" ".join(str(i) for i in range(a, a + 200)) for a in (0, 5000))
    two = spark.createDataFrame(spark.sparkContext.parallelize([(1, text, "a"), (1, text, "a")], 1), frame(spark, []).schema)
    assert [r["n_removed"] for r in operator.dedup(two).collect()] == [0, 0]
    got = operator.dedup(two.unionByName(frame(spark, [(2, text, None), (3, other, None)]))).collect()
    assert sorted((r["doc_id"], r["n_removed"] > 0) for r in got) == [(1, False), (1, False), (2, True), (3, False)]


@pytest.mark.parametrize("operator", [recompression, suffix_dedup])
@pytest.mark.parametrize("key", [None, 7])
def test_different_texts_under_one_id(spark, operator, key):
    text, x, y = (" ".join(str(i) for i in range(a, a + 200)) for a in (1000, 5000, 9000))
    got = operator.dedup(frame(spark, [(key, x + " " + text, "a"), (key, text + " " + y, "b")])).collect()
    assert [r["doc_id"] for r in got] == [key, key]
    kept = [bytes(r["kept"]).decode() if operator is suffix_dedup else r["kept"] for r in got]
    assert sum(x in k for k in kept) == sum(y in k for k in kept) == sum(text in k for k in kept) == 1
    assert sum(r["n_removed"] for r in got) == (len(text) if operator is suffix_dedup else 200)


def test_jaccard_chunks_of_the_same_texts_in_another_order(spark):
    x, y = (" ".join(str(i) for i in range(a, a + 60)) for a in (0, 5000))
    rows = spark.createDataFrame(spark.sparkContext.parallelize([(0, x, "s"), (1, y, "s"), (2, y, "s"), (3, x, "s")], 2), frame(spark, []).schema)
    assert sorted((r["doc_id"], r["component_id"]) for r in jaccard_join.link(rows).collect()) == [(0, 0), (1, 1), (2, 1), (3, 0)]


def test_jaccard_of_a_very_long_text(spark):
    long = " ".join(str(i) for i in range(100_000))
    assert [(r["n_shingles"], r["component_id"]) for r in jaccard_join.link(frame(spark, [(1, long, "s")])).collect()] == [(99_996, 1)]
    got = jaccard_join.link(frame(spark, [(1, long, "s"), (2, long + " end", "s"), (3, "x " + long[:300_000], "s")])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 1), (3, 3)]


def morse(n, flip):
    return "".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(n))


def test_words_that_a_polynomial_confuses_stay_apart(spark):
    """A word of two letters in Thue-Morse order and its complement have one value under any polynomial modulo 2^64."""
    a, b = morse(2048, 0), morse(2048, 1)
    head = " ".join(f"w{k}" for k in range(19))
    rows = frame(spark, [(1, f"{head} {a}", "s"), (2, f"{head} {b}", "s")])
    assert [r["n_removed"] for r in recompression.dedup(rows).collect()] == [0, 0]
    rows = frame(spark, [(1, a, "s"), (2, b, "s")])
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.link(rows).collect()} == {1: 1, 2: 2}


def test_another_hash_is_taken_where_too_many_words_share_one(spark, monkeypatch):
    monkeypatch.setattr(recompression, "MOST_CLASHES", 2)
    hashes = recompression._hashes
    monkeypatch.setattr(recompression, "_hashes", lambda words, bits=64, seed=0: hashes(words, 64 if seed else 1, seed))
    texts = recompression.stored(recompression.chunked(repeats.numbered(frame(spark), "doc_id", "text")[0]))
    assert len(recompression.clashing_words(texts, 0, 64, 1)) == 0


def test_word_hashes_of_any_length():
    draw = np.random.default_rng(1)
    data = draw.integers(97, 100, 400).astype(np.uint8)
    spans = {(lo, hi): data[lo:hi].tobytes() for lo in range(0, 400, 3) for hi in range(lo, 400, 7)}
    lo, hi = (np.array(x) for x in zip(*spans, strict=True))
    from reachbase.llm import wordhash

    by_word = {}
    for h, w in zip(wordhash.hashes(data, lo, hi).tolist(), spans.values(), strict=True):
        assert by_word.setdefault(h, w) == w
    assert len(by_word) == len(set(spans.values()))


@pytest.mark.parametrize("operator", [recompression.dedup, suffix_dedup.dedup, jaccard_join.link])
def test_extra_columns_and_very_long_texts(spark, operator):
    long = " ".join(f"v{k % 5000}" for k in range(150_000))
    rows = frame(spark, [(1, long, "a"), (2, "short text", "b"), (3, None, None)])
    clash = rows.selectExpr("doc_id", "text", "source as kept", "1 as n_words", "'x' as cls", "2 as chunk", "3 as n_removed", "4 as component_id")
    plain, crowded = ({r["doc_id"]: r for r in operator(x).collect()} for x in (rows, clash))
    assert plain == crowded and set(plain) == {1, 2, 3}
