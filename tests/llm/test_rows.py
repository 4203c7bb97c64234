import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from reachbase.llm import byte_bpe, fingerprints, importance, mixing, pii, quality_rules, url_rules
from tests.llm.fixture import documents, frame

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def test_statistics_equal_brute_force(spark):
    got = {r["doc_id"]: r for r in quality_rules.with_stats(frame(spark).withColumn("n_words", F.lit("clash"))).collect()}
    for i, text, _ in documents():
        w = words(text)
        lines = [x for x in (text or "").split("\n") if words(x)]
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        want = (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>") if text else 0, len(lines) - len(set(lines)), len(covered))
        assert tuple(got[i][c] for c in quality_rules.STATS) == want


def test_rules_are_learnt_on_held_out_rows():
    draw = np.random.default_rng(0)
    x = draw.random((4000, 2))
    bad = (x[:, 0] > 0.8) & (x[:, 1] < 0.3) | (x[:, 0] < 0.05)
    table = {"chars_per_word": x[:2000, 0], "upper_share": x[:2000, 1]}
    rules = quality_rules.learn_rules(table, bad[:2000])
    held = {"chars_per_word": x[2000:, 0], "upper_share": x[2000:, 1]}
    hit = np.logical_or.reduce([r.mask(held) for r in rules])
    assert (hit == bad[2000:]).mean() > 0.97
    assert quality_rules.learn_rules(table, np.zeros(2000, bool)) == []


def test_rules_without_labels_keep_what_passes_the_base(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.fit(frame(spark), labels) == []
    rows = quality_rules.apply_rules(quality_rules.with_stats(frame(spark)), []).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)


def test_url_rules(spark):
    urls = ["http://a.example.net/en/1", "http://example.net/de/1", "https://EXAMPLE.com/de/x?q", "http://x.org/fr/#a", "http://m.ads-track.example.com/en/1", "no scheme", None, "http://net", "http://notexample.net/en/", "http://net.org/", ""]
    got = url_rules.filter_urls(spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id int, url string, verdict string")).orderBy("page_id").collect()
    assert [r["rule"] for r in got] == ["example.net/en/", "net/", "example.com/de/", "org/fr/", None, None, None, None, "net/", None, None]
    assert [r["verdict"] for r in got] == ["allow", "block", "block", "allow", "block", "allow", "allow", "allow", "block", "allow", "allow"]
    assert got[5]["host"] == got[6]["path"] == "" and got[2]["host"] == "example.com"
    assert url_rules.filter_urls(spark.createDataFrame([], "url string")).count() == 0


def test_fingerprints_estimate_likeness(spark):
    draw = random.Random(3)
    rows = []
    for i in range(40):
        w = [str(draw.randrange(10**6)) for _ in range(300)]
        for k in range(i * 7):
            w[k % 300] = w[k % 300] + ("x" if k < 150 else "")
        rows.append(w)
    base = [str(i) for i in range(300)]
    cut = [base[: 300 - 7 * i] + rows[i][: 7 * i] for i in range(40)]
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    frame_ = spark.createDataFrame([(" ".join(base), " ".join(c)) for c in cut], "text string, other string")
    both = fingerprints.with_fingerprint(fingerprints.with_fingerprint(frame_), "other", "other_fp")
    got = [r[0] for r in both.select(fingerprints.likeness(F.col("fingerprint"), F.col("other_fp"))).collect()]
    true = [len(shingles(base) & shingles(c)) / len(shingles(base) | shingles(c)) for c in cut]
    assert max(abs(a - b) for a, b in zip(got, true, strict=True)) < 0.17 and abs(np.mean(np.array(got) - true)) < 0.03


def test_next_text_goes_down_and_around(spark):
    rows = fingerprints.with_next(frame(spark).select("doc_id", F.coalesce("text", F.lit("")).alias("text")), lambda x: x, ["text"], block_bytes=700).collect()
    texts = {i: t or "" for i, t, _ in documents()}
    assert all(r["next_text"] == texts[(r["doc_id"] - 1) % len(texts)] for r in rows) and len(rows) == len(texts)
    edited = spark.createDataFrame([("héllo wörld", "ab"), ("abc", ""), ("", "x")], "a string, b string").select(fingerprints.edited_text(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in edited] == ["héllo wöab", "ab", ""]


def test_bpe_equals_tiktoken_and_decodes(spark):
    rows = documents() + [(900, "it's  naïve\n\n 12 ½ ²   日本語 \U0001f600!! \x1c\x1d", None), (901, "x" * 5000, None), (902, "<|endoftext|>", None)]
    frame_ = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    done = byte_bpe.decode(byte_bpe.encode(frame_, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    codec = byte_bpe.Codec(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.vocabulary.ids, special_tokens={})
    for (_, text, _), r in zip(rows, done, strict=True):
        assert np.frombuffer(r["ids"], "<u4").tolist() == known.encode_ordinary(text or "")
        assert bytes(r["decoded"]).decode() == (text or "")


def test_bpe_prefix_table_appends_and_edits():
    v = byte_bpe.Codec(open(RANKS, "rb").read(), public_tokenizers.PATTERN).vocabulary
    draw = random.Random(2)
    for _ in range(60):
        data = bytes(draw.choice(b"the ing123") for _ in range(draw.randrange(1, 400)))
        at = draw.randrange(len(data))
        table = byte_bpe.PrefixTable(v, data[:at])
        table.append(data[at:])
        assert table.last == byte_bpe.PrefixTable(v, data).last
        a = draw.randrange(len(data))
        b, new = draw.randrange(a, len(data) + 1), bytes(draw.choice(b"the ") for _ in range(draw.randrange(5)))
        table.replace(a, b, new)
        assert table.last == byte_bpe.PrefixTable(v, data[:a] + new + data[b:]).last


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def test_pseudonyms_keep_format_and_link(spark):
    texts = ["card 4111 1111 1111 1111 and 4111111111111111", "on 2024-02-29, 31.12.1999 and 02/30/2000", "ip 70.214.118.188, not 999.1.1.1", "call +1 (988) 555-2485 or bob.x7@mail2.example.com", None, "", "plain words only 42", "again 4111-1111-1111-1111 bob.x7@mail2.example.com"]
    frame_ = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = [r["text"] for r in pii.pseudonymise(frame_).orderBy("id").collect()]
    shape = lambda t: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub(r"\d", "9", t)))
    for old, new in zip(texts, got, strict=True):
        assert (old is None and new is None) or re.sub(r"(9+\.){3}9+", "ip", shape(old)) == re.sub(r"(9+\.){3}9+", "ip", shape(new))
    card = re.findall(r"\d{4} \d{4} \d{4} \d{4}", got[0])[0]
    assert luhn(card) and card.replace(" ", "") in got[0].split()[-1] and card.replace(" ", "-") in got[7] and card != "4111 1111 1111 1111"
    assert "02/30/2000" in got[1] and "999.1.1.1" in got[2] and got[5] == "" and got[6] == texts[6]
    assert re.search(r"\S+@mail2", got[3])[0] == re.search(r"\S+@mail2", got[7])[0] and "bob" not in got[3]
    spark.conf.set(pii.KEY_SETTING, "it's another")
    try:
        other = pii.pseudonymise(frame_)
        assert [r["text"] for r in other.orderBy("id").collect()] != got
        assert "it's another" not in other._jdf.queryExecution().toString()
        spark.conf.set(pii.KEY_SETTING, "")
        with pytest.raises(ValueError):
            pii.pseudonymise(frame_)
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_pseudonyms_are_permutations(spark):
    numbers = [f"{i:03d}-{i % 100:02d}-{i:04d}" for i in range(300)] + [f"10.0.{i}.{i % 7}" for i in range(200)] + [f"({i}) 555-01{i % 100:02d}" for i in range(200, 400)]
    got = pii.pseudonymise(spark.createDataFrame([(n,) for n in numbers], "text string")).collect()
    assert len({r["text"] for r in got}) == len(set(numbers))
    refused = [f"{a}-{g}-{n}" for a, g, n in (("000", "12", "3456"), ("666", "12", "3456"), ("912", "34", "5678"), ("123", "00", "4567"), ("123", "45", "0000"))] + ["(155) 555-0100", "(255) 155-0100"]
    assert [r["text"] for r in pii.pseudonymise(spark.createDataFrame([(n,) for n in refused], "text string").coalesce(1)).collect()] == refused


def test_mixing_meets_budget_and_limits(spark):
    rows = [(i, "word " * (1 + i % 9), "big" if i % 4 else f"small{i % 3}") for i in range(600)] + [(600, None, None), (601, "", "big")]
    docs = frame(spark, rows)
    mix = mixing.Mix(entropy=0.95, most_passes=3.0, rows_per_block=50)
    dealt = mixing.deal(docs, mix).collect()
    times = Counter(r["doc_id"] for r in dealt)
    assert set(times) == {r[0] for r in rows} and max(times.values()) <= 4
    own = {i: -(-len((t or "").encode()) // 4) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    plan = {r["_source"]: r for r in mixing.plan(docs, mix).collect()}
    for name, p in plan.items():
        got = sum(own[i] * n for i, n in times.items() if source[i] == name)
        if p["tokens"]:
            assert p["passes"] * p["tokens"] + p["rest"] - 12 < got <= p["passes"] * p["tokens"] + p["rest"]
            assert got / p["tokens"] <= 3.0 + 1e-6
    assert times[600] == times[601] == 1
    few = mixing.deal(docs, mixing.Mix(entropy=None, budget_tokens=200, rows_per_block=50)).collect()
    assert 100 < sum(own[r["doc_id"]] for r in few) <= 200
    assert mixing.deal(frame(spark, [])).count() == 0


def test_importance_tells_held_out_rows_apart(spark):
    draw = random.Random(4)
    good, bad = [f"g{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(900):
        poor = i % 3 == 0
        rows.append((i, " ".join(draw.choice(bad if poor and draw.random() < 0.3 else good) for _ in range(80)), "s"))
        if i % 2:
            labels.append((i, 0 if poor else 1, 0))
    rows += [(1000, None, "s"), (1001, "", "s")]
    model = importance.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    keys, kept = importance.select(frame(spark, rows), model)
    stays = {r["doc_id"] for r in kept.collect()}
    assert stays == {r["doc_id"] for r in keys.where("kept").collect()}
    right = sum((i in stays) == (i % 3 != 0) for i in range(0, 900, 2))
    assert right > 0.95 * 450
    unlabelled = importance.fit(frame(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert importance.select(frame(spark, rows), unlabelled)[1].count() == len(rows)


def test_cut_takes_exactly_k(spark):
    draw = random.Random(6)
    values = [draw.gauss(0, 1) for _ in range(5000)]
    keys = spark.createDataFrame([(v,) for v in values], "gumbel_key double")
    for k in (1, 17, 2500, 4999):
        cut = importance.cut_of(keys, k, bins=16)
        assert sum(v >= cut for v in values) == k
    assert importance.cut_of(keys, 0) == float("inf") and importance.cut_of(keys, 9999) == float("-inf")


CLASHES = "_t _w _l _h _s _p _u _b _d _n _m _v _f _r _key _place _found _block _blocks _passes _floor _cut _source _pass _next _head blocks passes log_weight gumbel_key".split()


def clashing(spark, rows=None):
    """Documents whose other columns have the names that operators might use inside."""
    docs = frame(spark, rows)
    return docs.select("*", *[F.lit(f"mine {c}").alias(c) for c in CLASHES])


OPERATORS = {
    "importance": lambda d: importance.select(d, importance.Model(np.zeros(2 * importance.STARTS), (50.0, 1.0)))[1],
    "quality_rules": quality_rules.with_stats,
    "url_rules": lambda d: url_rules.filter_urls(d, url="text"),
    "fingerprints": lambda d: fingerprints.with_next(d, fingerprints.with_fingerprint, ["fingerprint"], block_bytes=900),
    "byte_bpe": lambda d: byte_bpe.encode(d, RANKS, public_tokenizers.PATTERN),
    "mixing": mixing.deal,
    "pii": lambda d: pii.pseudonymise(d, found="n_found"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_other_columns_pass_through(spark, name):
    out = OPERATORS[name](clashing(spark)).limit(1).collect()[0]
    assert all(out[c] == f"mine {c}" for c in CLASHES) and "source" in out


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_repeated_rows_and_nulls_are_treated_alike(spark, name):
    rows = [(1, "one two three 4111 1111 1111 1111", "a")] * 3 + [(None, None, None)] * 2 + [(None, "", "a"), (2, None, "a")]
    if name == "fingerprints":
        rows = [(i, t or "", s) for i, t, s in rows]
    out = OPERATORS[name](frame(spark, rows)).collect()
    for i, text in ((1, rows[0][1]), (None, None)):
        here = [{k: v for k, v in r.asDict().items() if not k.startswith("next_")} for r in out if r["doc_id"] == i and (r["source"] == "a") == (i == 1)]
        assert len({str(sorted(h.items(), key=str)) for h in here}) == (1 if name != "mixing" else len({(h["pass"]) for h in here}))
        assert name in ("mixing", "importance") or len(here) == sum(r[0] == i and (r[2] == "a") == (i == 1) for r in rows)


def test_very_long_texts(spark):
    """Many different words, a long run of one character, and one word again and again."""
    draw = random.Random(1)
    texts = [" ".join(f"w{draw.randrange(10**5)}" for _ in range(200_000)), "x" * 1_000_000, "word " * 100_000]
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    stats = {r["doc_id"]: r for r in quality_rules.with_stats(docs).select("doc_id", *quality_rules.STATS).collect()}
    assert [stats[i]["n_words"] for i in range(3)] == [200_000, 1, 100_000] and stats[2]["n_repeat_words"] == 100_000
    assert fingerprints.with_fingerprint(docs).where("length(fingerprint) = 512").count() == 3
    assert [r["text"] == t for r, t in zip(pii.pseudonymise(docs.orderBy("doc_id")).collect(), texts, strict=True)] == [True] * 3
    assert importance.select(docs, importance.Model(np.zeros(2 * importance.STARTS), (0.5, 1.0)))[0].count() == 3


def test_windows_of_one_hash_are_told_apart(spark):
    """Windows count as equal by their words: all windows of a text are found by words alone."""
    text = "a b c a b c d e f d e f g h i"
    row = quality_rules.with_stats(frame(spark, [(1, text, "s")])).first()
    w = words(text)
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    assert row["n_repeat_words"] == len({k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)})


def test_url_index_runs_few_rules(spark):
    """Ten thousand rules, filed under their rarest token, against running all of them."""
    draw = random.Random(9)
    rules = tuple(url_rules.UrlRule(f"r{i}", draw.choice(["allow", "block"]), rf"^site{i % 700}\.example\.com/(?:[^/]+/)*page{i}(?:/|$)", (f"site{i % 700}", "example", "com", f"page{i}")) for i in range(10_000))
    urls = [f"http://site{draw.randrange(700)}.example.com/a/page{draw.randrange(10_000)}/x" for _ in range(300)]
    urls += [f"http://site{i % 700}.example.com/page{i}" for i in range(0, 10_000, 97)] * 2
    got = url_rules.filter_urls(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string"), rules).collect()
    compiled = [(r, re.compile(r.pattern)) for r in rules]
    for r in got:
        fits = [x for x, p in compiled if p.search(r["host"] + r["path"])]
        best = min(fits, key=lambda x: (-len(x.name), x.name), default=None)
        assert r["pattern_rule"] == (best.name if best else None) and r["verdict"] == (best.verdict if best else "allow")


def test_no_rules_and_ties(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://a.com/x")], "page_id int, url string")
    assert {r["verdict"] for r in url_rules.filter_urls(pages, ()).collect()} == {"allow"}
    tie = (url_rules.UrlRule("b", "block", "a", ("a",)), url_rules.UrlRule("a", "allow", "a", ("a",)))
    assert {(r["pattern_rule"], r["verdict"]) for r in url_rules.filter_urls(pages, tie).collect()} == {("a", "allow")}


def test_importance_keeps_ties_at_the_cut(spark):
    rows = [(7, "same text here", "s")] * 6
    fitted = importance.Model(np.zeros(2 * importance.STARTS), (0.0, 1.0))
    assert importance.select(frame(spark, rows), fitted)[1].count() == 6


def test_byte_bpe_fills_only_the_prefixes_that_are_asked_for():
    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

    ranks = {bytes([b]): b for b in range(256)} | {t.encode(): 256 + i for i, t in enumerate("th he in er an re the ing ther ning other another".split())}
    v = byte_bpe.Vocabulary(Counted(ranks))
    deal = random.Random(5)
    pieces = [b"anotherning", *("".join(deal.choice("thernigao") for _ in range(deal.randrange(1, 40))).encode() for _ in range(300)), *(bytes(deal.randrange(256) for _ in range(20)) for _ in range(20))]
    tables = [byte_bpe.PrefixTable(v, p).tokens() for p in pieces]  # also finds out which tokens stay apart
    Counted.asked = 0
    assert [byte_bpe.PrefixTable(v, p).tokens() for p in pieces] == tables
    whole, Counted.asked = Counted.asked, 0
    assert [v.encoded(p) for p in pieces] == tables
    assert Counted.asked < whole
