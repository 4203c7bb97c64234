import hashlib
import random
import re
from collections import Counter
from zlib import crc32

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from reachbase.llm import periodic_runs, registry, sentence_pieces, spelling
from tests.llm.fixture import documents, frame

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Spelling variants


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows, shortest=5, least=3, factor=2, one_in=97):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{doc_id}:{run}".encode())
            if one_in and h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= shortest and k >= least}
    of = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, others in of.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(of[w]), n[form[w]] if form[w] else None))
    return out


def as_set(rows):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows.collect()}


def letters(seed=4, n=60):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abé") for _ in range(draw.randrange(4, 8))) for _ in range(60)] + ["Strasse", "STRASSE", "strassen", "ÜBUNG", "Übung", "x" * 300, "x" * 299, "naïve", "naive"]
    out = [(i, " ".join(draw.choice(words) for _ in range(draw.randrange(80))) + draw.choice(["", "!", " 7up", "×a"])) for i in range(n)]
    return out + [(n, None), (n + 1, ""), (n + 2, out[0][1]), (n + 2, out[0][1]), (None, "strasse strasse strasse")]


def test_variants_equal_brute_force(spark):
    rows = letters()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    assert as_set(spelling.variants(docs, one_in=97)) == plain_variants(rows)
    assert as_set(spelling.variants(docs, least=1, factor=1.5)) == plain_variants(rows, least=1, factor=1.5, one_in=None)
    assert spelling.variants(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [1, 4, 10**9])
def test_pairs_are_whole_however_buckets_are_cut(spark, bucket):
    draw = random.Random(bucket)
    words = sorted({"".join(draw.choice("ab") for _ in range(draw.randrange(1, 9))) for _ in range(300)} | {"same" + c for c in "abcdefgh"})
    got = {tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), bucket).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and near(a, b)}


def test_forms_are_followed_to_the_root(spark):
    chain = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(13)], "word string, form string")
    assert {tuple(r) for r in spelling.roots(chain).collect()} == {(f"w{k}", "w13") for k in range(13)}
    assert spelling.roots(chain.limit(0)).count() == 0


def test_variants_equal_sql(spark, tmp_path):
    rows = letters(9)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = as_set(registry.QUERIES["op11_spelling_variants"](spark, str(tmp_path)))
    assert got == plain_variants(rows)
    assert set(con.execute("select word, form, root, n, n_near, form_n from (" + registry.ORACLE_SQL["op11_spelling_variants"] + ")").fetchall()) == got


# SentencePiece


def texts():
    draw = random.Random(11)
    some = [t for _, t, _ in documents()]
    odd = ["", " ", "  a", "▁ x", " " * 700, "a" * 3000, "ab" * 999, "0123", "\x00\x01\n\t", "\U0001d49c 中文字 한국어", "<s> </s> <unk> <0x41>", "word " * 4000]
    mixed = ["".join(draw.choice("  ▁abcdeinrsté\n0中") for _ in range(draw.randrange(80))) for _ in range(300)]
    return [*some, *odd, *mixed]


def test_pieces_equal_the_library_and_go_round(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "mine") for i, t in rows + rows[:5]], "doc_id long, text string, ids string")
    got = sentence_pieces.decode(sentence_pieces.encode(docs, MODEL), MODEL).collect()
    assert len(got) == len(rows) + 5
    for r in got:
        want = library.encode(r["text"] or "", add_eos=True)
        assert r["ids"] == want and r["decoded"] == library.decode(want)
    assert sentence_pieces.decode(sentence_pieces.encode(docs.limit(0), MODEL), MODEL).count() == 0


def test_any_ids_decode_as_in_the_library():
    library, codec, draw = sentencepiece.SentencePieceProcessor(model_file=MODEL), sentence_pieces.Decoder(open(MODEL, "rb").read()), random.Random(2)
    for _ in range(3000):
        ids = [draw.randrange(270 if draw.random() < 0.5 else 32000) for _ in range(draw.randrange(9))]
        assert codec.decode(ids) == library.decode(ids)


def test_full_stores_change_nothing(monkeypatch):
    monkeypatch.setattr(sentence_pieces, "KEPT_WORDS", 3)
    monkeypatch.setattr(sentence_pieces, "KEPT_LENGTH", 4)
    monkeypatch.setattr(sentence_pieces, "BLOCK", 50)
    library, codec = sentencepiece.SentencePieceProcessor(model_file=MODEL), sentence_pieces.Encoder(open(MODEL, "rb").read())
    for text in texts()[:60]:
        ids = [int.from_bytes(x, "little") for x in re.findall(b"(?s)....", codec.encode([text or ""])[0])]
        assert ids == library.encode(text or "", add_eos=True)


# Runs


def plain_runs(w, shortest):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            if length >= max(shortest, 2 * q) and not any(all(w[start + x] == w[start + x + d] for x in range(length - d)) for d in range(1, q)):
                out.append((start, length, q))
            i += 1
    return sorted(out)


@pytest.mark.parametrize("shortest", [2, 5, 12])
def test_runs_equal_brute_force(shortest):
    draw = random.Random(shortest)
    for _ in range(3000):
        n, letters_ = draw.randrange(50), draw.randrange(1, 5)
        w = [draw.randrange(letters_) for _ in range(n)]
        if n > 2 and draw.random() < 0.7:
            s, p = draw.randrange(n), draw.randrange(1, n // 2 + 1)
            w = w[:s] + (w[s : s + p] * n)[: n - s]
            w[draw.randrange(n)] = draw.randrange(letters_)
        assert periodic_runs.runs(w, shortest) == plain_runs(w, shortest), w


def test_long_regular_texts_take_linear_time():
    """Words compared while finding next smaller suffixes, counted: a few for each word."""

    class Seen(int):
        count = 0

        def __eq__(self, other):
            Seen.count += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    def fibonacci(n):
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]

    n = 20_000
    for w in ([0] * n, [0, 1] * (n // 2), fibonacci(n), ([0] * 140 + [1]) * 140, list(range(n)), list(range(n, 0, -1)), [k & -k for k in range(1, n)]):
        Seen.count = 0
        periodic_runs.candidates([Seen(x) for x in w], 12)
        assert Seen.count < 4 * n
    assert periodic_runs.runs([0] * n) == [(0, n, 1)]


def test_collapse_and_digests_equal_plain_version(spark):
    extra = ["x y " * 9, "a " * 12, "a " * 11, "p q r " * 4 + "p", "k " * 5000, "one two three four five six one two three four five six", None]
    rows = [(i, t, "x") for i, t, _ in documents()] + [(1000 + i, t, None) for i, t in enumerate(extra)] + [(1000, extra[0], "x"), (None, "a b " * 20, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    tiled = periodic_runs.tiled(docs)
    got = periodic_runs.digests(periodic_runs.collapse(tiled)).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, text, _ in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
        h, n = crc32(str(i).encode()), len(w)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = plain_runs(w, 12)
        gone = {k for s, length, q in found for k in range(s + q, s + length)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        want[(i, len(found), *top, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))] += 1
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(tuple(r[c] for c in names) for r in got) == want
    assert periodic_runs.collapse(docs.limit(0)).count() == 0
    assert periodic_runs.collapse(docs.withColumn("judged", F.lit(1))).columns == ["doc_id", "text", "runs", "judged", "collapsed"]
