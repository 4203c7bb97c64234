import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.fixture import documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_chain(spark, tmp_path):
    rows = [(i, t, "en", s or "none", len(t or "")) for i, t, s in documents(n=64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 64, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "PII", "mixing sources", "byte-level BPE"]
    held = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, held, str(tmp_path))
        if k < 4:
            assert out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        held = spark.read.parquet(f"{tmp_path}/{k}")
    assert held.select("doc_id").distinct().count() == spark.read.parquet(f"{tmp_path}/1").select("doc_id").distinct().count()
    texts = [r["text"] for r in spark.read.parquet(f"{tmp_path}/1").where(F.col("text").rlike("[^ \\n\\t]")).collect()]
    assert len(texts) == len(set(texts))


def test_near_duplicates_keeps_one_row_of_each_component(spark):
    a, b, c, d = (" ".join(str(i) for i in range(k, k + 60)) for k in (0, 1000, 2000, 3000))
    rows = [(None, a), (None, b), (None, b + " x"), (1, c), (1, c), (1, d), (2, d + " y"), (3, "end"), (3, None), (3, None), (None, ""), (None, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sum(t in (b, b + " x") for _, t in kept) == 1
    rest = [x for x in kept if x[1] not in (b, b + " x")]
    assert sorted(rest, key=str) == sorted([(None, a), (1, c), (1, d), (3, "end"), (3, None), (None, ""), (None, " ")], key=str)
    # Siblings of different classes under one id: one stays.
    docs = spark.createDataFrame([(5, c, "en", "s", 0), (5, c + " z", "en", "s", 0)], docs.schema)
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 1
