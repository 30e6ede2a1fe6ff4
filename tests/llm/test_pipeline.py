"""The pipeline stages on a small table: what must go goes, what is clean stays, and columns are those of the input."""

from pyspark.sql import functions as F

import corpus_pipeline
from rxlake.llm.common import stored


def test_pipeline(spark, sample):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"spans": F.lit(2), "kept_text": F.lit("x")})
    docs = docs.unionByName(docs.where("doc_id = 12"))
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "repeated_strings", "personal_data", "packing"]
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "near_dedup":  # a near copy of one that stays
            first = docs.where("n_chars > 1500").orderBy("doc_id").limit(1)
            docs = docs.unionByName(first.withColumn("doc_id", F.lit(5000).cast("long")).withColumn("text", F.concat("text", F.lit(" one more word"))))
        before = docs
        docs = stored(stage(spark, before, sf), name)
        assert docs.columns == before.columns
        kept = [r.doc_id for r in docs.select("doc_id").collect()]
        sizes.append(len(kept))
        if name == "quality":
            good = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
            poor = [i for i, r in labels.items() if r.quality == 0 or r.toxic == 1]
            assert sum(i in set(kept) for i in good) / len(good) > 0.95
            assert sum(i in set(kept) for i in poor) / len(poor) < 0.2
        if name == "near_dedup":
            assert 5000 not in kept and len(kept) == len(set(kept))
    assert sizes == sorted(sizes, reverse=True)
    assert docs.where(F.col("text").rlike(r"[a-z0-9]@[a-z0-9]+\.example\.com")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def test_empty_and_odd_tables(spark, sample):
    for docs in (sample.limit(0), sample.where("doc_id IS NULL OR doc_id > 1000")):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, "/root/testdata/sf0.001"), name)
            assert name == "packing" or docs.columns == columns


def test_near_dedup_keeps_one_row_of_each_class(spark):
    """Different texts without an id or under one id stay; of near copies, and of equal rows, one stays."""
    text = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (7, text("c")), (7, text("d")), (7, text("d"))]
    rows += [(8, text("a") + " more"), (9, text("e")), (10, text("d") + " more"), (None, None), (11, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_doc", F.lit("x"))
    kept = corpus_pipeline.near_dedup(spark, docs, "/root/testdata/sf0.001")
    assert kept.columns == docs.columns
    expected = [(None, text("a")), (None, text("b")), (7, text("c")), (7, text("d")), (9, text("e")), (None, None)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, expected))
