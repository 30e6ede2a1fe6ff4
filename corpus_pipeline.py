"""A corpus pipeline: quality, near duplicates, repeated strings, personal data, packing.

Each stage takes all documents that the one before kept and returns those it keeps with the columns of ``documents``
(the last returns the packed pieces). ``run`` writes each result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxlake.llm.bag_minhash import NO_ID, near_duplicates
from rxlake.llm.common import documents, ready, stored
from rxlake.llm.packing import pack
from rxlake.llm.pii import redact
from rxlake.llm.quality import classify_quality
from rxlake.llm.queries import BYTE_VOCABULARY
from rxlake.llm.suffix_dedup import suffix_dedup


def as_documents(docs: DataFrame, like: DataFrame) -> DataFrame:
    """Text changed by a stage: the character count follows, the columns stay in order."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


KNOWN = ["doc_id", "text", "lang", "source", "n_chars"]


def guarded(stage):
    """The stage with all further columns under names of its own, so that none clashes with an operator's."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: f"further_column_{i}" for i, c in enumerate(docs.columns) if c not in KNOWN}
        result = stage(ready(spark), docs.withColumnsRenamed(names), sf_dir)
        return result.withColumnsRenamed({v: k for k, v in names.items()})

    run_stage.__name__, run_stage.__doc__ = stage.__name__, stage.__doc__
    return run_stage


@guarded
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    rest = [c for c in docs.columns if c != "text"]
    judged = classify_quality(docs, labels, bad, F.col("source"), F.col("lang"), rest, with_text=True)
    return judged.where(~F.col("rejected")).withColumnRenamed("kept_text", "text").select(*docs.columns)


@guarded
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates, the one with the least id (of equal ids the least text hash)."""
    classes = near_duplicates(docs)
    row = lambda doc: F.coalesce(doc, F.lit(NO_ID)).cast("long").alias("row_doc")
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_id") == F.col("class_text"))
    goes = classes.where(~stays).select(row("doc_id"), F.col("text_id").alias("row_text"))
    rows = docs.select("*", row("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_text"))
    kept = rows.join(goes, ["row_doc", "row_text"], "left_anti")
    # rows equal in id and text are one member of their class
    twice = stored(rows.groupBy("row_doc", "row_text").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "twice")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    single = kept.join(twice, ["row_doc", "row_text"], "left_anti")
    several = kept.join(twice, ["row_doc", "row_text"], "left_semi").dropDuplicates(["row_doc", "row_text"])
    return single.unionByName(several).select(*docs.columns)


@guarded
def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated 100-byte strings; a document of which nothing is left goes."""
    rest = [c for c in docs.columns if c != "text"]
    done = suffix_dedup(docs, rest, with_text=True)
    done = done.where((F.col("n_removed") == 0) | (F.length("kept_text") > 0)).withColumnRenamed("kept_text", "text")
    return as_documents(done, docs)


@guarded
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    return as_documents(redact(docs), docs)


@guarded
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return pack(docs, BYTE_VOCABULARY)


STAGES = [
    ("quality", quality), ("near_dedup", near_dedup), ("repeated_strings", repeated_strings),
    ("personal_data", personal_data), ("packing", packing),
]

#: The classifier, the signatures and the tokenizer have no SQL; the operators behind the stages have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
