import pytest
from pyspark.sql import functions as F

ODD_ROWS = [
    (None, None, None, None, None), (None, "no id here", "en", "src1", 10), (1005, "", "en", "src0", 0), (1006, None, None, None, None),
    (1007, "repeated row of a few words here", "en", "src0", 32), (1007, "repeated row of a few words here", "en", "src0", 32),
    (1007, "same id but another text", None, "src2", 24), (1008, "é ü 日本語 😀 <|endoftext|>", "fr", None, 20), (1009, " \t\n ", "de", "src0", 4),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = ["id", "copy", "deal", "band", "spans", "base", "asked", "host", "path", "n_bytes", "kept_text", "salt", "key", "code", "keep_0", "class_id", "score"]


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest documents table with odd rows added and columns whose names clash."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(ODD_ROWS, SCHEMA))
    long_text = " ".join(f"word{i % 977}x" for i in range(60_000))
    docs = docs.unionByName(spark.createDataFrame([(1010, long_text, "en", "src0", len(long_text))], SCHEMA))
    return docs.withColumns({c: F.lit(1) for c in CLASHING}).cache()


@pytest.fixture(scope="session")
def rows(sample):
    return [(r.doc_id, r.text) for r in sample.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def empty(sample):
    return sample.limit(0)
