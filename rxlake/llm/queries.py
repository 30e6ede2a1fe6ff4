"""The registered queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rxlake.llm.alignment import align
from rxlake.llm.bag_minhash import near_duplicates
from rxlake.llm.bpe import bpe_round_trip
from rxlake.llm.common import documents, ready
from rxlake.llm.fingerprint import fingerprints
from rxlake.llm.langid import identify
from rxlake.llm.lm import score_texts
from rxlake.llm.negatives import mine_negatives
from rxlake.llm.packing import pack
from rxlake.llm.pii import find_pii
from rxlake.llm.quality import classify_quality
from rxlake.llm.suffix_dedup import suffix_dedup
from rxlake.llm.topk import top_k
from rxlake.llm.urls import Rule, host_rules, judge_urls, site_rules

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECE_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")

SITES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
]
#: What the method itself blocks where no site rule fits: words of a host, and kinds of file and page.
BLOCKED_HOSTS = ["*spam*", "*pills*", "*casino*", "*viagra*", "*.xxx"]
BLOCKED_PAGES = ["*/**.exe", "*/**.apk", "*/wp-login*", "*/wp-admin/**"]
URL_RULES = [
    *site_rules(SITES), *(r for h in BLOCKED_HOSTS for r in host_rules("block", h)), *(Rule("block", g) for g in BLOCKED_PAGES),
]


def fold(buckets: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(buckets))


def op1_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of each document and text."""
    return near_duplicates(documents(spark, sf_dir))


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in each document."""
    return find_pii(documents(spark, sf_dir))


def op3_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document; the fold 2 of 4 is held out."""
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(fold(4) == 2, F.lit(False)))
    return identify(docs, ~F.col("held_out"), ["doc_id", "held_out"])


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of each hundredth vector."""
    vectors = ready(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 100 == 0)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 100-byte strings removed from each document."""
    return suffix_dedup(documents(spark, sf_dir))


def op6_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document from its text, its source, and the language section of that source."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return classify_quality(documents(spark, sf_dir), labels, bad, F.col("source"), F.col("lang"))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack(documents(spark, sf_dir), BYTE_VOCABULARY)


def op8_segment_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document encoded and decoded."""
    return bpe_round_trip(documents(spark, sf_dir), WORD_VOCABULARY)


def op9_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document scored by a model of the folds other than 2 of 7."""
    return score_texts(documents(spark, sf_dir), fold(7) != 2)


def op10_feature_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of each document and its likeness to its edited and next text."""
    return fingerprints(documents(spark, sf_dir))


def op11_packed_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of each hundredth vector; every seventh label is moved on by one."""
    vectors = ready(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(vectors, F.col("vec_id") % 100 == 0, label)


def op12_diagonal_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's tokens in two vocabularies aligned, with the corpus counts of linked tokens."""
    return align(documents(spark, sf_dir), BYTE_VOCABULARY, PIECE_VOCABULARY)


def op13_url_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's address judged by the site rules, and where none fits by the glob rules."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bag_minhash, op2_pii_spans, op3_byte_cnn, op4_top_k, op5_suffix_dedup, op6_site_quality, op7_best_fit,
        op8_segment_bpe, op9_backoff_lm, op10_feature_digest, op11_packed_negatives, op12_diagonal_alignment, op13_url_automaton,
    )
}

SQL: dict[str, str] = {
    "op4_top_k": """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0
),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([a[1] * a[2] for a in list_zip(q.e, c.e)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op11_packed_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND label IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0
),
a AS (SELECT row_number() OVER () AS a, * FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0)),
s AS (
  SELECT a.a, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         list_sum([x[1] * x[2] for x in list_zip(a.e, c.e)])::BIGINT AS score
  FROM a JOIN v c ON c.vec_id <> a.vec_id AND len(a.e) = len(c.e)
),
p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS n FROM s WHERE same),
r AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.n ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON p.a = s.a AND p.n <= 5 AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 5
""",
    "op13_url_automaton": """
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
),
r AS (
  SELECT *, '.' || host AS d, CASE
    WHEN '.' || host LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN '.' || host LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN '.' || host LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN '.' || host LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN '.' || host LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule,
  CASE WHEN host LIKE '%spam%' THEN '*spam*' WHEN host LIKE '%pills%' THEN '*pills*' WHEN host LIKE '%casino%' THEN '*casino*'
       WHEN host LIKE '%viagra%' THEN '*viagra*' WHEN host LIKE '%.xxx' THEN '*.xxx' END AS word,
  CASE WHEN path LIKE '/%.exe' THEN '*/**.exe' WHEN path LIKE '/%.apk' THEN '*/**.apk'
       WHEN starts_with(path, '/wp-login') AND instr(substr(path, 2), '/') = 0 THEN '*/wp-login*'
       WHEN starts_with(path, '/wp-admin/') THEN '*/wp-admin/**' END AS page
  FROM h
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN word IS NOT NULL OR page IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN rule IS NOT NULL THEN '*.' || rule || '**' WHEN word IS NOT NULL THEN '.' || word || CASE WHEN path = '' THEN '' ELSE '/**' END
            ELSE page END AS glob
FROM r
""",
}
