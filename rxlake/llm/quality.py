"""Document quality by hierarchical empirical Bayes.

A linear classifier gives each document a log-odds of being bad from the shape of its text and from a lexicon that
marks bad documents. Evidence is then pooled: the mean of a host is shrunk toward the global mean, the mean of a path
on that host toward its host, both with a strength estimated from the spread between groups (method of moments), so a
site with few documents stays near its parent. The document's log-odds is moved by how far its path's posterior lies
from the global one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxlake.llm.common import LOWER, RangeHash, released, row_blocks, stored, tokens_of, utf8

SAMPLE = 6_000  # labelled documents the classifier is fitted on, about
LEAST_SHARE = 0.01  # of the bad documents of the sample must hold a word of the lexicon
SITES = 50_000  # site posteriors of up to so many rows are broadcast, more are joined by a shuffle
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
CLASSES = {
    "upper": range(65, 91), "digit": range(48, 58), "shout": b"!?", "symbol": b"#$%&*@^~+=<>{}[]\\/_", "table": b"|\t",
    "line": b"\n", "space": b" ", "stop": b".,;:",
}


@dataclass
class Model:
    lexicon: np.ndarray  # sorted word hashes
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float


def words_and_shape(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes (case folded for A-Z), their rows, and the shape features of each row."""
    rows = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)
    shape = [np.log(size)]
    for members in CLASSES.values():
        is_in = np.zeros(256, bool)
        is_in[list(members)] = True
        total = np.concatenate([[0], np.cumsum(is_in[data], dtype=np.int64)])
        shape.append((total[offsets[1:]] - total[offsets[:-1]]) / size)
    start, end, row = tokens_of(data, offsets, WORD)
    words = RangeHash(LOWER[data]).of(start, end)
    count = np.bincount(row, minlength=rows)
    order = np.lexsort((words, row))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (words[order][1:] != words[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][fresh], minlength=rows)
    shape.append(distinct / np.maximum(count, 1))
    shape.append(np.bincount(row, end - start, rows) / np.maximum(count, 1))
    return words[order][fresh], row[order][fresh], np.stack(shape, 1)


def features(words: np.ndarray, row: np.ndarray, shape: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    hit = np.zeros(len(words), bool)
    if len(lexicon):
        hit = lexicon[np.minimum(np.searchsorted(lexicon, words), len(lexicon) - 1)] == words
    hits = np.bincount(row[hit], minlength=len(shape))
    return np.column_stack([shape, np.log1p(hits), hits > 0])


def families(words: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """A key for each row that near copies mostly share: its least word hash among words that are not common."""
    _, of, count = np.unique(words, return_inverse=True, return_counts=True)
    key = np.arange(rows, dtype=np.uint64) | np.uint64(1 << 63)
    rare = count[of] <= max(50, rows // 20)
    np.minimum.at(key, row[rare], words[rare] >> np.uint64(1))
    return key


def telling_words(words: np.ndarray, row: np.ndarray, bad: np.ndarray, family: np.ndarray) -> np.ndarray:
    """Words whose document frequency among bad documents is far above that among the others; a family counts once."""
    order = np.lexsort((family[row], bad[row], words))
    w, b, f = words[order], bad[row][order], family[row][order]
    fresh = np.ones(len(w), bool)
    fresh[1:] = (w[1:] != w[:-1]) | (b[1:] != b[:-1]) | (f[1:] != f[:-1])
    values, of = np.unique(w[fresh], return_inverse=True)
    in_bad = np.bincount(of, b[fresh], len(values))
    total = np.bincount(of, minlength=len(values))
    share = min(max(bad.mean() if len(bad) else 0.0, 1e-6), 1 - 1e-6)
    odds = (in_bad + 0.5) / (total - in_bad + 0.5) / (share / (1 - share))
    z = (in_bad - total * share) / np.sqrt(np.maximum(total * share * (1 - share), 1e-9))
    least = max(4, LEAST_SHARE * bad.sum())
    return values[(in_bad >= least) & (odds >= 6) & (z >= 5)]


def fit(texts: pa.Array, bad: np.ndarray) -> Model:
    """Lexicon from one half of the sample, weights from the other, so that the lexicon is not trusted too far."""
    data, offsets = utf8(texts)
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, len(CLASSES) + 3)))]
    for a, b in row_blocks(offsets, 1 << 19):  # a block at a time, for the driver's memory
        w, r, x = words_and_shape(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        parts.append((w, r + a, x))
    words, row, shape = (np.concatenate(x) for x in zip(*parts))
    half = np.arange(len(bad)) % 2 == 0
    family = families(words, row, len(bad))
    lexicon = telling_words(words[half[row]], row[half[row]], bad, family)
    x = features(words, row, shape, lexicon)
    mean, scale = x.mean(0) if len(x) else np.zeros(x.shape[1]), x.std(0) + 1e-6
    z, y = ((x - mean) / scale)[~half], bad[~half].astype(float)
    z = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(z.shape[1])
    for _ in range(30):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (y - p) - 0.5 * w
        curve = (z * (p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    lexicon = telling_words(words, row, bad, family)
    return Model(lexicon, mean, scale, w[:-1], float(w[-1]))


def fitted(docs: DataFrame, labels: DataFrame, bad: Column, sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` labelled documents, drawn by a hash of the id over the whole table."""
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(bad.cast("int")).alias("bad"))
    marked = marked.where(F.col("bad").isNotNull())
    total = max(marked.count(), 1)
    chosen = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / total)))
    chosen = chosen.limit(2 * sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "bad").toArrow()
    rows = rows.group_by("text").aggregate([("bad", "max")])  # copies would make their words look telling
    texts = rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string())
    return fit(texts, np.asarray(rows.column("bad_max").to_pylist(), float))


def score_batches(model: Model, keep_text: bool):
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            logit = np.zeros(batch.num_rows)
            for a, b in row_blocks(offsets):
                part = data[offsets[a]:offsets[b]]
                x = features(*words_and_shape(part, offsets[a:b + 1] - offsets[a]), model.lexicon)
                logit[a:b] = ((x - model.mean) / model.scale) @ model.weight + model.bias
            empty = np.diff(offsets) == 0
            logit[empty] = 10.0
            names = [n for n in batch.schema.names if keep_text or n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(np.clip(logit, -20, 20))], [*names, "doc_logit"]
            )

    return run


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def strength(groups: DataFrame, overall: float) -> float:
    """Pseudo-documents of the prior: within-group variance over the variance between groups (method of moments)."""
    row = groups.where("n > 1").agg(
        F.count("*").alias("k"), F.avg(F.col("s") / F.col("n")).alias("m"),
        F.var_pop(F.col("s") / F.col("n")).alias("v"), F.avg(1 / F.col("n")).alias("i"),
    ).first()
    if not row["k"] or row["k"] < 2:
        return 100.0
    inside = max(overall * (1 - overall), 1e-6)
    between = max(row["v"] - inside * row["i"], 1e-6)
    return float(min(max(inside / between - 1, 1.0), 1e5))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """Posterior share of bad documents for each (host, path), and the global share."""
    p = 1 / (1 + F.exp(-F.col("doc_logit")))
    paths = stored(scored.groupBy("host", "path").agg(F.sum(p).alias("s"), F.count("*").alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    row = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    overall = (row["s"] or 0.0) / row["n"] if row["n"] else 0.5
    k_host, k_path = strength(hosts, overall), strength(paths, overall)
    hosts = hosts.select(
        "host", ((F.col("s") + k_host * overall) / (F.col("n") + k_host)).alias("host_bad"),
    )
    rates = paths.join(hosts, "host").select(
        "host", "path", "host_bad", ((F.col("s") + k_path * F.col("host_bad")) / (F.col("n") + k_path)).alias("path_bad")
    )
    return stored(rates, "sites"), overall


def classify_quality(
    docs: DataFrame, labels: DataFrame, bad: Column, host: Column, path: Column, carry: list[str] = ("doc_id",),
    with_text: bool = False, threshold: float = 0.5,
) -> DataFrame:
    """Each document with ``p_doc`` (bad, by its text alone), ``host_bad``, ``path_bad``, ``p_bad`` (all evidence) and
    ``rejected``.

    ``labels`` has ``doc_id``; ``bad`` is a condition on its columns. Labels that are null or name no document are not
    used; several labels of one id count as bad if one is. Null and empty texts are bad. A null host or path is a site
    of its own ('').  Without labels nothing but empty texts is rejected. Repeated rows are scored alike; an empty
    table gives an empty result.
    """
    model = fitted(docs, labels, bad)
    if not len(model.weight) or not np.isfinite(model.weight).all():
        model.weight, model.bias = np.zeros(len(model.mean)), -5.0
    named = docs.select(
        *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(carry)], "text",
        F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"),
    )

    def scored(columns: list[str], keep_text: bool) -> DataFrame:
        part = named.select(*columns, "text")
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema if keep_text or f.name != "text")
        return part.mapInArrow(released(score_batches(model, keep_text)), f"{kinds}, doc_logit double")

    columns = [*[f"keep_{i}" for i in range(len(carry))], "host", "path"]
    if not with_text:
        first = stored(scored(columns, False), "scores")
        sites, overall = site_posteriors(first)
    else:  # the text is read twice, so that it is never shuffled or kept
        first = scored(columns, True)
        sites, overall = site_posteriors(scored(["host", "path"], False))
    if sites.count() <= SITES:
        sites = F.broadcast(sites)
    shift = logit(F.col("path_bad")) - logit(F.lit(overall))
    text = [F.col("text")] if with_text else []
    return first.join(sites, ["host", "path"], "left").select(
        *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(carry)], *[t.alias("kept_text") for t in text],
        (1 / (1 + F.exp(-F.col("doc_logit")))).alias("p_doc"), "host_bad", "path_bad",
        (1 / (1 + F.exp(-F.col("doc_logit") - shift))).alias("p_bad"),
    ).withColumn("rejected", F.col("p_bad") > threshold)
