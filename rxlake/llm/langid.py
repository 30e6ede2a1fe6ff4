"""Language identification with a byte convolutional network, trained in numpy.

A text is lower-cased and cut into windows of 128 bytes. Filters of two, three and four bytes slide over each window,
the largest response of every filter is kept, and a softmax over these gives the window's language; a document's
score is the mean over all of its windows, weighted by their lengths. Since the inputs are bytes, a filter is a sum of
one table row per place, and neighbouring places are folded into tables over byte pairs for prediction.

The network learns from a documented, bounded sample of labelled documents, drawn per language by a hash of the id
over the whole table, with windows spread over the whole of each text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxlake.llm.common import row_blocks, utf8

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
CLASSES = 256  # every byte has its own, by frequency in the sample; padding shares class 0 with one that UTF-8 never has
PER_LANGUAGE = 300  # training documents of each language, about
PER_TEXT = 6  # training windows of each document
LANGUAGES = 10_000  # more names of languages than this are refused, as the column then holds something else
EPOCHS = 8


@dataclass
class Network:
    languages: list[str]
    byte_class: np.ndarray
    filters: list[np.ndarray]  # per width: (width, CLASSES, FILTERS)
    bias: np.ndarray
    weight: np.ndarray
    offset: np.ndarray

    def pair_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses from bytes (i, i + 1) for all widths, and from bytes (i + 2, i + 3) for widths three and four."""
        two, three, four = self.filters
        head = np.concatenate([t[0][:, None, :] + t[1][None, :, :] for t in (two, three, four)], 2) + self.bias
        tail = np.concatenate([np.repeat(three[2][:, None, :], CLASSES, 1), four[2][:, None, :] + four[3][None, :, :]], 2)
        return head.reshape(CLASSES * CLASSES, -1).astype(np.float32), tail.reshape(CLASSES * CLASSES, -1).astype(np.float32)


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the windows of each row."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[row] + place * WINDOW
    return start, np.minimum(start + WINDOW, offsets[row + 1]), row


def trained(texts: list[str], labels: list[str], languages: list[str], seed: int = 3) -> Network:
    """Adam on minibatches; only the winning place of each filter passes a gradient."""
    rng = np.random.default_rng(seed)
    data, offsets = utf8(pc.utf8_lower(pa.array(texts, pa.string())))
    frequent = np.argsort(-np.bincount(data, minlength=256), kind="stable")
    frequent = frequent[frequent != 0xFF][: CLASSES - 1]
    byte_class = np.zeros(256, np.int64)
    byte_class[frequent] = np.arange(1, len(frequent) + 1)
    start, end, row = windows_of(data, offsets)
    pick = np.concatenate([
        lo + np.unique(np.linspace(0, hi - lo - 1, PER_TEXT).astype(int))
        for lo, hi in zip(*(np.searchsorted(row, np.arange(len(texts)), side) for side in ("left", "right"))) if hi > lo
    ]) if len(row) else np.zeros(0, int)
    x = np.zeros((len(pick), WINDOW + 3), np.int64)
    for i, p in enumerate(pick):
        x[i, : end[p] - start[p]] = byte_class[data[start[p]:end[p]]]
    place = {v: i for i, v in enumerate(languages)}
    y = np.array([place[labels[r]] for r in row[pick]], int)
    shapes = [(w, CLASSES, FILTERS) for w in WIDTHS]
    total = FILTERS * len(WIDTHS)
    params = [*(rng.normal(0, 0.3, s) for s in shapes), np.zeros(total), rng.normal(0, 0.1, (total, len(languages))), np.zeros(len(languages))]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        for some in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            if not len(some):
                continue
            step += 1
            xb, n = x[some], len(some)
            grads = [np.zeros_like(p) for p in params]
            tops, where = [], []
            for k, w in enumerate(WIDTHS):
                out = sum(params[k][o][xb[:, o:o + WINDOW]] for o in range(w))
                at = out.argmax(1)
                where.append(at)
                tops.append(np.take_along_axis(out, at[:, None, :], 1)[:, 0, :])
            top = np.concatenate(tops, 1) + params[3]
            act = np.maximum(top, 0)
            z = act @ params[4] + params[5]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(n), y[some]] -= 1
            p /= n
            grads[4], grads[5] = act.T @ p + 1e-4 * params[4], p.sum(0)
            back = (p @ params[4].T) * (top > 0)
            grads[3] = back.sum(0)
            for k, w in enumerate(WIDTHS):
                part = back[:, k * FILTERS:(k + 1) * FILTERS]
                for o in range(w):
                    seen = np.take_along_axis(xb, where[k] + o, 1)
                    np.add.at(grads[k][o], (seen, np.arange(FILTERS)[None, :]), part)
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] -= 0.01 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Network(languages, byte_class, params[:3], params[3], params[4].astype(np.float32), params[5].astype(np.float32))


def probabilities(network: Network, tables, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Language probabilities of each row: the mean of its windows, weighted by their lengths."""
    head, tail = tables
    rows = len(offsets) - 1
    result = np.zeros((rows, len(network.languages)))
    for a, b in row_blocks(offsets, 1 << 15):
        part = data[offsets[a]:offsets[b]]
        if not len(part):
            continue
        off = offsets[a:b + 1] - offsets[a]
        size = np.diff(off)
        shift = 3 * np.arange(b - a)  # three padding bytes after each row
        code = np.zeros(len(part) + 3 * (b - a) + 3, np.int64)
        code[np.arange(len(part)) + np.repeat(shift, size)] = network.byte_class[part]
        pair = code[:-1] * CLASSES + code[1:]
        start, end, row = windows_of(part, off)
        start, length = start + shift[row], end - start
        logits = []
        for i in range(0, len(start), 256):
            s = start[i:i + 256]
            stop = s[-1] + length[i:i + 256][-1]
            out = head[pair[s[0]:stop]]
            out[:, FILTERS:] += tail[pair[s[0] + 2:stop + 2]]
            top = np.maximum(np.maximum.reduceat(out, s - s[0], axis=0), 0)
            logits.append(top @ network.weight + network.offset)
        z = np.concatenate(logits).astype(np.float64)
        p = np.exp(z - z.max(1, keepdims=True))
        p *= (length / p.sum(1))[:, None]
        np.add.at(result, a + row, p)
    return result / np.maximum(result.sum(1, keepdims=True), 1e-300)


def predict_batches(network: Network):
    def run(batches):
        tables = network.pair_tables()
        for batch in batches:
            text = pc.utf8_lower(pc.fill_null(batch.column("text"), ""))
            data, offsets = utf8(text)
            p = probabilities(network, tables, data, offsets)
            lettered = batch.column("lettered").to_numpy(False).astype(bool)
            which = p.argmax(1)
            names = [network.languages[i] if ok else "und" for i, ok in zip(which, lettered)]
            score = np.where(lettered, np.clip(p.max(1), 0, 1), 0.0)
            rest = [n for n in batch.schema.names if n not in ("text", "lettered")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in rest), pa.array(names, pa.string()), pa.array(score)], [*rest, "lang_pred", "score"]
            )

    return run


def sample(docs: DataFrame, trains: Column) -> tuple[list[str], list[str], list[str]]:
    """Texts and languages to learn from, and the languages."""
    usable = docs.where(trains & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    if not counts:
        return [], [], []
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], int(1_000_000 * min(1.0, PER_LANGUAGE / r["n"])) + 1)])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000))
    rows = usable.where(draw < share[F.col("lang")]).select("text", "lang").limit(2 * PER_LANGUAGE * len(counts)).toArrow()
    languages = sorted(r["lang"] for r in counts)
    return rows.column("text").to_pylist(), rows.column("lang").to_pylist(), languages


def identify(docs: DataFrame, trains: Column, carry: list[str] = ("doc_id",)) -> DataFrame:
    """Each document with ``lang_pred`` and ``score`` (0 to 1), from its text alone.

    Learns from rows where ``trains`` holds, ``lang`` is not null and the text has a letter. Null texts and texts
    without a letter are ``und`` with score 0; so is everything if nothing can be learned. Every row gets a result,
    also repeated ones and those with a null id. A text of any length is read whole, window by window. More than
    LANGUAGES languages are an error; none is left out. An empty table gives an empty result.
    """
    texts, labels, languages = sample(docs, trains)
    kept = docs.select(
        *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(carry)], "text",
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
    )
    names = [F.col(f"keep_{i}").alias(c) for i, c in enumerate(carry)]
    if not languages or not texts:
        return kept.select(*names, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    network = trained(texts, labels, languages)
    kinds = ", ".join(f"keep_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    return kept.mapInArrow(predict_batches(network), f"{kinds}, lang_pred string, score double").select(*names, "lang_pred", "score")
