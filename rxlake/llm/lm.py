"""Language-model scoring with a weighted backoff automaton over all n-grams of up to three tokens.

Model: a token's share after a history is smoothed with its share after the shorter one,
p(x | h) = (n(h x) + PRIOR * p(x | shorter h)) / (n(h) + PRIOR); at the root stand (n + 1) / (N + V + 1), which give an
unseen token its share. No token, count or number of n-grams is left out.

Automaton: the root, every token and every pair seen in training are states. A seen n-gram is an arc from its history
with that share; its end is the longest state that ends the text so far. Where a state has no arc for the next token,
its failure arc leads to the shorter history and costs PRIOR / (n(h) + PRIOR). A text is read once from left to right.

At scale: texts are taken in groups of about GROUP tokens. A group asks once for the count of each of its n-grams, in
buckets by hash, and gets the counts in the order in which it asked, so that the answers are mere numbers. From those it
builds the part of the automaton that its texts can meet, and reads them. As a group names each n-gram once, none is
asked for more often than there are groups, however frequent: no bucket is hot. Codes of tokens are ranks by frequency
for the FREQUENT ones that all tasks hold, else hashes; blocks of sorted codes compress to a few bytes an n-gram.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxlake.llm.bag_minhash import NOT_SPACE
from rxlake.llm.common import LOWER, ODD, RangeHash, mixed, released, row_blocks, stored, tokens_of, utf8

END = np.uint64(0x656E64)
FREQUENT = 300_000  # tokens whose codes and counts every task holds
PRIOR = 4.0
FLUSH = 2_000_000
GROUP = 1_000_000  # tokens of a group of texts; a longer text is a group by itself
PIECE = 256  # tokens read at a stretch, many stretches side by side
RARE = np.uint64(1 << 63)


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each token in order; every row ends with the end token."""
    data = LOWER[data]
    start, end, row = tokens_of(data, offsets, NOT_SPACE)
    words = RangeHash(data).of(start, end)
    rows = len(offsets) - 1
    at = np.searchsorted(row, np.arange(rows), "right")
    return np.insert(words, at, END), np.insert(row, at, np.arange(rows))


def count_batches(batches):
    """Counts of tokens, combined within the task."""
    held, size = [], 0

    def flush():
        code, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], ["code", "n"])

    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for a, b in row_blocks(offsets):
            held.append(token_hashes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])[0])
            size += len(held[-1])
            if size > FLUSH:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


class Frequent:
    """The most frequent tokens: sorted hashes, code of each (1 and on, by falling count) and count by code."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        by_count = np.lexsort((hashes, -counts))
        rank = np.empty(len(hashes), np.uint64)
        rank[by_count] = np.arange(1, len(hashes) + 1)
        order = np.argsort(hashes)
        self.hashes, self.rank, self.counts = hashes[order], rank[order], np.append(0, counts[by_count])

    def codes(self, words: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return words | RARE
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, self.rank[at], words | RARE)


class Grams:
    """Distinct tokens, pairs and triples of some texts, and which of them ends at each position (-1: none)."""

    def __init__(self, codes: np.ndarray, row: np.ndarray):
        self.vocab, self.word = np.unique(codes, return_inverse=True)
        words, size = len(self.vocab), len(codes)
        same = row[1:] == row[:-1]
        self.pair, self.triple = np.full(size, -1), np.full(size, -1)
        self.pairs, self.pair[1:][same] = np.unique((self.word[:-1] * words + self.word[1:])[same], return_inverse=True)
        run = same[1:] & same[:-1]
        self.triples, self.triple[2:][run] = np.unique((self.pair[1:-1] * words + self.word[2:])[run], return_inverse=True)

    def asked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of what to ask for: triples, pairs (after a 0) and rare tokens (after two), each sorted."""
        words = max(len(self.vocab), 1)
        pair, last = np.divmod(self.triples, words)
        first, second = np.divmod(self.pairs, words)
        rare = self.vocab[self.vocab >= RARE]
        none = lambda n: np.zeros(n, np.uint64)
        return (
            np.concatenate([self.vocab[first[pair]], none(len(first) + len(rare))]),
            np.concatenate([self.vocab[second[pair]], self.vocab[first], none(len(rare))]),
            np.concatenate([self.vocab[last], self.vocab[second], rare]),
        )

    def times(self, trains: np.ndarray) -> np.ndarray:
        """How often each n-gram asked for ends at a position that trains."""
        count = lambda at, n: np.bincount(at[trains & (at >= 0)], minlength=n)
        return np.concatenate([count(self.triple, len(self.triples)), count(self.pair, len(self.pairs)),
                               count(self.word, len(self.vocab))[self.vocab >= RARE]])


class Automaton:
    """The part of the automaton that the given n-grams can meet. States: 0 the root, then the tokens, then the pairs."""

    def __init__(self, grams: Grams, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, unit: float):
        """``words``, ``pairs``, ``triples``: training counts of each; ``unit``: N + V + 1."""
        size = max(len(grams.vocab), 1)
        self.tokens = len(grams.vocab)
        first, second = np.divmod(grams.pairs, size)
        history = grams.triples // size
        shorter = np.full(len(grams.triples), -1)  # a triple's last two tokens
        ends = grams.triple >= 0
        shorter[grams.triple[ends]] = grams.pair[ends]
        p1 = (words + 1) / unit
        p2 = (pairs + PRIOR * p1[second]) / (words[first] + PRIOR)
        p3 = (triples + PRIOR * p2[shorter]) / (pairs[history] + PRIOR) if len(triples) else np.zeros(0)
        self.fail = np.concatenate([np.zeros(1 + self.tokens, np.int64), 1 + second])
        self.back = np.log10(PRIOR / (np.concatenate([[0], words, pairs]) + PRIOR))
        state = 1 + np.arange(self.tokens)
        # arcs from the root, from tokens and from pairs: weight, end (-1 where there is no arc)
        self.weight = [np.log10(p1), np.log10(p2), np.log10(p3)]
        pair_state = 1 + self.tokens + np.arange(len(pairs))
        self.end = [np.where(words > 0, state, 0), np.where(pairs > 0, pair_state, -1), np.where(triples > 0, pair_state[shorter] if len(triples) else 0, -1)]

    def read(self, grams: Grams, offsets: np.ndarray) -> np.ndarray:
        """Log10 probability of each text (``offsets``: its first token), read from left to right in stretches side by
        side. A stretch within a text starts two tokens earlier at the root: no state looks back further."""
        lengths = np.diff(offsets)
        stretches = -(-lengths // PIECE)
        text = np.repeat(np.arange(len(lengths)), stretches)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
        begin = offsets[text] + nth * PIECE
        stop = np.minimum(begin + PIECE, offsets[text + 1])
        start = np.maximum(begin - 2, offsets[text])
        order = np.argsort(start - stop, kind="stable")
        start, begin, stop = start[order], begin[order], stop[order]
        total, state = np.zeros(len(start)), np.zeros(len(start), np.int64)
        met = [grams.word, grams.pair, grams.triple]
        live = len(start)
        for step in range(int((stop - start).max(initial=0))):
            while start[live - 1] + step >= stop[live - 1]:
                live -= 1
            at, s = start[:live] + step, state[:live]
            cost, open_ = np.zeros(live), np.ones(live, bool)
            for depth, least in ((2, self.tokens), (1, 0), (0, -1)):
                here = np.flatnonzero(open_ & (s > least))
                arc = met[depth][at[here]]
                end = self.end[depth][arc] if len(here) else arc
                hit = end >= 0
                there, gone = here[hit], here[~hit]
                cost[there] += self.weight[depth][arc[hit]]
                s[there] = end[hit]
                open_[there] = False
                cost[gone] += self.back[s[gone]]
                s[gone] = self.fail[s[gone]]
            total[:live] += np.where(at >= begin[:live], cost, 0.0)
        return np.bincount(text[order], total, len(lengths))


def packed(*columns: np.ndarray) -> bytes:
    """Columns as one compressed block, first bytes first, since the high bytes are mostly zero."""
    return pa.compress(b"".join(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns), "zstd", asbytes=True)


def unpacked(block: bytes, *columns: tuple[type, int]) -> list[np.ndarray]:
    sizes = [np.dtype(t).itemsize * n for t, n in columns]
    raw, found, at = np.frombuffer(pa.decompress(block, sum(sizes), "zstd"), np.uint8), [], 0
    for (t, n), size in zip(columns, sizes):
        found.append(np.ascontiguousarray(raw[at:at + size].reshape(np.dtype(t).itemsize, n).T).view(t).ravel())
        at += size
    return found


def short_codes(codes: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """32-bit codes: rare tokens by their place in ``rare``, from the top."""
    short = codes.astype(np.uint32)
    at = codes >= RARE
    short[at] = np.uint32(1 << 31) + np.searchsorted(rare, codes[at]).astype(np.uint32)
    return short


def long_codes(short: np.ndarray, rare: np.ndarray) -> np.ndarray:
    codes = short.astype(np.uint64)
    at = short >= np.uint32(1 << 31)
    codes[at] = rare[short[at] - np.uint32(1 << 31)]
    return codes


def gram_hash(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    return mixed(mixed(mixed(x * ODD + np.uint64(1)) + y) * ODD + z)


def groups_of(batches, frequent: Frequent):
    """Groups of texts: number, codes and rows of the tokens, ids, and the columns ``held_out`` and ``trains``."""
    number, held, size = None, [], 0

    def flush():
        codes, lengths = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        return number, codes, np.repeat(np.arange(len(lengths)), lengths), lengths, pa.concat_tables(h[2] for h in held)

    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        rest = pa.Table.from_batches([batch.select(["doc_id", "held_out", "trains"])])
        if number is None and len(batch):
            number = batch.column("part")[0].as_py() << 32
        for a, b in row_blocks(offsets):
            words, row = token_hashes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            if held and size + len(words) > GROUP:
                yield flush()
                number, held, size = number + 1, [], 0
            held.append((frequent.codes(words), np.bincount(row, minlength=b - a), rest.slice(a, b - a)))
            size += len(words)
    if held:
        yield flush()


def checksum(codes: np.ndarray) -> int:
    """Of codes and their order: both readings of the texts must have formed the same groups."""
    return int(mixed(codes + np.arange(len(codes), dtype=np.uint64) * ODD).sum(dtype=np.uint64).view(np.int64))


BLOCKS = "bucket int, grp long, sum long, n int, rare int, docs int, data binary"


def blocks(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, types)], names)


def bucket_order(asked: tuple, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """What is asked for in order of buckets, and where each bucket begins."""
    bucket = (gram_hash(*asked) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    return np.argsort(bucket, kind="stable"), np.append(0, np.cumsum(np.bincount(bucket, minlength=buckets)))


def ask_batches(held_by_tasks, buckets: int):
    """A block a bucket: the n-grams of a group and how often each occurs in its training texts."""

    def run(batches):
        for number, codes, row, _, rest in groups_of(batches, held_by_tasks.value):
            grams = Grams(codes, row)
            asked, times = grams.asked(), grams.times(rest.column("trains").to_numpy()[row]).astype(np.uint32)
            order, begin = bucket_order(asked, buckets)
            rows, total = [], checksum(codes)
            for bucket in np.flatnonzero(np.diff(begin)):
                of = order[begin[bucket]:begin[bucket + 1]]
                part = [c[of] for c in asked]
                rare = np.unique(np.concatenate([c[c >= RARE] for c in part]))
                x, y, z = (short_codes(c, rare) for c in part)
                data = packed(np.diff(x, prepend=np.uint32(0)), y, z, times[of], rare)
                rows.append((int(bucket), number, total, len(of), len(rare), 0, data))
            yield blocks(rows)

    return released(run)


def answer(table: pa.Table) -> pa.Table:
    """All blocks of a bucket, each answered by the counts of its n-grams over all groups."""
    parts, rows = [], table.to_pylist()
    for r in rows:
        n, rare = r["n"], r["rare"]
        step, y, z, times, words = unpacked(r["data"], (np.uint32, n), (np.uint32, n), (np.uint32, n), (np.uint32, n), (np.uint64, rare))
        r["data"] = None
        x = np.cumsum(step, dtype=np.uint32)
        parts.append((gram_hash(*(long_codes(c, words) for c in (x, y, z))), times))
    _, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    count = np.bincount(of, np.concatenate([p[1] for p in parts])).astype(np.uint64)[of]
    ends = np.cumsum([len(p[0]) for p in parts])
    return pa.Table.from_batches([blocks([
        (r["bucket"], r["grp"], r["sum"], r["n"], 0, 0, packed(count[end - r["n"]:end])) for r, end in zip(rows, ends)])])


def text_batches(held_by_tasks):
    """A block a group: the codes of its tokens, the lengths of its texts, their ids and marks."""

    def run(batches):
        for number, codes, _, lengths, rest in groups_of(batches, held_by_tasks.value):
            rare = np.unique(codes[codes >= RARE])
            ids = rest.column("doc_id")
            marks = rest.column("held_out").to_numpy().astype(np.uint8) + 2 * ids.is_null().to_numpy().astype(np.uint8)
            data = packed(short_codes(codes, rare), rare, lengths.astype(np.int64), ids.fill_null(0).to_numpy(), marks)
            yield blocks([(-1, number, checksum(codes), len(codes), len(rare), len(lengths), data)])

    return released(run)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def read_group(held_by_tasks, buckets: int, unit: float):
    """The texts of a group read by the automaton of its n-grams."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        texts = [r for r in rows if r["bucket"] < 0]
        if len(texts) != 1 or {r["sum"] for r in rows} != {texts[0]["sum"]}:
            raise RuntimeError("the texts were not read twice in the same order: score a stored table")
        n, rare, docs = texts[0]["n"], texts[0]["rare"], texts[0]["docs"]
        short, words, lengths, ids, marks = unpacked(texts[0]["data"], (np.uint32, n), (np.uint64, rare), (np.int64, docs), (np.int64, docs), (np.uint8, docs))
        codes, offsets = long_codes(short, words), np.append(0, np.cumsum(lengths))
        row = np.repeat(np.arange(docs), lengths)
        grams = Grams(codes, row)
        order, begin = bucket_order(grams.asked(), buckets)
        counts = np.zeros(len(order), np.uint64)
        for r in rows:
            if r["bucket"] >= 0:
                counts[order[begin[r["bucket"]]:begin[r["bucket"] + 1]]] = unpacked(r["data"], (np.uint64, r["n"]))[0]
        triples, pairs, few = np.split(counts.astype(np.float64), np.cumsum([len(grams.triples), len(grams.pairs)]))
        usual = grams.vocab[grams.vocab < RARE].astype(np.int64)
        single = np.concatenate([held_by_tasks.value.counts[usual].astype(np.float64), few])
        automaton = Automaton(grams, single, pairs, triples, unit)
        sums = lambda x: np.bincount(row, x[grams.word], docs)
        return pa.table({
            "doc_id": pa.array(ids, mask=marks >= 2), "held_out": pa.array((marks & 1).astype(bool)), "n_tokens": pa.array(lengths),
            "n_known": pa.array(sums((single > 0).astype(float)).astype(np.int64)),
            "base_score": pa.array(sums(np.log10((single + 1) / unit))), "score": pa.array(automaton.read(grams, offsets)),
        })

    return run


def freed(run):
    """A function of one table, after which its worker gives freed memory back."""
    batchwise = released(lambda tables: map(run, tables))
    return lambda table: list(batchwise([table]))[0]


def most_frequent(counts: DataFrame) -> Frequent:
    """Up to FREQUENT tokens: all that occur at least so often."""
    room, least = FREQUENT, None
    for n, size in counts.where("n > 1").groupBy("n").count().orderBy(F.desc("n")).limit(FREQUENT).collect():
        if size > room:
            break
        room, least = room - size, n
    if least is None:
        return Frequent(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    found = counts.where(F.col("n") >= least).select("code", "n").toArrow()  # bounded by a parameter
    return Frequent(found.column("code").to_numpy().view(np.uint64), found.column("n").to_numpy())


def score_texts(docs: DataFrame, trains: Column) -> DataFrame:
    """Each document with ``held_out`` (``trains`` is false), ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``
    and ``score``, the automaton's log10 probability of the text.

    ``docs`` is read three times and must give the same rows in the same order, as a table does; else it fails.
    Null text is empty and consists of the end token alone. Every row gets a result, also repeated ones. Where
    ``trains`` is null, as for a null id, a row neither trains nor counts as held out. Without training texts all tokens
    are unknown and share 1. A text of any length is read whole; a group holds it and its n-grams in memory. An empty
    table gives an empty result.
    """
    marked = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"),
                         F.coalesce(~trains, F.lit(False)).alias("held_out"), F.coalesce(trains, F.lit(False)).alias("trains"),
                         F.spark_partition_id().alias("part"))
    training = marked.where("trains").select("text")
    counts = stored(training.mapInArrow(released(count_batches), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "counts")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    unit = float(total + kinds + 1)
    buckets = total // (1 << 20) + 1
    held_by_tasks = docs.sparkSession.sparkContext.broadcast(most_frequent(counts))
    asked = marked.mapInArrow(ask_batches(held_by_tasks, buckets), BLOCKS).repartition(buckets, "bucket")
    answers = asked.groupBy("bucket").applyInArrow(freed(answer), BLOCKS)
    texts = marked.mapInArrow(text_batches(held_by_tasks), BLOCKS)
    grouped = answers.unionByName(texts).repartition(buckets, "grp").groupBy("grp")
    return grouped.applyInArrow(freed(read_group(held_by_tasks, buckets, unit)), SCORES).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
