"""Near-duplicate classes by BagMinHash over the multiset of word shingles.

A document is the multiset of its runs of five words. Each shingle with multiplicity w spans the weights (0, w], cut
at the discrete levels 1, 2, 4, 8, ...; every cell between two levels carries a Poisson process of its own, whose
points come in ascending order from a hash of (shingle, cell), fall on a random signature component, and lie at a
random weight inside the cell (found by halving it), where a point beyond w is passed over. The least point of each
component is the signature: two documents agree in a component with the probability of their weighted Jaccard
similarity. A process is followed only until it passes the largest value that its document still holds, so a long
document costs little more than one point per shingle.

Signatures are banded (32 bands of 4; a pair at 0.8 is missed with probability 5e-8). Candidates are kept if the
signatures agree often enough, and what decides is the overlap of the multisets. Classes are the components of the
pairs at the threshold or above: the best partner of each document is verified first, and then every candidate pair
whose members are still apart. A bucket of many members is first compared with its head, the member with the least
share of shingles that nobody else has; then in bounded blocks, whole bags against whole bags and only across components; two blocks
report as many links as join their components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxlake.llm.common import ODD, RangeHash, mixed, released, row_blocks, stored, tokens_of, utf8
from rxlake.llm.components import components

WORDS = 5
THRESHOLD = 0.8
SIZE = 128
BANDS = 32
SMALL = 24  # buckets of up to so many members are compared whole at once, larger ones in blocks
BLOCK = 256
SPREAD = 1_024  # members of a bucket that look up their bucket's row under one key
SIEVE = 1 << 23  # bits; more ids than that only let more texts through to the join
NO_ID = -(1 << 63)
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row as (row, hash, multiplicity); fewer than five words make one shingle."""
    start, end, row = tokens_of(data, offsets, NOT_SPACE)
    words = RangeHash(data).of(start, end)
    count = np.bincount(row, minlength=len(offsets) - 1)
    value = np.zeros(len(words), np.uint64)
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    rows = np.concatenate([row, np.full(WORDS, -1)])
    for j in range(WORDS):
        value = value * np.uint64(0xD6E8FEB86659FD93) + np.where(rows[j:j + len(row)] == row, padded[j:j + len(row)], np.uint64(7))
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    keep = place < np.maximum(count[row] - WORDS + 1, 1)
    value, row = mixed(value[keep]), row[keep]
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    return row[at], value[at], np.diff(np.append(at, len(value)))


def signatures(row: np.ndarray, value: np.ndarray, weight: np.ndarray, rows: int, size: int = SIZE) -> np.ndarray:
    """Least point of each component; infinite for a row without shingles."""
    low, high, seed, doc, most = [], [], [], [], []
    lo, hi, level = 0, 1, 0
    while True:
        here = weight > lo
        if not here.any():
            break
        n = int(here.sum())
        low.append(np.full(n, lo))
        high.append(np.full(n, hi))
        seed.append(mixed(value[here] + np.array([level], np.uint64) * ODD))
        doc.append(row[here])
        most.append(weight[here])
        lo, hi, level = hi, hi * 2, level + 1
    least = np.full(rows * size, np.inf)
    if not doc:
        return least.reshape(rows, size)
    low, high, seed, doc, most = (np.concatenate(x) for x in (low, high, seed, doc, most))
    point, step = np.zeros(len(doc)), 0
    while len(doc):
        step += 1
        draw = mixed(seed + np.array([step], np.uint64) * ODD)
        gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53)
        point = point + gap / (size * (high - low))
        draw = mixed(draw ^ np.uint64(0xA0761D6478BD642F))
        place = doc * size + (draw % np.uint64(size)).astype(np.int64)
        at = low + 1 + (((draw >> np.uint64(32)) * (high - low).astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        within = at <= most
        np.minimum.at(least, place[within], point[within])
        go = point < least.reshape(rows, size).max(1)[doc]
        low, high, seed, doc, most, point = (x[go] for x in (low, high, seed, doc, most, point))
    return least.reshape(rows, size)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows, size = signature.shape
    bits = signature.view(np.uint64).reshape(rows, bands, size // bands)
    key = np.tile(np.arange(bands, dtype=np.uint64) * ODD, (rows, 1))
    for j in range(bits.shape[2]):
        key = mixed(key ^ bits[:, :, j])
    return key.view(np.int64)


def sign_batches(batches):
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        ids, docs = batch.column("id"), batch.column("doc")
        for a, b in row_blocks(offsets):
            part, off = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
            row, value, weight = shingles(part, off)
            least = signatures(row, value, weight, b - a)
            keys = band_keys(least)
            has_words = np.bincount(row, minlength=b - a) > 0
            short = (mixed(least.view(np.uint64)) & np.uint64(255)).astype(np.uint8)
            bands = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(has_words * BANDS)]).astype(np.int32)), pa.array(keys[has_words].ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [docs.slice(a, b - a), ids.slice(a, b - a), bands, pa.array([x.tobytes() for x in short], pa.binary())],
                ["doc", "id", "bands", "short"],
            )


def shingle_batches(batches):
    """Sorted 64-bit shingle hashes with repeats, as bytes."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        for a, b in row_blocks(offsets):
            row, value, weight = shingles(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            each = np.repeat(value, weight)
            cuts = np.concatenate([[0], np.cumsum(np.bincount(row, weight, b - a).astype(np.int64))])
            bags = [each[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(bags, pa.binary())], ["id", "bag"])


def distinct_batches(batches):
    """Each document's distinct shingles with their multiplicities."""
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            found = [np.unique(np.frombuffer(v.as_buffer(), np.int64), return_counts=True) for v in part.column("bag")]
            sizes = pa.array(np.repeat(np.arange(len(found)), [len(v) for v, _ in found]))
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(sizes), pa.array(np.concatenate([v for v, _ in found])), pa.array(np.concatenate([n for _, n in found]))],
                ["id", "shingle", "times"],
            )


def freshness(bags: DataFrame) -> DataFrame:
    """For each document its number of shingles (``total``) and of those that no other of these documents has."""
    each = bags.mapInArrow(released(distinct_batches), "id long, shingle long, times long")
    single = each.groupBy("shingle").agg(F.count("*").alias("docs"), F.min("id").alias("id"), F.min("times").alias("times"))
    alone = single.where("docs = 1").groupBy("id").agg(F.sum("times").alias("fresh"))
    totals = bags.select("id", (F.length("bag") / 8).cast("long").alias("total"))
    return totals.join(alone, "id", "left").select("id", "total", F.coalesce("fresh", F.lit(0)).alias("fresh"))


def sieve(ids: DataFrame) -> np.ndarray:
    """A table of ``SIEVE`` bits, set at the remainders of the ids: one megabyte, however many ids there are."""
    bit = F.pmod("id", F.lit(SIEVE))
    words = ids.groupBy(F.floor(bit / 64).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(id, {SIEVE}) % 64 AS INT))")).alias("bits"))
    found = words.toArrow()
    table = np.zeros(SIEVE // 64, np.uint64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return table


def sifted(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids have their bit set: all that the table was made of, and few others."""
    bit = np.mod(ids, SIEVE).astype(np.uint64)
    return (table[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def bags_of(keyed: DataFrame, ids: DataFrame) -> DataFrame:
    """Shingle bags of the documents with these ids.

    Most texts are nobody's partner: they are left out before the join by a bounded table of bits, so that only bags of
    those wanted are shuffled, and no text. The join decides.
    """
    ids = stored(ids, "wanted")
    table = keyed.sparkSession.sparkContext.broadcast(sieve(ids))

    def wanted_batches(batches):
        for batch in batches:
            some = batch.filter(pa.array(sifted(table.value, batch.column("id").to_numpy())))
            if some.num_rows:
                yield from shingle_batches([some])

    found = keyed.mapInArrow(released(wanted_batches), "id long, bag binary").join(ids.hint("merge"), "id", "left_semi")
    return stored(found.groupBy("id").agg(F.min("bag").alias("bag")), "bags")


def overlap(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted bags."""
    a, n = np.unique(x, return_counts=True)
    b, m = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    total = len(x) + len(y) - both
    return both / total if total else 0.0


def of_bucket(members: DataFrame, table: DataFrame) -> DataFrame:
    """Members (``band``, ``id``, ``n``) with their bucket's row of ``table``; crowded buckets are dealt over several keys."""
    parts = F.ceil(F.col("n") / SPREAD).cast("int")
    copies = table.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    return members.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).join(copies, ["band", "part"]).drop("part")


def verify_batches(threshold: float):
    def run(batches):
        for batch in batches:
            bags = [[np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in ("bag_a", "bag_b")]
            likeness = np.array([overlap(x, y) for x, y in zip(*bags)])
            keep = pa.array(likeness >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(likeness).filter(keep)], ["a", "b", "likeness"]
            )

    return run


def agreement(threshold: float) -> int:
    """Agreeing components a pair at the threshold reaches but for four and a half standard deviations."""
    return int(SIZE * threshold - 4.5 * (SIZE * threshold * (1 - threshold)) ** 0.5)


def item_batches(batches):
    """Bags as sets of 32-bit items, the second occurrence of a shingle being an item of its own, and so on."""
    for batch in batches:
        items = []
        for bag in batch.column("bag"):
            value = np.frombuffer(bag.as_buffer(), np.uint64)
            first = np.searchsorted(value, value, "left")
            items.append((mixed(value + (np.arange(len(value)) - first).astype(np.uint64) * ODD) >> np.uint64(32)).astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(items, pa.binary())], ["id", "items"])


def agreeing(batches):
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(x.as_py() for x in batch.column(c)), np.uint8).reshape(-1, SIZE) for c in ("short_a", "short_b"))
            same = (a == b).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(same.astype(np.int32))], ["a", "b", "same"])


COLUMNS = 8_192


def common_items(bags: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of common items of each left with each right bag, by products over slices of the items."""
    row = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    _, code, count = np.unique(np.concatenate(bags), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[code]
    row, code = row[keep], number[code[keep]]
    both = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    for a in range(0, int(shared.sum()), COLUMNS):
        some = slice(*np.searchsorted(code, [a, a + COLUMNS]))
        holds = np.zeros((len(bags), COLUMNS), np.float32)
        holds[row[some], code[some] - a] = 1
        both += holds[left] @ holds[right].T
    return both


def spanning(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Places of edges (u, v) that join the nodes into trees with the same components as all edges."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    edge = np.full((len(nodes), len(nodes)), -1)
    edge[ends[: len(u)], ends[len(u):]] = edge[ends[len(u):], ends[: len(u)]] = np.arange(len(u))
    left, chosen = np.ones(len(nodes), bool), []
    for root in range(len(nodes)):
        reached = [root] if left[root] else []
        left[root] = False
        while reached:
            at = reached.pop()
            new = np.flatnonzero(left & (edge[at] >= 0))
            left[new] = False
            chosen.append(edge[at, new])
            reached += new.tolist()
    return np.concatenate([np.zeros(0, np.int64), *chosen])


def across_blocks(threshold: float):
    """Links between two blocks of a crowded bucket: as many as join the components that the blocks' near pairs join."""

    def run(table: pa.Table) -> pa.Table:
        side, ids, labels = (table.column(c).to_numpy() for c in ("side", "id", "label"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return pa.table({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        bags = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("items").combine_chunks()]
        size = np.array([len(b) for b in bags], float)
        both = common_items(bags, left, right)
        total = size[left][:, None] + size[right][None, :] - both
        i, j = np.nonzero((both >= threshold * total - 1e-6) & (labels[left][:, None] != labels[right][None, :]))
        some = spanning(labels[left[i]], labels[right[j]])
        a, b = ids[left[i[some]]], ids[right[j[some]]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Each distinct ``doc_id`` and text (``text_id``, its hash) with the class of near duplicates it belongs to.

    A class is named by its least member: ``class_id`` is that one's id and ``class_text`` its ``text_id``. Two texts
    are linked if the multisets of their five-word shingles have a weighted Jaccard similarity of ``threshold`` or
    more; classes are the connected components. Null and empty texts are equal to each other and to nothing else. Only
    texts link rows: different texts without an id, or under one id, are rows of their own. A null id is reported as
    null and comes before all others. An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("doc"), F.xxhash64(text).alias("id"), text.alias("text"))
    keyed = rows.select("id", "text")  # a node is a text, so equal texts are one
    signed = stored(rows.mapInArrow(released(sign_batches), "doc long, id long, bands array<long>, short binary"), "signed")
    owners = signed.select("doc", "id")
    firsts = stored(signed.groupBy("id").agg(F.min(F.struct("bands", "short")).alias("s")).select("id", "s.*"), "firsts")

    rows = firsts.select("id", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("head")).where("n > 1")
    rows = stored(rows.join(buckets, "band"), "buckets")
    in_small = rows.where(F.col("n") <= SMALL).groupBy("band").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    pairs = in_small.select(
        F.explode(F.expr("flatten(transform(ids, (x, i) -> transform(slice(ids, i + 2, size(ids)), y -> struct(x as a, y as b))))")).alias("p")
    ).select("p.*")
    # crowded buckets: what a document shares with nobody bounds its likeness to any other, and the head of a bucket is
    # the member with the least of that
    crowd = stored(rows.where(F.col("n") > SMALL).select("band", "id", "n"), "crowd")
    crowd_bags = bags_of(keyed, crowd.select("id").distinct())
    # joins on the document take one row each, with its buckets (one a band at most) in a list
    places = crowd.groupBy("id").agg(F.collect_list(F.struct("band", "n")).alias("places"))
    weighed = stored(places.join(freshness(crowd_bags), "id"), "weighed")
    each_place = F.inline("places")
    items = stored(crowd_bags.mapInArrow(released(item_batches), "id long, items binary"), "items")
    head = weighed.select("id", (F.col("fresh") / F.col("total")).alias("share"), each_place).groupBy("band").agg(
        F.min_by("id", F.struct("share", "id")).alias("head"), F.max("n").alias("n"))
    heads = of_bucket(crowd, head).where("id != head").select(F.least("head", "id").alias("a"), F.greatest("head", "id").alias("b"))
    shorts = firsts.select("id", "short")
    least = agreement(threshold)

    def compared(pairs: DataFrame) -> DataFrame:
        both = pairs.join(shorts.select(F.col("id").alias("a"), F.col("short").alias("short_a")), "a")
        both = both.join(shorts.select(F.col("id").alias("b"), F.col("short").alias("short_b")), "b")
        return both.mapInArrow(released(agreeing), "a long, b long, same int").where(F.col("same") >= least)

    likely = stored(compared(stored(pairs.union(heads).distinct(), "pairs")), "likely")
    partners = likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct()
    bags = bags_of(keyed, partners.join(crowd_bags.select("id"), "id", "left_anti")).unionByName(crowd_bags)

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.select("a", "b").join(bags.select(F.col("id").alias("a"), F.col("bag").alias("bag_a")), "a")
        both = both.join(bags.select(F.col("id").alias("b"), F.col("bag").alias("bag_b")), "b")
        return both.mapInArrow(released(verify_batches(threshold)), "a long, b long, likeness double").select("a", "b")

    both_ways = likely.union(likely.select("b", "a", "same"))
    best = both_ways.groupBy("a").agg(F.max_by("b", "same").alias("b"))
    best = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = stored(verified(best), "links")
    first_labels = components(links)

    def labelled(ids: DataFrame) -> DataFrame:
        return ids.join(first_labels.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))

    apart = likely.select("a", "b").join(first_labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left")
    apart = apart.join(first_labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    apart = apart.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")

    crowded = stored(labelled(weighed), "crowded")
    sizes = crowded.select("label", each_place).groupBy("band", "label").agg(F.count("*").alias("size"), F.max("n").alias("n"))
    main = sizes.groupBy("band").agg(F.max_by("label", "size").alias("main"), F.count("*").alias("labels"), F.max("n").alias("n"))
    main = main.where("labels > 1").drop("labels")
    # a document of which too much is its own is near to none
    able = crowded.where(F.col("total") - F.col("fresh") >= threshold * F.col("total") - 1e-9)
    members = of_bucket(able.select("id", "label", each_place), main)
    members = members.groupBy("id", "label").agg(F.collect_list(F.struct("band", "n", "main")).alias("places"))
    members = stored(members.join(items, "id"), "members").select("id", "label", "items", each_place)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    left = members.where("label != main").select("band", own.alias("i"), every.alias("j"), F.lit(0).alias("side"), "id", "label", "items")
    busy = members.where("label != main").select("band", own.alias("i")).distinct()
    right = members.select("band", own.alias("j"), F.lit(1).alias("side"), "id", "label", "items", "main").join(busy, "band")
    right = right.where("label = main or j >= i").drop("main")  # two blocks of documents outside the main component meet once
    far = left.unionByName(right).groupBy("band", "i", "j").applyInArrow(across_blocks(threshold), "a long, b long").distinct()
    more = stored(verified(apart).union(far), "more")

    labels = components(links.union(more))
    classes = owners.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    least_row = classes.groupBy("label").agg(F.min(F.struct("doc", "id")).alias("least"))
    columns = ["doc", F.col("id").alias("text_id"), F.col("least.doc").alias("class_id"), F.col("least.id").alias("class_text")]
    result = stored(classes.join(least_row, "label").select(*columns).distinct(), "classes")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return result.select(known("doc").alias("doc_id"), "text_id", known("class_id").alias("class_id"), "class_text")
