"""Removal of repeated substrings with suffix arrays.

A string of 100 bytes that starts at two places is removed at all but the first (by document id, then start).

1. *Anchors.* Every 100-byte window is dealt by the hash of its leftmost smallest 32-gram, so equal windows meet
   wherever they lie. Neighbouring windows with one anchor travel as one segment.
2. *Collapse.* Equal segments (same bytes, same place of the anchor) are settled by their hash, first inside each
   batch and then per anchor: all but the first are removed. An anchor that occurs once has no repeats.
3. *Suffix arrays.* Different segments with one anchor are fetched from the texts, and each shard of anchors is
   sorted in two stages: only suffixes smaller than their successors are sorted directly, the others are induced by
   bucket scans. Adjacent common prefixes of 100 bytes or more give the runs of equal windows.

An anchor with very many different segments (a common passage amid ever new surroundings) is *hot*: its windows are
dealt singly by their own hash, where equal ones combine before the shuffle, so no task holds the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxlake.llm.common import RangeHash, gram_hashes, ragged, released, row_blocks, sliding_min, stored, utf8

LENGTH = 100
GRAM = 32
PLACE = np.uint64((1 << 24) - 1)
SPAN, ASK, HOT = 0, 1, 2
PIECE = 1 << 18  # window starts of a long text handled at once; no window is lost between pieces
BATCH = 8 << 20  # bytes of texts whose equal segments are settled together before the shuffle
CUT = 1 << 20  # bytes of segments cut at once
SYMBOLS = 7  # 9-bit symbols of a sort word
NO_ID = -(1 << 63)


# --- two-stage suffix sorting ---------------------------------------------------------------------


def sort_words(text: np.ndarray) -> np.ndarray:
    """For each place, the next seven symbols as one integer; symbols past the end are 0."""
    words = np.zeros(len(text), np.int64)
    padded = np.concatenate([text.astype(np.int64), np.zeros(SYMBOLS, np.int64)])
    for i in range(SYMBOLS):
        words |= padded[i:i + len(text)] << (9 * (SYMBOLS - 1 - i))
    return words


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one that starts a symbol later (the end counts as smallest)."""
    n = len(text)
    differ = np.flatnonzero(text[:-1] != text[1:])
    up = np.zeros(n, bool)
    if len(differ):
        rises = text[differ] < text[differ + 1]
        at = np.searchsorted(differ, np.arange(n))
        inside = at < len(differ)
        up[inside] = rises[at[inside]]
    return up


def sorted_directly(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Places ordered by their first ``depth`` symbols, word after word, each step among ties only."""
    places = places[np.argsort(words[places], kind="stable")]
    fresh = np.ones(len(places), bool)
    fresh[1:] = words[places[1:]] != words[places[:-1]]
    for skip in range(SYMBOLS, depth, SYMBOLS):
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group, here = np.cumsum(fresh)[at], places[at] + skip
        key = np.where(here < len(words), words[np.minimum(here, len(words) - 1)], 0)
        order = np.lexsort((key, group))
        places[at] = places[at][order]
        key, group = key[order], group[order]
        fresh[at[1:]] |= (key[1:] != key[:-1]) & (group[1:] == group[:-1])
    return places


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes of ``text`` (small non-negative integers) in order of their first ``depth`` symbols at least."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    words, small = sort_words(text), smaller_than_next(text)
    direct = sorted_directly(words, np.flatnonzero(small), depth)
    bounds = np.searchsorted(text[direct], np.arange(int(text.max()) + 2))
    waiting: list[list[np.ndarray]] = [[] for _ in range(int(text.max()) + 1)]
    waiting[int(text[-1])].append(np.array([n - 1]))  # the last suffix has only the end after it
    result = []
    for symbol in range(len(waiting)):
        level = np.concatenate(waiting[symbol]) if waiting[symbol] else np.zeros(0, np.int64)
        waiting[symbol] = []
        head = []
        while len(level):  # larger suffixes of this bucket, induced from smaller buckets and then from itself
            head.append(level)
            before = level[level > 0] - 1
            level = before[(text[before] == symbol) & ~small[before]]
        bucket = np.concatenate([*head, direct[bounds[symbol]:bounds[symbol + 1]]])
        result.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~small[before] & (text[before] > symbol)]
        if len(before):
            before = before[np.argsort(text[before], kind="stable")]
            cut = np.flatnonzero(np.diff(text[before])) + 1
            for part in np.split(before, cut):
                waiting[int(text[part[0]])].append(part)
    return np.concatenate(result)


def common_prefixes(text: np.ndarray, order: np.ndarray, limit: int = LENGTH) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, up to ``limit``."""
    lcp = np.zeros(len(order), np.int64)
    words = sort_words(text)
    at = np.arange(1, len(order))
    for skip in range(0, limit, SYMBOLS):
        a, b = order[at] + skip, order[at - 1] + skip
        inside = (a < len(text)) & (b < len(text))
        at, a, b = at[inside], a[inside], b[inside]
        apart = words[a] ^ words[b]
        bits = np.zeros(len(at), np.int64)
        some = apart != 0
        bits[some] = np.floor(np.log2(apart[some].astype(np.float64))).astype(np.int64) // 9 + 1
        lcp[at] += SYMBOLS - bits
        at = at[~some]
        if not len(at):
            break
    return np.minimum(lcp, limit)


def repeated_windows(segments: list[np.ndarray], length: int = LENGTH) -> list[np.ndarray]:
    """For segments in order of place: which windows of each also start earlier in the list."""
    parts, starts, total = [], [], 0
    for s in segments:
        starts.append(total)
        parts += [s.astype(np.int16) + 1, np.zeros(1, np.int16)]
        total += len(s) + 1
    text = np.concatenate(parts)
    order = suffix_array(text, length)
    same = common_prefixes(text, order, length) >= length
    group = np.cumsum(~same) - 1
    first = np.full(group[-1] + 1, len(text), np.int64)
    np.minimum.at(first, group, order)
    repeated = np.zeros(len(text), bool)
    repeated[order] = order != first[group]
    return [repeated[a:a + max(0, len(s) - length + 1)] for a, s in zip(starts, segments)]


# --- segments of the texts ------------------------------------------------------------------------


def segments_of(data: np.ndarray, ends: np.ndarray, length: int):
    """Segments of a block of bytes: first window, windows, gram of the anchor, hash of the whole segment."""
    windows = len(data) - length + 1
    grams = gram_hashes(data, GRAM)
    key = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(key, length - GRAM + 1)[:windows]
    place = np.arange(windows)
    owner = np.searchsorted(ends, place, "right")
    inside = place + length <= ends[owner]
    new = np.ones(windows, bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, windows))
    keep = inside[start]
    start, count = start[keep], count[keep]
    anchor = (least[start] & PLACE).astype(np.int64) - start
    whole = RangeHash(data).of(start, start + count + length - 1)
    whole ^= (anchor.astype(np.uint64) << np.uint64(40)) * np.uint64(0x2545F4914F6CDD1D)
    return start, count, (least[start] >> np.uint64(24)).astype(np.int64), whole.view(np.int64), owner[start]


def pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks as (row, first byte, last byte) arrays; long rows are cut with an overlap, so each window is seen once."""
    for first, last in row_blocks(offsets, PIECE):
        if last - first > 1 or offsets[last] - offsets[first] <= 2 * PIECE:
            yield np.arange(first, last), offsets[first:last], offsets[first + 1:last + 1]
        else:
            for at in range(int(offsets[first]), int(offsets[last]), PIECE):
                yield np.array([first]), np.array([at]), np.array([min(at + PIECE + length - 1, int(offsets[last]))])


def differs(*columns: np.ndarray) -> np.ndarray:
    """For sorted rows, which differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def collapsed(deal: np.ndarray, whole: np.ndarray, doc: np.ndarray, copy: np.ndarray, start: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """One row for each different segment; later equal ones are settled as spans, and rows of one place are one."""
    order = np.lexsort((start, copy, doc, whole, deal))
    deal, whole, doc, copy, start, count = (x[order] for x in (deal, whole, doc, copy, start, count))
    once = differs(deal, whole, doc, copy, start)
    deal, whole, doc, copy, start, count = (x[once] for x in (deal, whole, doc, copy, start, count))
    later = ~differs(deal, whole)
    kind = np.where(later, SPAN, ASK).astype(np.int8)
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (kind, np.where(later, whole ^ doc ^ start, deal), whole, doc, copy, start.astype(np.int32), count.astype(np.int16))],
        ["kind", "deal", "whole", "id", "copy", "start", "count"],
    )


def find_segments(length: int):
    def run(batches):
        for batch in batches:
            data, every = utf8(batch.column("text"))
            ids, copies = batch.column("id").to_numpy(), batch.column("copy").to_numpy()
            for top, bottom in row_blocks(every, BATCH):
                offsets, found = every[top:bottom + 1], []
                for rows, begin, end in pieces(offsets, length):
                    block = data[begin[0]:end[-1]]
                    if len(block) < length:
                        continue
                    start, count, gram, whole, owner = segments_of(block, end - begin[0], length)
                    row = rows[owner]
                    found.append((gram, whole, ids[top + row], copies[top + row], start + begin[0] - offsets[row], count))
                    if sum(len(f[0]) for f in found) > BATCH // 16:  # a long text
                        yield collapsed(*(np.concatenate(x) for x in zip(*found)))
                        found = []
                if found:
                    yield collapsed(*(np.concatenate(x) for x in zip(*found)))

    return run


FOUND = "kind byte, deal long, whole long, id long, copy long, start int, count short"


def settle(batches):
    """Rows sorted by anchor, segment and place: repeats of equal segments become spans, different segments of an
    anchor are asked for. Rows of one place (equal documents) are one. Holds one unfinished anchor, and of a hot one only
    its last row."""
    held, hot = None, None  # rows of the unfinished anchor; the last row of one already found hot
    previous = None
    for batch in batches:
        deal, whole, kind = (batch.column(c).to_numpy() for c in ("deal", "whole", "kind"))
        plain = kind == SPAN
        if plain.any():
            yield batch.filter(pa.array(plain))
            batch = batch.filter(pa.array(~plain))
        if batch.num_rows:
            place = [batch.column(c).to_numpy() for c in ("deal", "whole", "id", "copy", "start")]
            once = differs(*place)
            once[0] = [c[0] for c in place] != previous
            previous = [c[-1] for c in place]
            batch = batch.filter(pa.array(once))
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        held = None
        if not rows.num_rows:
            continue
        deal, whole = rows.column("deal").to_numpy(), rows.column("whole").to_numpy()
        if hot is not None:
            more = int(np.searchsorted(deal != hot[0], True)) if deal[0] == hot[0] else 0
            if more:
                before = np.concatenate([[hot[1]], whole[: more - 1]])
                yield from labelled(rows.slice(0, more), np.where(whole[:more] == before, SPAN, HOT))
                hot = (hot[0], whole[more - 1])
                rows, deal, whole = rows.slice(more), deal[more:], whole[more:]
                if not len(deal):
                    continue
            hot = None
        tail = int(np.searchsorted(deal == deal[-1], True)) if len(deal) else 0
        kinds = judged(deal[tail:], whole[tail:])
        if (kinds == HOT).any():
            yield from labelled(rows.slice(tail), kinds)
            hot = (deal[-1], whole[-1])
        else:
            first = np.ones(len(deal) - tail, bool)
            first[1:] = whole[tail + 1:] != whole[tail:-1]
            held = rows.slice(tail).combine_chunks()
            if len(first) > 4 * HOT_ANCHOR:  # equal segments are settled now; two of each stay to tell them apart
                second = np.zeros(len(first), bool)
                second[1:] = first[:-1] & ~first[1:]
                last = np.append(first[1:], True)
                stay = first | last
                yield from labelled(held.filter(pa.array(~stay)), np.full(int((~stay).sum()), SPAN))
                held = held.filter(pa.array(stay))
        if tail:
            yield from labelled(rows.slice(0, tail), judged(deal[:tail], whole[:tail]))
    if held is not None:
        yield from labelled(held, judged(held.column("deal").to_numpy(), held.column("whole").to_numpy()))


HOT_ANCHOR = 2_000


def judged(deal: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """For rows of whole anchors in order: SPAN for a repeat, ASK or HOT for one of several segments, else -1."""
    new_deal, new_whole = np.ones(len(deal), bool), np.ones(len(deal), bool)
    new_deal[1:] = deal[1:] != deal[:-1]
    new_whole[1:] = new_deal[1:] | (whole[1:] != whole[:-1])
    of = np.cumsum(new_deal) - 1
    several = np.bincount(of, new_whole)[of] if len(of) else of
    return np.where(~new_whole, SPAN, np.where(several > HOT_ANCHOR, HOT, np.where(several > 1, ASK, -1)))


def labelled(rows: pa.Table, kinds: np.ndarray):
    if len(kinds) and (kinds >= 0).any():
        rows = rows.set_column(0, "kind", pa.array(kinds.astype(np.int8))).filter(pa.array(kinds >= 0))
        yield from rows.combine_chunks().to_batches(100_000)


def single_windows(length: int):
    """Windows of hot segments, each dealt by its own hash; of equal ones in a batch only the first goes on."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            asked = batch.column("asked")
            values = asked.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
            start, count = (values.field(c).to_numpy().astype(np.int64) for c in ("start", "count"))
            ids, copies = batch.column("id").to_numpy(), batch.column("copy").to_numpy()
            for first, last in row_blocks(offsets, PIECE):
                a, b = np.searchsorted(row, [first, last])
                if a == b:
                    continue
                of, place = ragged(count[a:b])
                at = offsets[row[a:b]][of] + start[a:b][of] + place - offsets[first]
                whole = RangeHash(data[offsets[first]:offsets[last]]).of(at, at + length).view(np.int64)
                doc, copy, begin = ids[row[a:b]][of], copies[row[a:b]][of], start[a:b][of] + place
                yield collapsed(whole, whole, doc, copy, begin, np.ones(len(whole), np.int64))

    return run


def cut_segments(length: int):
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            asked = batch.column("asked")
            sizes = np.diff(asked.offsets.to_numpy())
            if not len(asked.flatten()):
                continue
            values = asked.flatten()
            row = np.repeat(np.arange(len(sizes)), sizes)
            start, count = (values.field(c).to_numpy().astype(np.int64) for c in ("start", "count"))
            begin, size = offsets[row] + start, count + length - 1
            for a, b in row_blocks(np.concatenate([[0], np.cumsum(size)]), CUT):
                run_of, place = ragged(size[a:b])
                cut = data[begin[a:b][run_of] + place]
                bounds = np.concatenate([[0], np.cumsum(size[a:b])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        values.field("deal").slice(a, b - a), batch.column("id").take(pa.array(row[a:b])),
                        batch.column("copy").take(pa.array(row[a:b])), values.field("start").slice(a, b - a),
                        pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(bounds), pa.py_buffer(cut)]),
                    ],
                    ["deal", "id", "copy", "start", "bytes"],
                )

    return run


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true values."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    start = np.flatnonzero(edge == 1)
    return start, np.flatnonzero(edge == -1) - start


SHARD_BYTES = 1 << 20


def sort_shards(length: int):
    """Suffix arrays over the segments of whole anchors, a few megabytes at a time."""

    def spans(table: pa.Table):
        doc, copy, start = (table.column(c).to_numpy() for c in ("id", "copy", "start"))
        order = np.lexsort((start, copy, doc))
        order = order[differs(doc[order], copy[order], start[order])]  # equal documents are one
        cuts = table.column("bytes").combine_chunks().take(pa.array(order))
        segments = [np.frombuffer(x.as_buffer(), np.uint8) for x in cuts]
        out = []
        for i, again in zip(order, repeated_windows(segments, length)):
            if again.any():
                begin, size = runs_of(again)
                out.append((np.full(len(begin), doc[i]), np.full(len(begin), copy[i]), start[i] + begin, size))
        if out:
            d, c, s, n = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(d), pa.array(c), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int16))],
                ["id", "copy", "start", "count"],
            )

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:  # sorted by deal within the partition
            deal = batch.column("deal").to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(deal)) + 1), len(deal)]
            for a, b in zip(bounds[:-1], bounds[1:]):
                if size > SHARD_BYTES and deal[a] != last:
                    yield from spans(pa.Table.from_batches(held))
                    held, size = [], 0
                part = batch.slice(a, b - a)
                held.append(part)
                size += part.column("bytes").nbytes
                last = deal[a]
        if held:
            yield from spans(pa.Table.from_batches(held))

    return run


def remove_spans(length: int, with_text: bool):
    import hashlib

    def run(batches):
        for whole in batches:
            for top, bottom in row_blocks(utf8(whole.column("text"))[1], BATCH):
                yield removed(whole.slice(top, bottom - top))

    def removed(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = utf8(batch.column("text"))
        spans = batch.column("spans")
        sizes = pc.fill_null(pc.list_value_length(spans), 0).to_numpy()
        values = spans.flatten()
        start, count = (values.field(c).to_numpy().astype(np.int64) for c in ("start", "count"))
        at, taken, found, digest, texts = 0, [], [], [], []
        for row, size in enumerate(sizes):
            text = data[offsets[row]:offsets[row + 1]]
            if size:
                edge = np.zeros(len(text) + 1, np.int32)
                np.add.at(edge, start[at:at + size], 1)
                np.add.at(edge, start[at:at + size] + count[at:at + size] + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                text = text[~gone]
                taken.append(int(gone.sum()))
                found.append(len(runs_of(gone)[0]))
            else:
                taken.append(0)
                found.append(0)
            at += size
            raw = text.tobytes()
            digest.append(hashlib.sha256(raw).hexdigest())
            texts.append(raw.decode("utf-8", "ignore") if with_text else None)
        new = {
            "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(taken, pa.int64()), "n_spans": pa.array(found, pa.int64()),
            "kept_sha256": pa.array(digest, pa.string()), "kept_text": pa.array(texts, pa.string()),
        }
        rest = [(n, batch.column(n)) for n in batch.schema.names if n not in ("text", "spans", "id", "copy", *new)]
        return pa.RecordBatch.from_arrays([*(c for _, c in rest), *new.values()], [*(n for n, _ in rest), *new])

    return run


def suffix_dedup(docs: DataFrame, carry: list[str] = ("doc_id",), with_text: bool = False, length: int = LENGTH) -> DataFrame:
    """Each document without the bytes of repeated strings of ``length`` bytes.

    Needs ``doc_id`` and ``text``; returns the ``carry`` columns, ``n_bytes``, ``n_removed``, ``n_spans`` and
    ``kept_sha256``, and with ``with_text`` the remaining text in ``kept_text`` (a character that lost some of its
    bytes goes whole). Null text is empty; a null id comes before all others. Rows that share an id are ordered by a
    hash of their texts; rows equal in id and text are one document: none is earlier than another, so each of them
    keeps what the first keeps. Texts of any length are read whole, in pieces that overlap. A text under ``length`` bytes
    keeps everything; an empty table gives an empty result.
    """
    keyed = docs.select(
        *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(carry)],
        F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("id"),
        F.xxhash64("text").alias("copy"), "text",
    )
    found = keyed.select("id", "copy", "text").mapInArrow(released(find_segments(length)), FOUND)
    order = ["deal", "whole", "id", "copy", "start"]
    settled = stored(
        found.repartition("deal").sortWithinPartitions(*order).mapInArrow(released(settle), FOUND).drop("whole"), "segments"
    )
    texts = keyed.repartition("id", "copy")

    def asked(kind: int) -> DataFrame:
        wanted = settled.where(F.col("kind") == kind).groupBy("id", "copy").agg(
            F.collect_list(F.struct("deal", "start", "count")).alias("asked")
        )
        return texts.join(wanted, ["id", "copy"]).select("id", "copy", "text", "asked")

    cold = (
        asked(ASK).mapInArrow(released(cut_segments(length)), "deal long, id long, copy long, start int, bytes binary")
        .repartition("deal").sortWithinPartitions("deal")
        .mapInArrow(released(sort_shards(length)), "id long, copy long, start int, count short")
    )
    single = (
        asked(HOT).mapInArrow(released(single_windows(length)), FOUND).repartition("deal").sortWithinPartitions(*order)
        .mapInArrow(released(settle), FOUND).select("id", "copy", "start", "count")
    )
    spans = (
        settled.where(F.col("kind") == SPAN).select("id", "copy", "start", "count").unionByName(cold).unionByName(single)
        .groupBy("id", "copy").agg(F.collect_list(F.struct("start", "count")).alias("spans"))
    )
    kinds = ", ".join(f"keep_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    result = texts.join(spans, ["id", "copy"], "left").mapInArrow(
        released(remove_spans(length, with_text)),
        f"{kinds}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string",
    )
    result = result.withColumnsRenamed({f"keep_{i}": c for i, c in enumerate(carry)})
    return result if with_text else result.drop("kept_text")
