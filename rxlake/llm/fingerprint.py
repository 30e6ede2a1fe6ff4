"""Improbable-feature digests of documents and their likeness.

Every window of 64 bytes gets a rarity from its Shannon entropy: entropies near that of running text are common,
others are rare, and near-empty ones are left out. In each run of 64 neighbouring windows the rarest one (the leftmost
of equals) scores a point, and windows with at least 16 points are features. A text in which these are few, because it is
short or regular, also has the features found in the same way among its windows of 8 bytes, so that every text but the
empty one has some and a changed word leaves most of them. A feature sets five bits of a Bloom
filter of 2,048 bits; a filter holds up to 160 features, then the next one of the chain begins. Two digests are
compared filter by filter: the overlap of bits beyond what chance gives, over the most that could overlap.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxlake.llm.common import RangeHash, mixed, ragged, row_blocks, sliding_min, stored

WINDOW = 64
RUN = 64
POPULAR = 16
BITS = 2048
HASHES = 5
FULL = 160
FEW = 16  # features of long windows up to which short windows count as well
SMALL_WINDOW, SMALL_RUN, SMALL_POPULAR = 8, 8, 2
SMALL_TYPICAL, SMALL_SPREAD = 2.6, 0.2  # entropy of an 8-byte window of running text, in bits
TYPICAL, SPREAD = 3.6, 0.25  # entropy of a 64-byte window of running text, in bits
LEAST_ENTROPY = 1.0
NO_ID = -(1 << 63)
UNIT = 1 << 20


def entropy_sums(data: np.ndarray) -> np.ndarray:
    """For each window the sum of c * log2(c) over its byte counts, in units of 2 ** -20.

    A window differs from the one before by one byte that enters and one that leaves; what each changes depends on how
    often that byte occurs in the 63 places before, or after. Those counts come from 63 shifted comparisons.
    """
    n = len(data)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for a in range(0, n, 1 << 16):  # pieces that stay in cache
        part = data[a:a + (1 << 16) + WINDOW]
        for d in range(1, WINDOW):
            if len(part) > d:
                same = (part[d:] == part[:-d]).view(np.uint8)
                stop = min(1 << 16, len(same))
                after[a:a + stop] += same[:stop]
    # the count behind: each place gets what its earlier equals saw ahead
    for a in range(0, n, 1 << 16):
        low = max(0, a - WINDOW + 1)
        part = data[low:a + (1 << 16)]
        off = a - low
        for d in range(1, WINDOW):
            if len(part) > d:
                same = (part[d:] == part[:-d]).view(np.uint8)
                skip = max(0, off - d)
                before[low + d + skip:low + d + len(same)] += same[skip:]
    c = np.arange(WINDOW + 1, dtype=np.float64)
    value = np.zeros(WINDOW + 1)
    value[1:] = c[1:] * np.log2(c[1:])
    gain = np.rint(np.diff(value) * UNIT).astype(np.int64)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    counts = np.bincount(data[:WINDOW], minlength=256)
    first = int(gain.cumsum()[counts[counts > 0] - 1].sum())
    change = gain[before[WINDOW:]] - gain[after[:n - WINDOW]]
    return first + np.concatenate([[0], np.cumsum(change)])


def small_entropies(data: np.ndarray) -> np.ndarray:
    """Entropy of each short window."""
    windows = np.lib.stride_tricks.sliding_window_view(data, SMALL_WINDOW)
    out = np.empty(len(windows))
    logs = np.log2(np.arange(1, SMALL_WINDOW + 1))
    for a in range(0, len(windows), 1 << 14):
        part = windows[a:a + (1 << 14)]
        equal = (part[:, :, None] == part[:, None, :]).sum(axis=2)
        out[a:a + len(part)] = np.log2(SMALL_WINDOW) - logs[equal - 1].sum(axis=1) / SMALL_WINDOW
    return out


def small_features(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the features of these rows among their short windows. A text with fewer of those than a run
    has one run; one shorter than a window is one feature as a whole. Where no window wins twice, as in a text of one
    byte over and over, the winner of the first run is the feature."""
    size = np.diff(offsets)[rows]
    tiny = rows[(size < SMALL_WINDOW) & (size > 0)]
    found = [(tiny, offsets[tiny], offsets[tiny + 1])]
    rows, size = rows[size >= SMALL_WINDOW], size[size >= SMALL_WINDOW]
    if len(rows):
        ends = np.cumsum(size)
        starts = ends - size
        of, place = ragged(size)
        joined = data[offsets[rows][of] + place]
        away = np.abs(small_entropies(joined) - SMALL_TYPICAL) / SMALL_SPREAD
        key = (np.rint(1000 * np.exp(-0.5 * away**2)).astype(np.uint64) << np.uint64(40)) | np.arange(len(away), dtype=np.uint64)
        # a run never crosses into the next text: windows that do are the least rare of all
        crossing = place[:len(away)] + SMALL_WINDOW > size[of[:len(away)]]
        key[crossing] |= np.uint64(1 << 60)
        key = np.concatenate([key, np.full(SMALL_RUN - 1, np.uint64(1 << 60))])
        winner = (sliding_min(key, SMALL_RUN) & np.uint64((1 << 40) - 1)).astype(np.int64)
        windows = size - SMALL_WINDOW + 1
        runs = np.maximum(1, windows - SMALL_RUN + 1)
        run_of, at = ragged(runs)
        winner = winner[starts[run_of] + at]
        points = np.bincount(winner, minlength=len(joined))
        least = np.minimum(SMALL_POPULAR, runs)
        chosen = np.flatnonzero((points > 0) & (points >= least[of]))
        without = np.flatnonzero(np.bincount(of[chosen], minlength=len(rows)) == 0)
        chosen = np.sort(np.append(chosen, winner[(np.cumsum(runs) - runs)[without]]))
        found.append((rows[of[chosen]], offsets[rows][of[chosen]] + place[chosen], offsets[rows][of[chosen]] + place[chosen] + SMALL_WINDOW))
    return tuple(np.concatenate(x) for x in zip(*found))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the features of each row, those of long windows first, in order of place."""
    hashes = RangeHash(data)
    none = np.zeros(0, np.int64)
    rows, starts, ends = [none], [none], [none]
    sums = entropy_sums(data)
    if len(sums) >= RUN:
        entropy = np.log2(WINDOW) - sums / (UNIT * WINDOW)
        level = np.rint(entropy * 128).astype(np.int64)
        common = np.rint(1000 * np.exp(-0.5 * ((level / 128 - TYPICAL) / SPREAD) ** 2)).astype(np.uint64)
        common[entropy < LEAST_ENTROPY] = 2000
        place = np.arange(len(sums), dtype=np.uint64)
        key = (common << np.uint64(40)) | place
        winner = (sliding_min(key, RUN) & np.uint64((1 << 40) - 1)).astype(np.int64)
        at = np.arange(len(winner))
        owner = np.searchsorted(offsets, at, "right") - 1
        inside = at + WINDOW + RUN - 1 <= offsets[owner + 1]
        winner = winner[inside]
        points = np.bincount(winner, minlength=len(sums))
        chosen = np.flatnonzero((points >= POPULAR) & (common < 2000))
        rows.append(np.searchsorted(offsets, chosen, "right") - 1)
        starts.append(chosen)
        ends.append(chosen + WINDOW)
    few = np.flatnonzero(np.bincount(np.concatenate(rows), minlength=len(offsets) - 1) < FEW)
    for column, values in zip((rows, starts, ends), small_features(data, offsets, few)):
        column.append(values)
    row, start, end = (np.concatenate(x) for x in (rows, starts, ends))
    order = np.lexsort((start, start - end, row))
    row, start, end = row[order], start[order], end[order]
    return row, hashes.of(start, end)


def chain(values: np.ndarray) -> np.ndarray:
    """Chained Bloom filters of a text's features, one row of bits each."""
    _, first = np.unique(values, return_index=True)
    values = values[np.sort(first)]
    filters = np.zeros((-(-len(values) // FULL), BITS), bool)
    for j in range(HASHES):
        bit = (mixed(values + np.uint64(j)) % np.uint64(BITS)).astype(np.int64)
        filters[np.arange(len(values)) // FULL, bit] = True
    return filters


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Mean over the filters of the shorter chain of its best normalised overlap with a filter of the other."""
    if x.shape == y.shape and (x == y).all():
        return 1.0
    if not len(x) or not len(y):
        return 0.0
    if len(x) > len(y):
        x, y = y, x
    a, b = x.sum(1)[:, None].astype(float), y.sum(1)[None, :].astype(float)
    both = x.astype(np.float32) @ y.T.astype(np.float32)
    most = np.minimum(a, b)
    chance = a * b / BITS + 0.3 * (most - a * b / BITS)
    score = np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1)
    return float(score.max(1).mean())


def digest(filters: np.ndarray) -> str:
    return np.packbits(filters, axis=1).tobytes().hex()


def filters_of(texts: list[bytes]) -> list[np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    out = []
    for a, b in row_blocks(offsets):
        row, value = features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        bounds = np.searchsorted(row, np.arange(b - a + 1))
        out += [chain(value[x:y]) for x, y in zip(bounds[:-1], bounds[1:])]
    return out


FIELDS = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string()),
]
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double, part int, edge string, text string"
)


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + after[:half] if half else text


def compared(ids: list[int], texts: list[str]) -> list[tuple]:
    """Result rows of all but the last text, each with the one after it."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    own = filters_of([t.encode() for t in texts])
    other = filters_of([t.encode() for t in changed])
    return [
        (
            ids[i], len(texts[i]), hashlib.sha256(changed[i].encode()).hexdigest(), digest(own[i]), digest(other[i]),
            likeness(own[i], other[i]), likeness(own[i], own[i + 1]),
        )
        for i in range(len(changed))
    ]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, FIELDS)], [n for n, _ in FIELDS])


STEP = 1 << 20


def follow(batches):
    """Documents of a sorted partition, each with the next; the first and last leave as edges."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    ids, texts, size, begun = [], [], 0, False
    edge = lambda kind, i, t: batch_of([(i, None, None, None, None, None, None, part, kind, t)])
    for batch in batches:
        for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            t = t or ""
            if not begun:
                yield edge("first", i, t)
                begun = True
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size > STEP and len(texts) > 1:
                yield batch_of([(*r, part, None, None) for r in compared(ids, texts)])
                ids, texts, size = ids[-1:], texts[-1:], len(t)
    if begun:
        if len(texts) > 1:
            yield batch_of([(*r, part, None, None) for r in compared(ids, texts)])
        yield edge("last", ids[-1], texts[-1])


def bridge(batches):
    """A last document with the first one of the next partition."""
    for batch in batches:
        rows = []
        for i, part, text, after in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "text", "after"))):
            rows.append((*compared([i, i], [text, after])[0], part, None, None))
        yield batch_of(rows)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text and of its edited text, and how near the text is to the edited and the next one.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next document in
    ascending id; after the last comes the first, so a lone document follows itself. Null text is empty, a null id
    comes first; rows that share an id are ordered by text. Equal texts have equal fingerprints and a likeness of 1; only
    an empty text has the empty fingerprint, with a likeness of 0 to others. Texts of any length are read whole. An empty
    table gives an empty result.
    """
    keyed = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = keyed.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    found = stored(dealt.mapInArrow(follow, SCHEMA), "fingerprints")
    edges = found.where(F.col("edge").isNotNull()).select("doc_id", "part", "edge", "text")
    order = [r["part"] for r in edges.where("edge = 'last'").select("part").distinct().orderBy("part").collect()]
    result = found.where(F.col("edge").isNull())
    if order:
        after = F.create_map(*[F.lit(x) for a, b in zip(order, order[1:] + order[:1]) for x in (a, b)])
        firsts = edges.where("edge = 'first'").select(F.col("part").alias("to"), F.col("text").alias("after"))
        lasts = edges.where("edge = 'last'").select("doc_id", "part", "text", after[F.col("part")].alias("to"))
        result = result.unionByName(lasts.join(firsts, "to").mapInArrow(bridge, SCHEMA))
    names = [n for n, _ in FIELDS[1:7]]
    return result.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), *names)
