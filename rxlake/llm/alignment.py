"""Alignment of two tokenizations of a text, and how often their tokens meet in a corpus.

Both tokenizers split the same bytes, so their arrays of token ends are merged: where a token of each ends at the same
byte, a group closes. Most groups hold one token of each, and along such a stretch the two indices keep their distance.
``aligned_groups`` therefore compares slices of the two arrays at the current distance, twice as long each time, halves
them at the first difference, and only then walks the irregular group token by token, which sets the next distance.

Texts are cut at single spaces, where neither tokenizer joins tokens, so a token of each ends there. Words that no bounded
cache holds are tokenized together and aligned as one stretch; a text is put together from its words. A first table holds, per document, its figures and its distinct linked pairs. Pairs are counted over
the corpus by documents; tasks hold the most frequent pairs, all others are met in a join.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxlake.llm.common import ragged, ready, stored, utf8
from rxlake.llm.packing import UNUSUAL, byte_letters, encoder

FREQUENT = 1 << 18  # pairs that every task holds; the path of a pair, not its result, depends on it
CACHE = 200_000  # words in each of two generations
LONG_PAIRS = 1 << 22  # pairs held, beyond which long words end both generations
LONG_WORD = 200  # characters; longer words are not cached
GROUP = 1 << 14  # links of one group beyond which its equal tokens are counted first
TEXTS = 64  # rows tokenized together, or fewer of 4 MiB
BREAK, TWO_BLANKS = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s\s")

TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

Runs = list[tuple[int, int, int, int]]


def aligned_groups(a: list[int], b: list[int]) -> Runs:
    """Groups of two lists of increasing ends with the same last: (first in a, count in a, first in b, count in b).

    A stretch of n groups of one token each is reported as one entry (i, n, j, -n).
    """
    out, i, j, size = [], 0, 0, len(a)
    while i < size:
        step, at = 1, i
        shift = j - i
        while a[at:at + step] == b[at + shift:at + shift + step] and at < size:
            at += step
            step *= 2
        while step > 1:  # the first difference lies within the last slice
            step //= 2
            if a[at:at + step] == b[at + shift:at + shift + step]:
                at += step
        at = min(at, size)
        if at > i:
            out.append((i, at - i, j, i - at))
            i, j = at, at + shift
            continue
        p, q = i, j
        while a[p] != b[q]:
            if a[p] < b[q]:
                p += 1
            else:
                q += 1
        out.append((i, p + 1 - i, j, q + 1 - j))
        i, j = p + 1, q + 1
    return out


class PairText(dict):
    """The text of a group of one token each, by pair; bounded."""

    def __init__(self, radix: int):
        super().__init__()
        self.radix = radix

    def __missing__(self, pair: int) -> str:
        if len(self) >= 2 * CACHE:
            self.clear()
        text = self[pair] = f"{pair // self.radix}|{pair % self.radix}"
        return text


class Held:
    """Aligned words by number: their groups as text, their linked pairs, and how many tokens, groups and links they have."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.text: list[str] = []
        self.figures = np.zeros((1_024, 4), np.int64)
        self.place = np.zeros((1_024, 2), np.int64)  # where a word's pairs begin, and how many they are
        self.pairs, self.used = np.zeros(4_096, np.int64), 0

    def add(self, words: list[str], texts: Iterable[str], figures: np.ndarray, pairs: np.ndarray, counts: np.ndarray) -> None:
        first, last, end = len(self.text), len(self.text) + len(words), self.used + len(pairs)
        self.number.update(zip(words, range(first, last)))
        self.text.extend(texts)
        if last > len(self.figures):
            more = np.zeros((last, self.figures.shape[1]), np.int64)
            self.figures, self.place = np.concatenate([self.figures, more]), np.concatenate([self.place, more[:, :2]])
        if end > len(self.pairs):
            self.pairs = np.concatenate([self.pairs, np.zeros(end, np.int64)])
        self.figures[first:last] = figures
        self.place[first:last, 0], self.place[first:last, 1] = self.used + np.cumsum(counts) - counts, counts
        self.pairs[self.used:end] = pairs
        self.used = end

    def pairs_of(self, numbers: np.ndarray) -> np.ndarray:
        first, count = self.place[numbers].T
        run, place = ragged(count)
        return self.pairs[first[run] + place]


class Words:
    """Aligned words, each with a space before it, in two bounded generations.

    ``bad`` has words whose bytes a vocabulary does not give back, ``large`` the distinct pairs and their counts of words
    with a group of very many links.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.now, self.before = Held(), Held()
        self.bad: set[str] = set()
        self.large: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        core = encoder(a_path).core
        self.piece_ids = core._core_bpe.encode_single_piece
        self.text_ids = tiktoken.Encoding("texts", pat_str=TOKEN, mergeable_ranks=core._mergeable_ranks, special_tokens={}).encode_ordinary
        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as file:
            model = json.load(file)
        letter = byte_letters()
        a_bytes = {i: bytes(letter[c] for c in t) if all(c in letter for c in t) else t.encode() for t, i in model["model"]["vocab"].items()}
        a_bytes.update({t["id"]: t["content"].encode() for t in model["added_tokens"]})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        self.tables = [self.table(t) for t in (a_bytes, b_bytes)]
        self.radix = len(pieces)
        self.pair_text = PairText(self.radix)

    @staticmethod
    def table(entries: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all entries, where each begins, and its length."""
        rows = [entries.get(i, b"") for i in range(max(entries) + 1)]
        sizes = np.array([len(r) for r in rows])
        return np.frombuffer(b"".join(rows), np.uint8), np.cumsum(sizes) - sizes, sizes

    def first_ids(self, words: list[str], given: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has. Usual words are tokenized as one text."""
        plain = [not (w[:1].isspace() or w[-1:].isspace() or UNUSUAL.search(w)) for w in words]
        ids = np.array(self.text_ids("".join([" " + w for w, p in zip(words, plain) if p])), np.int64)
        ends = np.cumsum(self.tables[0][2][ids])
        wanted = np.cumsum([len(g) for g, p in zip(given, plain) if p])
        counts = np.diff(np.searchsorted(ends, wanted, "left") + 1, prepend=0)
        if all(plain):
            return ids, counts
        out, counts, at = [], iter(counts.tolist()), 0
        for word, usual in zip(words, plain):
            if usual:
                n = next(counts)
                out.append(ids[at:at + n])
                at += n
            else:
                out.append(np.array(self.a.encode(" " + word, add_special_tokens=False).ids, np.int64))
        return np.concatenate(out), np.array([len(x) for x in out])

    def spelled(self, which: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of tokens joined, and the length of each."""
        data, start, size = self.tables[which]
        size = size[ids]
        run, place = ragged(size)
        return data[start[ids][run] + place], size

    def given_back(self, given: list[bytes], which: int, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Whether the tokens of each word spell its bytes."""
        whole = b"".join(given)
        spelled, size = self.spelled(which, ids)
        wanted = np.fromiter(map(len, given), np.int64, len(given))
        found = np.bincount(np.repeat(np.arange(len(given)), counts), size, len(given)).astype(np.int64)
        given, ends, starts = np.frombuffer(whole, np.uint8), np.cumsum(wanted), np.cumsum(found) - found
        if np.array_equal(found, wanted):
            differs = np.concatenate([[0], np.cumsum(spelled != given)])
            return differs[ends] == differs[ends - wanted]
        return np.array([n == m and np.array_equal(spelled[i:i + n], given[j - m:j]) for n, m, i, j in zip(found, wanted, starts, ends)])

    def hold(self, words: Iterable[str]) -> None:
        """Aligns those of the words that are not held."""
        if max(len(self.now.text), len(self.bad)) > CACHE:
            self.before, self.now = (self.now if len(self.bad) <= CACHE else Held()), Held()
            self.bad = self.bad if len(self.bad) <= CACHE else set()
        known, missing = [], []
        for w in set(words).difference(self.now.number):
            (known if w in self.before.number else missing).append(w)
        if known:
            old = np.fromiter(map(self.before.number.__getitem__, known), np.int64, len(known))
            texts = map(self.before.text.__getitem__, old.tolist())
            self.now.add(known, texts, self.before.figures[old], self.before.pairs_of(old), self.before.place[old, 1])
        if missing:
            self.align(missing)

    def align(self, words: list[str]) -> None:
        given = [(" " + w).encode() for w in words]
        rows = self.b.encode(words, num_threads=1)
        second = np.fromiter(map(len, rows), np.int64, len(rows))
        ids, counts = map(list, zip(self.first_ids(words, given), (np.fromiter(itertools.chain.from_iterable(rows), np.int64, int(second.sum())), second)))
        good = self.given_back(given, 0, ids[0], counts[0]) & self.given_back(given, 1, ids[1], counts[1])
        if not good.all():
            odd = [words[k] for k in np.flatnonzero(~good)]
            self.bad.update(odd)
            nothing = np.zeros(len(odd), np.int64)
            self.now.add(odd, [""] * len(odd), np.zeros((len(odd), 4), np.int64), nothing[:0], nothing)
            words = [words[k] for k in np.flatnonzero(good)]
            ids, counts = [i[np.repeat(good, n)] for i, n in zip(ids, counts)], [n[good] for n in counts]
            if not words:
                return
        # all these words as one text: each ends with a token of both
        a, b = ids
        groups = in_single_groups(aligned_groups(*(np.cumsum(self.tables[which][2][i]).tolist() for which, i in enumerate(ids))))
        ends = np.searchsorted(groups[:, 0], np.cumsum(counts[0]), "left")
        starts = np.concatenate([[0], ends[:-1]])
        n_links = groups[:, 1] * groups[:, 3]
        cuts = list(map(slice, starts.tolist(), ends.tolist()))
        texts = group_texts(a, b, groups, self.pair_text)
        totals = np.concatenate([[0], np.cumsum(n_links)])
        figures = np.stack([*counts, ends - starts, totals[ends] - totals[starts]], axis=1)
        crowded = np.unique(np.searchsorted(ends, np.flatnonzero(n_links > GROUP), "right"))
        for k in crowded.tolist():
            self.large[words[k]] = counted_links(a, b, groups[cuts[k]], self.radix)
            n_links[cuts[k]] = 0
        pairs = link_codes(a, b, groups[n_links > 0], self.radix)
        totals = np.concatenate([[0], np.cumsum(n_links)])
        self.now.add(words, map(";".join, map(texts.__getitem__, cuts)), figures, pairs, totals[ends] - totals[starts])

    def release(self, words: Iterable[str]) -> None:
        """Forgets very long words; what is held of them goes with the generation, which they end."""
        ended = False
        for w in words:
            ended |= self.now.number.pop(w, None) is not None
            self.bad.discard(w)
            self.large.pop(w, None)
        if ended and self.now.used > LONG_PAIRS:
            self.before, self.now = Held(), Held()

    def figures_of(self, parts: list[str]) -> tuple:
        """Figures and pairs of a text of these words."""
        numbers = list(map(self.now.number.__getitem__, parts))
        at = np.array(numbers, np.int64)
        n_a, n_b, n_groups, n_links = self.now.figures[at].sum(axis=0).tolist()
        digest = hashlib.sha256(";".join(map(self.now.text.__getitem__, numbers)).encode()).hexdigest()
        pairs, times = np.unique(self.now.pairs_of(at), return_counts=True)
        if self.large:
            more = [self.large[w] for w in parts if w in self.large]
            pairs, back = np.unique(np.concatenate([pairs, *(p for p, _ in more)]), return_inverse=True)
            times = np.bincount(back, np.concatenate([times, *(t for _, t in more)]), len(pairs)).astype(np.int64)
        return n_a, n_b, n_groups, n_links, digest, pairs, times


@functools.cache
def words_of(a_path: str, b_path: str) -> Words:
    return Words(a_path, b_path)


def link_codes(ids_a: np.ndarray, ids_b: np.ndarray, groups: np.ndarray, radix: int) -> np.ndarray:
    """All links of these groups as pairs (a * radix + b), group by group."""
    i, m, j, n = groups.T
    run, place = ragged(m * n)
    return ids_a[i[run] + place // n[run]] * radix + ids_b[j[run] + place % n[run]]


def counted_links(ids_a: np.ndarray, ids_b: np.ndarray, groups: np.ndarray, radix: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked pairs of these groups and how often each is linked, by the distinct tokens of each side."""
    code, times = [], []
    for i, m, j, n in groups:
        a, x = np.unique(ids_a[i:i + m], return_counts=True)
        b, y = np.unique(ids_b[j:j + n], return_counts=True)
        code.append((a[:, None] * radix + b).ravel())
        times.append((x[:, None] * y).ravel())
    pairs, back = np.unique(np.concatenate(code), return_inverse=True)
    return pairs, np.bincount(back, np.concatenate(times)).astype(np.int64)


def in_single_groups(runs: Runs) -> np.ndarray:
    """The groups one by one, stretches written out."""
    r = np.array(runs, np.int64).reshape(-1, 4)
    stretch = r[:, 3] < 0
    run, place = ragged(np.where(stretch, r[:, 1], 1))
    out = r[run]
    inside = stretch[run]
    out[inside, 0] += place[inside]
    out[inside, 2] += place[inside]
    out[inside, 1] = out[inside, 3] = 1
    return out


def group_texts(ids_a: np.ndarray, ids_b: np.ndarray, groups: np.ndarray, pair_text: PairText) -> list[str]:
    """Each group as text: the ids of both sides."""
    out = list(map(pair_text.__getitem__, (ids_a[groups[:, 0]] * pair_text.radix + ids_b[groups[:, 2]]).tolist()))
    odd = np.flatnonzero((groups[:, 1] > 1) | (groups[:, 3] > 1))
    a, b = ids_a.tolist(), ids_b.tolist()
    for k, (i, m, j, n) in zip(odd.tolist(), groups[odd].tolist()):
        out[k] = f"{str(a[i:i + m])[1:-1]}|{str(b[j:j + n])[1:-1]}".replace(" ", "")
    return out


NOTHING = (0, 0, 0, 0, "", [], [])
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]


def words_in(text: str) -> list[str]:
    """The text cut at its single spaces between other characters."""
    if TWO_BLANKS.search(text) or text[:1].isspace() or text[-1:].isspace():
        return BREAK.split(text)
    return text.split(" ") if text else []


def tokenized(words: Words, texts: list[str]) -> Iterator[tuple]:
    """Figures and pairs of each text, in order."""
    cut = list(map(words_in, texts))
    words.hold(itertools.chain.from_iterable(cut))
    odd = [k for k, parts in enumerate(cut) if not words.bad.isdisjoint(parts)]
    if odd:  # such a text is judged whole, as one word
        cut = [[t] if k in odd and t else parts for k, (t, parts) in enumerate(zip(texts, cut))]
        held = list(itertools.chain.from_iterable(cut[k] for k in odd))
        words.release([w for w in held if len(w) > LONG_WORD])
        words.hold(itertools.chain.from_iterable(cut))
    for parts in cut:
        yield words.figures_of(parts) if parts and words.bad.isdisjoint(parts) else NOTHING
    words.release({w for parts in cut for w in parts if len(w) > LONG_WORD})


def alignment(a_path: str, b_path: str):
    def run(batches):
        words = words_of(a_path, b_path)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            sizes = np.diff(utf8(texts)[1])
            first = 0
            while first < len(texts):
                last, room = first + 1, (1 << 22) - sizes[first]
                while last < len(texts) and last - first < TEXTS and room >= sizes[last]:
                    room -= sizes[last]
                    last += 1
                some = list(tokenized(words, texts.slice(first, last - first).to_pylist()))
                columns = dict(zip(COLUMNS, zip(*some)))
                out = {"doc_id": batch.column("doc_id").slice(first, last - first)}
                for c in COLUMNS[:4]:
                    out[c] = pa.array(columns[c], pa.int64())
                out["groups_sha256"] = pa.array(columns["groups_sha256"], pa.string())
                offsets = pa.array(np.cumsum([0, *map(len, columns["pairs"])]), pa.int32())
                for c in COLUMNS[5:]:
                    out[c] = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.asarray(x, np.int64) for x in columns[c]]), pa.int64()))
                yield pa.RecordBatch.from_arrays([*out.values()], [*out])
                first = last

    return run


def summed(weights):
    """Sums over the pairs that the task holds; the pairs left over go on."""

    def run(batches):
        known, n, best = (np.frombuffer(x, np.int64) for x in weights.value)
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            code, count = pairs.flatten().to_numpy(), times.flatten().to_numpy()
            row = np.repeat(np.arange(len(pairs)), pc.list_value_length(pairs).to_numpy())
            at = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
            held = known[at] == code if len(known) else np.zeros(len(code), bool)
            here, at = row[held], at[held]
            total = lambda x: pa.array(np.bincount(here, x, len(pairs)).round().astype(np.int64), pa.int64())
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[~held], minlength=len(pairs)))]), pa.int32())
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~held], pa.int64())) for x in (code, count)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_no"), total(count[held] * n[at]), total(count[held] * best[at]), *rest],
                ["row_no", "count_sum", "n_best", "pairs", "times"],
            )

    return run


def align(docs: DataFrame, a_path: str, b_path: str, frequent: int = FREQUENT) -> DataFrame:
    """Per row ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    Groups are cut where tokens of both vocabularies end; every token of one side is linked with every one of the
    other side in its group. ``count_sum`` adds up, over the links, how many rows of the corpus hold the linked pair of
    ids, ``n_best`` counts the links whose pair is (or ties as) the most frequent of its first id. A null or empty
    text, or one that a vocabulary cannot spell byte by byte, has no tokens: zeros and an empty digest. Texts of any
    length are taken whole, in one task each; equal rows count as rows of their own, each gets its own line; other
    columns do not matter, whatever their names; an empty table gives an empty result.
    """
    spark = ready(docs.sparkSession)
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(alignment(a_path, b_path), schema)
    rows = stored(rows.withColumn("row_no", F.monotonically_increasing_id()), "aligned")
    counts = stored(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    first = F.floor(F.col("pair") / words_of(a_path, b_path).radix).alias("first")
    most = counts.groupBy(first).agg(F.max("n").alias("most"))
    weights = counts.withColumn("first", first).join(most, "first").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    weights = stored(weights, "pair-weights")
    held = weights.orderBy(F.desc("n"), "pair").limit(frequent).toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast([held.column(c).to_numpy().astype(np.int64).tobytes() for c in ("pair", "n", "best")])
    sums = rows.select("row_no", "pairs", "times").mapInArrow(summed(shared), "row_no long, count_sum long, n_best long, pairs array<long>, times array<long>")
    sums = stored(sums, "pair-sums")
    rest = sums.select("row_no", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row_no", "x.pairs", "x.times")
    rest = rest.join(weights.withColumnRenamed("pair", "pairs"), "pairs").groupBy("row_no").agg(
        F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.col("times") * F.col("best")).alias("more_best"),
    )
    zero = F.lit(0).cast("long")
    figures = sums.select("row_no", "count_sum", "n_best").join(rest, "row_no", "left")
    return rows.drop("pairs", "times").join(figures, "row_no").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", zero)).alias("count_sum"), "groups_sha256",
    )
