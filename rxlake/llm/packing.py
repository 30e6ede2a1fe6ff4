"""Best-fit packing of tokenized documents, planned on the histogram of lengths.

Documents are tokenized once into a narrow table of pieces. Only the histogram of piece lengths (at most as many rows
as a sequence has tokens) reaches the driver, where best fit runs over counts: all pieces of a length go at once to the
fullest bins that take them. The plan names, for each range of ranks within a length, the sequences and offsets; its
size is bounded by the sequence length, whatever the number of documents. Pieces then get their rank within their
length from numbered salted parts, so that a length shared by a third of all pieces is no single group, and take the
slot planned for that rank.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rxlake.llm.common import released, stored

SEQUENCE = 2048
END = 0
SALTS = 64
CACHE = 300_000
LATIN = 0x250


def members(kind: str) -> str:
    """The characters of a Unicode category among the first blocks, for a character class."""
    return "".join(f"\\u{c:04x}" for c in range(LATIN) if unicodedata.category(chr(c))[0] == kind)


LETTER, NUMBER = members("L"), members("N")
PATTERN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+"
)
#: Characters beyond those blocks, separators on which libraries differ, and special tokens: such texts go to the
#: tokenizer whole.
UNUSUAL = re.compile(r"[^\x00-\x1b\x20-\x84\x86-\u024f]|<\|")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Encoder(dict):
    """Token ids (as little-endian bytes) of pre-tokens; a bounded cache in front of the tokenizer."""

    def __init__(self, path: str):
        super().__init__()
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        letter = byte_letters()
        ranks = {bytes(letter[c] for c in token): i for token, i in vocab.items()}
        self.core = tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.core._encode_single_piece(piece), "<u4").tobytes()
        if len(self) >= CACHE:
            self.clear()
        self[piece] = ids
        return ids

    def ids(self, text: str) -> np.ndarray:
        if UNUSUAL.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(b"".join(map(self.__getitem__, PATTERN.findall(text))), "<u4")


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut_pieces(path: str, size: int):
    def run(batches):
        encode = encoder(path)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(pc.fill_null(batch.column("text"), "").to_pylist()):
                ids = np.append(encode.ids(text), np.uint32(END)).astype("<u4")
                at, end = 0, (len(ids) - 1) % size + 1
                while at < len(ids):
                    rows.append(row)
                    piece.append((at + size - 1) // size)
                    start.append(at)
                    length.append(end - at)
                    crc.append(zlib.crc32(ids[at:end].tobytes()))
                    at, end = end, end + size
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def best_fit_plan(histogram: dict[int, int], size: int = SEQUENCE) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, first bin, pieces per bin, offset) in order of rank.

    Lengths go from long to short. Bins are kept as runs of equal remaining space; a piece goes to the least space
    that takes it, so a bin with space r takes r // length pieces before the next one is touched.
    """
    space: dict[int, list[tuple[int, int]]] = {size: []}
    bins, plan = 0, {}
    for length in sorted(histogram, reverse=True):
        left, rank, rows = histogram[length], 0, []
        while left:
            fit = min((r for r in space if r >= length and space[r]), default=None)
            if fit is None:
                fit, each = size, size // length
                run = (bins, -(-left // each))
                bins += run[1]
                space[size].append(run)
            first, count = space[fit].pop()
            each = fit // length
            full = min(count, left // each)
            if full:
                rows.append((rank, first, each, size - fit))
                space.setdefault(fit - each * length, []).append((first, full))
                rank, left, first, count = rank + full * each, left - full * each, first + full, count - full
            if count and left and left < each:
                rows.append((rank, first, each, size - fit))
                space.setdefault(fit - left * length, []).append((first, 1))
                rank, left, first, count = rank + left, 0, first + 1, count - 1
            if count:
                space[fit].append((first, count))
        plan[length] = np.array(rows, np.int64)
        space = {r: runs for r, runs in space.items() if runs or r == size}
    return plan


def take_slots(plan: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(part):
                    rows = plan[int(length[part[0]])]
                    row = rows[np.searchsorted(rows[:, 0], rank[part], "right") - 1]
                    past = rank[part] - row[:, 0]
                    sequence[part] = row[:, 1] + past // row[:, 2]
                    offset[part] = row[:, 3] + past % row[:, 2] * length[part]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE) -> DataFrame:
    """Pieces of all documents placed in sequences of at most ``size`` tokens.

    Needs ``doc_id`` and ``text``; ``tokenizer`` is the path of a byte-level vocabulary present on each worker. A
    document is its ids and one end token; null and empty texts are the end token alone. Only a longer document is
    cut, its first piece being the short one. Every row counts, also repeated ones and those with a null id. An empty
    table gives an empty result.
    """
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(cut_pieces(tokenizer, size)), kinds)
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int")
    pieces = stored(pieces.withColumn("salt", salt), "pieces")
    parts = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    parts = stored(parts, "parts")  # at most size x SALTS rows
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("at", F.row_number().over(within) - 1).join(F.broadcast(parts), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("skip") + F.col("at")).cast("long").alias("rank"))
    return ranked.mapInArrow(take_slots(best_fit_plan(histogram, size)), f"{kinds}, sequence_id long, offset long")
