"""BPE encoding and decoding with a segment tree over adjacent pairs.

The symbols of a word stand in a row; each adjacent pair that can merge has a leaf with its rank and place. The root
of the tree of minima is then the leftmost pair of the lowest rank. A merge changes three leaves, each in logarithmic
time, and encoding ends when the root is empty; so a word of any length costs n log n. Encoded words are kept in a
bounded cache, since most words of a text are repeated.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxlake.llm.packing import LETTER, NUMBER, UNUSUAL, byte_letters

SUFFIX = "</w>"
CACHE = 250_000
EMPTY = 1 << 62
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+")


def merged(symbols: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """Symbols after all merges; ``merges`` maps left << 32 | right to (rank, new symbol)."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1
    while size < n - 1:
        size *= 2
    tree = [EMPTY] * (2 * size)
    symbols = [*symbols]
    for i in range(n - 1):
        pair = merges.get(symbols[i] << 32 | symbols[i + 1])
        if pair:
            tree[size + i] = pair[0] << 32 | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(leaf: int, value: int) -> None:
        leaf += size
        tree[leaf] = value
        leaf >>= 1
        while leaf:
            a, b = tree[2 * leaf], tree[2 * leaf + 1]
            low = a if a < b else b
            if tree[leaf] == low:
                break
            tree[leaf] = low
            leaf >>= 1

    while tree[1] != EMPTY:
        i = tree[1] & 0xFFFFFFFF
        j = after[i]
        symbols[i] = merges[symbols[i] << 32 | symbols[j]][1]
        k = after[j]
        after[i] = k
        if j < n - 1:
            put(j, EMPTY)
        if k < n:
            before[k] = i
            pair = merges.get(symbols[i] << 32 | symbols[k])
            put(i, pair[0] << 32 | i if pair else EMPTY)
        else:
            put(i, EMPTY)
        p = before[i]
        if p >= 0:
            pair = merges.get(symbols[p] << 32 | symbols[i])
            put(p, pair[0] << 32 | p if pair else EMPTY)
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return out


class WordBpe(dict):
    """Word -> (ids as little-endian bytes, decoded tokens); a bounded cache."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)  # only to normalise and split texts with unusual characters
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        vocab = parts["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.token = {i: t for t, i in {**vocab, **self.special}.items()}
        self.merges = {}
        for rank, pair in enumerate(parts["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        letters = {b: c for c, b in byte_letters().items()}
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.last = [vocab[letters[b] + SUFFIX] for b in range(256)]
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def __missing__(self, word: str) -> tuple[bytes, str]:
        raw = word.encode()
        ids = merged([*(self.inner[b] for b in raw[:-1]), self.last[raw[-1]]], self.merges)
        value = (np.array(ids, "<u4").tobytes(), " ".join(map(self.token.__getitem__, ids)))
        if len(self) >= CACHE:
            self.clear()
        self[word] = value
        return value

    def words(self, text: str) -> list[str]:
        low = text.lower()
        if not UNUSUAL.search(low):
            return PIECES.findall(low)
        whole = self.library.normalizer.normalize_str(text)
        letter = byte_letters()
        return [bytes(letter[c] for c in w).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(whole)]

    def encoded(self, text: str) -> tuple[bytes, str]:
        """Ids as bytes, and what they decode to."""
        if "<|" not in text:
            found = [self[w] for w in self.words(text)]
        else:
            found = []
            for part in self.specials.split(text):
                if part in self.special:
                    found.append((np.array([self.special[part]], "<u4").tobytes(), part))
                elif part:
                    found += [self[w] for w in self.words(part)]
        return b"".join([f[0] for f in found]), " ".join([f[1] for f in found])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encoded(text)[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.token[i] for i in ids if i in self.token)


@functools.cache
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def encode_batches(path: str, with_values: bool):
    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            count, ids_hash, text_hash, ids, decoded = [], [], [], [], []
            for text in pc.fill_null(batch.column("text"), "").to_pylist():
                raw, back = bpe.encoded(text)
                count.append(len(raw) // 4)
                ids_hash.append(hashlib.sha256(raw).hexdigest())
                text_hash.append(hashlib.sha256(back.encode()).hexdigest())
                if with_values:
                    ids.append(np.frombuffer(raw, "<u4").astype(np.int32))
                    decoded.append(back)
            new = {"n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(ids_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())}
            if with_values:
                new |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), *new.values()], [*rest, *new])

    return run


def bpe_round_trip(docs: DataFrame, path: str, carry: list[str] = ("doc_id",), with_values: bool = False) -> DataFrame:
    """Each document with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; ``with_values`` adds ``ids``, ``decoded``.

    ``path`` names a vocabulary file present on each worker. Null text is empty and has no ids. Every row gets a
    result, also repeated ones and those with a null id. An empty table gives an empty result.
    """
    kept = docs.select(*[F.col(c).alias(f"keep_{i}") for i, c in enumerate(carry)], "text")
    kinds = ", ".join(f"keep_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    kinds += ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_values
    result = kept.mapInArrow(encode_batches(path, with_values), kinds)
    return result.withColumnsRenamed({f"keep_{i}": c for i, c in enumerate(carry)})
