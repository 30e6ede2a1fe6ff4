"""Hard negatives: exact inner products by packed multiplication.

A tile meets a block of anchors and a shard of rows. Components are made non-negative by a bias, and one component of
a thousand rows becomes one wide integer, a field a row. An anchor multiplies each of its (biased) components once by
that integer and adds the products up; every field then holds one row's biased inner product, and what the biases
added is taken off again. Fields are wide enough for the largest sum, so nothing carries over and scores are exact.

The tiles run twice: first for each anchor's best rows of its label, then, with their scores known, for the rows of
other labels inside each band of scores. Each tile keeps a few rows an anchor; lists are merged in two levels.
"""

from __future__ import annotations

import math
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxlake.llm.common import ready, stored
from rxlake.llm.topk import matrix

SHARD = 16_384
BLOCK = 2_048
FIELDS = 1_024  # rows packed into one integer
FAN = 16  # shards whose rows are merged first


def whole(values: np.ndarray) -> np.ndarray:
    """Integral floats as integers of any size."""
    if np.abs(values).max(initial=0) < 2**62:
        return values.astype(np.int64)
    return np.array([[int(x) for x in row] for row in values], object).reshape(values.shape)


class Packed:
    """Rows packed field by field, for anchors whose components are at most ``most`` in size."""

    def __init__(self, rows: np.ndarray, most: int):
        self.count, dim = rows.shape
        self.bias, self.most = int(np.abs(rows).max(initial=0)), most
        room = max(4 * self.bias * most * dim, 2 * self.bias).bit_length()
        self.width = next((w for w in (4, 8) if room <= 8 * w), -(-room // 8))
        if self.width > 8:
            rows = rows.astype(object)
        lifted = rows + self.bias
        if self.width in (4, 8):
            lifted = np.ascontiguousarray(lifted.T.astype(f"<u{self.width}"))
            self.columns = [int.from_bytes(c.tobytes(), "little") for c in lifted]
        else:
            self.columns = [int.from_bytes(b"".join(int(x).to_bytes(self.width, "little") for x in c), "little") for c in lifted.T]
        # the part of the bias that hangs on the row alone
        self.own = most * rows.sum(axis=1) + dim * most * self.bias

    def products(self, anchor: list[int]) -> np.ndarray:
        """Exact inner products with every row; one beyond 64 bits stays at the nearest 64-bit value."""
        total = sum(map(mul, [a + self.most for a in anchor], self.columns))
        data, taken = total.to_bytes(self.width * self.count, "little"), self.bias * sum(anchor)
        if self.width == 4:
            return np.frombuffer(data, "<u4").astype(np.int64) - self.own - taken
        if self.width == 8:  # differences wrap around, and true scores are below 2 ** 62 here
            return (np.frombuffer(data, "<u8") - self.own.astype(np.uint64) - np.uint64(taken % 2**64)).astype(np.int64)
        fields = [int.from_bytes(data[i:i + self.width], "little") for i in range(0, len(data), self.width)]
        low, high = -(1 << 63), (1 << 63) - 1
        return np.array([min(max(f - int(o) - taken, low), high) for f, o in zip(fields, self.own)], np.int64)


def tile(pick, columns: list[str]):
    """For each anchor of the block the rows that ``pick`` keeps of its scores with all rows of the shard."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {c: [np.zeros(0, np.int64)] for c in columns}
        if left.num_rows and right.num_rows:
            ids, labels = right.column("row_id").to_numpy(), right.column("row_label").to_numpy()
            rows, anchors = (whole(matrix(t.column(c).combine_chunks())) for t, c in ((right, "row_vector"), (left, "vector")))
            most = int(np.abs(anchors).max(initial=0))
            packs = [Packed(rows[i:i + FIELDS], most) for i in range(0, len(rows), FIELDS)]
            asked = left.column("asked").to_pylist()
            for a, (anchor, key, label) in enumerate(zip(*(left.column(c).to_pylist() for c in ("anchor_id", "anchor_key", "label")))):
                score = np.concatenate([p.products([int(x) for x in anchors[a]]) for p in packs])
                found = pick(score, ids, labels == label, ids != anchor, asked[a])
                for c, values in zip(columns, (np.full(len(found[0]), anchor), np.full(len(found[0]), key), *found)):
                    out[c].append(values)
        return pa.table({c: np.concatenate(v) for c, v in out.items()})

    return run


def top(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Of these rows the k with the highest scores, ties to the smaller id."""
    down = ~score[rows]  # unlike the negative of a score, never out of range
    if len(rows) > k:
        near = down <= np.partition(down, k - 1)[k - 1]
        rows, down = rows[near], down[near]
    return rows[np.lexsort((ids[rows], down))[:k]]


def mine_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, n_positives: int = 5, n_negatives: int = 5, least_percent: int = 80, scale: float = 256.0,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score`` and ``negative_score``.

    Needs ``vec_id``, ``embedding`` and the label. Each component counts as floor(scale * x). Rows without an id, a
    label or a vector, or with a null or non-finite component, take no part. An anchor's positives are its best rows
    of the same label, the negatives of each are the best rows of another label from ``least_percent`` of the
    positive's score up to that score. Ties go to the smaller id. A row never meets a row of its own id; rows that
    share an id are rows of their own, but anchors equal in id, label and vector are one. Vectors of different lengths
    do not meet, and the product of empty ones is 0. An empty table gives an empty result.
    """
    ready(vectors.sparkSession)
    sound = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.col("row_label").isNotNull() & F.expr(
        "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )
    usable = vectors.select(F.col("vec_id").cast("long"), "embedding", label.cast("long").alias("row_label"), is_anchor.alias("asks")).where(sound).select(
        "vec_id", "row_label", "asks", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("place"),
        # from 2 ** 52 on a double is whole, and floor() would cut it to a long
        F.expr(
            f"transform(transform(embedding, x -> cast({scale!r}D as double) * cast(x as double)), "
            "x -> if(abs(x) < 4503599627370496D, cast(floor(x) as double), x))"
        ).alias("vector"),
    )
    total, asked = usable.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    shards, blocks = max(1, math.ceil(total / SHARD)), max(1, math.ceil(asked / BLOCK))
    rows = usable.select(
        F.col("vec_id").alias("row_id"), "row_label", F.col("vector").alias("row_vector"), F.col("dim").alias("row_dim"),
        F.pmod(F.xxhash64("vec_id", "place"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    anchors = usable.where("asks").select(F.col("vec_id").alias("anchor_id"), F.col("row_label").alias("label"), "vector", "dim").distinct()
    anchors = anchors.withColumn("anchor_key", F.xxhash64("anchor_id", "label", "vector"))
    whose = ["anchor_id", "anchor_key"]

    def met(asking: DataFrame, pick, columns: dict[str, str]) -> DataFrame:
        names = [*whose, *columns]
        dealt = asking.withColumns({"block": F.pmod("anchor_key", F.lit(blocks)).cast("int"), "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))})
        tiles = dealt.groupBy("dim", "block", "shard").cogroup(rows.groupBy("row_dim", "block", "shard"))
        return tiles.applyInArrow(tile(pick, names), ", ".join(f"{c} long" for c in names))

    def merged(lists: DataFrame, by: list[str], k: int, rank: str) -> DataFrame:
        """The k best of each list, first in parts of about ``FAN`` shards' rows."""
        order, first = [F.desc("score"), F.asc("vec_id")], max(1, math.ceil(shards / FAN))
        part = F.pmod(F.xxhash64("vec_id"), F.lit(first))
        lists = lists.withColumn(rank, F.row_number().over(Window.partitionBy(*by, part).orderBy(*order))).where(F.col(rank) <= k)
        return lists.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)

    def near(score, ids, same, other, _):
        rows = top(score, ids, np.flatnonzero(same & other), n_positives)
        return ids[rows], score[rows]

    def inside(score, ids, same, other, bands):
        free, found = np.flatnonzero(~same & other), [(np.zeros(0, np.int64),) * 3]
        value = score[free]
        for bound in sorted({b for b in bands if b is not None}):
            rows = free[(value >= -(-least_percent * bound // 100)) & (value <= bound)]
            rows = top(score, ids, rows, n_negatives)
            found.append((np.full(len(rows), bound), ids[rows], score[rows]))
        return tuple(np.concatenate(x) for x in zip(*found))

    lists = met(anchors.withColumn("asked", F.array().cast("array<long>")), near, {"vec_id": "row", "score": "score"})
    positives = stored(merged(lists, whose, n_positives, "nth").select(*whose, F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    bands = positives.groupBy(*whose).agg(F.sort_array(F.collect_set("positive_score")).alias("asked"))
    lists = met(anchors.join(bands, whose), inside, {"bound": "bound", "vec_id": "row", "score": "score"})
    negatives = merged(lists, [*whose, "bound"], n_negatives, "rank").withColumnRenamed("bound", "positive_score")
    return positives.join(negatives, [*whose, "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
