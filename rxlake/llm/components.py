"""Connected components by hooking and contraction; edges and labels stay in tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxlake.llm.common import stored


def local_stars(batches):
    """Edges of a partition, batch by batch, replaced by an edge from each node to the least node it reaches."""
    for batch in batches:
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        u, v = at[: len(a)], at[len(a):]
        label = np.arange(len(nodes))
        while True:
            least = np.minimum(label[u], label[v])
            new = label.copy()
            np.minimum.at(new, label[u], least)
            np.minimum.at(new, label[v], least)
            new = new[new]
            if (new == label).all():
                break
            label = new
        apart = label != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(nodes[label[apart]])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``node`` and the least node of its component as ``label``, for each node that has an edge (``a``, ``b``)."""
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b")
    edges = stored(edges.mapInArrow(local_stars, "a long, b long").distinct(), "edges")
    labels = stored(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node")), "labels")
    while True:
        both = edges.union(edges.select("b", "a"))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("up"))
        hook = stored(hook, "hooks")
        for _ in range(2):  # pointer jumping
            next_up = hook.select(F.col("a").alias("up"), F.col("up").alias("over"))
            hook = hook.join(next_up, "up", "left").select("a", F.coalesce("over", "up").alias("up"))
        hook = stored(hook, "hooks")
        labels = stored(
            labels.join(hook.select(F.col("a").alias("label"), "up"), "label", "left")
            .select("node", F.coalesce("up", "label").alias("label")), "labels",
        )
        edges = (
            edges.join(hook, "a").select(F.col("up").alias("x"), F.col("b").alias("a")).join(hook, "a")
            .select(F.col("x").alias("a"), F.col("up").alias("b")).where("a != b").distinct()
        )
        edges = stored(edges.mapInArrow(local_stars, "a long, b long").distinct(), "edges")
        if edges.isEmpty():
            return labels
