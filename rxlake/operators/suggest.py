"""Type-ahead: names that start with, then contain, a typed fragment."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rxlake import vocab_constants as V
from rxlake.functions.normalize import with_normalized
from rxlake.operators.fuzzy import confusable_partners
from rxlake.sources.artifacts import stored

#: Fragments up to this length are answered from ranked lists.
DEPTH = 6


def suggestion_labels(surfaces: DataFrame, combinations: DataFrame) -> DataFrame:
    """Everything that can be offered, once per case-folded label, with its search key.

    A molecule's own name goes first, then its aliases, then combination packs.
    """
    own = surfaces.select(
        F.trim("surface").alias("label"),
        F.when(F.col("is_alias"), "other_name").otherwise("ingredient").alias("kind"),
        F.when(F.col("is_alias"), F.col("inn_name")).alias("ingredient"), "molecule_id",
        F.lit(0).alias("stage"), F.col("is_alias").alias("second"),
    )
    # The label of a pack lists its ingredients: gathered per pack, as a pack is printed.
    packs = combinations.groupBy("brand_key").agg(
        F.max("brand_raw").alias("label"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("position", "inn_name"))), lambda c: c["inn_name"]), " + "
        ).alias("ingredient"),
    ).select(
        F.trim("label").alias("label"), F.lit("combination").alias("kind"), "ingredient",
        F.lit(None).cast("string").alias("molecule_id"), F.lit(1).alias("stage"), F.lit(False).alias("second"),
    )
    offered = own.unionByName(packs).filter("label <> ''").withColumn("folded", F.lower("label"))
    order = F.struct("stage", F.coalesce("molecule_id", F.lit("")).alias("m"), "second", "label")
    chosen = offered.groupBy("folded").agg(
        F.min_by(F.struct("label", "kind", "ingredient", "molecule_id"), order).alias("o")
    ).select("folded", "o.*")
    return with_normalized(chosen, "label", prefix="__").withColumnRenamed("__normalized", "label_key")


def _grams(text, size: int):
    n = F.char_length(text)
    return F.when(
        n >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.substr(text, i, F.lit(size))))
    ).otherwise(F.array().cast("array<string>"))


@dataclass
class SuggestionIndex:
    """Labels by the pieces of their keys, with the best labels of every short piece.

    ``ranked`` (piece, rank, label fields) answers fragments of up to ``DEPTH`` characters: the order of a fragment's
    labels depends on the fragment and the label alone, so the first ``SUGGEST_MAX_LIMIT`` labels of a piece are the
    answer to that fragment and the cut is exact. ``long`` (piece, folded, label_key) holds all labels of every piece of
    ``DEPTH`` characters, for fragments that are longer; ``sizes`` says how many. ``alike`` (label_key, partner_key,
    other) holds the look-alikes of every label, whether or not they are ever shown.
    """

    labels: DataFrame
    ranked: DataFrame
    long: DataFrame
    sizes: DataFrame
    alike: DataFrame

    def prepare(self, folder: str) -> SuggestionIndex:
        """The same index stored in ``folder``, for many queries."""
        return SuggestionIndex(**{f.name: stored(getattr(self, f.name), folder, f"suggest-{f.name}") for f in fields(self)})


def label_order(fragment):
    """Labels that start with the fragment go first, then shorter ones, then by their folded form."""
    return [F.when(F.startswith("label_key", fragment), 0).otherwise(1), F.char_length("label"), F.col("folded")]


def suggestion_index(labels: DataFrame, pairs: DataFrame) -> SuggestionIndex:
    """Index of ``suggestion_labels`` and of the look-alike pairs.

    A piece that many labels hold costs a task of the ranking at most the limit times the tasks before it: Spark cuts
    each partition to the first ranks before it shuffles. An empty key has no piece and is never offered.
    """
    key = F.col("label_key")
    cut = F.concat(*[_grams(key, size) for size in range(1, DEPTH + 1)])
    order = Window.partitionBy("piece").orderBy(*label_order(F.col("piece")))
    pieces = labels.withColumn("piece", F.explode(cut)).withColumn("rank", F.row_number().over(order))
    long = labels.select("folded", "label_key", F.explode(_grams(key, DEPTH)).alias("piece"))
    alike = confusable_partners(pairs).join(
        labels.select(F.col("label_key").alias("partner"), F.col("label").alias("other")).hint("merge"), "partner"
    )
    return SuggestionIndex(
        labels=labels, ranked=pieces.filter(F.col("rank") <= V.SUGGEST_MAX_LIMIT), long=long,
        sizes=long.groupBy("piece").agg(F.count("*").alias("n")),
        alike=alike.select(F.col("key").alias("label_key"), F.col("partner").alias("partner_key"), "other"),
    )


def matches(queries: DataFrame, index: SuggestionIndex, limit: int) -> DataFrame:
    """Distinct query keys with their first labels and ranks.

    Keys of up to ``DEPTH`` characters read their ranked list. Longer ones take the piece of ``DEPTH`` characters that
    the fewest labels hold and test those labels.
    """
    q = F.col("query_key")
    wanted = queries.select("query_key").filter("query_key <> ''").distinct()
    short = wanted.filter(F.char_length(q) <= DEPTH).join(
        index.ranked.filter(F.col("rank") <= limit).withColumnRenamed("piece", "query_key"), "query_key"
    )
    rarest = (
        wanted.filter(F.char_length(q) > DEPTH).select("query_key", F.explode(_grams(q, DEPTH)).alias("piece"))
        .join(index.sizes, "piece", "left")
        .groupBy("query_key")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("p"))
        .select("query_key", F.col("p.piece").alias("piece"))
    )
    held = rarest.join(index.long, "piece").filter(F.contains("label_key", "query_key")).select("query_key", "folded")
    order = Window.partitionBy("query_key").orderBy(*label_order(q))
    tested = held.join(index.labels, "folded").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    columns = ["query_key", "rank", *index.labels.columns]
    return short.select(*columns).unionByName(tested.select(*columns))


def suggest(
    queries: DataFrame, labels: DataFrame, pairs: DataFrame, limit: int = V.SUGGEST_DEFAULT_LIMIT,
    index: SuggestionIndex | None = None,
) -> DataFrame:
    """Ranked suggestions per query with the look-alikes that the same query also finds.

    ``queries`` has ``q``. Prefix matches come before inner matches, shorter labels before longer.
    A look-alike counts when it matches the query too, shown or not, so it is tested against the label
    table rather than against the limited list. ``index`` is a ``suggestion_index`` of the same labels and pairs; it is
    built here when it is not given.
    """
    if not 1 <= limit <= V.SUGGEST_MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {V.SUGGEST_MAX_LIMIT}")
    index = index or suggestion_index(labels, pairs)
    asked = with_normalized(queries.select("q").distinct(), "q", prefix="__").withColumnRenamed("__normalized", "query_key")
    shown = matches(asked, index, limit)
    flagged = (
        shown.select("query_key", "label", "label_key")
        .join(index.alike, "label_key")
        .filter(F.contains("partner_key", "query_key") & (F.col("other") != F.col("label")))
        .groupBy("query_key", "label")
        .agg(F.array_join(F.array_sort(F.collect_set("other")), "|").alias("confusable_with"))
    )
    out = shown.join(flagged, ["query_key", "label"], "left")
    return asked.join(out, "query_key").select(
        "q", "rank", "label", "kind", "ingredient", "molecule_id", F.coalesce("confusable_with", F.lit("")).alias("confusable_with")
    )
