"""Raw product lists and interaction rows to typed tables, with every refused row reported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rxlake.functions.normalize import with_normalized
from rxlake.functions.text import blank_to_null, money, stated_severity
from rxlake.operators.dedupe import first_wins, last_wins


def ingest_products(rows: DataFrame, money_style: str = "in", source: str = "PMBJP") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(products, aliases, rejected)`` of rows with canonical column names and a 1-based ``row_no``.

    Form and strength come from the name when the row has none; a row without an id gets one from its
    position. A row without a name or with an unreadable price is rejected with the reason.
    """
    have = set(rows.columns)
    text = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) if c in have else F.lit("")
    staged = rows.select(
        "row_no", text("generic_name_raw").alias("generic_name_raw"), text("mrp").alias("price_text"),
        text("product_id").alias("given_id"), text("form").alias("given_form"), text("strength_raw").alias("given_strength"),
    ).withColumn("mrp", money(F.col("price_text"), money_style))
    reason = F.when(F.col("generic_name_raw") == "", "no generic name").when(
        F.col("mrp").isNull(), F.concat(F.lit("unparseable MRP '"), F.col("price_text"), F.lit("'"))
    )
    checked = staged.withColumn("reason", reason)
    rejected = checked.filter("reason IS NOT NULL").select("row_no", "reason")
    named = with_normalized(
        checked.filter("reason IS NULL"), "generic_name_raw", ("normalized", "form", "strength_raw"), "n_"
    )
    number = F.col("row_no").cast("string")
    made_id = F.concat(F.lit("PMBJP-"), F.when(F.length(number) < 6, F.lpad(number, 6, "0")).otherwise(number))
    products = named.select(
        F.coalesce(blank_to_null(F.col("given_id")), made_id).alias("product_id"), F.lit(source).alias("source"),
        "generic_name_raw", F.coalesce(blank_to_null(F.col("given_form")), F.col("n_form")).alias("form"),
        F.coalesce(blank_to_null(F.col("given_strength")), F.col("n_strength_raw")).alias("strength_raw"), "mrp",
    )
    aliases = first_wins(
        named.filter("n_normalized <> ''").select(
            F.col("n_normalized").alias("normalized_string"), F.col("generic_name_raw").alias("raw_string"), "row_no"
        ),
        ["normalized_string"], ["row_no"],
    ).select("raw_string", "normalized_string", F.lit("pmbjp").alias("source"))
    return products, aliases, rejected


def canonical_rows(rows: DataFrame) -> DataFrame:
    """Interaction rows with both names in key space and ordered; ``usable`` is false for blanks and self-pairs."""
    keyed = with_normalized(with_normalized(rows, "drug_a", prefix="__a_"), "drug_b", prefix="__b_")
    a, b = F.col("__a_normalized"), F.col("__b_normalized")
    return keyed.select(
        *rows.columns, a.alias("key_a"), b.alias("key_b"), F.least(a, b).alias("molecule_id_a"),
        F.greatest(a, b).alias("molecule_id_b"), ((a != "") & (b != "") & (a != b)).alias("usable"),
    )


def ingest_interactions(rows: DataFrame, order: list[str], provenance: str = "ddinter") -> DataFrame:
    """One row per unordered pair; reverse rows fall on the same key and the last row wins."""
    usable = canonical_rows(rows).filter("usable")
    typed = usable.select(
        "molecule_id_a", "molecule_id_b", stated_severity(F.col("severity")).alias("severity"),
        F.coalesce(F.trim("mechanism"), F.lit("")).alias("mechanism"), *order,
    )
    chosen = last_wins(typed, ["molecule_id_a", "molecule_id_b"], order).drop(*order)
    return chosen.withColumn("provenance", F.lit(provenance))


def interaction_aliases(rows: DataFrame, order: list[str]) -> DataFrame:
    """Names seen in usable interaction rows; of a key the first spelling in row order is kept."""
    usable = canonical_rows(rows).filter("usable")
    names = usable.select(
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("side"), F.trim("drug_a").alias("raw_string"), F.col("key_a").alias("normalized_string")),
                F.struct(F.lit(1).alias("side"), F.trim("drug_b").alias("raw_string"), F.col("key_b").alias("normalized_string")),
            )
        ).alias("n"),
        *order,
    ).select("n.*", *order)
    return first_wins(names, ["normalized_string"], [*order, "side"]).select(
        "raw_string", "normalized_string", F.lit("ddinter").alias("source")
    )


def interaction_ingest_report(rows: DataFrame) -> DataFrame:
    """Input, usable and skipped rows, and the pairs they become."""
    flagged = canonical_rows(rows)
    pairs = flagged.groupBy("usable", "molecule_id_a", "molecule_id_b").agg(F.count("*").alias("n"))
    return pairs.agg(
        F.sum("n").alias("input_rows"),
        F.coalesce(F.sum(F.when(~F.col("usable"), F.col("n"))), F.lit(0)).alias("skipped"),
        F.count(F.when(F.col("usable"), 1)).alias("interactions"),
    )


def interaction_dedupe_stats(rows: DataFrame, file: str) -> DataFrame:
    """Totals of the cross-file collapse: pairs, collapsed rows, pairs in several files, severity conflicts.

    Counted from (pair, file, severity) groups, which combine before the shuffle; no pair gathers its rows.
    """
    usable = canonical_rows(rows).filter("usable")
    cells = usable.groupBy(
        "molecule_id_a", "molecule_id_b", F.col(file).alias("file"), stated_severity(F.col("severity")).alias("severity")
    ).agg(F.count("*").alias("n"))
    per_pair = cells.groupBy("molecule_id_a", "molecule_id_b").agg(
        F.sum("n").alias("n"), F.min("file").alias("f0"), F.max("file").alias("f1"),
        F.min("severity").alias("s0"), F.max("severity").alias("s1"),
    )
    return per_pair.agg(
        F.sum("n").alias("raw_rows"), F.count("*").alias("unique_pairs"), (F.sum("n") - F.count("*")).alias("rows_collapsed"),
        F.count(F.when(F.col("f0") != F.col("f1"), 1)).alias("pairs_in_several_files"),
        F.count(F.when(F.col("s0") != F.col("s1"), 1)).alias("severity_conflicts"),
    )


def severity_distribution(edges: DataFrame) -> DataFrame:
    """Pairs per severity with their share in percent."""
    counted = edges.groupBy("severity").agg(F.count("*").alias("n"))
    # The window holds one row per severity, not per pair.
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counted.select("severity", "n", F.bround(F.col("n") * 100.0 / total, 2).alias("pct"))
