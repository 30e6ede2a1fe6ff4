"""Row validation as columns: nothing is raised per row, every row carries its first failed rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxlake import vocab_constants as V

STAGES = ("molecules", "products", "contains", "aliases", "brand_aliases", "interactions")


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) == ""


def _missing(names, what: str) -> tuple[Column, str]:
    return reduce(lambda a, b: a | b, [_blank(n) for n in names]), f"{what} is missing required properties"


def _not_in(name: str, allowed, what: str) -> tuple[Column, str]:
    return ~F.coalesce(F.col(name).isin(allowed), F.lit(False)), f"Invalid {what}"


def molecule_rules() -> list[tuple[Column, str]]:
    return [
        _missing(["molecule_id", "inn_name", "category"], "Molecule"),
        _not_in("category", V.MOLECULE_CATEGORIES, "Molecule.category"),
    ]


def product_rules() -> list[tuple[Column, str]]:
    price = F.trim(F.col("mrp").cast("string"))
    value = price.try_cast("double")
    return [
        _missing(["product_id", "source", "generic_name_raw"], "Product"),
        (F.col("mrp").isNull(), "Product.mrp is required"),
        (value.isNull(), "Product.mrp must be numeric"),
        (value < 0, "Product.mrp must be non-negative"),
        _not_in("source", V.PRODUCT_SOURCES, "Product.source"),
    ]


def alias_rules() -> list[tuple[Column, str]]:
    return [
        _missing(["raw_string", "normalized_string", "source"], "Alias"),
        _missing(["molecule_id"], "Alias (ALIAS_OF target)"),
        _not_in("source", V.ALIAS_SOURCES, "Alias.source"),
    ]


def contains_rules() -> list[tuple[Column, str]]:
    return [_missing(["product_id", "molecule_id"], "CONTAINS")]


def interaction_rules() -> list[tuple[Column, str]]:
    return [
        _missing(["molecule_id_a", "molecule_id_b", "severity"], "INTERACTS_WITH"),
        (F.col("molecule_id_a") == F.col("molecule_id_b"), "INTERACTS_WITH requires two distinct molecules"),
    ]


RULES = {
    "molecules": molecule_rules,
    "products": product_rules,
    "contains": contains_rules,
    "aliases": alias_rules,
    "brand_aliases": alias_rules,
    "interactions": interaction_rules,
}


def validate_rows(df: DataFrame, stage: str) -> DataFrame:
    """Add ``error`` (first failed rule, null when the row is good) and ``errors`` (all of them)."""
    rules = RULES[stage]()
    first = F.coalesce(*[F.when(bad, F.lit(text)) for bad, text in rules])
    every = F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in rules]))
    return df.select("*", first.alias("error"), every.alias("errors"))


def reject_split(df: DataFrame, stage: str) -> tuple[DataFrame, DataFrame]:
    """Lenient load: ``(accepted, rejected)``; rejected rows keep their values, stage and error."""
    checked = validate_rows(df, stage)
    accepted = checked.filter(F.col("error").isNull()).drop("error", "errors")
    rejected = checked.filter(F.col("error").isNotNull()).select(F.lit(stage).alias("stage"), "*")
    return accepted, rejected


def strict_rows(df: DataFrame, stage: str) -> DataFrame:
    """Strict load: the job fails on the first bad row it meets."""
    checked = validate_rows(df, stage)
    guard = F.when(F.col("error").isNull(), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit(f"{stage}: "), F.col("error"))).cast("boolean")
    )
    return checked.filter(guard).drop("error", "errors")
