"""Brand packs: one curated row per trade name, validated against catalogue, aliases and blocklist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxlake.functions.normalize import with_normalized
from rxlake.operators.fuzzy import confusable_partners

# --- Fixed values: rejection reasons, in the order they are tested ---
EMPTY_KEY = "normalizes to an empty key"
IS_MOLECULE = "collides with a molecule name"
NO_INGREDIENTS = "no ingredients listed"
MISSING_INGREDIENT = "ingredient not in catalogue"
DUPLICATE = "duplicate brand with different ingredients"
IS_ALIAS = "already in the alias table"
CONFUSABLE = "blocklisted confusable"


def validate_brands(pack: DataFrame, names: DataFrame, alias_keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """Outcome of every brand row: ``alias``, ``combination``, ``rejected`` (with reason) or ``skipped``.

    ``pack`` has ``row_no, brand, ingredients ('|' separated), kind``; ``names`` is key -> molecule;
    ``alias_keys`` one column of claimed keys; ``pairs`` the blocklist. A row is compared with the first
    accepted row of its key, never with all rows of it.
    """
    kind = F.lower(F.coalesce(F.nullif(F.trim("kind"), F.lit("")), F.lit("brand")))
    rows = pack.select("row_no", F.trim("brand").alias("brand"), "ingredients", kind.alias("kind")).filter("brand <> ''")
    rows = with_normalized(rows, "brand", prefix="__").withColumnRenamed("__normalized", "brand_key")
    listed = F.filter(
        F.transform(F.split(F.coalesce("ingredients", F.lit("")), r"\|"), lambda p: F.trim(p)), lambda x: x != ""
    )
    rows = rows.withColumn("listed", listed).drop("ingredients")

    parts = rows.select("row_no", F.posexplode("listed").alias("at", "ingredient"))
    found = with_normalized(parts, "ingredient", prefix="__").join(
        names.select(F.col("key").alias("__normalized"), "molecule_id", "inn_name").hint("merge"), "__normalized", "left"
    )
    # Gathers the ingredients of one row, which came out of that row.
    item = F.struct("at", "ingredient", "molecule_id", "inn_name")
    per_row = found.groupBy("row_no").agg(F.array_sort(F.collect_list(item)).alias("parts"))
    molecules = names.select(F.col("key").alias("brand_key"), F.lit(True).alias("is_molecule"))
    claimed = alias_keys.select(F.col(alias_keys.columns[0]).alias("brand_key")).filter("brand_key <> ''").distinct()
    partners = (
        confusable_partners(pairs)
        .join(names.select(F.col("key").alias("partner")).hint("merge"), "partner", "left_semi")
        .groupBy(F.col("key").alias("brand_key")).agg(F.min("partner").alias("look_alike"))
    )
    # Sort-merge: a row per brand or name in each, and Spark would send every one that it guesses small through the driver.
    checked = (
        rows.join(per_row.hint("merge"), "row_no", "left")
        .join(molecules.hint("merge"), "brand_key", "left")
        .join(claimed.withColumn("is_alias", F.lit(True)).hint("merge"), "brand_key", "left")
        .join(partners.hint("merge"), "brand_key", "left")
    )
    missing = F.array_join(
        F.transform(F.filter("parts", lambda p: p["molecule_id"].isNull()), lambda p: p["ingredient"]), ", "
    )
    row_reason = (
        F.when(F.col("brand_key") == "", EMPTY_KEY)
        .when(F.coalesce("is_molecule", F.lit(False)) & (F.col("kind") != "synonym"), IS_MOLECULE)
        .when(F.size("listed") == 0, NO_INGREDIENTS)
        .when(missing != "", MISSING_INGREDIENT)
    )
    staged = checked.select(
        "row_no", "brand", "brand_key", "kind", "parts", "look_alike", "is_alias", row_reason.alias("row_reason"),
        missing.alias("missing"), F.transform("parts", lambda p: p["molecule_id"]).alias("ids"),
    )
    eligible = staged.filter("row_reason IS NULL AND is_alias IS NULL AND look_alike IS NULL")
    first = eligible.groupBy("brand_key").agg(F.min_by(F.struct("row_no", "ids"), F.col("row_no")).alias("first"))
    joined = staged.join(first.hint("merge"), "brand_key", "left")
    earlier = F.col("row_reason").isNull() & (F.col("first.row_no") < F.col("row_no"))
    reason = (
        F.when(F.col("row_reason").isNotNull(), F.col("row_reason"))
        .when(earlier & (F.col("first.ids") != F.col("ids")), DUPLICATE)
        .when(earlier, F.lit(None).cast("string"))
        .when(F.col("is_alias"), IS_ALIAS)
        .when(F.col("look_alike").isNotNull(), CONFUSABLE)
    )
    detail = (
        F.when(reason == IS_MOLECULE, F.concat("brand_key", F.lit(" is an INN in the catalogue")))
        .when(reason == MISSING_INGREDIENT, F.col("missing"))
        .when(reason == DUPLICATE, F.col("brand_key"))
        .when(reason == IS_ALIAS, F.concat("brand_key", F.lit(" is claimed by an existing entry, which keeps precedence")))
        .when(reason == CONFUSABLE, F.concat(F.lit("look-alike of "), F.col("look_alike")))
        .when(reason.isNotNull(), F.lit(""))
    )
    outcome = (
        F.when(reason.isNotNull(), "rejected")
        .when(earlier, "skipped")
        .when(F.size("parts") == 1, "alias")
        .otherwise("combination")
    )
    return joined.select(
        "row_no", "brand", "brand_key", "kind", outcome.alias("outcome"), reason.alias("reason"), detail.alias("detail"), "parts"
    )


def brand_aliases(validated: DataFrame) -> DataFrame:
    part = F.element_at("parts", 1)
    return validated.filter("outcome = 'alias'").select(
        F.col("brand").alias("raw_string"), F.col("brand_key").alias("normalized_string"), F.lit("manual").alias("source"),
        part["molecule_id"].alias("molecule_id"), part["inn_name"].alias("inn_name"),
    )


def brand_combinations(validated: DataFrame) -> DataFrame:
    return validated.filter("outcome = 'combination'").select(
        "brand_key", F.col("brand").alias("brand_raw"), "kind", F.posexplode("parts").alias("at", "p")
    ).select(
        "brand_key", "brand_raw", F.col("p.molecule_id").alias("molecule_id"), F.col("p.inn_name").alias("inn_name"),
        (F.col("at") + 1).alias("position"), "kind",
    )


def brand_rejections(validated: DataFrame) -> DataFrame:
    """Rejected rows by reason, most common first."""
    return validated.filter("outcome = 'rejected'").groupBy("reason").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "reason"
    )
