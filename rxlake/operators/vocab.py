"""Vocabulary: keys of molecules, aliases and combination packs, and the index that resolves them.

The joins of the vocabulary's own tables are sort-merge joins: a row per molecule or pack on one side, which several
joins of one plan would each send through the driver. Requests meet a stored index, broadcast only while it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxlake.functions.normalize import with_normalized
from rxlake.functions.text import quoted
from rxlake.operators.dedupe import last_wins

INCOMPLETE_COMBINATION = (
    "{brand} is a combination pack, but {missing} of its {total} ingredients are not in the catalogue, "
    "so it cannot be checked completely and has not been accepted"
)
COMBINATION_NOTE = (
    "this pack contains more than one active ingredient; every ingredient is checked, and it cannot be "
    "swapped for a single-ingredient generic"
)


def load_molecules(molecules: DataFrame) -> DataFrame:
    """Molecules with ``inn_name`` brought into key space."""
    return with_normalized(molecules, "inn_name", ("normalized",), "__").withColumn(
        "inn_name", F.col("__normalized")
    ).drop("__normalized")


def load_aliases(aliases: DataFrame, index_raw_strings: bool = False) -> DataFrame:
    """Aliases with ``normalized_string`` brought into key space (raw string when it is empty).

    ``index_raw_strings`` also makes the raw spelling a lookup key, after the curated one.
    """
    chosen = F.coalesce(F.nullif(F.col("normalized_string"), F.lit("")), F.col("raw_string"))
    if index_raw_strings:
        both = F.array_distinct(F.array(chosen, F.coalesce(F.col("raw_string"), chosen)))
        staged = aliases.withColumn("__key", F.explode(both))
    else:
        staged = aliases.withColumn("__key", chosen)
    return (
        with_normalized(staged, "__key", ("normalized",), "__")
        .withColumn("normalized_string", F.col("__normalized"))
        .drop("__normalized", "__key")
    )


def exact_index(molecules: DataFrame) -> DataFrame:
    """key -> molecule; the smallest molecule_id wins when two molecules share a name."""
    return (
        molecules.filter(F.col("inn_name") != "")
        .groupBy(F.col("inn_name").alias("key"))
        .agg(F.min_by(F.struct("molecule_id", "inn_name", "category"), F.col("molecule_id")).alias("m"))
        .select("key", "m.*")
    )


def molecule_table(molecules: DataFrame) -> DataFrame:
    """One row per molecule_id."""
    return molecules.groupBy("molecule_id").agg(
        F.max("inn_name").alias("inn_name"), F.max("category").alias("category")
    )


def alias_index(aliases: DataFrame, molecules: DataFrame, order: list[str]) -> DataFrame:
    """key -> molecule with the alias it came from.

    An alias whose molecule does not exist is never written; of the others the last one in ``order`` wins.
    """
    known = molecule_table(molecules)
    usable = aliases.filter(F.col("normalized_string") != "").join(
        known.select("molecule_id").hint("merge"), "molecule_id", "left_semi"
    )
    chosen = last_wins(
        usable.select("normalized_string", "raw_string", "source", "molecule_id", *order), ["normalized_string"], order
    )
    return chosen.join(known.hint("merge"), "molecule_id").select(
        F.col("normalized_string").alias("key"),
        "molecule_id",
        "inn_name",
        "category",
        F.col("raw_string").alias("alias_raw_string"),
        F.col("source").alias("alias_source"),
    )


def combination_index(combinations: DataFrame, order: list[str]) -> DataFrame:
    """Component rows of every pack with at least two components, with their order in the pack.

    ``brand_key`` falls back to the normalised raw name; rows without key or molecule are skipped. Name and
    kind of a pack come from its first row in ``order``. Packs stay in long form (a row per component), so
    no pack is gathered into one row.
    """
    staged = with_normalized(combinations, "brand_raw", ("normalized",), "__")
    key = F.coalesce(F.nullif(F.trim("brand_key"), F.lit("")), F.col("__normalized"))
    rows = staged.select(
        key.alias("brand_key"),
        F.coalesce(F.nullif(F.trim("brand_raw"), F.lit("")), key).alias("brand_raw"),
        F.nullif(F.trim("molecule_id"), F.lit("")).alias("molecule_id"),
        F.coalesce(F.nullif(F.trim("inn_name"), F.lit("")), F.col("molecule_id")).alias("inn_name"),
        F.coalesce(F.col("position").cast("int"), F.lit(0)).alias("position"),
        F.coalesce(F.nullif(F.trim("kind"), F.lit("")), F.lit("brand")).alias("kind"),
        *order,
    ).filter((F.col("brand_key") != "") & F.col("molecule_id").isNotNull())
    packs = (
        rows.groupBy("brand_key")
        .agg(
            F.count("*").alias("n_components"),
            F.min_by(F.struct("brand_raw", "kind"), F.struct(*order)).alias("b"),
        )
        .filter(F.col("n_components") >= 2)
        .select("brand_key", "n_components", F.col("b.brand_raw").alias("pack"), F.col("b.kind").alias("pack_kind"))
    )
    return rows.drop("brand_raw", "kind", *order).join(packs.hint("merge"), "brand_key").select(
        "brand_key", F.col("pack").alias("brand_raw"), "molecule_id", "inn_name", "position",
        F.col("pack_kind").alias("kind"), "n_components",
    )


def dropped_combinations(combinations: DataFrame, index: DataFrame) -> DataFrame:
    """Packs refused because they name fewer than two components."""
    staged = with_normalized(combinations, "brand_raw", ("normalized",), "__")
    key = F.coalesce(F.nullif(F.trim("brand_key"), F.lit("")), F.col("__normalized"))
    return (
        staged.select(key.alias("brand_key"))
        .filter("brand_key <> ''")
        .groupBy("brand_key")
        .agg(F.count("*").alias("n_rows"))
        .join(index.select("brand_key"), "brand_key", "left_anti")
    )


def combination_status(index: DataFrame, molecules: DataFrame) -> DataFrame:
    """One row per pack: accepted only when every component exists."""
    known = molecule_table(molecules).select("molecule_id", F.lit(1).alias("__found"))
    return (
        index.join(known.hint("merge"), "molecule_id", "left")
        .groupBy(F.col("brand_key").alias("key"))
        .agg(
            F.max("brand_raw").alias("brand_raw"),
            F.count("*").alias("n_components"),
            F.count("__found").alias("n_found"),
        )
        .withColumn("complete", F.col("n_components") == F.col("n_found"))
    )


def combination_components(index: DataFrame, molecules: DataFrame) -> DataFrame:
    """Components of the complete packs, names taken from the catalogue."""
    complete = combination_status(index, molecules).filter("complete").select(F.col("key").alias("brand_key"))
    names = molecule_table(molecules).select("molecule_id", F.col("inn_name").alias("catalogue_name"))
    return (
        index.join(complete.hint("merge"), "brand_key", "left_semi")
        .join(names.hint("merge"), "molecule_id")
        .select(
            "brand_key", "brand_raw", "molecule_id", F.col("catalogue_name").alias("inn_name"), "position",
            F.col("inn_name").alias("listed_name"),
        )
    )


def resolution_index(
    molecules: DataFrame, aliases: DataFrame, combinations: DataFrame, alias_order: list[str]
) -> DataFrame:
    """key -> outcome, with exact before alias before combination already decided.

    ``combinations`` is the output of :func:`combination_index`. Because the precedence is settled here,
    resolving any number of drug strings is one equi-join on the key.
    """
    null = F.lit(None).cast("string")

    def row(rank: int, status, path, fields: dict) -> Column:
        names = ["molecule_id", "inn_name", "category", "alias_raw_string", "alias_source", "brand_raw"]
        return F.struct(
            F.lit(rank).alias("rank"),
            status.alias("status"),
            path.alias("path"),
            *[fields.get(n, null).alias(n) for n in names],
            fields.get("n_components", F.lit(None).cast("bigint")).alias("n_components"),
            fields.get("note", null).alias("note"),
        )

    hit = {n: F.col(n) for n in ("molecule_id", "inn_name", "category")}
    exact = exact_index(molecules).select("key", row(0, F.lit("resolved"), F.lit("exact"), hit).alias("r"))
    alias = alias_index(aliases, molecules, alias_order).select(
        "key",
        row(
            1, F.lit("resolved"), F.lit("alias"),
            {**hit, "alias_raw_string": F.col("alias_raw_string"), "alias_source": F.col("alias_source")},
        ).alias("r"),
    )
    before, after = INCOMPLETE_COMBINATION.split("{brand}")
    middle, rest = after.split("{missing}")
    of, end = rest.split("{total}")
    refused = F.concat(
        F.lit(before), quoted(F.col("brand_raw")), F.lit(middle), (F.col("n_components") - F.col("n_found")).cast("string"),
        F.lit(of), F.col("n_components").cast("string"), F.lit(end),
    )
    packs = combination_status(combinations, molecules).select(
        "key",
        row(
            2, F.when(F.col("complete"), "combination").otherwise("unresolved"), null,
            {
                "brand_raw": F.col("brand_raw"),
                "n_components": F.col("n_components"),
                "note": F.when(F.col("complete"), F.lit(COMBINATION_NOTE)).otherwise(refused),
            },
        ).alias("r"),
    )
    return (
        exact.unionByName(alias)
        .unionByName(packs)
        .groupBy("key")
        .agg(F.min_by("r", F.col("r.rank")).alias("r"))
        .select("key", "r.*")
        .drop("rank")
    )


def surface_forms(molecules: DataFrame, aliases: DataFrame, alias_order: list[str]) -> DataFrame:
    """Every name a molecule can be found under: ``molecule_id, inn_name, surface, is_alias``.

    Long form on purpose: a molecule with very many aliases is many rows, not one wide row.
    """
    names = molecule_table(molecules)
    own = names.select("molecule_id", "inn_name", F.col("inn_name").alias("surface"), F.lit(False).alias("is_alias"))
    other = alias_index(aliases, molecules, alias_order).select(
        "molecule_id", "inn_name", F.col("key").alias("surface"), F.lit(True).alias("is_alias")
    )
    return own.unionByName(other)


def molecules_by_ids(ids: DataFrame, molecules: DataFrame) -> DataFrame:
    """Catalogue rows of the requested ids, each once."""
    wanted = ids.select("molecule_id").distinct()
    return molecules.join(wanted, "molecule_id", "left_semi").select("molecule_id", "inn_name", "category")


def anchor_enrich(molecules: DataFrame, anchors: DataFrame, order: list[str]) -> DataFrame:
    """``ddinter_anchor`` from (drug, top_file) rows; the last row of a drug wins."""
    rows = anchors.select(
        F.lower(F.trim("drug")).alias("__drug"), F.trim("top_file").alias("ddinter_anchor"), *order
    ).filter((F.col("__drug") != "") & (F.col("ddinter_anchor") != ""))
    chosen = last_wins(rows, ["__drug"], order).select("__drug", "ddinter_anchor")
    return (
        molecules.drop("ddinter_anchor")
        .join(chosen, F.lower("inn_name") == F.col("__drug"), "left")
        .drop("__drug")
    )


def missing_aliases(source: DataFrame, loaded: DataFrame) -> DataFrame:
    """Alias keys present in the source table and absent from the loaded one."""
    return source.select("normalized_string").distinct().join(
        loaded.select("normalized_string").hint("merge"), "normalized_string", "left_anti"
    )


def edges_with_endpoints(edges: DataFrame, endpoints: list[tuple[str, DataFrame, str]]) -> tuple[DataFrame, DataFrame]:
    """``(kept, dangling)``: edges whose endpoints all exist, and the rest.

    ``endpoints`` lists (edge column, node table, node column). The node side is reduced to distinct
    ids, so the join never multiplies edges.
    """
    flagged, flags = edges, []
    for i, (column, nodes, node_column) in enumerate(endpoints):
        ids = nodes.select(F.col(node_column).alias(f"__id{i}")).distinct()
        flagged = flagged.join(ids, F.col(column) == F.col(f"__id{i}"), "left")
        flags.append(F.col(f"__id{i}").isNotNull())
    ok = flags[0]
    for flag in flags[1:]:
        ok = ok & flag
    flagged = flagged.withColumn("__ok", ok).drop(*[f"__id{i}" for i in range(len(endpoints))])
    return flagged.filter("__ok").drop("__ok"), flagged.filter("NOT __ok").drop("__ok")


def graph_counts(nodes: dict[str, DataFrame], edges: dict[str, DataFrame]) -> DataFrame:
    """Row counts by label and relationship type: ``kind, name, n``."""
    parts = [
        df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), "n")
        for kind, tables in (("node", nodes), ("relationship", edges))
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
