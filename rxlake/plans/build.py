"""From raw tables to the loaded set, and the reports about it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxlake.operators import bridge, coverage, ingest
from rxlake.operators.dedupe import assign_molecule_ids, last_wins
from rxlake.operators.interactions import canonical_edges
from rxlake.operators.validate import STAGES, reject_split, strict_rows
from rxlake.operators.vocab import edges_with_endpoints, load_aliases, load_molecules
from rxlake.sources.artifacts import read_stage

# --- Fixed values: keys of the loaded tables ---
KEYS = {
    "molecules": ["molecule_id"],
    "products": ["product_id"],
    "contains": ["product_id", "molecule_id"],
    "aliases": ["normalized_string"],
    "brand_aliases": ["normalized_string"],
    "interactions": ["molecule_id_a", "molecule_id_b"],
}


@dataclass
class Loaded:
    """Validated, keyed tables plus what was refused on the way."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    offered: dict[str, DataFrame] = field(default_factory=dict)
    rejected: dict[str, DataFrame] = field(default_factory=dict)
    dangling: dict[str, DataFrame] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)


def load_tables(stages: dict[str, DataFrame | None], order: list[str], strict: bool = True) -> Loaded:
    """Load tables already at hand in dependency order; each table carries the ``order`` columns.

    Keys are re-normalised on load. A stage that is None is skipped and reported, not an error. Strict
    loading fails on a bad row, lenient loading sets bad rows aside.
    """
    out = Loaded()
    for stage in STAGES:
        rows = stages.get(stage)
        if rows is None:
            out.skipped.append(stage)
            continue
        if stage == "molecules":
            rows = load_molecules(rows)
        elif stage in ("aliases", "brand_aliases"):
            rows = load_aliases(rows)
        out.offered[stage] = rows
        if strict:
            good = strict_rows(rows, stage)
        else:
            good, out.rejected[stage] = reject_split(rows, stage)
        molecules, products = out.tables.get("molecules"), out.tables.get("products")
        ends = {
            "contains": [("product_id", products, "product_id"), ("molecule_id", molecules, "molecule_id")],
            "aliases": [("molecule_id", molecules, "molecule_id")],
            "brand_aliases": [("molecule_id", molecules, "molecule_id")],
            "interactions": [("molecule_id_a", molecules, "molecule_id"), ("molecule_id_b", molecules, "molecule_id")],
        }.get(stage, [])
        ends = [e for e in ends if e[1] is not None]
        if ends:
            good, out.dangling[stage] = edges_with_endpoints(good, ends)
        if stage == "interactions":
            out.tables[stage] = canonical_edges(good, order)
        else:
            out.tables[stage] = last_wins(good, KEYS[stage], order)
    return out


def load_folder(spark: SparkSession, directory: str, strict: bool = False) -> Loaded:
    """Load the files of a folder; the position of a row decides between rows of one key."""
    stages = {}
    for stage in STAGES:
        stages[stage] = read_stage(spark, directory, stage, order="row_no")
    return load_tables(stages, ["row_no"], strict)


def load_report(loaded: Loaded) -> DataFrame:
    """Per stage: rows offered, rejected, dangling and written, and whether the load is complete."""
    spark = next(iter(loaded.tables.values())).sparkSession
    count = lambda df, stage, kind: df.agg(F.count("*").alias("n")).select(
        F.lit(stage).alias("stage"), F.lit(kind).alias("kind"), "n"
    )
    parts = [count(df, s, "offered") for s, df in loaded.offered.items()]
    parts += [count(df, s, "rejected") for s, df in loaded.rejected.items()]
    parts += [count(df, s, "dangling") for s, df in loaded.dangling.items()]
    parts += [count(df, s, "written") for s, df in loaded.tables.items()]
    if loaded.skipped:
        parts.append(spark.createDataFrame([(s, "skipped", 1) for s in loaded.skipped], "stage string, kind string, n bigint"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    n = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k)
    table = rows.groupBy("stage").agg(n("offered"), n("rejected"), n("dangling"), n("written"), n("skipped"))
    return table.withColumn("complete", (F.col("rejected") == 0) & (F.col("skipped") == 0))


def rejected_rows(loaded: Loaded) -> DataFrame:
    """Stage and error of every row set aside by a lenient load, with counts."""
    out = None
    for stage, df in loaded.rejected.items():
        part = df.groupBy("stage", "error").agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@dataclass
class Built:
    """Output of :func:`build_tables`."""

    molecules: DataFrame
    products: DataFrame
    contains: DataFrame
    aliases: DataFrame
    interactions: DataFrame
    coverage: DataFrame
    unjoined: DataFrame
    dropped_interactions: DataFrame
    rejected_products: DataFrame


def build_tables(
    raw_products: DataFrame, raw_interactions: DataFrame, raw_atc: DataFrame, manual_aliases: DataFrame,
    order: list[str], atc_order: list[str], money_style: str = "in",
) -> Built:
    """Raw product list, interaction rows and ATC rows to loadable tables.

    The vocabulary comes from the interaction source and the curated aliases; products join onto it and
    never create molecules.
    """
    products, product_aliases, rejected = ingest.ingest_products(raw_products, money_style)
    pairs = ingest.ingest_interactions(raw_interactions, order)
    names = ingest.interaction_aliases(raw_interactions, order)
    ids = assign_molecule_ids(bridge.canonical_keys(names, manual_aliases), "inn_name")
    molecules = ids.withColumn("category", F.lit("small_molecule"))
    aliases = bridge.bridge_aliases([names, manual_aliases, product_aliases], ids, ["raw_string"])
    contains, unjoined = bridge.bridge_products(products, ids)
    edges, dropped = bridge.rekey_interactions(pairs, ids)
    by_name = coverage.atc_map(raw_atc, atc_order)
    return Built(
        molecules, products, contains, aliases, edges, bridge.rekey_coverage(by_name, ids), unjoined, dropped, rejected
    )


def readiness_report(
    molecules: DataFrame, products: DataFrame, pairs: DataFrame, coverage_rows: DataFrame, combinations: DataFrame,
    missing: tuple[str, ...] = (),
) -> DataFrame:
    """Is the loaded set fit to answer: one row per control with its count, state and note.

    Only an empty catalogue blocks; missing guards are stated and do not.
    """
    spark = molecules.sparkSession
    brands = combinations.select("brand_key").distinct()
    # Control names and notes.
    controls = [
        ("molecules", molecules, True, "no molecules are loaded; every answer would be empty"),
        ("products", products, False, "no products are loaded; no substitute can be found"),
        ("blocklist", pairs, False, "confusable-pair blocklist is empty or missing — fuzzy candidates are UNGUARDED"),
        ("coverage", coverage_rows, False, "interaction coverage manifest is missing — every pair will report not_checked"),
        ("combinations", brands, False, "combination index is missing — multi-ingredient pack names will not resolve"),
    ]
    out = None
    for name, df, blocking, note in controls:
        loaded = F.lit(False) if name in missing else (F.col("n") > 0)
        row = df.agg(F.count("*").alias("n")).select(
            F.lit(name).alias("control"), "n", loaded.alias("loaded"),
            (loaded | F.lit(not blocking)).alias("ready"), F.when(~loaded, note).otherwise("").alias("note"),
        )
        out = row if out is None else out.unionByName(row)
    return out
