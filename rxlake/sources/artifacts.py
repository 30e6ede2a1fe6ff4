"""Reading and writing table files: CSV with exact headers, JSON lists, commented CSV, keyed snapshots."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from rxlake.functions.normalize import with_normalized  # noqa: F401  (re-exported for loaders)
from rxlake.operators.dedupe import last_wins

# --- Fixed values: stage -> file stems in the order they are tried; stages in dependency order ---
STAGE_STEMS = {
    "molecules": ["molecules", "molecule_catalog"],
    "products": ["products", "pmbjp_final_clean"],
    "contains": ["contains"],
    "aliases": ["alias_bridge_table_final", "aliases"],
    "brand_aliases": ["brand_aliases"],
    "interactions": ["ddinter_final_clean", "interactions"],
}

# --- Fixed values: columns of every stage ---
STAGE_COLUMNS = {
    "molecules": ["molecule_id", "inn_name", "category"],
    "products": ["product_id", "source", "generic_name_raw", "form", "strength_raw", "mrp"],
    "contains": ["product_id", "molecule_id", "strength", "unit"],
    "aliases": ["raw_string", "normalized_string", "source", "molecule_id"],
    "brand_aliases": ["raw_string", "normalized_string", "source", "molecule_id"],
    "interactions": ["molecule_id_a", "molecule_id_b", "severity", "mechanism", "provenance"],
}

BOM = "﻿"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def in_file_order(scan: DataFrame, name: str) -> DataFrame:
    """A file scan with ``name``: each row's place (from 0) when the files are read one after another by their paths.

    Spark deals parts of files to tasks by size, so neither partitions nor ids of rows follow the files. Within one
    part of a file they do; a row's place is the number of rows in the parts before, by path and start, plus its place in
    its own part. Adds ``__file`` as well.
    """
    marked = scan.select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__id"),
    )
    parts = marked.groupBy("__file", "__start").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("__file", "__start", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # One row per part of a file: bounded by the number of parts, whatever the row count.
    return marked.join(F.broadcast(starts), ["__file", "__start"]).select(
        *[F.col(f"`{c}`") for c in scan.columns], "__file", (F.col("__before") + F.col("__id") - F.col("__first")).alias(name)
    )


def scan_csv(spark: SparkSession, path: str, columns: list[str] | None = None, multi_line: bool = False, order: str | None = None) -> DataFrame:
    """CSV with a header, all values as stripped strings, empty values null.

    With ``columns`` the result has exactly those; a column the file lacks is null. With ``order`` that column holds the
    place of the row over all files.
    """
    raw = (
        spark.read.option("header", True).option("quote", '"').option("escape", '"')
        .option("multiLine", multi_line).csv(path)
    )
    return _cleaned(raw, columns, order)


def _cleaned(raw: DataFrame, columns: list[str] | None, order: str | None) -> DataFrame:
    """The stripped columns of a scan, those asked for, and the place of each row."""
    clean = lambda c: F.nullif(F.regexp_replace(F.col(f"`{c}`"), r"^\s+|\s+$", ""), F.lit(""))
    named = {c.strip().removeprefix(BOM): clean(c) for c in raw.columns}
    null = F.lit(None).cast("string")
    picked = [named.get(c, null).alias(c) for c in columns or named]
    if order is None:
        return raw.select(*picked)
    return in_file_order(raw, order).select(*picked, order)


def scan_json(spark: SparkSession, path: str, columns: list[str], lines: bool = False, order: str | None = None) -> DataFrame:
    """A JSON list of objects (or JSON lines), with the given string columns. Anything else is an error."""
    if not lines:
        head = spark.read.text(path).filter(F.trim("value") != "").select(F.trim("value")).first()
        if head is None or not head[0].startswith("["):
            raise ValueError(f"{path} must contain a list of objects")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    return _cleaned(rows, columns, order)


def scan_commented_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with ``#`` lines and blank lines anywhere, also indented; the first other line is the header.

    A folder of files is read as one text in the order of their paths; where a further file begins with the header
    again, that line is no row. Adds ``row_no``, the place of the row from 1, for rules that depend on order.
    """
    plain = (F.trim("value") != "") & ~F.ltrim("value").startswith("#")
    lines = in_file_order(spark.read.text(path).filter(plain), "row_no")  # the header is row 0
    first = lines.groupBy("__file").agg(F.min(F.struct("row_no", "value")).alias("first"))
    header = first.agg(F.min("first")).first()[0]
    if header is None:
        return spark.createDataFrame([], "row_no bigint")
    names = [n.strip().strip('"') for n in header["value"].removeprefix(BOM).split(",")]
    schema = ", ".join(f"`{n}` string" for n in names)
    # one row per file
    heads = first.filter(F.col("first.value") == header["value"]).select(F.col("first.row_no").alias("row_no"))
    rows = lines.join(heads, "row_no", "left_anti")
    parsed = rows.select("row_no", F.from_csv("value", schema, {"escape": '"'}).alias("r"))
    return parsed.select(
        "row_no", *[F.coalesce(F.trim(F.col(f"r.`{n}`")), F.lit("")).alias(n) for n in names]
    )


def read_stage(spark: SparkSession, directory: str, stage: str, order: str | None = None) -> DataFrame | None:
    """The first existing file of a stage, CSV before JSON; None when there is none."""
    columns = STAGE_COLUMNS[stage]
    for stem in STAGE_STEMS[stage]:
        base = f"{directory.rstrip('/')}/{stem}"
        if path_exists(spark, base + ".csv"):
            return scan_csv(spark, base + ".csv", columns, order=order)
        if path_exists(spark, base + ".json"):
            return scan_json(spark, base + ".json", columns, order=order)
    return None


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]] | None:
    """Coverage manifest: ``(molecule_id, atc_group)`` rows and the covered groups; None when it is absent."""
    if not path_exists(spark, path):
        return None
    schema = "covered_atc_groups array<string>, molecule_atc_groups map<string,string>"
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    head = df.select(F.transform("covered_atc_groups", lambda g: F.upper(F.trim(g))).alias("g")).first()  # one row: the file is one object
    rows = df.select(F.explode("molecule_atc_groups").alias("molecule_id", "atc_group")).select(
        "molecule_id", F.upper(F.trim("atc_group")).alias("atc_group")
    ).filter("atc_group <> ''")
    return rows, sorted({g for g in (head["g"] if head and head["g"] else []) if g})


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """CSV with a fixed field order; other columns are left out."""
    df.select(*fields).write.mode("overwrite").option("header", True).csv(path)


def write_manifest(groups: DataFrame, stats: DataFrame, path: str) -> None:
    """Coverage as a table (JSON lines, a row per molecule) beside a one-row header with the counts."""
    groups.select("molecule_id", "atc_group", "evidence").write.mode("overwrite").json(f"{path}/groups")
    stats.write.mode("overwrite").json(f"{path}/stats")


#: Tables of more rows are joined by sort-merge: in memory a row takes up to 200 bytes, in its file often less than ten.
BROADCAST_ROWS = 100_000


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The table written to ``folder/name`` and read back.

    Later plans then know its real size, which decides whether a join with a large table moves that table
    at all; an estimate over a chain of joins and aggregates is far too high for that. Its size in the files says little
    of its size in the driver's memory, so from ``BROADCAST_ROWS`` on it is not broadcast whatever its files take. A lost
    executor costs a re-read, not a recomputation.
    """
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    return table.hint("merge") if table.count() > BROADCAST_ROWS else table


def upsert(existing: DataFrame | None, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keyed upsert: a new row replaces the old row of its key; loading the same rows again changes nothing."""
    fresh = last_wins(new, keys, order).drop(*order) if order else new
    if existing is None:
        return fresh
    kept = existing.join(fresh.select(*keys), keys, "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)


def upsert_snapshot(spark: SparkSession, root: str, version: int, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Write snapshot ``version`` from snapshot ``version - 1`` and the new rows.

    A snapshot is a new folder and is never overwritten by a later one, so a repeated batch rewrites its
    own version from the same input: the result does not depend on how often it ran.
    """
    previous = f"{root}/v={version - 1}"
    if version > 0 and not path_exists(spark, previous):
        raise ValueError(f"snapshot {version - 1} is missing under {root}: version {version} would lose its rows")
    existing = spark.read.parquet(previous) if version > 0 else None
    upsert(existing, new, keys, order).write.mode("overwrite").parquet(f"{root}/v={version}")
    return spark.read.parquet(f"{root}/v={version}")


# --- tables in parts -----------------------------------------------------------------------------

PARTS = 64


def _part_of(keys: list[str], parts: int):
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def _manifest(spark: SparkSession, root: str, version: int) -> DataFrame:
    path = f"{root}/manifest/v={version}"
    if not path_exists(spark, path):
        raise ValueError(f"version {version} is missing under {root}: its rows would be lost")
    return spark.read.schema("part int, version int, parts int, schema string").json(path)


def read_parts(spark: SparkSession, root: str, version: int, only: list[int] | None = None) -> DataFrame:
    """The rows of a version; with ``only``, of some of its parts."""
    listed = _manifest(spark, root, version).collect()  # one row per part
    schema = T.StructType.fromJson(json.loads(listed[0]["schema"]))
    folders = [f"{root}/data/v={r['version']}/part={r['part']}" for r in listed if r["version"] >= 0 and (only is None or r["part"] in only)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert_parts(
    spark: SparkSession, root: str, version: int, new: DataFrame, keys: list[str], order: list[str], parts: int = PARTS,
) -> DataFrame:
    """Write version ``version`` of a keyed table that is split by a hash of its key, and return its rows.

    Only parts that the new rows fall in are read and rewritten; the manifest of the version names, for every part, the
    version that wrote it last. The folders of a version are written from the version before it alone, so repeating a
    batch writes the same again. The number of parts is that of version 0.
    """
    if version > 0:
        old = _manifest(spark, root, version - 1).collect()  # one row per part
        parts, where = old[0]["parts"], {r["part"]: r["version"] for r in old}
        schema = T.StructType.fromJson(json.loads(old[0]["schema"]))
    else:
        where, schema = dict.fromkeys(range(parts), -1), None
    fresh = last_wins(new, keys, order).drop(*order) if order else new
    fresh = fresh.withColumn("part", _part_of(keys, parts))
    if schema is not None:
        fresh = fresh.select(*schema.names, "part")
    # the batch is read once here and once below; both see the same rows
    touched = sorted(r["part"] for r in fresh.select("part").distinct().collect())  # at most a row per part
    rows = fresh
    if version > 0 and touched:
        kept = read_parts(spark, root, version - 1, touched)
        # Sort-merge: files are far smaller than their rows, and keys that Spark takes for small would go through the driver.
        kept = kept.withColumn("part", _part_of(keys, parts)).join(fresh.select(*keys).hint("merge"), keys, "left_anti")
        rows = kept.select(*fresh.columns).unionByName(fresh)
    if touched:
        rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{root}/data/v={version}")
    where.update(dict.fromkeys(touched, version))
    text = json.dumps((schema or T.StructType([f for f in fresh.schema if f.name != "part"])).jsonValue())
    spark.createDataFrame([(p, v, parts, text) for p, v in where.items()], "part int, version int, parts int, schema string").coalesce(1).write.mode("overwrite").json(f"{root}/manifest/v={version}")
    return read_parts(spark, root, version)
