"""Medicine-shaped tables projected from the supplied ones.

The supplied tables hold no medicine data, so part names stand for molecules, parts for products, order
lines for drug strings and interaction rows, orders for prescriptions. Each statement is plain arithmetic
that Spark and DuckDB both run, so both sides of a check start from the same rows; ``{name}`` refers to a
supplied table or to another statement.
"""

from __future__ import annotations

import functools
import string

from pyspark.sql import DataFrame, SparkSession

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def letters(n: str) -> str:
    """A number written in four letters, least significant first."""
    alphabet = "'abcdefghijklmnopqrstuvwxyz'"
    parts = [f"substr({alphabet}, CAST(CAST(floor({n} / {26**i}) AS BIGINT) % 26 AS INT) + 1, 1)" for i in range(4)]
    return "(" + " || ".join(parts) + ")"


def mol(name: str, head: str = "MOL_") -> str:
    return f"('{head}' || replace({name}, ' ', '_'))"


def anywhere(key: str) -> str:
    """A part key (they count from 0) that this number leads to, anywhere among all parts."""
    return f"(({key}) * 7919 % (SELECT count(*) FROM {{part}}))"


#: So many parts share a name; its letters come from their number, so that names grow with the parts. A third of all
#: names begin alike and another third end alike.
SHARED = 8
GROUP = "CAST(h.p_partkey / 8 AS BIGINT)"
CODE = "(" + " || ".join(f"substr('bcdfgklmnprstvwz', CAST(CAST(floor(({GROUP} * 104729 + 7) % 1048576 / {16**i}) AS BIGINT) % 16 AS INT) + 1, 1)" for i in range(5)) + ")"
ITEM_NAME = (
    f"(CASE WHEN {GROUP} % 3 = 0 THEN 'red' ELSE split_part(h.p_name, ' ', 1) END || {CODE} || ' ' || "
    f"CASE WHEN {GROUP} % 3 = 1 THEN 'rod' ELSE split_part(h.p_name, ' ', 2) END)"
)
ADJ, NOUN = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
STRENGTH = "((1 + p_size % 4) * 10)"
FORM = (
    "CASE WHEN p_type IN ('ECONOMY', 'LARGE') THEN 'tablet' WHEN p_type IN ('SMALL', 'PROMO') THEN 'capsule' "
    "ELSE 'syrup' END"
)
FORM_WORD = (
    "CASE p_type WHEN 'ECONOMY' THEN 'Tab' WHEN 'LARGE' THEN 'Tablets' WHEN 'SMALL' THEN 'caps' "
    "WHEN 'PROMO' THEN 'Capsule' WHEN 'STANDARD' THEN 'Syp' ELSE 'Syrup' END"
)
PRODUCT_NAME = f"""CASE p_partkey % 6
    WHEN 0 THEN upper(p_name) || ' ' || CAST({STRENGTH} AS STRING) || 'MG ' || {FORM_WORD}
    WHEN 1 THEN p_name || ' Hydrochloride ' || CAST({STRENGTH} AS STRING) || ' mg ' || {FORM_WORD} || ' 10''s'
    WHEN 2 THEN p_name || ' ' || CAST({STRENGTH} AS STRING) || ' ' || {FORM_WORD}
    WHEN 3 THEN p_name || '-Sulphate (' || CAST({STRENGTH} AS STRING) || '000µg) 1x10 ' || {FORM_WORD}
    WHEN 4 THEN 'Sodium ' || p_name || ' 0.0' || CAST({STRENGTH} AS STRING) || 'g/' || CAST(p_size AS STRING) || ' ml'
    ELSE 'haem' || p_name || ' of each strip' END"""
TYPO_AT = "(1 + CAST((l_orderkey + l_linenumber) % length(p_name) AS INT))"
TYPO = f"(substr(p_name, 1, {TYPO_AT} - 1) || 'x' || substr(p_name, {TYPO_AT} + 1))"
QUERY = f"""CASE (l_orderkey + l_linenumber) % 9
    WHEN 0 THEN upper(p_name) || ' ' || CAST(p_size AS STRING) || 'MG TAB'
    WHEN 1 THEN {NOUN} || ' ' || {ADJ} || ' ' || CAST(p_size AS STRING) || ' caps'
    WHEN 2 THEN 'Combo ' || {letters('l_suppkey')} || ' ' || CAST(p_size AS STRING) || ' Tablets'
    WHEN 3 THEN {TYPO}
    WHEN 4 THEN p_type || ' Remedy ' || CAST(p_size AS STRING) || '''s'
    WHEN 5 THEN p_name || ' Sodium ' || CAST(p_size AS STRING) || ' mcg Inj'
    WHEN 6 THEN CAST(p_size AS STRING) || 'mg tablet'
    WHEN 7 THEN 'zz' || p_name || 'zz "x" it''s'
    ELSE p_name || ' ' || CAST({STRENGTH} AS STRING) || ' mg ' || {FORM_WORD} END"""
ATC = f"(ascii(substr({ADJ}, 1, 1)) + ascii(substr({NOUN}, 1, 1)) + ascii(substr({NOUN}, 2, 1)) + ascii(substr(p_name, 7, 1))) % 15"

# name -> statement
TABLES = {
    "items": f"""
        SELECT p.p_partkey, p.p_brand, p.p_type, p.p_size, p.p_retailprice, {ITEM_NAME} AS p_name
        FROM {{part}} p JOIN {{part}} h ON h.p_partkey = p.p_partkey - p.p_partkey % {SHARED}""",
    "pairs_of_items": f"""
        SELECT a.*, b.p_name AS other_name
        FROM (SELECT *, {anywhere('p_partkey * 7 + 3')} AS other FROM {{items}}) a JOIN {{items}} b ON b.p_partkey = a.other""",
    "names": "SELECT DISTINCT p_name FROM {items}",
    "molecules": f"""
        SELECT {mol('p_name')} AS molecule_id, p_name AS inn_name,
               CASE WHEN p_name LIKE '%ring' THEN 'biologic' ELSE 'small_molecule' END AS category
        FROM {{names}}
        UNION ALL
        SELECT {mol('p_name', 'MOX_')}, p_name, 'small_molecule' FROM {{names}} WHERE p_name LIKE 'red%'""",
    "products": f"""
        SELECT 'PRD' || CAST(p_partkey AS STRING) AS product_id,
               CASE WHEN p_partkey % 2 = 0 THEN 'PMBJP' ELSE 'branded_csv' END AS source,
               {PRODUCT_NAME} AS generic_name_raw,
               CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE {FORM} END AS form,
               CAST({STRENGTH} AS STRING) || 'mg' AS strength_raw,
               CAST(CASE WHEN p_partkey % 50 = 0 THEN 0 ELSE p_retailprice END AS DECIMAL(12,2)) AS mrp
        FROM {{items}}""",
    "contains_all": f"""
        SELECT 'PRD' || CAST(p_partkey AS STRING) AS product_id, {mol('p_name')} AS molecule_id,
               CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN CAST({STRENGTH} AS DOUBLE)
                    ELSE CAST({STRENGTH} AS DOUBLE) / 1000 END AS strength,
               CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'mg' ELSE 'g' END AS unit
        FROM {{items}}
        UNION ALL
        SELECT 'PRD' || CAST(p_partkey AS STRING),
               CASE WHEN p_partkey % 30 = 0 THEN 'MOL_none' ELSE {mol('other_name')} END, 5.0, 'ml'
        FROM {{pairs_of_items}} WHERE p_partkey % 10 = 0 AND other_name <> p_name""",
    "contains": """
        SELECT c.* FROM {contains_all} c WHERE c.molecule_id IN (SELECT molecule_id FROM {molecules})""",
    "aliases": f"""
        SELECT p_partkey * 4 AS row_no, {NOUN} || ' ' || {ADJ} AS raw_string, '' AS normalized_string,
               'manual' AS source, {mol('p_name')} AS molecule_id FROM {{items}}
        UNION ALL
        SELECT p_partkey * 4 + 1, p_brand || ' ' || p_name, NULL, 'pmbjp', {mol('p_name')} FROM {{items}}
        UNION ALL
        SELECT p_partkey * 4 + 2, p_type || ' Remedy', lower(p_type) || ' remedy', 'ddinter',
               CASE WHEN p_partkey % 7 = 0 THEN 'MOL_none' ELSE {mol('p_name')} END FROM {{items}}
        UNION ALL
        SELECT p_partkey * 4 + 3, 'former ' || p_name, '', 'rxnorm_dump', 'MOL_none' FROM {{items}} WHERE p_partkey % 16 = 3""",
    "combinations": " UNION ALL ".join(
        f"""
        SELECT s_suppkey * 4 + {k} AS row_no, '' AS brand_key, 'Combo ' || {letters('s_suppkey')} AS brand_raw,
               {"CASE WHEN s_suppkey % 5 = 0 THEN 'MOL_none' ELSE " + mol('p_name') + " END" if k == 2 else mol('p_name')} AS molecule_id,
               p_name AS inn_name, {4 - k} AS position, 'brand' AS kind
        FROM (SELECT s_suppkey, {anywhere(f's_suppkey * {k} + {k}')} AS item FROM {{supplier}}) JOIN {{items}} ON p_partkey = item
        WHERE {("TRUE", "s_suppkey % 9 <> 0", "s_suppkey % 9 <> 0 AND s_suppkey % 4 = 0")[k - 1]}"""
        for k in (1, 2, 3)
    ),
    "requests": f"""
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {QUERY} AS query
        FROM {{lineitem}} JOIN {{items}} ON l_partkey = p_partkey""",
    "lines": """
        SELECT l_orderkey AS rx_id, CAST(row_number() OVER (
                 PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS pos, query
        FROM {requests}""",
    "raw_interactions": f"""
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
               CASE WHEN l_linenumber % 2 = 0 THEN upper(a.p_name) ELSE a.p_name || ' sodium' END AS drug_a,
               CASE WHEN l_linenumber = 5 THEN split_part(a.p_name, ' ', 1) || ' ' || split_part(b.p_name, ' ', 2) ELSE b.p_name END AS drug_b,
               CASE l_returnflag WHEN 'A' THEN ' Major' WHEN 'R' THEN 'Moderate' ELSE '' END AS severity,
               CASE WHEN l_linenumber = 3 THEN 'bleeding risk ' || CAST(CAST(l_quantity AS INT) AS STRING) || '.' ELSE NULL END AS mechanism,
               'ddinter_downloads_code_' || substr('ABDHLPRV', CAST((l_suppkey + l_linenumber) % 8 AS INT) + 1, 1) || '.csv' AS source_file
        FROM (SELECT *, {anywhere('l_suppkey * 5 + l_partkey')} AS other FROM {{lineitem}})
        JOIN {{items}} a ON l_partkey = a.p_partkey JOIN {{items}} b ON b.p_partkey = other""",
    "coverage": f"""
        SELECT {mol('p_name')} AS molecule_id, lower(substr('ABCDGHJLMNPRSV', CAST({ATC} AS INT) + 1, 1)) AS atc_group
        FROM {{names}} WHERE {ATC} < 14""",
    "typo_pairs": """
        SELECT 'x' || substr(p_name, 2) AS name_a, p_name AS name_b, 'look-alike' AS reason, 'manual' AS source
        FROM {names}""",
    "brand_pack": f"""
        SELECT c_custkey AS row_no,
               CASE c_custkey % 8 WHEN 0 THEN '500mg' WHEN 1 THEN p_name WHEN 2 THEN 'Brand ' || p_name
                 WHEN 3 THEN 'dup ' || c_mktsegment WHEN 4 THEN 'x' || substr(p_name, 2)
                 ELSE 'Bra' || {letters('c_custkey')} END AS brand,
               CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN p_name || ' | unobtainium' WHEN 2 THEN p_name || '|' || other_name
                 WHEN 3 THEN ' ' || upper(p_name) || ' 5mg ' ELSE p_name END AS ingredients,
               CASE WHEN c_custkey % 16 = 1 THEN 'Synonym' ELSE '' END AS kind
        FROM (SELECT *, {anywhere('c_custkey')} AS item FROM {{customer}}) JOIN {{pairs_of_items}} ON p_partkey = item""",
    "raw_products": f"""
        SELECT p_partkey + 1 AS row_no,
               CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(9000 + p_partkey AS STRING) END AS Drug_Code,
               CASE WHEN p_partkey % 31 = 0 THEN '  ' ELSE {PRODUCT_NAME} END AS Generic_Name,
               '10''s' AS Unit_Size,
               CASE p_partkey % 5 WHEN 0 THEN '₹' || CAST(p_size AS STRING) || '.50' WHEN 1 THEN '1,' || CAST(100 + p_size AS STRING) || '.00'
                 WHEN 2 THEN 'Rs ' || CAST(p_size AS STRING) WHEN 3 THEN 'not-a-price' ELSE CAST(p_size AS STRING) || '.25' END AS MRP
        FROM {{items}}""",
    "fdc_products": f"""
        SELECT 'PRD' || CAST(a.p_partkey AS STRING) AS product_id,
               CASE a.p_partkey % 7
                 WHEN 0 THEN a.p_name || ' ' || CAST(a.p_size AS STRING) || 'mg, ' || other_name || ' 10 mg and ' || other_name || ' 2% w/w Cream'
                 WHEN 1 THEN a.p_name || ' 1g and ' || other_name || ' 200mg Powder for Injection 1 Vial'
                 WHEN 2 THEN a.p_name || ' (with rod, ring, and ' || other_name || ') 5mg Tablets'
                 WHEN 3 THEN a.p_name || ' 10 tablets and ' || other_name || ' 5mg'
                 WHEN 4 THEN 'Insulin ' || a.p_name || ' 30% and Isophane 70%'
                 WHEN 5 THEN 'Vitamin ' || a.p_name || ' and minerals 10 capsules'
                 ELSE a.p_name || ' 5mg and ab 3mg' END AS generic_name_raw
        FROM {{pairs_of_items}} a""",
    "component_products": f"""
        SELECT 'PRD' || CAST(a.p_partkey AS STRING) AS product_id,
               CASE a.p_partkey % 4 WHEN 0 THEN a.p_name || '|' || upper(other_name) WHEN 1 THEN a.p_name || ' 75mg | nothing known'
                 WHEN 2 THEN split_part(a.p_name, ' ', 2) || ' ' || split_part(a.p_name, ' ', 1) || '| |' || other_name ELSE '' END AS components,
               CASE a.p_partkey % 3 WHEN 0 THEN CAST(a.p_size AS STRING) || 'mg; 20 mg' WHEN 1 THEN '5 ml' ELSE NULL END AS strength_raw
        FROM {{pairs_of_items}} a""",
    "ceilings": f"""
        SELECT CASE WHEN s_suppkey % 3 = 0 THEN upper(p_name) || ' 5mg' WHEN s_suppkey % 3 = 1 THEN p_name ELSE 'other ' || p_name END AS molecule,
               CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(p_retailprice AS DOUBLE) END AS ceiling_price
        FROM (SELECT *, {anywhere('s_suppkey')} AS item FROM {{supplier}}) JOIN {{items}} ON p_partkey = item""",
    "bad_rows": f"""
        SELECT CAST(p_partkey AS BIGINT) AS row_no, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE 'PRD' || CAST(p_partkey AS STRING) END AS product_id,
               CASE p_partkey % 3 WHEN 0 THEN 'PMBJP' WHEN 1 THEN 'branded_csv' ELSE CASE WHEN p_partkey % 11 = 0 THEN 'other' ELSE 'PMBJP' END END AS source,
               CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_name END AS generic_name_raw, CAST(NULL AS STRING) AS form, CAST(NULL AS STRING) AS strength_raw,
               CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'abc' WHEN 2 THEN '-5.0' ELSE CAST(p_size AS STRING) || '.5' END AS mrp
        FROM {{items}}""",
    "atc_rows": f"""
        SELECT c_custkey AS row_no, CASE WHEN c_custkey % 3 = 0 THEN upper(p_name) || ' 10mg' ELSE p_name END AS drug_name,
               CASE WHEN c_custkey % 10 = 0 THEN '' ELSE substr('abdhlprvcg', CAST(c_custkey % 10 AS INT) + 1, 1) || '01' END AS atc_code
        FROM (SELECT *, {anywhere('c_custkey')} AS item FROM {{customer}}) JOIN {{items}} ON p_partkey = item""",
    "alias_seed": f"""
        SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN {NOUN} || ' ' || {ADJ} ELSE 'old ' || p_name END AS raw_string,
               CASE WHEN p_size % 4 = 0 THEN 'new ' || p_name WHEN p_size % 4 = 1 THEN p_name ELSE {NOUN} || ' ' || {ADJ} END AS target_string
        FROM {{items}}""",
    "fragments": f"""
        SELECT DISTINCT substr(p_name, 1 + CAST(l_linenumber % 3 AS INT), 1 + CAST(l_quantity % 6 AS INT)) AS q
        FROM {{lineitem}} JOIN {{items}} ON l_partkey = p_partkey
        UNION SELECT '10''s' UNION SELECT 'combo a'""",
    "typed": """
        SELECT DISTINCT substr(p_name, 1 + CAST(l_linenumber % 3 AS INT), 1 + CAST((l_quantity + l_linenumber) % 10 AS INT)) AS q
        FROM {lineitem} JOIN {items} ON l_partkey = p_partkey""",
    "stem_table": """
        SELECT rule_no, pattern, atc_group FROM (
          SELECT DISTINCT p_partkey - p_partkey % 8 AS rule_no, substr('CJBNMGS', CAST(CAST((p_partkey - p_partkey % 8) / 8 AS BIGINT) % 7 AS INT) + 1, 1) AS atc_group,
                 CASE CAST(CAST((p_partkey - p_partkey % 8) / 8 AS BIGINT) % 6 AS INT)
                   WHEN 0 THEN '^' || substr(p_name, 1, 5) WHEN 1 THEN '(' || substr(p_name, 3, 4) || '|' || substr(p_name, 5, 3) || ')'
                   WHEN 2 THEN upper(substr(p_name, 4, 4)) || '|' || substr(p_name, 2, 4) || 'x' WHEN 3 THEN substr(p_name, 1, 4) || '[a-m]+.*' || substr(p_name, 7, 2) || '?'
                   WHEN 4 THEN ' ' || substr(p_name, 2, 5) || ' ' ELSE '(' || substr(p_name, 2, 2) || ')?' || substr(p_name, 4, 4) END AS pattern
          FROM {items})
        UNION ALL SELECT 9000000000, '[xyz]{{2}}|^.{{9}}$', 'N' UNION ALL SELECT 9000000001, '(rod|ring)$', 'M'""",
    "stems": """
        SELECT molecule_id, inn_name FROM {molecules}""",
}

STEM_RULES = [("(rod|ring)$", "C"), ("^red", "J"), ("bolt$", "B"), ("^(hot|cold)g", "N"), ("ge", "M")]


def dependencies(name: str) -> list[str]:
    return [f for _, f, _, _ in string.Formatter().parse(TABLES[name]) if f]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table. Row tables that arrive in fewer splits than there are cores are spread out, since
    the work per row is what costs; a table of many files or row groups is read as it is."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("lineitem", "documents") and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df


class Domain:
    """Domain tables of one test folder as DataFrames, each built once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @functools.cache
    def table(self, name: str) -> DataFrame:
        if name in BASE:
            return load(self.spark, self.sf_dir, name)
        used = {d: self.table(d) for d in dependencies(name)}
        if name == "items":
            # Sort-merge: the file of parts is far smaller than its rows, and every table of a query would send them
            # through the driver again.
            used["part"] = used["part"].hint("merge")
        return self.spark.sql(TABLES[name], **used)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in TABLES and name not in BASE):
            raise AttributeError(name)
        return self.table(name)
