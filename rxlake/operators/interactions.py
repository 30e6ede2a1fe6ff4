"""Prescription checks: every pair of drugs is an interaction, has none known, or was not checked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxlake import vocab_constants as V
from rxlake.functions.text import quoted, severity_bucket
from rxlake.operators.dedupe import last_wins

# --- Fixed values: reasons ---
SAME_MOLECULE = "the same molecule was supplied twice; no pairwise check applies"
BOTH_COVERED = "both molecules are within ingested DDInter coverage and no edge exists"
NO_MANIFEST = "no interaction coverage manifest is loaded"


def canonical_edges(rows: DataFrame, order: list[str]) -> DataFrame:
    """Interaction edges stored once with ``molecule_id_a < molecule_id_b``; the last row of a pair wins."""
    a, b = F.col("molecule_id_a"), F.col("molecule_id_b")
    ordered = rows.filter(a != b).select(
        F.least(a, b).alias("molecule_id_a"), F.greatest(a, b).alias("molecule_id_b"), "severity", "mechanism",
        "provenance", *order,
    )
    return last_wins(ordered, ["molecule_id_a", "molecule_id_b"], order).drop(*order)


def interactions_between(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose both ends are in the id set."""
    wanted = ids.select("molecule_id").distinct()
    left = wanted.select(F.col("molecule_id").alias("molecule_id_a"))
    right = wanted.select(F.col("molecule_id").alias("molecule_id_b"))
    return edges.join(left, "molecule_id_a", "left_semi").join(right, "molecule_id_b", "left_semi").select(edges.columns)


def split_prescriptions(
    lines: DataFrame, max_drugs: int = V.MAX_DRUGS_PER_PRESCRIPTION
) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)``: prescription lines within the size a request accepts, and the ids beyond it with their
    size. Batch checks do not use it: they check every prescription in full.
    """
    sizes = lines.groupBy("rx_id").agg(F.count("*").alias("n_drugs"))
    too_long = sizes.filter(F.col("n_drugs") > max_drugs)
    return lines.join(too_long, "rx_id", "left_anti"), too_long


def coverage_gap(query, label, molecule_id, group, covered: Column, manifest_missing: Column) -> Column:
    """Why a drug cannot be checked; null when it can."""
    return (
        F.when(molecule_id.isNull(), F.concat(quoted(query), F.lit(" could not be resolved to a molecule")))
        .when(manifest_missing, NO_MANIFEST)
        .when(group.isNull(), F.concat(label, F.lit(" has no ATC group in the coverage manifest")))
        .when(
            ~covered,
            F.concat(
                label, F.lit(" is in ATC group "), group,
                F.lit(", which the ingested DDInter source does not cover"),
            ),
        )
    )


def coverage_table(groups: DataFrame) -> DataFrame:
    """``molecule_id, atc_group`` with upper-case groups; empty groups are no information."""
    return groups.select("molecule_id", F.upper(F.trim("atc_group")).alias("atc_group")).filter("atc_group <> ''")


def with_gaps(inputs: DataFrame, manifest_missing: bool, covered_groups=tuple(V.COVERED_ATC_GROUPS)) -> DataFrame:
    """Prescription inputs that have their ``atc_group``, with their label and, when uncovered, the reason.

    ``manifest_missing`` means that nothing is covered.
    """
    label, reason = label_and_gap(F.col, manifest_missing, covered_groups)
    return inputs.select("*", label.alias("label"), reason.alias("gap"))


def label_and_gap(field, manifest_missing: bool, covered_groups=tuple(V.COVERED_ATC_GROUPS)) -> tuple[Column, Column]:
    """Label and gap of an input, whose fields ``field`` gives by name."""
    label = F.coalesce(F.nullif(field("inn_name"), F.lit("")), field("query"))
    return label, gap_of(field, label, manifest_missing, covered_groups)


def gap_of(field, label: Column, manifest_missing: bool, covered_groups=tuple(V.COVERED_ATC_GROUPS)) -> Column:
    group = field("atc_group")
    covered = F.coalesce(group.isin(list(covered_groups)), F.lit(False))
    return coverage_gap(field("query"), label, field("molecule_id"), group, covered, F.lit(manifest_missing))


GIVEN_FIELDS = ["query", "molecule_id", "inn_name", "from_combination", "atc_group"]
INPUT_FIELDS = [*GIVEN_FIELDS, "label", "gap"]


def rx_pairs(inputs: DataFrame) -> DataFrame:
    """Pairs of every prescription: ``rx_id, pair_no, left struct, right struct``.

    ``inputs`` has ``rx_id, pos, comp_pos, comp_name`` and the input fields. The inputs of a prescription are numbered
    and joined with those that follow, so a prescription of any length is checked in full and none is gathered in a
    row; the join splits a very long one among tasks.
    """
    order = ["pos", "comp_pos", "comp_name"]
    mine = Window.partitionBy("rx_id")
    item = F.struct(*[F.col(c) for c in order + INPUT_FIELDS])
    numbered = inputs.withColumn("__at", F.row_number().over(mine.orderBy(*order, *INPUT_FIELDS)) - 1)
    numbered = numbered.withColumn("__n", F.count("*").over(mine))
    left = numbered.select("rx_id", F.col("__at").cast("bigint").alias("__i"), "__n", item.alias("l"))
    right = numbered.select(F.col("rx_id").alias("__rx"), F.col("__at").cast("bigint").alias("__j"), item.alias("r"))
    i, j = F.col("__i"), F.col("__j")
    before = F.floor(i * (2 * F.col("__n") - i - 1) / 2).cast("bigint")
    return left.join(right, (F.col("rx_id") == F.col("__rx")) & (i < j)).select(
        "rx_id", (before + j - i - 1).cast("int").alias("pair_no"), "l", "r"
    )


def classify_pairs(pairs: DataFrame, edges: DataFrame, gap: Callable[[Column], Column] | None = None) -> DataFrame:
    """Status of every pair. A known edge always counts; without one the coverage decides.

    Only pairs of two different molecules can have an edge; they alone are moved to meet the edges. The others keep their
    place, and the status needs of a gap only whether there is one, so counts move no texts. With ``gap``, which makes it
    from the other fields of a side, sides move without it.
    """
    left, right = F.col("l.molecule_id"), F.col("r.molecule_id")
    edge = edges.select(
        F.col("molecule_id_a").alias("__a"), F.col("molecule_id_b").alias("__b"), "severity", "mechanism",
        "provenance", F.lit(True).alias("__edge"),
    )
    gapped = F.concat_ws("; ", F.col("l.gap"), F.col("r.gap")) != ""
    apart = F.coalesce(left != right, F.lit(False))
    flagged = pairs.withColumn("__gapped", gapped)
    moved = [f for f in INPUT_FIELDS if f != "gap"]
    fields = lambda s: [F.col(f"{s}.{f}").alias(f) for f in moved]
    able = flagged.filter(apart)
    if gap is not None:
        able = able.select("rx_id", "pair_no", F.struct(*fields("l")).alias("l"), F.struct(*fields("r")).alias("r"), "__gapped")
    met = able.join(edge, (F.least(left, right) == F.col("__a")) & (F.greatest(left, right) == F.col("__b")), "left").drop("__a", "__b")
    if gap is not None:
        met = met.withColumns({s: F.struct(*fields(s), gap(F.col(s)).alias("gap")) for s in ("l", "r")})
    none = [F.lit(None).cast(edge.schema[c].dataType).alias(c) for c in ("severity", "mechanism", "provenance", "__edge")]
    whole = lambda s: F.struct(*fields(s), F.col(f"{s}.gap").alias("gap")).alias(s)
    same = F.coalesce(left == right, F.lit(False))
    names = ["rx_id", "pair_no", "__gapped", "severity", "mechanism", "provenance", "__edge"]
    met = met.select(*names, whole("l"), whole("r"), F.lit(False).alias("__same"))
    alone = flagged.filter(~apart).select("rx_id", "pair_no", "__gapped", *none, whole("l"), whole("r"), same.alias("__same"))
    joined = met.unionByName(alone)
    found = F.coalesce(F.col("__edge"), F.lit(False))
    status = (
        F.when(found, "interaction")
        .when(F.col("__gapped"), "not_checked")
        .when(F.col("__same"), "not_checked")
        .otherwise("no_known_interaction")
    )
    reason = (
        F.when(found, F.lit(None).cast("string"))
        .when(F.col("__gapped"), F.concat_ws("; ", F.col("l.gap"), F.col("r.gap")))
        .when(F.col("__same"), SAME_MOLECULE)
        .otherwise(BOTH_COVERED)
    )
    side = lambda s: [
        F.col(f"{s}.query").alias(f"{n}_query") if f == "query" else F.col(f"{s}.{f}").alias(f"{n}_{f}")
        for n in [{"l": "left", "r": "right"}[s]]
        for f in INPUT_FIELDS if f != "gap"
    ]
    return joined.select(
        "rx_id", "pair_no", status.alias("status"), *side("l"), *side("r"),
        F.when(found, F.col("severity")).alias("severity"), F.when(found, F.col("mechanism")).alias("mechanism"),
        F.when(found, F.col("provenance")).alias("provenance"), reason.alias("reason"),
    )


def input_display(inn_name: Column, label: Column, pack: Column) -> Column:
    """Label of an input; components of a pack name the pack they came from."""
    return F.when(
        pack.isNotNull() & inn_name.isNotNull(), F.concat(inn_name, F.lit(" (in "), pack, F.lit(")"))
    ).otherwise(label)


def check_summary(prescriptions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts per prescription; one with no pairs is complete with zero pairs."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    counted = pairs.groupBy("rx_id").agg(
        F.count("*").alias("pairs_total"), n("interaction").alias("interactions_found"),
        n("no_known_interaction").alias("checked_no_interaction"), n("not_checked").alias("not_checked"),
    )
    zero = F.lit(0).cast("bigint")
    return prescriptions.select("rx_id").distinct().join(counted, "rx_id", "left").select(
        "rx_id",
        *[F.coalesce(c, zero).alias(c) for c in (
            "pairs_total", "interactions_found", "checked_no_interaction", "not_checked",
        )],
        (F.coalesce("not_checked", zero) == 0).alias("coverage_complete"),
    )


def report_order(pairs: DataFrame) -> DataFrame:
    """Adds the sort keys of a report: findings first, then gaps, then clear pairs; worst findings first."""
    status = F.when(F.col("status") == "interaction", 0).when(F.col("status") == "not_checked", 1).otherwise(2)
    bucket = severity_bucket(F.col("severity"))
    severity = (
        F.when(bucket == "major", 0).when(bucket == "moderate", 1).when(bucket == "unknown", 2).otherwise(3)
    )
    return pairs.withColumn("status_rank", status).withColumn(
        "severity_rank", F.when(F.col("status") == "interaction", severity).otherwise(0)
    )
