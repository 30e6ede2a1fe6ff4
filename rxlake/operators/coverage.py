"""Which molecules the interaction source covers, and how well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rxlake import vocab_constants as V
from rxlake.functions.normalize import lenient_double, with_normalized
from rxlake.operators.dedupe import first_wins, last_wins


def name_to_molecule(molecules: DataFrame, order: list[str]) -> DataFrame:
    """key -> molecule for build jobs: the last molecule of a name wins."""
    keyed = with_normalized(molecules, "inn_name", ("normalized",), "__").select(
        F.col("__normalized").alias("key"), "molecule_id", "inn_name", *[c for c in order if c != "molecule_id"]
    )
    return last_wins(keyed, ["key"], order).select("key", "molecule_id", "inn_name")


def tier_from_anchors(
    anchors: DataFrame, names: DataFrame, order: list[str], floor: float = V.ANCHOR_FLOOR
) -> tuple[DataFrame, DataFrame]:
    """``(groups, rejected)``: drugs that anchor their top file, and those below the floor."""
    keyed = with_normalized(anchors, "drug", ("normalized",), "__")
    group = F.upper(F.substr(F.trim("top_file"), F.lit(1), F.lit(1)))
    rows = (
        keyed.join(names.select(F.col("key").alias("__normalized"), "molecule_id"), "__normalized")
        .select(
            "molecule_id", group.alias("atc_group"), *order,
            F.coalesce(lenient_double(F.col("anchor_concentration")), F.lit(0.0)).alias("concentration"),
        )
        .filter(F.col("atc_group").rlike(r"^\p{L}$"))
    )
    accepted = first_wins(rows.filter(F.col("concentration") >= floor), ["molecule_id"], order)
    return accepted.select("molecule_id", "atc_group"), rows.filter(F.col("concentration") < floor)


def accepted_stem_rules(rules: list[tuple[str, str]]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """``(usable, refused)``: a rule may never name a covered group, whatever its pattern."""
    clean = [(p.strip(), g.strip().upper()) for p, g in rules if p.strip() and g.strip()]
    return (
        [r for r in clean if r[1] not in V.COVERED_ATC_GROUPS],
        [r for r in clean if r[1] in V.COVERED_ATC_GROUPS],
    )


def stem_group(name: Column, rules: list[tuple[str, str]]) -> Column:
    """Group of the first matching rule, as one expression: no join with the rules."""
    usable, _ = accepted_stem_rules(rules)
    if not usable:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(name.rlike(f"(?i){p}"), F.lit(g)) for p, g in usable])


def tier_from_stems(molecules: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    return molecules.select("molecule_id", stem_group(F.col("inn_name"), rules).alias("atc_group")).filter(
        "atc_group IS NOT NULL"
    )


#: A rule whose pattern names no text that every match must hold is tested on every name; more such rules are an error.
OPEN_RULES = 200
#: Most letters of the pieces by which rules with a required text meet names.
PIECE = 8


def _staged(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns that leave through a generator, so that the optimizer does not copy them into every use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_required_texts(rules: DataFrame) -> DataFrame:
    """Adds ``texts``: lower-case texts of which every match of ``pattern`` holds at least one; null if none is known.

    One outer group of plain alternatives is written out (``(rod|ring)$`` holds ``rod`` or ``ring``); other groups,
    classes, escapes, optional and repeated characters are skipped. What is skipped only shortens a text.
    """
    gap = "\u0001"
    # Escapes and flags that change how later characters read: nothing is known.
    unread = F.col("pattern").rlike(r"\\[QEpPxukcN0-9]|\(\?[a-zA-Z-]*[xu]")
    bare = F.regexp_replace(F.regexp_replace("pattern", r"\\.", gap), r"\[[^\]]*\]([?*+]|\{[^}]*\})*", gap)
    rest = F.col("__bare")
    for _ in range(4):
        rest = F.regexp_replace(rest, r"\([^()]*\)([?*+]|\{[^}]*\})*", gap)
    # A group of plain alternatives without a quantifier, and nothing else that branches.
    inner = F.regexp_extract("__bare", r"^[^()|\[\]]*\(([a-zA-Z0-9 |-]+)\)(?![?*+{])[^()|\[\]]*$", 1)
    runs = lambda text: F.split(F.lower(F.regexp_replace(text, r".[?*]|.\{[^}]*\}|[^a-zA-Z0-9 -]", gap)), gap)
    longest = lambda text: F.aggregate(
        runs(text), F.lit(""), lambda best, r: F.when(F.char_length(r) > F.char_length(best), r).otherwise(best)
    )
    shortest = lambda texts: F.array_min(F.transform(texts, F.char_length))
    cut = _staged(_staged(rules, __bare=bare), __rest=rest, __inner=inner)
    whole = F.when(F.col("__rest").rlike(r"[()\[\]]"), F.array(F.lit(gap))).otherwise(F.split("__rest", r"\|"))
    read = _staged(cut, __outer=F.transform(whole, longest), __grouped=F.transform(F.split("__inner", r"\|"), longest))
    better = (F.col("__inner") != "") & (shortest(F.col("__grouped")) > shortest(F.col("__outer")))
    chosen = _staged(read, __texts=F.when(better, F.col("__grouped")).otherwise(F.col("__outer")))
    texts = F.when(~unread & (shortest(F.col("__texts")) > 0), F.col("__texts"))
    return _staged(chosen, texts=texts).select(*rules.columns, "texts")


def _pieces(text: Column, size: int) -> Column:
    n = F.char_length(text)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.substr(text, i, F.lit(size)))).otherwise(
        F.array().cast("array<string>")
    )


def tier_from_stem_table(molecules: DataFrame, rules: DataFrame) -> DataFrame:
    """Group of the first matching rule of a table ``rule_no, pattern, atc_group``, per ``molecule_id``.

    Rules with a blank pattern or group, or for a covered group, are refused as in :func:`accepted_stem_rules`. A rule
    meets only names that hold the first letters of a text its pattern requires (an equi-join on that piece, then the
    pattern itself), and of rules with one pattern only the first meets them, so thousands of rules cost what they match. Rules without such a text become one expression over
    the names; more than ``OPEN_RULES`` of them raise an error. Rules of equal number count in the order of their
    patterns. Names that are null match nothing.
    """
    clean = rules.select(
        F.col("rule_no").cast("bigint").alias("rule_no"), F.trim("pattern").alias("pattern"), F.upper(F.trim("atc_group")).alias("atc_group")
    ).filter((F.col("pattern") != "") & (F.col("atc_group") != "") & ~F.col("atc_group").isin(sorted(V.COVERED_ATC_GROUPS)))
    first_rules = clean.groupBy("pattern").agg(F.min(F.struct("rule_no", "atc_group")).alias("r")).select("r.rule_no", "pattern", "r.atc_group")
    known = with_required_texts(first_rules)
    keyed = known.filter("texts IS NOT NULL").select(
        "rule_no", "pattern", "atc_group", F.explode(F.array_distinct(F.transform("texts", lambda t: F.substring(t, 1, PIECE)))).alias("piece")
    )
    open_rules = known.filter("texts IS NULL").orderBy("rule_no", "pattern", "atc_group").drop("texts").limit(OPEN_RULES + 1).collect()  # bounded
    if len(open_rules) > OPEN_RULES:
        raise ValueError(f"more than {OPEN_RULES} rules name no text that a match must hold")
    named = molecules.select("molecule_id", "inn_name").filter("inn_name IS NOT NULL")
    lowered = F.lower("inn_name")
    pieces = F.array_distinct(F.concat(*[_pieces(lowered, size) for size in range(1, PIECE + 1)]))
    # Sort-merge, since Spark takes the pieces of a name for as small as the name and would broadcast them.
    met = named.select("molecule_id", "inn_name", F.explode(pieces).alias("piece")).join(keyed.hint("merge"), "piece").filter(
        F.expr("inn_name RLIKE concat('(?i)', pattern)")
    ).select("molecule_id", F.struct("rule_no", "pattern", "atc_group").alias("rule"))
    if open_rules:
        first = F.coalesce(*[
            F.when(F.col("inn_name").rlike(f"(?i){r['pattern']}"), F.struct(
                F.lit(r["rule_no"]).cast("bigint").alias("rule_no"), F.lit(r["pattern"]).alias("pattern"), F.lit(r["atc_group"]).alias("atc_group")))
            for r in open_rules
        ])
        met = met.unionByName(named.select("molecule_id", first.alias("rule")).filter("rule IS NOT NULL"))
    return met.groupBy("molecule_id").agg(F.min("rule").alias("rule")).select("molecule_id", "rule.atc_group", "rule.rule_no")


def coverage_groups(molecules: DataFrame, anchored: DataFrame, stems: DataFrame) -> DataFrame:
    """``molecule_id, atc_group, evidence``: anchor evidence first. Covered groups only from anchors."""
    tiers = anchored.select("molecule_id", "atc_group", F.lit(0).alias("t"), F.lit(V.TIER_ANCHOR).alias("evidence")).unionByName(
        stems.select("molecule_id", "atc_group", F.lit(1).alias("t"), F.lit(V.TIER_STEM).alias("evidence"))
    )
    chosen = (
        tiers.join(molecules.select("molecule_id"), "molecule_id", "left_semi")
        .groupBy("molecule_id")
        .agg(F.min_by(F.struct("atc_group", "evidence"), F.col("t")).alias("g"))
        .select("molecule_id", "g.*")
    )
    leaked = F.col("atc_group").isin(V.COVERED_ATC_GROUPS) & (F.col("evidence") != V.TIER_ANCHOR)
    guard = F.when(~leaked, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("covered group from an inference tier: "), F.col("molecule_id"))).cast("boolean")
    )
    return chosen.filter(guard)


def coverage_stats(molecules: DataFrame, groups: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row of counts over the molecules, plus the partial anchors that were refused."""
    joined = molecules.select("molecule_id").join(groups, "molecule_id", "left")
    covered = F.col("atc_group").isin(V.COVERED_ATC_GROUPS)
    n = lambda c: F.count(F.when(c, 1))
    counts = joined.agg(
        F.count("*").alias("molecules_total"), F.count("atc_group").alias("molecules_with_group"),
        n(covered).alias("molecules_covered"), n(F.col("atc_group").isNotNull() & ~covered).alias("molecules_not_covered"),
        n(F.col("atc_group").isNull()).alias("molecules_unknown"),
        n(F.col("evidence") == V.TIER_ANCHOR).alias("by_anchor"), n(F.col("evidence") == V.TIER_STEM).alias("by_stem_rule"),
    )
    names = counts.columns
    refused = rejected.agg(F.count("*").alias("partial_anchors_rejected"))
    # Two rows of aggregates, added up.
    both = counts.unionByName(refused, allowMissingColumns=True)
    return both.agg(*[F.sum(c).alias(c) for c in [*names, "partial_anchors_rejected"]])


def observed_coverage(atc: DataFrame) -> DataFrame:
    """Covered groups that were observed; all covered groups when none was."""
    covered = F.col("atc_group").isin(V.COVERED_ATC_GROUPS)
    # At most one letter per covered group.
    seen = atc.agg(F.collect_set(F.when(covered, F.col("atc_group"))).alias("seen"))
    every = F.array(*[F.lit(g) for g in V.COVERED_ATC_GROUPS])
    return seen.select(F.explode(F.when(F.size("seen") == 0, every).otherwise(F.col("seen"))).alias("atc_group"))


def atc_map(rows: DataFrame, order: list[str]) -> DataFrame:
    """``key, atc_group`` from (drug_name, atc_code); the last row of a drug wins."""
    keyed = with_normalized(rows, "drug_name", ("normalized",), "__").filter(
        (F.col("__normalized") != "") & (F.coalesce("atc_code", F.lit("")) != "")
    )
    group = F.substr(F.upper(F.trim("atc_code")), F.lit(1), F.lit(1))
    return last_wins(
        keyed.select(F.col("__normalized").alias("key"), group.alias("atc_group"), *order), ["key"], order
    ).select("key", "atc_group")


# --- how complete the interaction source is ------------------------------------------------------


def partners(rows: DataFrame, a: str, b: str, keep: list[str]) -> DataFrame:
    """Both directions of every row: ``drug, partner`` and the kept columns."""
    pair = F.explode(
        F.array(
            F.struct(F.col(a).alias("drug"), F.col(b).alias("partner")),
            F.struct(F.col(b).alias("drug"), F.col(a).alias("partner")),
        )
    )
    return rows.filter(F.col(a) != F.col(b)).select(pair.alias("p"), *keep).select("p.*", *keep)


def anchor_profile(rows: DataFrame, a: str, b: str, file: str) -> DataFrame:
    """Per drug: the file with most of its partners, and the share of its partners found there.

    Pairs are made distinct before they are counted, in steps that combine on the map side, so no drug's partner list is
    held in one place. The rows are read once: both counts come from the same pairs.
    """
    pair = [F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(file).alias("file")]
    seen = rows.filter(F.col(a) != F.col(b)).select(*pair).distinct()
    # A pair counts once in every file and, by the first of its files, once in all.
    once = F.row_number().over(Window.partitionBy("a", "b").orderBy("file")) == 1
    flagged = seen.withColumn("pair", F.when(once, 1))
    both = flagged.select("file", "pair", F.explode(F.array("a", "b")).alias("drug"))
    per_file = both.groupBy("drug", "file").agg(
        F.count("*").alias("n_in_file"), F.count("pair").alias("n_new")
    )
    top = per_file.groupBy("drug").agg(
        F.min(F.struct((-F.col("n_in_file")).alias("n"), "file")).alias("t"), F.sum("n_new").alias("n_partners")
    )
    return top.select(
        "drug", F.col("t.file").alias("top_file"), (-F.col("t.n")).alias("n_in_top_file"), "n_partners",
        (-F.col("t.n") / F.col("n_partners")).alias("anchor_concentration"),
    )


def interaction_degree(edges: DataFrame) -> DataFrame:
    """Number of partners per molecule; edges are already canonical and unique."""
    return partners(edges, "molecule_id_a", "molecule_id_b", []).groupBy(F.col("drug").alias("molecule_id")).agg(
        F.count("*").alias("degree")
    )


def degree_by_class(degree: DataFrame, anchored: DataFrame) -> DataFrame:
    flags = degree.join(anchored.select("molecule_id").distinct().withColumn("a", F.lit(True)), "molecule_id", "left")
    return flags.groupBy(F.when(F.col("a"), "anchored").otherwise("partner_only").alias("anchor_class")).agg(
        F.count("*").alias("n_molecules"), F.bround(F.avg("degree"), 1).alias("mean_degree")
    )


def pair_density(molecules: DataFrame, anchored: DataFrame, edges: DataFrame) -> DataFrame:
    """Possible and present pairs by anchor class of the two sides. Possible pairs are arithmetic."""
    flags = (
        molecules.select("molecule_id").distinct()
        .join(anchored.select("molecule_id").distinct().withColumn("a", F.lit(1)), "molecule_id", "left")
        .select("molecule_id", F.coalesce("a", F.lit(0)).alias("a"))
    )
    sizes = flags.agg(F.sum("a").alias("n"), F.sum(1 - F.col("a")).alias("m"))
    n, m = F.col("n"), F.col("m")
    possible = sizes.select(
        F.explode(
            F.array(
                F.struct(F.lit("both_partner_only").alias("region"), (m * (m - 1) / 2).cast("bigint").alias("possible")),
                F.struct(F.lit("one_side_anchored").alias("region"), (n * m).cast("bigint").alias("possible")),
                F.struct(F.lit("both_anchored").alias("region"), (n * (n - 1) / 2).cast("bigint").alias("possible")),
            )
        ).alias("r")
    ).select("r.*")
    left = flags.select(F.col("molecule_id").alias("molecule_id_a"), F.col("a").alias("fa"))
    right = flags.select(F.col("molecule_id").alias("molecule_id_b"), F.col("a").alias("fb"))
    region = (
        F.when(F.col("fa") + F.col("fb") == 2, "both_anchored")
        .when(F.col("fa") + F.col("fb") == 1, "one_side_anchored")
        .otherwise("both_partner_only")
    )
    present = (
        edges.join(left, "molecule_id_a").join(right, "molecule_id_b")
        .groupBy(region.alias("region")).agg(F.count("*").alias("present"))
    )
    return possible.join(present, "region", "left").select(
        "region", "possible", F.coalesce("present", F.lit(0).cast("bigint")).alias("present"),
        F.when(F.col("possible") > 0, F.bround(F.coalesce("present", F.lit(0)) * 100.0 / F.col("possible"), 2))
        .otherwise(F.lit(0.0)).alias("coverage_pct"),
    )
