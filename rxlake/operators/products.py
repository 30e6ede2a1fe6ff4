"""Products, their molecules, and cheaper equivalents.

Whole-table substitution never forms product pairs. Everything a product needs to know about the others
of its molecule is a property of its equivalence class (molecule, form, strength) and of the prices in
it, so one aggregate of the products per class and price carries the answer for all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rxlake.functions.normalize import canonical_strength
from rxlake.operators.dedupe import number_in_order

ANY = "*"

# --- Fixed values: exclusion reasons ---
R_FDC = "candidate is a fixed-dose combination (out of scope in v1)"
R_FORM_UNKNOWN = "dosage form unknown on one side; equivalence not verifiable"
R_STRENGTH_UNKNOWN = "strength not comparable; equivalence not verifiable"
R_NOT_CHEAPER = "not cheaper than the reference"
R_NO_PRICE = "price not available on one side; no saving can be stated"


def molecules_of_products(contains: DataFrame) -> DataFrame:
    """One row per product: its molecule count and, when there is one, the molecule with its strength."""
    return contains.groupBy("product_id").agg(
        F.count("*").alias("molecule_count"),
        F.min(F.struct("molecule_id", "strength", "unit")).alias("m"),
    )


def product_profile(products: DataFrame, contains: DataFrame) -> DataFrame:
    """Products with molecule count, combination flag, first molecule and its comparable strength.

    A product without any molecule keeps a null count.
    """
    # Sort-merge: one row per product on either side, which Spark takes for as small as its compressed file.
    profile = products.join(molecules_of_products(contains).hint("merge"), "product_id", "left")
    value, unit = F.col("m.strength"), F.col("m.unit")
    return profile.select(
        *products.columns,
        "molecule_count",
        (F.coalesce(F.col("molecule_count"), F.lit(0)) > 1).alias("is_fdc"),
        F.col("m.molecule_id").alias("molecule_id"),
        value.alias("strength"),
        unit.alias("unit"),
        canonical_strength(value, unit).alias("comparable"),
    )


def products_for_molecule(contains: DataFrame, products: DataFrame, molecules: DataFrame) -> DataFrame:
    """Every product of every molecule with the molecule count of the product.

    Read in (molecule_id, mrp, product_id) order by sorting the result; no order is forced here.
    """
    counts = contains.groupBy("product_id").agg(F.count("*").alias("molecule_count"))
    return (
        contains.join(products, "product_id")
        .join(counts, "product_id")
        .join(molecules.select("molecule_id").distinct(), "molecule_id", "left_semi")
        .select(
            "molecule_id", "product_id", "source", "generic_name_raw", "form", "strength_raw", "mrp", "strength",
            "unit", "molecule_count",
        )
    )


def single_products(profile: DataFrame, price_guard: bool = True) -> DataFrame:
    """Products with exactly one molecule, with class columns and the ``priced`` flag."""
    priced = (F.col("mrp") > 0) if price_guard else F.lit(True)
    form = F.nullif(F.col("form"), F.lit(""))
    return profile.filter("molecule_count = 1").select(
        "product_id", "molecule_id", "mrp", form.alias("form"), "comparable",
        strength_key(F.col("comparable")).alias("strength_key"), priced.alias("priced"),
    )


def strength_key(comparable: Column) -> Column:
    return F.concat_ws(" ", comparable["value"].cast("string"), comparable["unit"])


def exclusion_reason(ref_form: Column, form: Column, ref: Column, other: Column, is_fdc: Column) -> Column:
    """First failed equivalence test of a candidate against its reference; null when equivalent."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    show = lambda s: F.concat(s["value"].cast("string"), s["unit"])
    return (
        F.when(is_fdc, R_FDC)
        .when(blank(ref_form) | blank(form), R_FORM_UNKNOWN)
        .when(ref_form != form, F.concat(F.lit("dosage form differs ("), ref_form, F.lit(" vs "), form, F.lit(")")))
        .when(ref.isNull() | other.isNull(), R_STRENGTH_UNKNOWN)
        .when(
            (ref["value"] != other["value"]) | (ref["unit"] != other["unit"]),
            F.concat(F.lit("strength differs ("), show(ref), F.lit(" vs "), show(other), F.lit(")")),
        )
    )


def savings_abs(reference: Column, candidate: Column) -> Column:
    return reference - candidate


def savings_pct(reference: Column, candidate: Column) -> Column:
    """Percent of the reference price, two decimals half-even; 0 when the reference has no price."""
    ratio = (reference - candidate).cast("double") / reference.cast("double") * 100
    return F.when(reference <= 0, F.lit(0.0)).otherwise(F.bround(ratio, 2))


CLASS = ["molecule_id", "form", "strength_key"]


def _price_ladder(singles: DataFrame) -> DataFrame:
    """Products counted per class and price: the only aggregate that reads all products."""
    return singles.withColumn("comparable_known", F.col("comparable").isNotNull()).groupBy(
        *CLASS, "comparable_known", "mrp", "priced"
    ).agg(F.count("*").alias("n"), F.min("product_id").alias("first_id"))


def _class_tables(ladder: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    by_class = ladder.groupBy(*CLASS, "comparable_known").agg(
        F.sum("n").alias("n_class"),
        F.sum(F.when(F.col("priced"), F.col("n")).otherwise(0)).alias("n_priced"),
        F.min(F.when(F.col("priced"), F.struct("mrp", "first_id"))).alias("cheapest"),
    )
    by_form = by_class.groupBy("molecule_id", "form").agg(
        F.sum("n_class").alias("n_form"),
        F.sum(F.when(~F.col("comparable_known"), F.col("n_class")).otherwise(0)).alias("n_form_no_strength"),
    )
    by_molecule = by_form.groupBy("molecule_id").agg(
        F.sum("n_form").alias("n_single"),
        F.sum(F.when(F.col("form").isNull(), F.col("n_form")).otherwise(0)).alias("n_no_form"),
    )
    # Distinct prices of a class, not its products, go through this window.
    below = Window.partitionBy(*CLASS).orderBy("mrp").rowsBetween(Window.unboundedPreceding, -1)
    prices = (
        ladder.filter("priced AND form IS NOT NULL AND comparable_known")
        .select(*CLASS, "mrp", "n", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("n_below"))
        .select(*CLASS, "mrp", "n_below")
    )
    return by_molecule, by_form, by_class, prices


def substitutes_for_product(profile: DataFrame, price_guard: bool = True) -> DataFrame:
    """For every product: status, best substitute with its saving, and how many others fell out and why.

    Linear in the products. ``price_guard`` keeps products without a price out of every comparison;
    ``False`` compares them as they stand. Costlier equivalents are part of :func:`substitution_listing`.
    """
    singles = single_products(profile, price_guard)
    by_molecule, by_form, by_class, prices = _class_tables(_price_ladder(singles))
    form_known = by_form.filter("form IS NOT NULL")
    class_known = by_class.filter("form IS NOT NULL AND comparable_known").drop("comparable_known")
    # Sort-merge: up to a row per product each, and their sizes are guessed from compressed files.
    joined = (
        singles.join(by_molecule.hint("merge"), "molecule_id", "left")
        .join(form_known.hint("merge"), ["molecule_id", "form"], "left")
        .join(class_known.hint("merge"), CLASS, "left")
        .join(prices.hint("merge"), [*CLASS, "mrp"], "left")
    )
    zero = F.lit(0).cast("bigint")
    has_form, has_class = F.col("form").isNotNull(), F.col("n_class").isNotNull()
    others = F.col("n_single") - 1
    no_form = F.when(has_form, F.col("n_no_form")).otherwise(others)
    differs = F.when(has_form, F.col("n_single") - F.col("n_no_form") - F.col("n_form")).otherwise(zero)
    no_strength = (
        F.when(~has_form, zero).when(has_class, F.col("n_form_no_strength")).otherwise(F.col("n_form") - 1)
    )
    other_strength = F.when(
        has_form & has_class, F.col("n_form") - F.col("n_form_no_strength") - F.col("n_class")
    ).otherwise(zero)
    in_class = F.when(has_class, F.col("n_class") - 1).otherwise(zero)
    unpriced = F.when(~has_class, zero).when(F.col("priced"), F.col("n_class") - F.col("n_priced")).otherwise(in_class)
    comparable = in_class - unpriced
    cheaper = F.when(F.col("priced"), F.coalesce("n_below", zero)).otherwise(zero)
    reference, best = F.col("mrp"), F.col("cheapest.mrp")
    found = F.col("n_substitutes") > 0
    summary = joined.select(
        "product_id",
        cheaper.alias("n_substitutes"),
        no_form.alias("n_form_unknown"), differs.alias("n_form_differs"),
        no_strength.alias("n_strength_unknown"), other_strength.alias("n_strength_differs"),
        unpriced.alias("n_no_price"), (comparable - cheaper).alias("n_not_cheaper"),
        "mrp", "cheapest", "priced",
    )
    summary = summary.select(
        "product_id", "n_substitutes", "n_form_unknown", "n_form_differs", "n_strength_unknown",
        "n_strength_differs", "n_no_price", "n_not_cheaper", "priced",
        F.when(found, F.col("cheapest.first_id")).alias("best_product_id"),
        F.when(found, best).alias("best_mrp"),
        F.when(found, savings_abs(reference, best)).alias("best_savings_abs"),
        F.when(found, savings_pct(reference, best)).alias("best_savings_pct"),
    )
    status = (
        F.when(F.col("molecule_count").isNull(), "no_products")
        .when(F.col("is_fdc"), "out_of_scope_fdc")
        .when(~F.col("priced"), "price_not_available")
        .when(F.col("n_substitutes") > 0, "ok")
        .otherwise("no_substitutes")
    )
    return profile.select("product_id", "molecule_id", "molecule_count", "is_fdc", "mrp").join(
        summary.hint("merge"), "product_id", "left"
    ).select(
        "product_id", "molecule_id", status.alias("status"), "mrp",
        *[F.coalesce(F.col(c), zero).alias(c) for c in (
            "n_substitutes", "n_form_unknown", "n_form_differs", "n_strength_unknown", "n_strength_differs",
            "n_no_price", "n_not_cheaper",
        )],
        "best_product_id", "best_mrp", "best_savings_abs", "best_savings_pct",
    )


def substitute_exclusions(summary: DataFrame) -> DataFrame:
    """Products left out of comparisons, counted by reason over the whole table."""
    reasons = {
        "form unknown": "n_form_unknown", "form differs": "n_form_differs", "strength unknown": "n_strength_unknown",
        "strength differs": "n_strength_differs", "price not available": "n_no_price", "not cheaper": "n_not_cheaper",
    }
    pairs = ", ".join(f"'{name}', {column}" for name, column in reasons.items())
    return (
        summary.filter("status IN ('ok', 'no_substitutes', 'price_not_available')")
        .groupBy("molecule_id")
        .agg(*[F.sum(c).alias(c) for c in reasons.values()])
        .selectExpr("molecule_id", f"stack({len(reasons)}, {pairs}) AS (reason, n_excluded)")
    )


def substitute_candidates(profile: DataFrame) -> DataFrame:
    """Per single-molecule product: how many other single-molecule products share its molecule, and the
    first of them in (mrp, product_id) order.

    The two lowest products of a molecule answer this for all its products.
    """
    singles = single_products(profile, price_guard=False)
    item = F.struct("mrp", "product_id")
    lowest = singles.groupBy("molecule_id").agg(F.count("*").alias("n_single"), F.min(item).alias("first"))
    without = singles.join(lowest.select("molecule_id", "first"), "molecule_id").filter(
        F.col("product_id") != F.col("first.product_id")
    )
    second = without.groupBy("molecule_id").agg(F.min(item).alias("second"))
    table = lowest.join(second, "molecule_id", "left")
    chosen = F.when(F.col("product_id") == F.col("first.product_id"), F.col("second")).otherwise(F.col("first"))
    return singles.join(table, "molecule_id").select(
        "product_id", "molecule_id", (F.col("n_single") - 1).alias("n_candidates"),
        chosen["product_id"].alias("first_candidate_id"), chosen["mrp"].alias("first_candidate_mrp"),
    )


def _with_any(rows: DataFrame) -> DataFrame:
    """Each product under its exact form/strength and under "any" of either: at most four rows."""
    forms = F.array_compact(F.array(F.lit(ANY), F.col("form")))
    strengths = F.array_compact(F.array(F.lit(ANY), F.when(F.col("comparable").isNotNull(), F.col("strength_key"))))
    return rows.withColumn("form_key", F.explode(forms)).withColumn("want_key", F.explode(strengths))


def baseline_table(profile: DataFrame, price_guard: bool = True) -> DataFrame:
    """Most expensive single-molecule product per (molecule, form or any, strength or any)."""
    singles = single_products(profile, price_guard).filter("priced")
    return (
        _with_any(singles)
        .groupBy("molecule_id", "form_key", "want_key")
        .agg(F.min(F.struct((-F.col("mrp")).alias("m"), "product_id")).alias("b"))
        .select("molecule_id", "form_key", "want_key", F.col("b.product_id").alias("product_id"))
    )


def substitution_baseline(
    requests: DataFrame, profile: DataFrame, contains: DataFrame, price_guard: bool = True
) -> DataFrame:
    """The product a request is compared against, without pairing requests with products.

    ``requests`` has ``molecule_id, form, strength_value, strength_unit, strength_hint`` and any other
    columns. A stated strength limits the pool; a bare number does so only when some product has it in mg.
    Adds ``status`` (null while undecided), ``reference_id`` and ``hint_used``.
    """
    wanted = canonical_strength(F.col("strength_value"), F.col("strength_unit"))
    form = F.coalesce(F.nullif(F.col("form"), F.lit("")), F.lit(ANY))
    has_wanted = F.col("__wanted").isNotNull()
    hint = F.struct(F.col("strength_hint").alias("value"), F.lit("mg").alias("unit"))
    staged = requests.withColumn("__wanted", wanted)
    staged = staged.withColumn("__form", form).withColumn(
        "__key", F.when(has_wanted, strength_key(F.col("__wanted"))).otherwise(F.lit(ANY))
    ).withColumn("__hint", F.when(~has_wanted & F.col("strength_hint").isNotNull(), strength_key(hint)))
    table = baseline_table(profile, price_guard)
    plain = table.select(
        F.col("molecule_id"), F.col("form_key").alias("__form"), F.col("want_key").alias("__key"),
        F.col("product_id").alias("__plain"),
    )
    hinted = table.select(
        F.col("molecule_id"), F.col("form_key").alias("__form"), F.col("want_key").alias("__hint"),
        F.col("product_id").alias("__hinted"),
    )
    availability = (
        contains.join(profile.select("product_id", "is_fdc", "mrp").hint("merge"), "product_id")
        .groupBy("molecule_id")
        .agg(
            F.max((~F.col("is_fdc")).cast("int")).alias("__single"),
            F.max(F.when(~F.col("is_fdc"), (F.col("mrp") > 0).cast("int"))).alias("__priced"),
        )
    )
    out = (
        staged.join(plain.hint("merge"), ["molecule_id", "__form", "__key"], "left")
        .join(hinted.hint("merge"), ["molecule_id", "__form", "__hint"], "left")
        .join(availability.hint("merge"), "molecule_id", "left")
    )
    reference = F.coalesce("__hinted", "__plain")
    unpriced = (F.col("__priced") == 0) if price_guard else F.lit(False)
    status = (
        F.when(F.col("__single").isNull(), "no_products")
        .when(F.col("__single") == 0, "out_of_scope_fdc")
        .when(unpriced, "price_not_available")
        .when(reference.isNull(), "no_substitutes")
    )
    return out.select(
        *requests.columns, status.alias("status"), F.when(status.isNull(), reference).alias("reference_id"),
        F.coalesce(status.isNull() & F.col("__hinted").isNotNull(), F.lit(False)).alias("hint_used"),
    )


def substitutes_for_molecule(
    requests: DataFrame, profile: DataFrame, contains: DataFrame, price_guard: bool = True
) -> DataFrame:
    """Request header: status, reference product, best substitute and counts."""
    base = substitution_baseline(requests, profile, contains, price_guard)
    summary = substitutes_for_product(profile, price_guard).select(
        F.col("product_id").alias("reference_id"), F.col("status").alias("__status"), F.col("mrp").alias("reference_mrp"),
        "n_substitutes", "best_product_id", "best_mrp", "best_savings_abs", "best_savings_pct",
    )
    return base.join(summary.hint("merge"), "reference_id", "left").select(
        *requests.columns, F.coalesce("status", "__status").alias("status"), "reference_id", "reference_mrp",
        F.coalesce("n_substitutes", F.lit(0).cast("bigint")).alias("n_substitutes"),
        "best_product_id", "best_mrp", "best_savings_abs", "best_savings_pct", "hint_used",
    )


@dataclass
class Ladders:
    """Single-molecule products in one global order: by class, those with a price first, then price, then id.

    ``rows`` (``row_no, product_id, mrp, priced, class_no, below_no``): a class is the range of numbers from its
    ``class_no``, and the substitutes of a product are the range from there to ``below_no``, the first row of its
    price. ``classes`` has a row per class (``class_no, priced_end, class_end`` beside its molecule, form and
    strength). Both are as long as the products; whatever is listed for a product is a few ranges of numbers.
    """

    rows: DataFrame
    classes: DataFrame


RUNG_BLOCK = 1_024


def price_ladders(profile: DataFrame, price_guard: bool = True) -> Ladders:
    """The order behind every ranked list, made by one sort; a class of any size is spread over all tasks."""
    singles = single_products(profile, price_guard)
    order = ["molecule_id", "form", "strength_key", F.desc("priced"), "mrp", "product_id"]
    rows = number_in_order(singles, order, "row_no")
    classes = rows.groupBy("molecule_id", "form", "strength_key").agg(
        F.min("row_no").alias("class_no"), F.count("*").alias("n"), F.count(F.when(F.col("priced"), 1)).alias("n_priced"),
        F.first("comparable").alias("comparable"),
    ).select(
        "molecule_id", "form", "strength_key", "comparable", "class_no",
        (F.col("class_no") + F.col("n_priced")).alias("priced_end"), (F.col("class_no") + F.col("n")).alias("class_end"),
    )
    prices = rows.groupBy("molecule_id", "form", "strength_key", "priced", "mrp").agg(F.min("row_no").alias("below_no"))
    same = lambda *names: F.expr(" AND ".join(f"x.{c} <=> y.{c}" for c in names))
    placed = rows.alias("x").join(prices.alias("y"), same("molecule_id", "form", "strength_key", "priced", "mrp")).select("x.*", "y.below_no")
    placed = placed.alias("x").join(classes.alias("y"), same("molecule_id", "form", "strength_key"))
    return Ladders(placed.select("row_no", "product_id", "x.molecule_id", "mrp", "priced", "class_no", "below_no"), classes)


def listed_ranges(references: DataFrame, ladders: Ladders, include_costlier: bool = False) -> DataFrame:
    """For each reference the ranges of numbers that its list consists of, each with its exclusion reason (null:
    substitutes). References are joined with the classes of their molecule, never with its products.
    """
    wanted = references.select("reference_id").distinct()
    ref = ladders.rows.join(wanted, ladders.rows["product_id"] == wanted["reference_id"]).select(
        "reference_id", F.col("row_no").alias("ref_no"), "molecule_id", F.col("mrp").alias("ref_mrp"), F.col("priced").alias("ref_priced"),
        F.col("class_no").alias("own_no"), "below_no",
    )
    own = ladders.classes.select(F.col("class_no").alias("own_no"), F.col("form").alias("ref_form"), F.col("comparable").alias("ref_comparable"))
    met = ref.join(own, "own_no").join(ladders.classes, "molecule_id")
    why = exclusion_reason(F.col("ref_form"), F.col("form"), F.col("ref_comparable"), F.col("comparable"), F.lit(False))
    part = lambda first, end, reason: F.struct(first.alias("first"), end.alias("end"), reason.alias("reason"))
    first, priced_end, class_end = F.col("class_no"), F.col("priced_end"), F.col("class_end")
    none = F.lit(None).cast("string")
    best = priced_end if include_costlier else F.col("below_no")
    comparable = F.array(
        part(first, F.when(F.col("ref_priced"), best).otherwise(first), none),
        part(F.when(F.col("ref_priced"), best).otherwise(priced_end), priced_end, F.lit(R_NOT_CHEAPER)),
        part(F.when(F.col("ref_priced"), priced_end).otherwise(first), class_end, F.lit(R_NO_PRICE)),
    )
    parts = F.when(why.isNull(), comparable).otherwise(F.array(part(first, class_end, why)))
    return met.select("reference_id", "ref_no", "molecule_id", "ref_mrp", F.inline(parts)).filter(F.col("first") < F.col("end"))


def substitution_listing(
    references: DataFrame, profile: DataFrame, price_guard: bool = True, include_costlier: bool = False,
    ladders: Ladders | None = None, substitutes_only: bool = False,
) -> DataFrame:
    """Every other single-molecule product of each reference's molecule: ranked substitute, or excluded with reason.

    ``references`` has ``reference_id`` and is the set of prescribed products being asked about; one output row per
    reference and other product. ``rank`` counts substitutes by falling saving, then price and id. The list is cut
    out of the ladders: ranges of numbers meet the rows of their blocks, so exactly the listed rows come out.
    """
    ladders = ladders or price_ladders(profile, price_guard)
    ranges = listed_ranges(references, ladders, include_costlier)
    if substitutes_only:
        ranges = ranges.filter("reason IS NULL")
    block = lambda c: F.floor(c / RUNG_BLOCK)
    spread = ranges.withColumn("block", F.explode(F.sequence(block(F.col("first")), block(F.col("end") - 1))))
    rungs = ladders.rows.select("row_no", "product_id", "mrp", block(F.col("row_no")).alias("block"))
    inside = (F.col("row_no") >= F.col("first")) & (F.col("row_no") < F.col("end")) & (F.col("row_no") != F.col("ref_no"))
    kept = F.col("reason").isNull()
    saving = savings_abs(F.col("ref_mrp"), F.col("mrp"))
    place = F.col("row_no") - F.col("first") + F.when((F.col("ref_no") >= F.col("first")) & (F.col("ref_no") < F.col("row_no")), 0).otherwise(1)
    return spread.join(rungs, "block").filter(inside).select(
        "reference_id", "molecule_id", "product_id", "mrp", F.col("reason").alias("exclusion_reason"), F.when(kept, place).alias("rank"),
        F.when(kept, saving).alias("savings_abs"), F.when(kept, savings_pct(F.col("ref_mrp"), F.col("mrp"))).alias("savings_pct"),
    )


def substitute_edges(listing: DataFrame) -> DataFrame:
    """SUBSTITUTE_FOR rows of a listing: a cache of the savings, valid while both prices hold."""
    return listing.filter("exclusion_reason IS NULL").select(
        F.col("product_id").alias("substitute_product_id"), F.col("reference_id").alias("product_id"),
        "savings_abs", "savings_pct",
    )
