import pytest
from pyspark.sql import functions as F

from rxlake.operators import interactions as I
from rxlake.operators import products as P
from rxlake.plans import check, resolve
from tests.fixtures import catalogue


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    vocabulary, products, contains, edges, coverage = catalogue(spark)
    prepared = vocabulary.prepare(str(tmp_path_factory.mktemp("vocab")))
    return prepared, products, contains, I.canonical_edges(edges, ["row_no"]), coverage


RESOLUTIONS = [
    ("amoxicillin", "resolved", "exact", "MOL001"), ("Amoxicillin 500mg Capsule", "resolved", "exact", "MOL001"),
    ("AMOXYCILLIN 500MG CAP", "resolved", "exact", "MOL001"), ("Metformin Hydrochloride 0.5g Tab", "resolved", "exact", "MOL002"),
    ("Clavulanic Acid", "resolved", "exact", "MOL014"), ("Albuterol", "resolved", "alias", "MOL012"),
    ("Ecosprin 75 Tablet", "resolved", "alias", "MOL005"), ("Glycomet", "resolved", "alias", "MOL002"), ("Atorva", "resolved", "alias", "MOL003"),
    ("amoxicilin", "needs_review", None, None), ("zzzznotadrug", "unresolved", None, None), ("500mg tablet", "unresolved", None, None),
    ("hydralazine", "unresolved", None, None), ("prednisone", "resolved", "exact", "MOL011"), ("augmentin 625", "combination", None, None),
    ("Halfpack", "unresolved", None, None), ("Single", "unresolved", None, None), ("Ghost", "unresolved", None, None),
]


def test_resolution(spark, world):
    asked = spark.createDataFrame([(r[0],) for r in RESOLUTIONS], "query string")
    got = {r["query"]: r for r in resolve.resolve(asked, world[0]).collect()}
    for query, status, path, molecule in RESOLUTIONS:
        r = got[query]
        assert (r["status"], r["path"], r["molecule_id"]) == (status, path, molecule), query
        # A similarity hit is never an identification.
        assert r["molecule_id"] is None or r["n_candidates"] == 0
    assert got["Halfpack"]["note"].startswith("'Halfpack' is a combination pack, but 1 of its 2 ingredients")
    assert got["500mg tablet"]["note"] == "input normalized to an empty key"


def test_both_rules_of_the_blocklist(spark, world):
    keys = spark.createDataFrame([("prednisolon",), ("hydralazine",), ("omeprazol",)], "normalized string")
    rows = {(r["normalized"], r["inn_name"]): r for r in resolve.guarded_candidates(world[0], keys, 55).collect()}
    for name, other in (("prednisolone", "prednisone"), ("prednisone", "prednisolone")):
        assert rows["prednisolon", name]["reason"].endswith("both present in candidate set")
        assert rows["prednisolon", name]["confusable_with"] == other
    assert rows["hydralazine", "hydroxyzine"]["confusable_with"] == "hydralazine"
    assert rows["omeprazol", "omeprazole"]["reason"] == "blocklisted confusable of the query string"


def test_substitution(spark, world):
    _, products, contains, _, _ = world
    profile = P.product_profile(products, contains)
    schema = "molecule_id string, form string, strength_value double, strength_unit string, strength_hint double"
    asked = [
        ("MOL001", "capsule", 500.0, "mg", None), ("MOL002", "tablet", 500.0, "mg", None), ("MOL014", None, None, None, None),
        ("MOL005", None, None, None, None), ("MOL009", None, None, None, None), ("MOL001", None, None, None, 250.0), ("MOL001", None, None, None, 999.0),
        ("MOL001", "syrup", None, None, None),
    ]
    got = P.substitutes_for_molecule(spark.createDataFrame(asked, schema), profile, contains).collect()
    by = {(r["molecule_id"], r["form"], r["strength_hint"]): r for r in got}
    r = by["MOL001", "capsule", None]
    assert (r["status"], r["reference_id"], float(r["best_savings_abs"]), r["best_product_id"]) == ("ok", "PRD003", 79.5, "PRD001")
    r = by["MOL002", "tablet", None]
    assert (r["status"], r["reference_id"], float(r["best_savings_abs"])) == ("ok", "PRD012", 23.0)
    assert by["MOL014", None, None]["status"] == "out_of_scope_fdc"
    assert by["MOL009", None, None]["status"] == "no_products"
    assert by["MOL001", "syrup", None]["status"] == "no_substitutes"
    assert (by["MOL001", None, 250.0]["reference_id"], by["MOL001", None, 250.0]["hint_used"]) == ("PRD004", True)
    assert (by["MOL001", None, 999.0]["reference_id"], by["MOL001", None, 999.0]["hint_used"]) == ("PRD003", False)
    # A product without a price is on neither side of a comparison.
    r = by["MOL005", None, None]
    assert (r["status"], r["reference_id"], r["best_savings_pct"]) == ("no_substitutes", "PRD031", None)


def test_price_guard_off(spark, world):
    _, products, contains, _, _ = world
    profile = P.product_profile(products, contains)
    got = {r["product_id"]: r for r in P.substitutes_for_product(profile, price_guard=False).collect()}
    assert got["PRD031"]["best_savings_pct"] == 100.0
    on = {r["product_id"]: r for r in P.substitutes_for_product(profile).collect()}
    assert (on["PRD031"]["status"], on["PRD031"]["n_no_price"]) == ("no_substitutes", 1)
    assert (on["PRD030"]["status"], on["PRD040"]["status"], on["PRD060"]["status"]) == ("price_not_available", "out_of_scope_fdc", "no_products")
    zero = spark.createDataFrame([("PRD030",)], "reference_id string")
    costlier = P.substitution_listing(zero, profile, price_guard=False, include_costlier=True).first()
    assert (costlier["product_id"], costlier["savings_pct"]) == ("PRD031", 0.0)


RX = {
    1: (["Warfarin", "Aspirin"], ["interaction"]), 2: (["Warfarin", "Metformin"], ["no_known_interaction"]),
    3: (["Warfarin", "Atorvastatin"], ["not_checked"]), 4: (["Warfarin", "Amoxicillin"], ["not_checked"]),
    5: (["Warfarin", "it's new"], ["not_checked"]), 6: (["Warfarin", "warfarin 5mg"], ["not_checked"]),
    7: (["Augmentin", "Atorvastatin"], ["not_checked", "not_checked", "interaction"]), 8: (["Warfarin"], []),
}


def lines(spark):
    return spark.createDataFrame([(rx, i + 1, drug) for rx, (drugs, _) in RX.items() for i, drug in enumerate(drugs)], "rx_id bigint, pos int, query string")


def test_pairs(spark, world):
    vocabulary, _, _, edges, coverage = world
    rows = check.check_pairs(lines(spark), vocabulary, edges, coverage).orderBy("rx_id", "pair_no").collect()
    for rx, (_, expected) in RX.items():
        assert [r["status"] for r in rows if r["rx_id"] == rx] == expected, rx
    reasons = {r["rx_id"]: r["reason"] for r in rows}
    assert reasons[3] == "atorvastatin is in ATC group C, which the ingested DDInter source does not cover"
    assert reasons[5] == '"it\'s new" could not be resolved to a molecule'
    assert reasons[6].startswith("the same molecule was supplied twice")
    packs = [r for r in rows if r["rx_id"] == 7]
    assert [(r["left_inn_name"], r["right_inn_name"]) for r in packs] == [
        ("amoxicillin", "clavulanic acid"), ("amoxicillin", "atorvastatin"), ("clavulanic acid", "atorvastatin")]
    summary = {r["rx_id"]: r for r in I.check_summary(lines(spark), check.check_pairs(lines(spark), vocabulary, edges, coverage)).collect()}
    assert (summary[8]["pairs_total"], summary[8]["coverage_complete"]) == (0, True)
    assert (summary[7]["interactions_found"], summary[7]["not_checked"]) == (1, 2)


def test_no_manifest_means_nothing_is_clean(spark, world):
    vocabulary, _, _, edges, _ = world
    rows = check.check_pairs(lines(spark), vocabulary, edges, None).collect()
    assert {r["status"] for r in rows} == {"interaction", "not_checked"}


def test_array_form_equals_line_form(spark, world):
    vocabulary, _, _, edges, coverage = world
    arrays = spark.createDataFrame([(rx, drugs) for rx, (drugs, _) in RX.items()] + [(99, ["Warfarin"] * 51)], "rx_id bigint, drugs array<string>")
    a = check.check_arrays(arrays, check.prescription_lookup(vocabulary, coverage), edges)
    long = spark.range(51).select(F.lit(99).cast("bigint").alias("rx_id"), F.col("id").cast("int").alias("pos"), F.lit("Warfarin").alias("query"))
    b = check.check_pairs(lines(spark).unionByName(long), vocabulary, edges, coverage).drop("pair_no")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def test_oversized_prescriptions_are_reported(spark):
    rows = spark.range(60).select(F.lit(1).alias("rx_id"), F.col("id").alias("pos"), F.lit("x").alias("query"))
    valid, rejected = I.split_prescriptions(rows)
    assert valid.count() == 0 and rejected.first()["n_drugs"] == 60


def test_only_pairs_that_can_have_an_edge_are_moved(spark, world):
    """Pairs without two different molecules take no part in the join with the edges; a repeated id is two prescriptions."""
    vocabulary, _, _, edges, coverage = world
    pairs = check.check_pairs(lines(spark), vocabulary, edges.hint("merge"), coverage)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString().splitlines()
    met = [i for i, line in enumerate(plan) if "Join LeftOuter" in line and "least(" in line]
    assert len(met) == 1  # the ids are the keys, with no key for pairs that have none
    assert any("Union" in line for line in plan[: met[0]])
    twice = spark.createDataFrame([(1, ["Warfarin", "Aspirin"]), (1, ["Warfarin", "Aspirin"])], "rx_id bigint, drugs array<string>")
    assert check.check_arrays(twice, check.prescription_lookup(vocabulary, coverage), edges).count() == 2
