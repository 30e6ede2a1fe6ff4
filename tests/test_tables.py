import random

import pytest
from pyspark.sql import functions as F

from rxlake.functions import text as X
from rxlake.operators import dedupe, evaluate, explain, fdc, validate, vocab
from rxlake.operators import products as P
from rxlake.plans import build
from rxlake.sources import artifacts, headers
from tests.fixtures import catalogue


def test_scans(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿name, price\n" x ",1\n"a, ""b""",\n', encoding="utf-8")
    rows = artifacts.scan_csv(spark, str(path), ["name", "price", "absent"]).collect()
    assert [tuple(r) for r in rows] == [("x", "1", None), ('a, "b"', None, None)]
    path = tmp_path / "b.csv"
    path.write_text("# top\n\n  # indented\nbrand,kind\nA,brand\n# middle\nB,\n")
    assert [tuple(r) for r in artifacts.scan_commented_csv(spark, str(path)).orderBy("row_no").collect()] == [(1, "A", "brand"), (2, "B", "")]
    (tmp_path / "c.json").write_text('[{"molecule_id": "M1", "inn_name": " x "}]')
    assert tuple(artifacts.scan_json(spark, str(tmp_path / "c.json"), ["molecule_id", "inn_name"]).first()) == ("M1", "x")
    (tmp_path / "d.json").write_text('{"molecule_id": "M1"}')
    with pytest.raises(ValueError):
        artifacts.scan_json(spark, str(tmp_path / "d.json"), ["molecule_id"])
    (tmp_path / "m.json").write_text('{"covered_atc_groups": ["a", "B"], "molecule_atc_groups": {"M1": "a", "M2": ""}}')
    rows, groups = artifacts.read_manifest(spark, str(tmp_path / "m.json"))
    assert groups == ["A", "B"] and [tuple(r) for r in rows.collect()] == [("M1", "A")]
    assert artifacts.read_manifest(spark, str(tmp_path / "none.json")) is None


def test_folder_load(spark, tmp_path):
    (tmp_path / "molecule_catalog.csv").write_text("molecule_id,inn_name,category\nM1,Warfarin Sodium,small_molecule\nM2,x,bogus\nM3,aspirin,small_molecule\n")
    (tmp_path / "interactions.csv").write_text("molecule_id_a,molecule_id_b,severity,mechanism,provenance\nM3,M1,major,,d\nM1,M3,minor,,d\nM1,M1,minor,,d\nM1,M9,minor,,d\n")
    loaded = build.load_folder(spark, str(tmp_path))
    report = {r["stage"]: r for r in build.load_report(loaded).collect()}
    assert (report["molecules"]["written"], report["molecules"]["rejected"]) == (2, 1)
    assert (report["interactions"]["written"], report["interactions"]["dangling"], report["interactions"]["rejected"]) == (1, 1, 1)
    assert report["products"]["skipped"] == 1 and not report["products"]["complete"]
    assert tuple(loaded.tables["interactions"].select("molecule_id_a", "molecule_id_b", "severity").first()) == ("M1", "M3", "minor")
    assert {r["inn_name"] for r in loaded.tables["molecules"].collect()} == {"warfarin", "aspirin"}
    with pytest.raises(Exception, match="Invalid Molecule.category"):
        validate.strict_rows(loaded.offered["molecules"], "molecules").collect()


def test_headers():
    chosen, unknown = headers.match_headers(["Drug Code", "Generic Name", "Unit Size", "MRP (Rs)", "Price"], headers.PRODUCT_HEADERS)
    assert chosen == {"product_id": "Drug Code", "generic_name_raw": "Generic Name", "mrp": "Price"} and unknown == ["Unit Size", "MRP (Rs)"]


@pytest.mark.parametrize("style,text,value", [("in", "₹8.00", 8.0), ("in", "1,200.00", 1200.0), ("in", "Rs 5", 5.0), ("in", "not-a-price", None), ("in", "", None), ("eu", "1.234,50", 1234.5), ("eu", "10,00", 10.0)])
def test_money(spark, style, text, value):
    got = spark.createDataFrame([(text,)], "t string").select(X.money(F.col("t"), style)).first()[0]
    assert (None if got is None else float(got)) == value


def test_upsert_is_idempotent(spark, tmp_path):
    first = spark.createDataFrame([("a", 1, 0), ("b", 2, 1)], "k string, v int, s int")
    new = spark.createDataFrame([("b", 3, 0), ("b", 4, 1), ("c", 5, 2)], "k string, v int, s int")
    artifacts.upsert_snapshot(spark, str(tmp_path), 0, first, ["k"], ["s"])
    for version in (1, 2, 2):
        got = artifacts.upsert_snapshot(spark, str(tmp_path), version, new, ["k"], ["s"])
        assert sorted(map(tuple, got.collect())) == [("a", 1), ("b", 4), ("c", 5)]


def test_numbering_over_many_partitions(spark):
    keys = spark.createDataFrame([(f"k{i % 500:04d}",) for i in range(3000)], "key string").repartition(7)
    got = [tuple(r) for r in dedupe.assign_molecule_ids(keys, "key").orderBy("key").collect()]
    assert got == [(f"MOL{i + 1:06d}", f"k{i:04d}") for i in range(500)]


def test_product_summary_equals_listing_with_a_hot_molecule(spark):
    rng = random.Random(3)
    rows, links = [], []
    for i in range(240):
        molecule = "M0" if i % 3 == 0 else f"M{rng.randint(1, 9)}"
        rows.append((f"P{i}", rng.choice(["tablet", "syrup", None]), rng.choice([0, 5, 5, 7, 9, 12, 13])))
        links.append((f"P{i}", molecule, rng.choice([None, 5.0, 0.005]), rng.choice(["mg", "g"])))
        if i % 11 == 0:
            links.append((f"P{i}", "MX", 1.0, "ml"))
    products = spark.createDataFrame(rows, "product_id string, form string, mrp int").withColumn("mrp", F.col("mrp").cast("decimal(12,2)"))
    profile = P.product_profile(products, spark.createDataFrame(links, "product_id string, molecule_id string, strength double, unit string")).cache()
    for guard in (True, False):
        listing = P.substitution_listing(profile.select(F.col("product_id").alias("reference_id")), profile, guard).collect()
        summary = {r["product_id"]: r for r in P.substitutes_for_product(profile, guard).collect()}
        candidates = {r["product_id"]: r for r in P.substitute_candidates(profile).collect()}
        for pid, s in summary.items():
            mine = [r for r in listing if r["reference_id"] == pid]
            good = sorted((-r["savings_abs"], r["mrp"], r["product_id"]) for r in mine if r["exclusion_reason"] is None)
            assert s["n_substitutes"] == len(good)
            assert s["best_product_id"] == (good[0][2] if good else None)
            excluded = s["n_form_unknown"] + s["n_form_differs"] + s["n_strength_unknown"] + s["n_strength_differs"] + s["n_no_price"] + s["n_not_cheaper"]
            assert excluded == len(mine) - len(good), pid
            if mine:
                assert candidates[pid]["n_candidates"] == len(mine)
                assert candidates[pid]["first_candidate_id"] == min((r["mrp"], r["product_id"]) for r in mine)[1]


def test_look_alike_classes(spark):
    pairs = [("vitamin k", "vitamin c", 1), ("amlodipine", "s-amlodipine", 2), ("povidone iodine", "povidone-iodine", 1), ("lincomycin", "linomycin", 1), ("ofloxacin", "ofloxaxin", 1), ("albendazole", "mebendazole", 2)]
    rows = {r["name_a"]: (r["verdict"], r["reason"].split(" - ")[0]) for r in fdc.confusable_classify(spark.createDataFrame(pairs, "name_a string, name_b string, edit_distance int")).collect()}
    assert rows["vitamin k"] == ("dangerous", "same stem but different single-letter designator (k vs c)")
    assert rows["amlodipine"][1] == "enantiomer/isomer prefix" and rows["povidone iodine"][0] == "benign"
    assert rows["lincomycin"][1] == "shared class suffix -mycin but different stem"
    assert rows["ofloxacin"][1] == "short name" and rows["albendazole"][1].startswith("no orthographic rule")


def test_doubled_letters_that_count_as_one(spark):
    pairs = spark.createDataFrame([("redbbcod rod", "redbcod rod", 1), ("redllcod rod", "redlcod rod", 1)], "name_a string, name_b string, edit_distance int")
    verdicts = lambda **kw: {r["name_a"]: r["verdict"] for r in fdc.confusable_classify(pairs, **kw).collect()}
    assert verdicts() == {"redbbcod rod": "benign", "redllcod rod": "benign"}
    assert verdicts(doubled="lz") == {"redbbcod rod": "dangerous", "redllcod rod": "benign"}
    none = spark.createDataFrame([], "key_a string, key_b string")
    bridged = fdc.orthographic_bridge(pairs.select("name_a"), pairs.select("name_b"), none, doubled="lzxd").collect()
    assert [tuple(r) for r in bridged] == [("redllcod rod", "redlcod rod")]


def test_name_decomposition(spark):
    names = [("1", "Clobetasol 0.05% w/w, Ofloxacin 0.75% w/w, Ornidazole 2% w/w and Terbinafine 1% w/w Cream"), ("2", "Amoxycillin 1g and Potassium Clavulanate 200mg Powder for Injection 1 Vial"), ("3", "Extract (a, b and c) 5mg"), ("4", "Vitamin B and C")]
    parts = fdc.fdc_decompose(spark.createDataFrame(names, "product_id string, generic_name_raw string")).orderBy("product_id", "position").collect()
    by = lambda p: [r["component"] for r in parts if r["product_id"] == p]
    assert [c.split()[0] for c in by("1")] == ["Clobetasol", "Ofloxacin", "Ornidazole", "Terbinafine"]
    assert len(by("2")) == 2 and by("3") == ["Extract (a, b and c) 5mg"] and by("4") == ["Vitamin B and C"]


def test_evaluation_classes(spark):
    cases = spark.createDataFrame(
        [("1", "a", "exact", "M1", None), ("2", "b", "exact", "M1", None), ("3", "c", "alias", "M1", ""), ("4", "d", "needs_review", "M2", ""), ("5", "e", "any", None, "inn:two"), ("6", "f", "unresolved", None, "")],
        "case_id string, query string, expected_path string, expected_molecule_id string, forbidden_molecules string")
    answers = spark.createDataFrame(
        [("a", "a", "resolved", "exact", "M1", "one"), ("b", "b", "resolved", "exact", "M9", "nine"), ("c", "c", "needs_review", None, None, None), ("d", "d", "needs_review", None, None, None), ("e", "e", "needs_review", None, None, None), ("f", "f", "unresolved", None, None, None)],
        "query string, normalized string, status string, path string, molecule_id string, inn_name string")
    offered = spark.createDataFrame([("c", 1, "M1", "one"), ("d", 1, "M3", "x"), ("d", 2, "M2", "two"), ("e", 1, "M2", "two")], "normalized string, rank int, molecule_id string, inn_name string")
    outcomes = evaluate.score_resolution(cases, answers, offered)
    assert {r["case_id"]: r["outcome"] for r in outcomes.collect()} == {"1": "correct_accept", "2": "false_accept", "3": "missed_accept", "4": "as_expected", "5": "violation", "6": "as_expected"}
    m = evaluate.resolution_metrics(outcomes).first()
    assert (m["accept_precision"], m["accept_recall"], m["candidate_recall"], m["mean_candidate_rank"], m["passed"]) == (0.5, 0.5, 1.0, 2.0, False)
    empty = evaluate.resolution_metrics(outcomes.filter("false")).first()
    assert (empty["accept_precision"], empty["passed"]) == (0.0, True)


def test_wording_never_reassures_about_unchecked_pairs(spark):
    rows = spark.createDataFrame(
        [("not_checked", "a", None, "b", "M2", None, "A"), ("not_checked", "a", "M1", "b", "M2", "C", "A"), ("not_checked", "a", "M1", "b", "M2", None, "A")],
        "status string, left_label string, left_molecule_id string, right_label string, right_molecule_id string, left_atc_group string, right_atc_group string",
    ).select("*", F.lit(None).cast("string").alias("severity"), F.lit(None).cast("string").alias("mechanism"))
    heads = [r["headline"] for r in explain.explain_pairs(rows).collect()]
    assert heads == ["Not checked — we could not identify one of these", "Not checked — this kind of medicine is outside our data", "Not checked"]
    assert all("not loaded" in r["headline"] for r in explain.explain_pairs(rows.filter("left_molecule_id IS NOT NULL"), coverage_missing=True).collect())


def test_alias_rules(spark):
    vocabulary, *_ = catalogue(spark)
    rows = spark.createDataFrame([("Chlorthalidon", "chlorthalidone", "manual", "MOL001", 0), ("B", "", "manual", "MOL002", 1), ("b", "b", "manual", "MOL003", 2)],
                                 "raw_string string, normalized_string string, source string, molecule_id string, row_no bigint")
    index = vocab.alias_index(vocab.load_aliases(rows), vocabulary.molecules, ["row_no"])
    assert {r["key"]: r["molecule_id"] for r in index.collect()} == {"chlorthalidone": "MOL001", "b": "MOL003"}
    both = vocab.load_aliases(rows, index_raw_strings=True)
    assert "chlorthalidon" in {r["normalized_string"] for r in both.collect()}


def test_raw_files_to_tables(spark):
    products = spark.createDataFrame(
        [(1, "1", "Warfarin Sodium 5mg Tablet", "10's", "₹8.00"), (2, "2", "Metformin 500mg Tablet", "10's", "1,200.00"), (3, "3", "", "10's", "5"), (4, "4", "Aspirin", "10's", "not-a-price"), (5, "", "Zinc mystery tab", "1", "2")],
        "row_no bigint, `Drug Code` string, `Generic Name` string, `Unit Size` string, MRP string")
    pairs = spark.createDataFrame([(0, "Warfarin", "Aspirin", "Major", "x"), (1, "aspirin", "WARFARIN", "Minor", ""), (2, "Aspirin", "aspirin", "", ""), (3, "Metformin", "Warfarin", "", None)],
                                  "row_no bigint, drug_a string, drug_b string, severity string, mechanism string")
    atc = spark.createDataFrame([(0, "Warfarin", "b01aa03"), (1, "Nobody", "A01")], "row_no bigint, drug_name string, atc_code string")
    manual = spark.createDataFrame([], "raw_string string, normalized_string string, source string")
    rows = headers.map_columns(products, headers.PRODUCT_HEADERS, headers.PRODUCT_REQUIRED, keep=("row_no",))
    made = build.build_tables(rows, pairs, atc, manual, ["row_no"], ["row_no"])
    ids = {r["inn_name"]: r["molecule_id"] for r in made.molecules.collect()}
    assert ids == {"aspirin": "MOL000001", "metformin": "MOL000002", "warfarin": "MOL000003"}
    assert sorted((r["molecule_id_a"], r["molecule_id_b"], r["severity"]) for r in made.interactions.collect()) == [("MOL000001", "MOL000003", "minor"), ("MOL000002", "MOL000003", "unknown")]
    assert {(r["product_id"], r["molecule_id"], r["strength"]) for r in made.contains.collect()} == {("1", "MOL000003", 5.0), ("2", "MOL000002", 500.0)}
    assert [(r["product_id"], r["generic_name_raw"]) for r in made.unjoined.collect()] == [("PMBJP-000005", "Zinc mystery tab")]
    assert sorted(r["reason"] for r in made.rejected_products.collect()) == ["no generic name", "unparseable MRP 'not-a-price'"]
    assert [tuple(r) for r in made.coverage.collect()] == [("MOL000003", "B")]


def test_long_prescriptions_are_checked_in_full(spark):
    """60 and 500 lines: every pair has a status, numbered without gaps, and nothing is reported complete unchecked."""
    from pyspark.sql import functions as F

    from rxlake.operators import interactions as I

    lines = spark.createDataFrame([(rx, p) for rx, n in ((1, 60), (2, 500), (3, 1)) for p in range(n)], "rx_id long, pos int")
    null = F.lit(None).cast("string")
    inputs = lines.select("rx_id", "pos", F.lit(0).alias("comp_pos"), F.lit("").alias("comp_name"), F.concat(F.lit("drug "), "pos").alias("query"),
                          *[null.alias(c) for c in I.INPUT_FIELDS if c not in ("query", "gap")], F.lit("unknown").alias("gap"))
    edges = spark.createDataFrame([], "molecule_id_a string, molecule_id_b string, severity string, mechanism string, provenance string")
    pairs = I.classify_pairs(I.rx_pairs(inputs), edges)
    found = {r.rx_id: r for r in pairs.groupBy("rx_id").agg(F.count("*").alias("n"), F.max("pair_no").alias("top"), F.countDistinct("pair_no").alias("d")).collect()}
    assert {k: (v.n, v.top, v.d) for k, v in found.items()} == {1: (1770, 1769, 1770), 2: (124750, 124749, 124750)}
    summary = {r.rx_id: r.coverage_complete for r in I.check_summary(lines, pairs).collect()}
    assert summary == {1: False, 2: False, 3: True}


def test_snapshot_gap_is_an_error(spark, tmp_path):
    import pytest

    from rxlake.sources import artifacts

    rows = spark.createDataFrame([("a", 1)], "k string, v int")
    artifacts.upsert_snapshot(spark, str(tmp_path), 0, rows, ["k"], [])
    with pytest.raises(ValueError):
        artifacts.upsert_snapshot(spark, str(tmp_path), 2, rows, ["k"], [])


def test_rows_equal_to_the_header_and_many_groups(spark, tmp_path):
    import json

    from rxlake.sources import artifacts

    (tmp_path / "p.csv").write_text("# note\nbrand,kind\nA,x\nbrand,kind\nB,y\n")
    rows = artifacts.scan_commented_csv(spark, str(tmp_path / "p.csv")).orderBy("row_no").collect()
    assert [tuple(r) for r in rows] == [(1, "A", "x"), (2, "brand", "kind"), (3, "B", "y")]
    groups = [f"G{i:02}" for i in range(40)]
    (tmp_path / "m.json").write_text(json.dumps({"covered_atc_groups": groups, "molecule_atc_groups": {"M1": "A"}}))
    assert artifacts.read_manifest(spark, str(tmp_path / "m.json"))[1] == groups
    (tmp_path / "t.csv").write_text('a,b\n"\tx\t",y\n')
    assert artifacts.scan_csv(spark, str(tmp_path / "t.csv")).first()["a"] == "x"


def test_anchor_profile_reads_its_rows_once(spark):
    """Partners by file and in all come from one reading, equal to counting by hand; self-pairs and nulls do not count."""
    from itertools import product

    from rxlake.operators.coverage import anchor_profile

    rows = [(a, b, f) for a, b, f in product(["p", "q", "r", None], ["q", "p", "s", "t"], ["A", "B", "C"]) if hash_of(a, b, f) % 3]
    table = spark.createDataFrame(rows * 2, "x string, y string, f string")
    got = anchor_profile(table, "x", "y", "f")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") <= 2  # once in the final and once in the initial plan
    seen = {(d, e, f) for a, b, f in rows if a and b and a != b for d, e in ((a, b), (b, a))}
    want = {}
    for drug in {d for d, _, _ in seen}:
        files = {f: len({e for d, e, g in seen if d == drug and g == f}) for d, _, f in seen if d == drug}
        top = min(files, key=lambda f: (-files[f], f))
        total = len({e for d, e, _ in seen if d == drug})
        want[drug] = (top, files[top], total, files[top] / total)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want


def hash_of(*values) -> int:
    return sum((i + 1) * ord(v or "z") for i, v in enumerate(values))
