"""Ranked lists, threshold ranges, tables in parts and row order against plain versions."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rxlake.operators import fuzzy
from rxlake.operators import products as P
from rxlake.sources import artifacts


@pytest.mark.parametrize(("guard", "costlier"), [(True, False), (False, True)])
def test_ranked_lists(spark, guard, costlier):
    """A molecule with many products of one price, unknown forms and strengths, and prices of zero."""
    rng = random.Random(3)
    rows = [
        (f"P{i:03}", rng.choice(["A", "A", "A", "B"]), rng.choice(["tablet", "syrup", None]), rng.choice([10.0, 20.0, None]), Decimal(rng.choice(["0", "5", "5", "7.50", "9"])))
        for i in range(90)
    ]
    products = spark.createDataFrame([(i, f, m) for i, _, f, _, m in rows], "product_id string, form string, mrp decimal(12,2)")
    contains = spark.createDataFrame([(i, a, s, "mg") for i, a, _, s, _ in rows], "product_id string, molecule_id string, strength double, unit string")
    profile = P.product_profile(products, contains)
    got = {(r.reference_id, r.product_id): r for r in P.substitution_listing(products.select(F.col("product_id").alias("reference_id")), profile, guard, costlier).collect()}
    for ref in rows:
        accepted, others = [], [o for o in rows if o[1] == ref[1] and o[0] != ref[0]]
        for other in others:
            row = got.pop((ref[0], other[0]))
            comparable = ref[2] and ref[2] == other[2] and ref[3] and ref[3] == other[3]
            priced = not guard or (ref[4] > 0 and other[4] > 0)
            assert (row.exclusion_reason is None) == bool(comparable and priced and (costlier or other[4] < ref[4])), (ref, other, row)
            if row.exclusion_reason is None:
                accepted.append((-(ref[4] - other[4]), other[4], other[0], row.rank))
                assert row.savings_abs == ref[4] - other[4]
        assert [a[3] for a in sorted(accepted)] == list(range(1, len(accepted) + 1))
    assert not got


def test_threshold_ranges_equal_the_rules(spark):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(9)]
    scored = [(f"q{q}", f"M{i}", n, float(rng.choice([70, 75, 80, 85, 90])), n, "inn_name") for q in range(12) for i, n in enumerate(names) if rng.random() < 0.7]
    scored += [("n1", "M2", "n2", 90.0, "n2", "inn_name"), ("q1", "M99", "n3", 72.0, "n3", "inn_name")]
    scored = spark.createDataFrame(scored, "normalized string, molecule_id string, inn_name string, score double, matched_string string, matched_on string")
    pairs = spark.createDataFrame([("n1", "n2"), ("n3", "n4"), ("n3", "n5"), ("n7", "n8")], "key_a string, key_b string")
    thresholds = [70.0, 75.0, 78.0, 85.0, 90.0, 95.0]
    swept = fuzzy.candidates_by_threshold(fuzzy.threshold_ranges(scored, pairs), thresholds).collect()
    for t in thresholds:
        single = fuzzy.fuzzy_candidates(fuzzy.guard_candidates(scored.filter(F.col("score") >= t), pairs)).collect()
        assert sorted(tuple(r)[1:] for r in swept if r.threshold == t) == sorted(map(tuple, single)), t


def test_tables_in_parts(spark, tmp_path):
    root, schema = str(tmp_path), "k string, v int, seq int"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    table = lambda df: {r.k: r.v for r in df.collect()}
    start = [(f"k{i}", i, 0) for i in range(300)]
    artifacts.upsert_parts(spark, root, 0, frame(start), ["k"], ["seq"], parts=16)
    batch = frame([("k5", 50, 1), ("k5", 51, 2), ("new", 7, 1)])
    wanted = {**{f"k{i}": i for i in range(300)}, "k5": 51, "new": 7}
    assert table(artifacts.upsert_parts(spark, root, 1, batch, ["k"], ["seq"])) == wanted
    rewritten = [r for r in artifacts._manifest(spark, root, 1).collect() if r.version == 1]
    assert 1 <= len(rewritten) <= 2  # the parts of the two keys, of 16
    artifacts.upsert_parts(spark, root, 2, frame([("k7", 70, 1)]), ["k"], ["seq"])
    assert table(artifacts.upsert_parts(spark, root, 2, frame([("k7", 70, 1)]), ["k"], ["seq"])) == {**wanted, "k7": 70}  # delivered again
    assert table(artifacts.upsert_parts(spark, root, 3, frame([]), ["k"], ["seq"])) == {**wanted, "k7": 70}
    assert table(artifacts.read_parts(spark, root, 1)) == wanted  # earlier versions stay
    with pytest.raises(ValueError, match="missing"):
        artifacts.upsert_parts(spark, root, 9, batch, ["k"], ["seq"])


@pytest.mark.parametrize("split", ["128m", "200"])
def test_rows_follow_the_files(spark, tmp_path, split):
    """Files of unequal size, read in one split each or in many: the order of one sequential reading."""
    lines = ["# head", "name,n"]
    for f, size in enumerate([3, 200, 1, 40]):
        lines += [x for i in range(size) for x in (f"r{f}_{i},{i}", *(["  # note"] if i % 7 == 0 else []), *([""] if i % 5 == 0 else []))]
        (tmp_path / f"part-{f}.csv").write_text("\n".join(lines) + "\n")
        lines = ["name,n"] if f == 1 else []
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = artifacts.scan_commented_csv(spark, str(tmp_path)).orderBy("row_no").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r["name"] for r in got] == [f"r{f}_{i}" for f, size in enumerate([3, 200, 1, 40]) for i in range(size)]
