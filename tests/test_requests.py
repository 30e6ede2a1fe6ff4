"""Type-ahead lists, stem rules from a table and the state of missed keys against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from rxlake.operators import coverage, suggest, vocab
from rxlake.plans import resolve as R
from rxlake.sources import artifacts
from rxlake.streaming import jobs
from tests.fixtures import catalogue


def test_type_ahead_equals_brute_force(spark):
    """Fragments of 1 to 9 letters over labels of few letters, so that most fragments match more labels than are shown."""
    rng = random.Random(11)
    keys = sorted({"".join(rng.choice("aab c") for _ in range(rng.randint(1, 14))).strip() for _ in range(600)} - {""})
    keys = [" ".join(k.split()) for k in keys]
    keys = sorted(set(keys)) + ["zz" + "a" * 40]
    labels = spark.createDataFrame([(k, k.upper(), k) for k in keys], "folded string, label string, label_key string")
    labels = labels.select("folded", "label", F.lit("ingredient").alias("kind"), F.lit(None).cast("string").alias("ingredient"), F.lit(None).cast("string").alias("molecule_id"), "label_key")
    pairs = [(a, b) for a, b in zip(keys, keys[1:]) if a < b]
    partners = {k: {b for a, b in pairs if a == k} | {a for a, b in pairs if b == k} for k in keys}
    index = suggest.suggestion_index(labels, spark.createDataFrame(pairs, "key_a string, key_b string"))
    asked = ["a", "b", "c", "ab", "a b", "bab", "aaaa", "caba", "aabaa", "aaaaaa", "aaabaa", "aaaaaaa", "abaabaaa", "zzaaaaaaa", "q", "qqqqqqqqq", ""]
    for limit in (3, 25):
        rows = suggest.matches(spark.createDataFrame([(a,) for a in asked * 2], "query_key string"), index, limit).collect()
        got = {a: [r.folded for r in sorted((r for r in rows if r.query_key == a), key=lambda r: r["rank"])] for a in asked}
        for a in asked:
            wanted = sorted((k for k in keys if a and a in k), key=lambda k: (not k.startswith(a), len(k), k))[:limit]
            assert got[a] == wanted, (limit, a)
    full = suggest.suggest(spark.createDataFrame([(a,) for a in asked], "q string"), labels, None, index=index).collect()
    assert full
    for r in full:
        assert r.confusable_with == "|".join(sorted(p.upper() for p in partners[r.label.lower()] if r.q in p)), r
    with pytest.raises(ValueError, match="limit"):
        suggest.suggest(labels, labels, None, limit=26, index=index)


PATTERNS = [
    "^red", "(rod|ring)$", "mycin", "abc|def", "a[bc]d", "[]abc]x", "x?yz", "(ab)?cd", "(ab|cd)?ef", "^(hot|cold)g", "ge{2}", "ge{0}n", "a.c", "co+l",
    r"\bold", r"o\.l", r"rod\|ring", "(a(b|c)d)e", "(?:old|new)er", "(rod|)x", "ROD", "rod ring", "[aeiou]{3}", "", "  ", "l(?!d)", "(?i)Gold", r"\Qa|b\E", "ab*c", "(gold|g)old",
    "a|", "ring$|^rod$", "(?x) g o l d", "x-(y)z",
]


def test_stem_rules_equal_sequential_matching(spark):
    rng = random.Random(7)
    words = ["red", "rod", "ring", "mycin", "old", "gold", "cold", "hot", "gee", "gn", "aeio", "ab", "cd", "ef", "abc", "x", "yz", "newer", ".", " ", "-", "]", "a|b"]
    names = ["".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(400)] + ["", "ROD", "ſRod", "\u212aing", None]
    molecules = spark.createDataFrame([(f"M{i}", n) for i, n in enumerate(names)], "molecule_id string, inn_name string")
    numbered = [(i, p, "CGJMNS"[i % 6]) for i, p in enumerate(PATTERNS)] + [(-1, "gold", "A"), (-2, "gold", " "), (5, None, "C")]
    for seed in range(2):
        rng.shuffle(numbered)
        rules = [(i, p, g) for i, (_, p, g) in enumerate(numbered)] if seed else numbered
        table = spark.createDataFrame(rules, "rule_no long, pattern string, atc_group string")
        got = {r.molecule_id: (r.atc_group, r.rule_no) for r in coverage.tier_from_stem_table(molecules, table).collect()}
        usable = sorted((n, p.strip(), g) for n, p, g in rules if p and p.strip() and g.strip() and g != "A")
        tested = molecules.crossJoin(spark.createDataFrame(usable, "rule_no long, pattern string, g string"))  # a small fixture
        hits = tested.filter(F.expr("inn_name RLIKE concat('(?i)', pattern)")).groupBy("molecule_id").agg(F.min(F.struct("rule_no", "pattern", "g")).alias("r"))
        assert got == {r.molecule_id: (r.r.g, r.r.rule_no) for r in hits.collect()}
    texts = spark.createDataFrame([(p,) for p in ["(rod|ring)$", "^red", "a|", "[]abc]x", "abc|Def", "(ab)?cd"]], "pattern string")
    found = {r.pattern: r.texts for r in coverage.with_required_texts(texts).collect()}
    assert found == {"(rod|ring)$": ["rod", "ring"], "^red": ["red"], "a|": None, "[]abc]x": None, "abc|Def": ["abc", "def"], "(ab)?cd": ["cd"]}


def test_thousands_of_rules_and_too_many_open_ones(spark):
    molecules = spark.range(300).select(F.concat(F.lit("M"), "id").alias("molecule_id"), F.concat(F.lit("nam"), "id", F.lit("mab")).alias("inn_name"))
    rules = spark.range(3000).select(F.col("id").alias("rule_no"), F.concat(F.lit("^nam"), "id", F.lit("m")).alias("pattern"), F.lit("N").alias("atc_group"))
    got = {r.molecule_id: r.rule_no for r in coverage.tier_from_stem_table(molecules, rules).collect()}
    assert got == {f"M{i}": i for i in range(300)}
    assert coverage.tier_from_stem_table(molecules, rules.limit(0)).count() == 0
    with pytest.raises(ValueError, match="rules name no text"):
        coverage.tier_from_stem_table(molecules, rules.withColumn("pattern", F.concat(F.lit("."), F.lit("{"), F.col("rule_no") + 500, F.lit("}"))))


def test_rules_with_one_pattern_meet_names_once_and_pieces_are_not_broadcast(spark):
    molecules = spark.range(20).select(F.concat(F.lit("M"), "id").alias("molecule_id"), F.concat(F.lit("nam"), "id", F.lit("mab")).alias("inn_name"))
    rules = spark.range(600).select(
        (F.col("id") + 7).alias("rule_no"), F.when(F.col("id") % 2 == 0, "^nam1.*ab").otherwise("[xyz]a|.mab$").alias("pattern"),
        F.when(F.col("id") < 2, "N").otherwise("C").alias("atc_group"))
    found = coverage.tier_from_stem_table(molecules, rules)
    assert {(r.molecule_id, r.atc_group, r.rule_no) for r in found.collect()} == {(f"M{i}", "N", 7 if str(i)[0] == "1" else 8) for i in range(20)}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_missed_keys_meet_the_similarity_join_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    vocabulary, known, near = catalogue(spark)[0], "metformin", "metformix"
    compared = []
    real = jobs.guarded_candidates
    monkeypatch.setattr(jobs, "guarded_candidates", lambda v, keys, t: (compared.append(sorted(r.normalized for r in keys.collect())), real(v, keys, t))[1])
    batches = [[near, known, "nothing like it", None, ""], [near, near, "another one"], [near, "nothing like it"], [near], []]
    jobs.missed_state(spark, root)
    for n, rows in enumerate(batches):
        batch = spark.createDataFrame([(r,) for r in rows], "query string")
        version = "v2" if n == 3 else "v1"
        for _ in range(2 if n in (1, 3) else 1):  # delivered again
            got = jobs.resolve_batch(batch, n, vocabulary, version, root)
            wanted = R.resolve(batch, vocabulary)
            assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect())), n
    new = [[near, "nothing like it"], ["another one"], ["another one"], [], [near], [near], []]
    assert compared == new
    state = {r.key: (r.vocabulary, r.computed_in) for r in artifacts.read_parts(spark, root, 5).collect()}
    assert state == {near: ("v2", 3), "nothing like it": ("v1", 0), "another one": ("v1", 1)}


def test_rows_of_small_files_are_not_broadcast(spark, tmp_path):
    """A file is far smaller than its rows: upserts and profiles join them without the driver."""
    rows = spark.range(200).select(F.concat(F.lit("P"), "id").alias("product_id"), (F.col("id") % 7).cast("decimal(12,2)").alias("mrp"), F.lit("tab").alias("form"))
    links = rows.select("product_id", F.concat(F.lit("M"), F.substring("product_id", 2, 1)).alias("molecule_id"), F.lit(5.0).alias("strength"), F.lit("mg").alias("unit"))
    contains = artifacts.stored(links, str(tmp_path), "contains")
    products = artifacts.upsert_parts(spark, f"{tmp_path}/t", 0, rows, ["product_id"], [])
    found = jobs.affected_substitutes(products.filter("product_id = 'P17'"), products, contains)
    assert found.count() == 111
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_lookups_with_many_rows_are_not_broadcast(spark, tmp_path):
    """Stored lookups by their rows, the vocabulary's own tables in any case; a small stored lookup still is."""
    executed = lambda df: (df.collect(), df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])[1]
    ids = spark.range(artifacts.BROADCAST_ROWS + 1).select("id", F.lit("x").alias("v"))
    asked = spark.range(50).select((F.col("id") * 7).alias("id"))
    large, small = artifacts.stored(ids, str(tmp_path), "large"), artifacts.stored(ids.limit(10), str(tmp_path), "small")
    assert "BroadcastHashJoin" not in executed(asked.join(large, "id")) and asked.join(large, "id").count() == 50
    assert "BroadcastHashJoin" in executed(asked.join(small, "id"))
    molecules = spark.createDataFrame([("M1", "metformin", "s"), ("M2", "glipizide", "s")], "molecule_id string, inn_name string, category string")
    aliases = spark.createDataFrame([("met", "met", "manual", "M1", 1), ("gone", "gone", "manual", "M9", 2)], "raw_string string, normalized_string string, source string, molecule_id string, row_no int")
    index = vocab.alias_index(aliases, molecules, ["row_no"])
    assert [(r.key, r.inn_name) for r in index.collect()] == [("met", "metformin")]
    plan = executed(index)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
