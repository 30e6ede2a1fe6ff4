import random

import pytest

from rxlake.operators import fuzzy, suggest
from tests.fixtures import catalogue


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


def near(rng, word):
    letters = list(word)
    for _ in range(rng.randint(0, 4)):
        at = rng.randrange(len(letters) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            letters.insert(at, rng.choice("abcé"))
        elif letters[at:]:
            letters[at : at + 1] = [] if kind == 1 else [rng.choice("abcé")]
    return "".join(letters)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(7)
    # One shared stem in a third of the words: a hot segment.
    base = ["".join(rng.choice("abcé ") for _ in range(rng.randint(1, 22))).strip() for _ in range(60)]
    base += ["common stem " + "".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(30)]
    return [w for w in base if w], [w for w in (near(rng, w) for w in base * 2) if w]


@pytest.mark.parametrize("threshold", [0, 40, 55, 70, 88, 100])
def test_blocked_join_equals_all_pairs(spark, words, threshold):
    forms, queries = words
    got = fuzzy.similar_strings(
        spark.createDataFrame([(w,) for w in queries], "q string"), spark.createDataFrame([(w,) for w in forms], "f string"), threshold
    ).collect()
    expected = {
        (q, f): round((1 - distance(q, f) / max(len(q), len(f))) * 100, 2)
        for q in set(queries) for f in set(forms)
        if round((1 - distance(q, f) / max(len(q), len(f))) * 100, 2) >= threshold
    }
    assert len(got) == len(expected)
    assert {(r[0], r[1]): r[2] for r in got} == expected


def test_scan_equals_all_pairs(spark, words):
    names = sorted(set(words[0] + words[1]))
    got = {(r[0], r[1]): r[2] for r in fuzzy.confusable_scan(spark.createDataFrame([(w,) for w in names], "n string")).collect()}
    expected = {(a, b): distance(a, b) for a in names for b in names if a < b and distance(a, b) <= 2}
    assert got == expected


def test_scores(spark):
    df = spark.createDataFrame([("amoxicilin", "amoxicillin")], "a string, b string")
    assert df.select(fuzzy.similarity_score(df.a, df.b)).first()[0] == 90.91


def test_blocklist_collapse_fails(spark):
    with pytest.raises(Exception, match="single key"):
        fuzzy.blocklist_pairs(spark.createDataFrame([("Sulphate x", "sulfate X")], "name_a string, name_b string")).collect()


def test_suggest(spark):
    vocabulary, *_ = catalogue(spark)
    labels = suggest.suggestion_labels(vocabulary.surfaces(), vocabulary.combinations)
    asked = spark.createDataFrame([("10's",), ("predniso",), ("met",), ("o",), ("augm",)], "q string")
    rows = suggest.suggest(asked, labels, vocabulary.pairs).orderBy("q", "rank").collect()
    by = lambda q: [(r["label"], r["confusable_with"]) for r in rows if r["q"] == q]
    assert by("10's") == []
    assert by("predniso") == [("prednisone", "prednisolone"), ("prednisolone", "prednisone")]
    assert by("met")[0] == ("metformin", "")
    assert by("augm")[0][0] == "Augmentin" and len(by("o")) == 8


@pytest.fixture(scope="module")
def long_words():
    """Lengths on both sides of those up to which shortened texts are listed, with ends in common."""
    rng = random.Random(11)
    base = ["red" + "".join(rng.choice("abcé") for _ in range(n)) + " rod" for n in (1, 2, 12, 14, 16, 17, 18, 22, 24, 25, 26, 27, 28, 40) for _ in range(2)]
    return base, sorted({near(rng, w) for w in base * 3} | {"a", "ab", "é"})


@pytest.mark.parametrize("threshold", [65, 80, 88, 93])
def test_long_strings_equal_all_pairs(spark, long_words, threshold):
    forms, queries = long_words
    got = fuzzy.similar_strings(
        spark.createDataFrame([(w,) for w in queries], "q string"), spark.createDataFrame([(w,) for w in forms], "f string"), threshold
    ).collect()
    score = lambda q, f: round((1 - distance(q, f) / max(len(q), len(f))) * 100, 2)
    expected = {(q, f): score(q, f) for q in set(queries) for f in set(forms) if score(q, f) >= threshold}
    assert len(got) == len(expected) and {(r[0], r[1]): r[2] for r in got} == expected


@pytest.mark.parametrize("most", [1, 2, 3])
def test_scan_of_long_names_equals_all_pairs(spark, long_words, most):
    names = sorted(set(long_words[0]) | set(long_words[1]))
    got = fuzzy.confusable_scan(spark.createDataFrame([(w,) for w in names], "n string"), most).collect()
    expected = {(a, b): distance(a, b) for a in names for b in names if a < b and distance(a, b) <= most}
    assert len(got) == len(expected) and {(r[0], r[1]): r[2] for r in got} == expected


def test_keys_are_not_broadcast(spark, words):
    """The many keys of a string never pass through the driver, however small Spark takes their table to be."""
    names = spark.createDataFrame([(w,) for w in words[0]], "n string")
    for found in (fuzzy.confusable_scan(names), fuzzy.similar_strings(names, names)):
        assert found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_rule_one_alone_equals_the_guard(spark, words):
    """Rule 1 is answered over the blocklist, without the candidates that it does not drop."""
    rng = random.Random(3)
    forms, queries = (sorted(set(w)) for w in words)
    surfaces = [(f"M{i}", w, w, False) for i, w in enumerate(forms)] + [(f"M{i}", w, near(rng, w) or "a", True) for i, w in enumerate(forms)] + [("X1", forms[0], forms[0], False)]
    surfaces = spark.createDataFrame(surfaces, "molecule_id string, inn_name string, surface string, is_alias boolean")
    pairs = {tuple(sorted((q, f))) for q in queries for f in forms if q != f and distance(q, f) <= 4}
    pairs = spark.createDataFrame(sorted(pairs), "key_a string, key_b string")
    keys = spark.createDataFrame([(w,) for w in queries], "q string")
    alone = fuzzy.rule_one_candidates(keys, surfaces, pairs, 70)
    guarded = fuzzy.suppressed_candidates(fuzzy.guard_candidates(fuzzy.score_molecules(keys, surfaces, 70), pairs))
    expected = sorted(map(tuple, guarded.filter(guarded.reason == fuzzy.RULE_ONE).collect()))
    assert expected and sorted(map(tuple, alone.collect())) == expected
    assert "Generate" not in alone._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("threshold", [0, 45, 60, 70, 79.9])
def test_tiles_equal_all_pairs(spark, words, long_words, monkeypatch, threshold):
    """Several shards and blocks, queries and forms beyond a machine word, characters of one side only."""
    monkeypatch.setattr(fuzzy.tiles, "SHARD", 20)
    monkeypatch.setattr(fuzzy.tiles, "BLOCK", 30)
    rng = random.Random(2)
    huge = ["".join(rng.choice("ab💊") for _ in range(n)) for n in (60, 63, 64, 65, 66, 70, 90)]
    forms = words[0][:25] + long_words[0][:6] + huge + ["z", "\u0101b"]
    queries = words[1][:35] + long_words[1][:9] + [near(rng, w) for w in huge] + ["q", "\u0102b"]
    got = fuzzy.similar_strings(
        spark.createDataFrame([(w,) for w in queries], "q string"), spark.createDataFrame([(w,) for w in forms], "f string"), threshold
    ).collect()
    score = lambda q, f: round((1 - distance(q, f) / max(len(q), len(f))) * 100, 2)
    expected = {(q, f): score(q, f) for q in set(queries) - {""} for f in set(forms) if score(q, f) >= threshold}
    assert len(got) == len(expected) and {(r[0], r[1]): r[2] for r in got} == expected


def test_low_thresholds_have_no_segment_keys(spark, words):
    """Of 300 names that begin and end alike the keys would list nearly all pairs several times over."""
    names = spark.range(300).selectExpr("'red' || lpad(conv(id * 7919 % 65536, 10, 16), 4, 'g') || ' rod' AS n")
    found = fuzzy.similar_strings(names, names, 70)
    rows = found.collect()
    assert len({(r[0], r[1]) for r in rows}) == len(rows)
    tiled = found.filter("length(left_text) <= 64")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in tiled
