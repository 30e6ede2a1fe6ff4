import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from rxlake.functions import normalize as N

CASES = [
    # raw, key, form, strength_raw, value, unit, hint, salts
    ("Paracetamol", "paracetamol", None, None, None, None, None, ""),
    ("  PARACETAMOL   500 MG Tab ", "paracetamol", "tablet", "500mg", 500.0, "mg", None, ""),
    ("Co-Trimoxazole", "co trimoxazole", None, None, None, None, None, ""),
    ("Cefalexín", "cefalexin", None, None, None, None, None, ""),
    ("Paracetamol (500mg)", "paracetamol", None, "500mg", 500.0, "mg", None, ""),
    ("Salbutamol 100µg", "salbutamol", None, "100mcg", 100.0, "mcg", None, ""),
    ("Salbutamol 100 ug", "salbutamol", None, "100mcg", 100.0, "mcg", None, ""),
    ("Insulin 40IU", "insulin", None, "40iu", 40.0, "iu", None, ""),
    ("Lignocaine 2%", "lignocaine", None, "2%", 2.0, "%", None, ""),
    ("Atorvastatin 10mg 10's", "atorvastatin", None, "10mg", 10.0, "mg", None, ""),
    ("Amlodipine 5mg 1x10", "amlodipine", None, "5mg", 5.0, "mg", None, ""),
    ("Sodium Chloride 0.9% Injection", "sodium chloride", "injection", "0.9%", 0.9, "%", None, ""),
    (
        "Amoxicillin and Clavulanic Acid 500mg/125mg Tablet",
        "amoxicillin clavulanic acid", "tablet", "500mg/125mg", 500.0, "mg", None, "",
    ),
    ("Metformin Hydrochloride 0.5g Tab", "metformin", "tablet", "0.5g", 0.5, "g", None, "hydrochloride"),
    ("AMOXYCILLIN 500MG CAP", "amoxicillin", "capsule", "500mg", 500.0, "mg", None, ""),
    ("Magnesium Sulphate", "magnesium sulfate", None, None, None, None, None, ""),
    ("Ferrous Sulphate", "ferrous", None, None, None, None, None, "sulfate"),
    ("Cephalexin caps", "cefalexin", "capsule", None, None, None, None, ""),
    ("Oestradiol Valerate", "estradiol", None, None, None, None, None, "valerate"),
    ("Haemoglobin", "hemoglobin", None, None, None, None, None, ""),
    ("Thyroxine", "levothyroxine", None, None, None, None, None, ""),
    ("Glycomet 500", "glycomet", None, None, None, None, 500.0, ""),
    ("Ecosprin 75 10", "ecosprin", None, None, None, None, 75.0, ""),
    ("Clobetasol 0.05% w/w Cream", "clobetasol w w", "cream", "0.05%", 0.05, "%", None, ""),
    ("Paracetamol 1,000 mg", "paracetamol", None, "000mg", 0.0, "mg", None, ""),
    ("500mg tablet", "", "tablet", "500mg", 500.0, "mg", None, ""),
    ("", "", None, None, None, None, None, ""),
    (None, "", None, None, None, None, None, ""),
    ("Straße ﬁn Ａlpha_beta", "strasse fin alpha beta", None, None, None, None, None, ""),
    ("Cream Tab Ointment x", "x", "cream", None, None, None, None, ""),
    ("500gx drug 5 milligrams", "500gx drug", None, "5mg", 5.0, "mg", None, ""),
    ("drug 5mg10mg", "drug", None, "5mg/10mg", 5.0, "mg", None, ""),
    ("B.12 v1.5 a.5", "b.12 v1.5 a.5", None, None, None, None, None, ""),
    ("दवा ५०० mg", None, None, "५००mg", 500.0, "mg", None, ""),
]


def test_normaliser_rows(spark):
    rows = [(i, c[0]) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, raw string")
    got = {r["i"]: r for r in N.normalize_names(df, "raw").withColumn("k", N.normalized_key(F.col("raw"))).collect()}
    for i, (raw, key, form, s_raw, value, unit, hint, salts) in enumerate(CASES):
        r = got[i]
        if key is not None:
            assert r["normalized"] == key, raw
        assert r["k"] == r["normalized"], raw
        assert (r["form"], r["strength_raw"], r["strength_value"], r["strength_unit"], r["strength_hint"]) == (
            form, s_raw, value, unit, hint,
        ), raw
        assert " ".join(r["salts"]) == salts, raw
        assert " ".join(r["tokens"]) == r["normalized"], raw


def test_idempotent_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    once = N.with_normalized(df, "text")
    twice = N.with_normalized(once, "normalized", prefix="again_")
    # Removing a strength can bring two words together that read as a strength again; the documents
    # hold no such pair.
    assert twice.filter("normalized <> again_normalized").count() == 0


def test_fold_equals_python(spark):
    texts = ["Élan Ñandú ß µg ﬁ Ⅷ ½ ｆｕｌｌ", "İstanbul ǅ ŉ", "क़लम कि ् x", "ﷺ", "áͅb", "Ångstrom ΣΑΣ", "é̖z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[1] for r in df.select("t", N.fold_text(F.col("t"))).collect()]

    def expected(t):
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        return unicodedata.normalize("NFKC", t).casefold()

    assert got == [expected(t) for t in texts]


@pytest.mark.parametrize(
    "value,unit,expected",
    [(0.5, "g", (500.0, "mg")), (100.0, "mcg", (0.1, "mg")), (1.0, "l", (1000.0, "ml")), (1.0, "sachets", None),
     (2.0, "%", (2.0, "%")), (40.0, "Units", (40.0, "iu")), (None, "mg", None), (1.0, None, None)],
)
def test_canonical_strength(spark, value, unit, expected):
    row = spark.createDataFrame([(value, unit)], "v double, u string").select(
        N.canonical_strength(F.col("v"), F.col("u")).alias("c")
    ).first()["c"]
    assert (None if row is None else tuple(row)) == expected


def test_plain_names_skip_no_step(spark):
    """Names that the short path takes, and others a character or a word away from it, give the fields of the whole chain."""
    words = ["red", "rod", "sodium", "hydrochloride", "tab", "g", "u", "and", "sulphate", "cephalo", "xceph", "oestr", "aero", "haemo", "thyroxine", "tabs5"]
    marks = ["", " ", "  ", "-", ".", "'", "\u212a", "\u0130", "\u017f", "\u00e9", "5", "5mg", "%", "\n", "\t", "10's"]
    texts = [a + m + b for a in ["", *words] for m in marks for b in ["", *words]] + [f" {w}" for w in words] + [f"{w} {w.upper()} x" for w in words]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "i int, raw string")
    whole = N.clean_text(F.col("raw"))
    words_left = N.bare_words(whole)
    chain = df.select("i", N.normalized_key(F.col("raw")).alias("k"), N._squeeze(N.spelling(words_left)).alias("s"), whole.alias("c"))
    marked = chain.select(
        "*", F.regexp_extract("c", N.STRENGTH, 1).alias("v"), F.regexp_extract("c", N.BARE_NUMBER, 1).alias("h"), F.regexp_extract_all("s", F.lit(f"({N.SALT})"), F.lit(1)).alias("t"),
        F.regexp_extract(F.regexp_replace("c", N.STRENGTH, " "), f"({N.FORM})", 1).alias("f"),
    )
    want = {r["i"]: r for r in marked.collect()}
    got = {r["i"]: r for r in N.normalize_names(df, "raw").collect()}
    assert len(got) == len(want) == len(texts) + 1
    for i, w in want.items():
        g = got[i]
        assert g["normalized"] == w["k"], (g, w)
        assert g["salts"] == (w["t"] if w["k"] != w["s"] else []), (g, w)
        assert (g["form"] or "") == (N._FORM_OF[w["f"]] if w["f"] else ""), (g, w)
        assert (g["strength_value"] is None) == (w["v"] == ""), (g, w)
        assert (g["strength_hint"] is None) == (w["v"] != "" or w["h"] == ""), (g, w)


def test_plain_names_are_tested_once(spark):
    """Plain names pass one test before the salts: the steps between stand under its condition."""
    df = N.with_normalized(spark.createDataFrame([("red rod",)], "raw string"), "raw")
    plan = df._jdf.queryExecution().analyzed().toString()
    steps = [line for line in plan.splitlines() if "regexp_replace" in line]
    assert steps and all("CASE WHEN" in line for line in steps)


def test_plain_names_meet_patterns_from_their_start_alone(spark):
    """The tests of plain names are anchored, give every word once, and take texts of any length; both profiles agree."""
    assert all(p.startswith("^") and p.endswith(r"++\z") for p in (N.PLAIN, N.PLAIN_KEY))
    texts = ["red " * 100_000 + "rod", "red rod\n", "red rod sodium", "red tab rod", "red tabrod", "", " red", "red ", "red  rod", "Red ROD", "sodium", "haemred", "redhaem", "oered", "redoe", "g"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    rows = df.select("raw", F.lower("raw").rlike(N.PLAIN).alias("p"), F.lower("raw").rlike(N.PLAIN_KEY).alias("k")).collect()
    assert [(r["p"], r["k"]) for r in rows][:8] == [(True, True), (False, False), (True, False), (False, False), (True, True), (False, False), (False, False), (False, False)]
    want = {r["i"]: r["k"] for r in df.select("i", N.normalized_key(F.col("raw")).alias("k")).collect()}
    assert {r["i"]: r["normalized"] for r in N.with_normalized(df, "raw").collect()} == want
