"""Product-name preparation: combination products split into components, look-alike pairs classified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxlake.functions.normalize import with_normalized

# --- Fixed values: what counts as a dose, a separator and a pack size in a product name ---
DOSE = (
    r"(?:[0-9]+(?:\.[0-9]+)?\s*(?:mg|mcg|g|ml|iu|units)\b"
    r"|[0-9]+(?:\.[0-9]+)?\s*%(?:\s*(?:w/w|w/v|v/v)\b)?)"
)
SEPARATOR = r"(?:\s*,\s*and\s+|\s*,\s*|\s+and\s+)"
PACK_SIZE = r"\s+[0-9]+\s*(?:'s|tablets|capsules|vials?|sachets?|strips?|bottles?)\b.*$"

# --- Fixed values: residue reasons ---
INSULIN = "insulin preparation - strength and mix ratio not decomposable by name"
FUSION = "suspected component fusion (1 molecule but >=2 dose tokens)"
NOTHING = "no component normalized to a molecule"
TOO_SHORT = "component too short to be a molecule"
TOO_LONG = "component did not reduce to a molecule-length string"
OPAQUE = "opaque blend / trivial name carries no component molecule names"

MARK, HIDDEN = "\u0001", "\u0002"


def split_components(name: Column) -> Column:
    """Component texts of a product name.

    Commas in parentheses are hidden first. A comma or "and" separates only where a dose or a
    percentage stands directly before it, so names that merely contain "and" stay whole.
    """
    masked = F.regexp_replace(name, r",(?=[^()]*\))", HIDDEN)
    marked = F.regexp_replace(masked, rf"(?i)({DOSE}){SEPARATOR}", f"$1{MARK}")
    return F.transform(F.split(marked, MARK), lambda p: F.trim(F.replace(p, F.lit(HIDDEN), F.lit(","))))


def pack_guard(name: Column) -> tuple[Column, Column]:
    """``(name without its pack size, guard fired)``.

    A removal that would take a separator or a dose with it is refused and the name kept whole.
    """
    lost = F.regexp_extract(name, f"(?i){PACK_SIZE}", 0)
    fired = (lost != "") & lost.rlike(rf"(?i){DOSE}|,|\band\b")
    kept = F.when(fired, name).otherwise(F.regexp_replace(name, f"(?i){PACK_SIZE}", ""))
    return kept, fired


def fdc_pack_guard(products: DataFrame) -> DataFrame:
    kept, fired = pack_guard(F.col("generic_name_raw"))
    return products.select("product_id", "generic_name_raw", kept.alias("trimmed_name"), fired.alias("guard_fired"))


def fdc_decompose(products: DataFrame) -> DataFrame:
    """One row per component of every product name: ``product_id, position, component, normalized, ...``."""
    kept, _ = pack_guard(F.col("generic_name_raw"))
    parts = products.select("product_id", F.posexplode(split_components(kept)).alias("at", "component"))
    return with_normalized(parts, "component", ("normalized", "strength_raw")).select(
        "product_id", (F.col("at") + 1).alias("position"), "component", "normalized", "strength_raw"
    )


def fdc_residue(products: DataFrame, components: DataFrame, min_chars: int = 4, max_chars: int = 60) -> DataFrame:
    """Combination products that did not decompose, by reason.

    A product is a suspect when its name carries a separator word or two doses.
    """
    counted = components.groupBy("product_id").agg(
        F.count(F.when(F.col("normalized") != "", 1)).alias("n_components"),
        F.min(F.when(F.col("normalized") != "", F.char_length("normalized"))).alias("shortest"),
        F.max(F.char_length("normalized")).alias("longest"),
    )
    name = F.lower("generic_name_raw")
    doses = F.regexp_count(name, F.lit(DOSE))
    looks_combined = (doses >= 2) | name.rlike(r"\band\b|,|\+")
    reason = (
        F.when(name.contains("insulin"), INSULIN)
        .when(F.col("n_components") == 0, NOTHING)
        .when(F.col("shortest") < min_chars, TOO_SHORT)
        .when(F.col("longest") > max_chars, TOO_LONG)
        .when((F.col("n_components") == 1) & (doses >= 2), FUSION)
        .when(F.col("n_components") == 1, OPAQUE)
    )
    return (
        products.filter(looks_combined).join(counted, "product_id")
        .select("product_id", "generic_name_raw", "n_components", doses.alias("n_dose_tokens"), reason.alias("residue_reason"))
        .filter("residue_reason IS NOT NULL")
    )


# --- look-alike pairs ----------------------------------------------------------------------------

# --- Fixed values: class suffixes, enantiomer prefixes, spelling reductions, short-name bound ---
CLASS_SUFFIXES = [
    "floxacin", "gliflozin", "gliptin", "oxetine", "prazole", "cillin", "dipine", "semide", "azepam", "tinib",
    "mycin", "sone",
]
ISOMER_PREFIXES = ["es", "lev", "levo", "dex", "dextro", "s", "r", "l", "d"]
SHORT_NAME = 10
DESIGNATOR_REASON = "same stem but different single-letter designator ({a} vs {b}) - different substances"
ISOMER_REASON = "enantiomer/isomer prefix - different strength, not interchangeable"
CLASS_REASON = "shared class suffix -{s} but different stem - different molecules in the same class"
SHORT_REASON = "short name - a 1-2 character edit changes molecular identity"
OTHER_REASON = "no orthographic rule explains the difference - treat as different molecules pending human review"
BENIGN_REASON = "spelling variant of one name"


def reduced_spelling(name: Column, doubled: str | None = None) -> Column:
    """Spelling-system differences removed: ph/f, oe/ae/e, y/i, k/c, doubled letters, hyphen and space.

    ``doubled`` lists the letters that count the same single and doubled; all do where it is not given.
    """
    out = F.lower(name)
    letter = "(.)" if doubled is None else f"([{doubled}])"
    for old, new in (("ph", "f"), ("oe", "e"), ("ae", "e"), ("y", "i"), ("k", "c"), (r"[\s-]+", ""), (letter + r"\1", "$1")):
        out = F.regexp_replace(out, old, new)
    return out


def _designator(name: Column) -> Column:
    return F.regexp_extract(name, r"^.*[\s-]([a-z])$", 1)


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"[\s-][a-z]$", "")


def _isomer(longer: Column, shorter: Column) -> Column:
    options = [longer == F.concat(F.lit(p), sep, shorter) for p in ISOMER_PREFIXES for sep in (F.lit(""), F.lit(" "), F.lit("-"))]
    out = options[0]
    for o in options[1:]:
        out = out | o
    return out


def designator_conflict(a: Column, b: Column, doubled: str | None = None) -> Column:
    """Same stem, different single-letter designators; one side may have lost its designator."""
    return (_designator(a) != "") & (_designator(b) != "") & (_designator(a) != _designator(b)) & (
        reduced_spelling(_stem(a), doubled) == reduced_spelling(_stem(b), doubled)
    )


def confusable_classify(pairs: DataFrame, doubled: str | None = None) -> DataFrame:
    """Verdict and reason of look-alike pairs. Designators outrank spelling; no rule means dangerous."""
    a, b = F.lower("name_a"), F.lower("name_b")
    suffix = F.coalesce(*[F.when(a.endswith(s) & b.endswith(s), F.lit(s)) for s in CLASS_SUFFIXES])
    isomer = _isomer(a, b) | _isomer(b, a)
    same = reduced_spelling(a, doubled) == reduced_spelling(b, doubled)
    head, middle, tail = DESIGNATOR_REASON.replace("{b}", "{a}").split("{a}")
    c_head, c_tail = CLASS_REASON.split("{s}")
    conflict = designator_conflict(a, b, doubled)
    reason = (
        F.when(conflict, F.concat(F.lit(head), _designator(a), F.lit(middle), _designator(b), F.lit(tail)))
        .when(isomer, ISOMER_REASON)
        .when(same, BENIGN_REASON)
        .when(suffix.isNotNull(), F.concat(F.lit(c_head), suffix, F.lit(c_tail)))
        .when(F.least(F.char_length(a), F.char_length(b)) <= SHORT_NAME, SHORT_REASON)
        .otherwise(OTHER_REASON)
    )
    verdict = F.when(~conflict & ~isomer & same, "benign").otherwise("dangerous")
    return pairs.select("name_a", "name_b", "edit_distance", verdict.alias("verdict"), reason.alias("reason"))


def orthographic_bridge(names: DataFrame, vocabulary: DataFrame, pairs: DataFrame, doubled: str | None = None) -> DataFrame:
    """Names that reach exactly one vocabulary key through the spelling reduction.

    Names already in the vocabulary are left out, as are blocklisted pairs and pairs that cross a
    designator or an isomer prefix. ``pairs`` has ``key_a, key_b``.
    """
    left = names.select(F.col(names.columns[0]).alias("name")).filter("name <> ''").distinct()
    right = vocabulary.select(F.col(vocabulary.columns[0]).alias("target")).filter("target <> ''").distinct()
    unjoined = left.join(right.withColumnRenamed("target", "name"), "name", "left_anti")
    # Only keys with one target are kept, so the join adds at most one row per name.
    single = (
        right.groupBy(reduced_spelling(F.col("target"), doubled).alias("reduced"))
        .agg(F.count("*").alias("n"), F.min("target").alias("target"))
        .filter("n = 1").select("reduced", "target")
    )
    joined = unjoined.withColumn("reduced", reduced_spelling(F.col("name"), doubled)).join(single, "reduced")
    name, target = F.col("name"), F.col("target")
    safe = joined.filter(~designator_conflict(name, target, doubled) & ~_isomer(name, target) & ~_isomer(target, name))
    blocked = pairs.select(F.col("key_a").alias("name"), F.col("key_b").alias("target")).unionByName(
        pairs.select(F.col("key_b").alias("name"), F.col("key_a").alias("target"))
    )
    return safe.join(blocked, ["name", "target"], "left_anti").select("name", "target")


# --- Fixed values: category rules ---
VACCINE_WORDS = r"\b(vaccine|vaccines|toxoid|bcg)\b"


def classify_category(molecules: DataFrame, herbal: DataFrame) -> DataFrame:
    """``molecule_id, inn_name, category``: biologic, vaccine, herbal by a curated list, else small molecule."""
    listed = herbal.select(F.col(herbal.columns[0]).alias("inn_name")).distinct().withColumn("h", F.lit(True))
    name = F.lower("inn_name")
    category = (
        F.when(name.rlike(VACCINE_WORDS), "vaccine")
        .when(name.rlike(r"mab$") | name.rlike(r"\binsulin\b"), "biologic")
        .when(F.col("h"), "herbal")
        .otherwise("small_molecule")
    )
    return molecules.select("molecule_id", "inn_name").join(listed, "inn_name", "left").select(
        "molecule_id", "inn_name", category.alias("category")
    )


def category_counts(categories: DataFrame, subset: DataFrame) -> DataFrame:
    """Molecules per category: all of them, and those in the subset (``molecule_id``)."""
    flag = subset.select("molecule_id").distinct().withColumn("s", F.lit(1))
    return categories.join(flag, "molecule_id", "left").groupBy("category").agg(
        F.count("*").alias("n_all"), F.count("s").alias("n_subset")
    )
