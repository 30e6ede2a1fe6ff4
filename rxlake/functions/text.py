"""Small text expressions shared by reports and loads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: what each ATC first level is called for a reader ---
ATC_LABELS = {
    "A": "stomach, gut and diabetes medicines",
    "B": "blood and blood-thinning medicines",
    "C": "heart and blood-pressure medicines",
    "D": "skin medicines",
    "G": "urinary and reproductive-health medicines",
    "H": "hormone medicines, including steroids and thyroid",
    "J": "antibiotics and other infection medicines",
    "L": "cancer and immune-system medicines",
    "M": "bone, joint and painkiller medicines",
    "N": "brain and nervous-system medicines, including painkillers and antidepressants",
    "P": "antiparasitic medicines",
    "R": "lung and breathing medicines, including allergy tablets",
    "S": "eye and ear medicines",
    "V": "various other medicines",
}

# --- Fixed values: provenance file pattern and sentences ---
PROVENANCE_FILE = r"ddinter_downloads_code_([A-Za-z])\.csv"
ONE_LIST = "From DDInter, an open drug-interaction database — its list of "
SEVERAL_LISTS = "From DDInter, an open drug-interaction database — its lists of "


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def quoted(text: Column) -> Column:
    """The text in quotes: single ones, or double when it holds single quotes and no double ones."""
    body = F.regexp_replace(text, r"\\", r"\\\\")
    body = F.replace(F.replace(F.replace(body, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("\\r"))
    has_single, has_double = F.contains(text, F.lit("'")), F.contains(text, F.lit('"'))
    single = F.concat(F.lit("'"), F.when(has_single, F.replace(body, F.lit("'"), F.lit("\\'"))).otherwise(body), F.lit("'"))
    return F.when(has_single & ~has_double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(single)


def severity_bucket(severity: Column) -> Column:
    value = F.lower(F.trim(F.coalesce(severity, F.lit(""))))
    return (
        F.when(value.contains("major") | value.contains("severe"), "major")
        .when(value.contains("moderate"), "moderate")
        .when(value.contains("minor"), "minor")
        .otherwise("unknown")
    )


def stated_severity(severity: Column) -> Column:
    """Lower-cased severity; ``unknown`` when none is given."""
    return F.lower(F.trim(F.coalesce(F.nullif(severity, F.lit("")), F.lit("unknown"))))


def atc_first_level(code: Column) -> Column:
    return F.upper(F.substr(F.trim(code), F.lit(1), F.lit(1)))


def atc_label(group: Column, unknown: str = "medicines in group ") -> Column:
    table = F.create_map(*[F.lit(x) for item in ATC_LABELS.items() for x in item])
    named = F.element_at(table, F.upper(group))
    return F.coalesce(named, F.concat(F.lit(unknown), F.upper(group)))


def group_phrase(group: Column) -> Column:
    return F.when(F.coalesce(group, F.lit("")) == "", "medicines of this kind").otherwise(atc_label(group))


def join_names(names: Column) -> Column:
    """``a``, ``a and b``, ``a, b and c``."""
    n = F.size(names)
    head = F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n > 1, F.concat(head, F.lit(" and "), F.element_at(names, -1))).otherwise(F.array_join(names, ""))


def readable_provenance(provenance: Column) -> Column:
    """File names turned into a sentence; other text passes through; empty stays null."""
    text = F.trim(provenance)
    letters = F.array_sort(
        F.array_distinct(F.transform(F.regexp_extract_all(provenance, F.lit(PROVENANCE_FILE), F.lit(1)), F.upper))
    )
    named = F.transform(letters, lambda g: atc_label(g, "group "))
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(None).cast("string"))
        .when(F.size(letters) == 0, F.concat(F.lit("Source: "), text))
        .when(F.size(letters) == 1, F.concat(F.lit(ONE_LIST), F.element_at(named, 1), F.lit(".")))
        .otherwise(F.concat(F.lit(SEVERAL_LISTS), join_names(named), F.lit(".")))
    )


def money(text: Column, style: str = "in") -> Column:
    """Price text as DECIMAL(12,2), null when it is not a number.

    ``in`` reads the comma as thousands separator (1,200.00); ``eu`` reads the dot as thousands
    separator and the comma as decimal mark (1.200,00).
    """
    raw = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "₹|Rs", ""))
    if style == "in":
        plain = F.trim(F.regexp_replace(raw, ",", ""))
    elif style == "eu":
        plain = F.regexp_replace(F.regexp_replace(raw, r"\.", ""), ",", ".")
    else:
        raise ValueError(f"unknown money style {style!r}")
    return plain.try_cast("decimal(12,2)")
