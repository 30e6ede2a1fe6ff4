"""Drug-name normaliser as column expressions.

Every step is a whole-string regular expression over space-separated words, so the chain stays in
generated code with no UDF and no per-word lambda. Names with non-ASCII characters are folded by the
ICU library that ships with Spark; the ASCII arm is a plain ``lower``.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxlake import vocab_constants as V

DIGIT = r"\p{Nd}"
NUMBER = rf"{DIGIT}+(?:\.{DIGIT}+)?"
WORD_START, WORD_END = "(?<![^ ])", "(?![^ ])"


def _alternatives(words) -> str:
    """Regex for a word list that branches on shared prefixes, longer spellings first."""
    heads: dict[str, list[str]] = {}
    for word in sorted(set(words)):
        heads.setdefault(word[:1], []).append(word[1:])
    branches = [
        head + (rest[0] if len(rest) == 1 else f"(?:{_alternatives(rest)})") for head, rest in heads.items() if head
    ]
    return "|".join(branches + ([""] if "" in heads else []))


def _whole_word(body: str) -> str:
    return f"{WORD_START}(?:{body}){WORD_END}"


_FORM_OF = {s: label for label, spellings in V.FORM_SPELLINGS.items() for s in spellings}
_UNIT_OF = {s: label for label, spellings in V.UNIT_SPELLINGS.items() for s in spellings}

STRENGTH = rf"({NUMBER})\s*({_alternatives(V.MEASURED_UNITS)})(?![a-z])"
FORM = _whole_word(_alternatives(_FORM_OF))
PACK_COUNT = rf"{DIGIT}+x{DIGIT}+|{DIGIT}+s|x{DIGIT}+"
DROPPED = _whole_word(
    "|".join([_alternatives(V.PACKAGING_WORDS), PACK_COUNT, NUMBER, _alternatives(_UNIT_OF), _alternatives(_FORM_OF)])
)
BARE_NUMBER = f"{WORD_START}({NUMBER}){WORD_END}"
SALT = _whole_word(_alternatives(V.SALTS))


@functools.cache
def _combining_class() -> str:
    """Regex class of every character with a non-zero combining class, built as ranges.

    The cheap test for "any mark" comes first, so other characters never walk through the ranges.
    """
    marks = [c for c in range(0x80, sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    ranges: list[list[int]] = []
    for code in marks:
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return r"[\p{M}&&[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges) + "]]"


@functools.cache
def _digit_fold() -> tuple[str, str]:
    """Decimal digits of other scripts and the ASCII digits they stand for."""
    pairs = [
        (chr(c), str(unicodedata.decimal(chr(c))))
        for c in range(0x80, 0x10000)
        if unicodedata.category(chr(c)) == "Nd"
    ]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _icu(cls: str, method: str, text: Column, flag: bool = True) -> Column:
    return F.reflect(F.lit(cls), F.lit(method), text, F.lit(flag))


def fold_text(text: Column) -> Column:
    """Accents stripped, compatibility characters folded, case folded."""
    decomposed = _icu("com.ibm.icu.text.Normalizer", "decompose", text)
    stripped = F.regexp_replace(decomposed, _combining_class(), "")
    composed = _icu("com.ibm.icu.text.Normalizer", "compose", stripped)
    folded = _icu("com.ibm.icu.lang.UCharacter", "foldCase", composed)
    return F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(F.lower(text))


def clean_text(text: Column) -> Column:
    """Folded text with every separator reduced to one space; decimal points survive."""
    out = fold_text(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, "['‘’]", "")
    out = F.regexp_replace(out, rf"(?<!{DIGIT})\.(?!{DIGIT})", " ")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}.%]+", " ")
    return F.trim(out)


def _squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, " +", " "))


def bare_words(clean: Column) -> Column:
    """Strengths, pack words, numbers, units and dosage forms removed."""
    return F.regexp_replace(F.regexp_replace(clean, STRENGTH, " "), DROPPED, "")


def spelling(words: Column) -> Column:
    """Spelling variants folded in every word; word variants run before and after the rules."""

    def variants(text: Column) -> Column:
        for word, target in V.WORD_VARIANTS.items():
            text = F.regexp_replace(text, _whole_word(word), target)
        return text

    out = variants(words)
    for where, old, new in V.SPELLING_RULES:
        out = F.regexp_replace(out, (WORD_START if where == "start" else "") + old, new)
    return variants(out)


_NEEDS_SPELLING = "|".join(
    [*V.WORD_VARIANTS, *[(WORD_START if where == "start" else "") + old for where, old, _ in V.SPELLING_RULES]]
)


def _spelled(words: Column) -> Column:
    """Same as :func:`spelling`, skipped for text that contains none of its patterns."""
    return F.when(words.rlike(_NEEDS_SPELLING), spelling(words)).otherwise(words)


def _key_of(spelled: Column) -> Column:
    base = _squeeze(F.regexp_replace(spelled, SALT, ""))
    return F.coalesce(F.nullif(base, F.lit("")), _squeeze(spelled), F.lit(""))


#: A lower-cased text that the steps before the salts leave as it is: words of ``a`` to ``z`` between single spaces, none of
#: them dropped or folded at its start. What they fold anywhere (``_FOLDED``) is looked for apart. One pass over the words
#: decides; looking for any change at every character costs twice as much.
_CHANGED_WORD = "|".join([
    _alternatives([*V.PACKAGING_WORDS, *_UNIT_OF, *_FORM_OF]).join(["(?:", ")(?![^ ])"]),
    *[re.escape(old) for where, old, _ in V.SPELLING_RULES if where == "start"],
])
_WORDS = r"^(?:(?!{})[a-z]++(?: (?! |\z)|\z))++\z"
PLAIN = _WORDS.format(_CHANGED_WORD)
#: Such a text without a salt is its own key.
PLAIN_KEY = _WORDS.format(f"{_CHANGED_WORD}|(?:{_alternatives(V.SALTS)})(?![^ ])")
_FOLDED = [*V.WORD_VARIANTS, *[old for where, old, _ in V.SPELLING_RULES if where != "start"]]


def normalized_key(text: Column) -> Column:
    """The comparison key alone, as one expression (for lambdas and single projections)."""
    return _key_of(spelling(bare_words(clean_text(text))))


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), key)


def strength_raw(clean: Column) -> Column:
    """All strengths as ``value+unit`` joined by ``/``, or null."""
    parts = F.arrays_zip(
        F.regexp_extract_all(clean, F.lit(STRENGTH), F.lit(1)).alias("v"),
        F.regexp_extract_all(clean, F.lit(STRENGTH), F.lit(2)).alias("u"),
    )
    joined = F.array_join(F.transform(parts, lambda p: F.concat(p["v"], _lookup(_UNIT_OF, p["u"]))), "/")
    return F.when(joined != "", joined)


def _number(text: Column) -> Column:
    foreign, ascii_digits = _digit_fold()
    folded = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, foreign, ascii_digits)).otherwise(text)
    return folded.try_cast("double")


ALL_FIELDS = (
    "normalized", "tokens", "salts", "form", "strength_value", "strength_unit", "strength_raw", "strength_hint",
)


def with_normalized(df: DataFrame, source: str, fields=("normalized",), prefix: str = "") -> DataFrame:
    """Add the chosen normaliser fields of column ``source`` as columns ``prefix + field``.

    The texts between the steps are separate projections: each is read several times, and a separate projection is
    computed once per row. Most names are plain words, which one test finds (``PLAIN_KEY``, with salts ``PLAIN``); they
    skip the steps before the salts, without salts all steps. The fields leave through a one-element ``inline``: filters and join conditions on them then stay above
    it, where the optimizer would otherwise copy the whole chain of expressions into every predicate.
    """
    keep = list(df.columns)
    lower, clean, bare, words, spelled = (F.col(f"__norm_{n}") for n in ("lower", "clean", "bare", "words", "spelled"))
    plain, measured = F.col("__norm_plain"), F.col("__norm_measured")
    step = lambda given, changed: F.when(plain, given).otherwise(changed)
    staged = df.withColumn("__norm_lower", F.lower(F.coalesce(F.col(source), F.lit(""))))
    folded = functools.reduce(lambda x, y: x | y, [F.contains(lower, F.lit(text)) for text in _FOLDED])
    staged = staged.withColumn("__norm_key", ~folded & lower.rlike(PLAIN_KEY))
    staged = staged.withColumn("__norm_plain", F.col("__norm_key") | (~folded & lower.rlike(PLAIN)))
    staged = staged.withColumn("__norm_clean", step(lower, clean_text(F.col(source))))
    staged = staged.withColumn("__norm_bare", step(clean, F.regexp_replace(clean, STRENGTH, " ")))
    texts = {}
    if {"normalized", "tokens", "salts"} & set(fields):
        staged = staged.withColumn("__norm_words", step(bare, F.regexp_replace(bare, DROPPED, "")))
        staged = staged.withColumn("__norm_spelled", step(words, _spelled(words)))
        texts["__norm_salty"] = ~F.col("__norm_key") & spelled.rlike(SALT)
    # A strength holds a digit, so taking one out always changes the text.
    staged = staged.withColumn("__norm_measured", bare != clean)
    if "form" in fields:
        texts["__norm_form"] = step(F.lit(""), F.regexp_extract(bare, f"({FORM})", 1))
    if "strength_value" in fields:
        texts["__norm_value"] = F.when(measured, F.regexp_extract(clean, STRENGTH, 1))
    if "strength_unit" in fields:
        texts["__norm_unit"] = F.when(measured, F.regexp_extract(clean, STRENGTH, 2))
    if "strength_hint" in fields:
        texts["__norm_hint"] = F.when(~measured & ~plain, F.regexp_extract(clean, BARE_NUMBER, 1))
    staged = staged.withColumns(texts) if texts else staged
    salty = F.col("__norm_salty")
    if "__norm_salty" in texts:
        staged = staged.withColumn("__norm_base", F.when(salty, _squeeze(F.regexp_replace(spelled, SALT, ""))).otherwise(step(spelled, _squeeze(spelled))))
    base = F.col("__norm_base")
    key = F.when(salty & (base == ""), _squeeze(spelled)).otherwise(base)
    none = F.array().cast("array<string>")
    build = {
        "normalized": lambda: key,
        "tokens": lambda: F.when(key == "", none).otherwise(F.split(key, " ")),
        "salts": lambda: F.when(salty & (base != ""), F.regexp_extract_all(spelled, F.lit(f"({SALT})"), F.lit(1))).otherwise(none),
        "form": lambda: F.when(F.col("__norm_form") != "", _lookup(_FORM_OF, F.col("__norm_form"))),
        "strength_value": lambda: _number(F.col("__norm_value")),
        "strength_unit": lambda: F.when(F.col("__norm_unit") != "", _lookup(_UNIT_OF, F.col("__norm_unit"))),
        "strength_raw": lambda: F.when(measured, strength_raw(clean)),
        "strength_hint": lambda: _number(F.col("__norm_hint")),
    }
    fields_of_row = F.struct(*[build[f]().alias(prefix + f) for f in fields])
    replaced = {prefix + f for f in fields}
    return staged.select(*[F.col(k) for k in keep if k not in replaced], F.inline(F.array(fields_of_row)))


def normalize_names(df: DataFrame, source: str) -> DataFrame:
    """All normaliser fields of ``source`` next to the input columns."""
    return with_normalized(df, source, ALL_FIELDS)


def unit_label(unit: Column) -> Column:
    return _lookup(_UNIT_OF, F.lower(unit))


def canonical_strength(value: Column, unit: Column) -> Column:
    """``struct(value, unit)`` in the base unit, or null when the strength cannot be compared."""
    label = unit_label(unit)
    factors = F.create_map(*[F.lit(x) for u, (_, f) in V.BASE_UNITS.items() for x in (u, f)])
    bases = F.create_map(*[F.lit(x) for u, (b, _) in V.BASE_UNITS.items() for x in (u, b)])
    factor = F.element_at(factors, label)
    return F.when(
        value.isNotNull() & factor.isNotNull(),
        F.struct(
            F.bround(value * factor, 6).alias("value"),
            F.element_at(bases, label).alias("unit"),
        ),
    )


def lenient_double(text: Column) -> Column:
    """Blank and non-numeric text become null instead of failing."""
    return F.trim(text.cast("string")).try_cast("double")
