"""DuckDB SQL that computes the same results as the operators, from the same domain statements.

Fragments are named common table expressions; ``compose`` puts the needed ones in front of a query.
"""

from __future__ import annotations

from rxlake import vocab_constants as V
from testbed.domain import BASE, TABLES, dependencies

FRAGMENTS: dict[str, str] = {}
NEEDS: dict[str, list[str]] = {}


def fragment(name: str, sql: str, needs: list[str] = ()) -> str:
    FRAGMENTS[name], NEEDS[name] = sql, list(needs)
    return name


for _name in TABLES:
    _deps = dependencies(_name)
    fragment(
        f"d_{_name}",
        TABLES[_name].format(**{d: d if d in BASE else f"d_{d}" for d in _deps}),
        [f"d_{d}" for d in _deps if d not in BASE],
    )


def compose(query: str, needs: list[str]) -> str:
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for dep in NEEDS[name]:
            visit(dep)
        done.append(name)

    for name in needs:
        visit(name)
    if not done:
        return query
    return "WITH " + ",\n".join(f"{n} AS ({FRAGMENTS[n]})" for n in done) + "\n" + query


# --- name normaliser in list form (this engine's regular expressions have no look-around) --------


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _case(value: str, table: dict[str, list[str]], otherwise: str) -> str:
    arms = " ".join(f"WHEN {value} IN {_in(spellings)} THEN '{label}'" for label, spellings in table.items())
    return f"CASE {arms} ELSE {otherwise} END"


def _units_regex() -> str:
    return "|".join(sorted((u for u in V.MEASURED_UNITS), key=lambda u: (-len(u), u)))


NUM = r"\p{Nd}+(?:\.\p{Nd}+)?"
KEEP = "chr(1)"


def norm(source: str) -> str:
    """SELECT with one row per distinct string ``s`` of ``source`` and every field of the normaliser."""
    units = _units_regex()
    strength = rf"({NUM})\s*({units})([^a-z]|$)"
    all_units = [s for spellings in V.UNIT_SPELLINGS.values() for s in spellings]
    all_forms = [s for spellings in V.FORM_SPELLINGS.values() for s in spellings]
    spell = "t"
    variants = lambda t: "CASE " + " ".join(f"WHEN {t} = '{a}' THEN '{b}'" for a, b in V.WORD_VARIANTS.items()) + f" ELSE {t} END"
    spell = variants("t")
    for where, old, new in V.SPELLING_RULES:
        spell = f"regexp_replace({spell}, '{'^' if where == 'start' else ''}{old}', '{new}', 'g')"
    unit = lambda u: _case(u, V.UNIT_SPELLINGS, u)
    return rf"""
      SELECT s, clean, base_key AS normalized, array_to_string(salt_list, ' ') AS salts, form,
             TRY_CAST(vals[1] AS DOUBLE) AS sval, {unit("units[1]")} AS sunit,
             nullif(array_to_string(list_transform(generate_series(1, len(vals)), lambda i: vals[i] || {unit("units[i]")}), '/'), '') AS sraw,
             CASE WHEN len(vals) = 0 THEN TRY_CAST(nums[1] AS DOUBLE) END AS hint, kept_text, spelled_text
      FROM (
        SELECT *, CASE WHEN len(base) = 0 THEN array_to_string(sp, ' ') ELSE array_to_string(base, ' ') END AS base_key,
               CASE WHEN len(base) = 0 THEN [] ELSE list_filter(sp, lambda t: t IN {_in(V.SALTS)}) END AS salt_list,
               array_to_string(kept, ' ') AS kept_text, array_to_string(sp, ' ') AS spelled_text
        FROM (
          SELECT *, list_filter(sp, lambda t: NOT (t IN {_in(V.SALTS)})) AS base
          FROM (
            SELECT *, list_transform(kept, lambda x: (list_transform([x], lambda t: {variants("(" + spell + ")")}))[1]) AS sp,
                   {_case("formtok", V.FORM_SPELLINGS, "NULL")} AS form
            FROM (
              SELECT *, list_filter(toks, lambda t: NOT (t IN {_in(V.PACKAGING_WORDS + all_units + all_forms)})
                         AND NOT regexp_full_match(t, '\p{{Nd}}+x\p{{Nd}}+|\p{{Nd}}+s|x\p{{Nd}}+|{NUM}')) AS kept,
                     (list_filter(toks, lambda t: t IN {_in(all_forms)}))[1] AS formtok,
                     list_filter(toks, lambda t: regexp_full_match(t, '{NUM}')) AS nums
              FROM (
                SELECT *, list_filter(string_split(regexp_replace(pre, '{strength}', ' \3', 'g'), ' '), lambda t: t <> '') AS toks,
                       regexp_extract_all(pre, '{strength}', 1) AS vals, regexp_extract_all(pre, '{strength}', 2) AS units
                FROM (
                  SELECT s, clean, regexp_replace(regexp_replace(clean, '(\p{{Nd}}(?:{units}))(\p{{Nd}})', '\1 \2', 'g'),
                                                  '(\p{{Nd}}(?:{units}))(\p{{Nd}})', '\1 \2', 'g') AS pre
                  FROM (
                    SELECT s, trim(regexp_replace(replace(replace(
                             regexp_replace(regexp_replace(
                               regexp_replace(replace(replace(lower(strip_accents(coalesce(s, ''))), 'ß', 'ss'), 'µ', 'μ'), '[''‘’]', '', 'g'),
                               '(\p{{Nd}})\.', '\1' || {KEEP}, 'g'), '\.(\p{{Nd}})', {KEEP} || '\1', 'g'),
                             '.', ' '), {KEEP}, '.'), '[^\p{{L}}\p{{N}}.%]+', ' ', 'g')) AS clean
                    FROM (SELECT DISTINCT s FROM ({source})))))))))
    """


def norm_fragment(name: str, source: str, needs: list[str]) -> str:
    return fragment(name, norm(source), needs)
