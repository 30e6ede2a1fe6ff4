"""Similarity joins: candidates for human review, look-alike scans, and the confusable-pair guard.

At high thresholds the join never compares everything with everything. Two strings within ``d`` edits have a text in common that
each becomes when at most ``d`` of its characters are dropped; the hash of that text is an equi-join key, which
only near strings share, however many strings begin or end alike. Where a string is too long, or too many edits
are allowed, to list all those texts, it is cut in ``d + 1`` segments instead, of which any partner must contain
one unchanged and shifted by at most ``d`` (the Pass-Join filter, Li et al., VLDB 2011). The edit distance is
checked inside the join condition, and only verified pairs leave it. At low thresholds neither kind of key tells strings
apart; there all pairs are compared, in tiles of bounded size (``tiles``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rxlake import vocab_constants as V
from rxlake.functions.normalize import with_normalized
from rxlake.operators import tiles

RULE_ONE = "blocklisted confusable of the query string"
RULE_TWO = "blocklisted confusable pair both present in candidate set"


def similarity_score(left: Column, right: Column) -> Column:
    """Levenshtein similarity in [0, 100], two decimals, half-even."""
    longest = F.greatest(F.char_length(left), F.char_length(right))
    share = F.lit(1.0) - F.levenshtein(left, right) / longest
    return F.when(longest == 0, F.lit(100.0)).otherwise(F.bround(share * 100, 2))


def _allowed(longest: Column, threshold: float) -> Column:
    """Most edits a pair may have when its longer string has ``longest`` characters."""
    return F.floor(longest * F.lit((100.0 - threshold + 0.005) / 100.0)).cast("int")


def _segments(text: Column, length: Column, parts: Column) -> Column:
    """``array(struct(no, at, text))``: ``parts`` segments whose lengths differ by at most one."""
    base, extra = F.floor(length / parts).cast("int"), (length % parts).cast("int")

    def segment(i):
        at = i * base + F.greatest(i - (parts - extra), F.lit(0))
        size = base + F.when(i >= parts - extra, 1).otherwise(0)
        return F.struct(i.alias("no"), at.alias("at"), F.substr(text, at + 1, size).alias("text"))

    return F.transform(F.sequence(F.lit(0), parts - 1), segment)


def _probe(text: Column, length: Column, other: Column, parts: Column, shift: Column) -> Column:
    """Substrings of ``text`` that could be a segment of a partner of length ``other``.

    The shift of a segment is bounded from both ends: by what may happen before it and by what may
    happen after it.
    """
    base, extra = F.floor(other / parts).cast("int"), (other % parts).cast("int")

    def one(i):
        at = i * base + F.greatest(i - (parts - extra), F.lit(0))
        size = base + F.when(i >= parts - extra, 1).otherwise(0)
        low = F.greatest(F.lit(0), at - shift)
        high = F.least(length - size, at + shift)
        starts = F.when(high >= low, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda p: F.struct(i.alias("no"), F.substr(text, p + 1, size).alias("text")))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), parts - 1), one)))


# For so many edits, the longest string whose shortened texts are listed (a few hundred of them at most).
LISTED_LENGTH = {0: 256, 1: 256, 2: 32}
# Fixed value: below it the segments of a string have fewer than five characters.
TILED_BELOW = 80.0


def _shortened(text: Column, drops: Column, most: int) -> Column:
    """Hashes of every text left when up to ``drops`` (at most ``most``) characters of ``text`` are dropped.

    Characters are dropped from left to right, so no choice of positions comes twice.
    """
    none = F.array().cast("array<struct<text:string,at:int>>")

    def less(s):
        positions = F.when(s["at"] <= F.char_length(s["text"]), F.sequence(s["at"], F.greatest(s["at"], F.char_length(s["text"]))))
        dropped = lambda i: F.struct(
            F.concat(F.substr(s["text"], F.lit(1), i - 1), F.substr(s["text"], i + 1)).alias("text"), i.alias("at")
        )
        return F.transform(F.coalesce(positions, F.array().cast("array<int>")), dropped)

    levels = [F.array(F.struct(text.alias("text"), F.lit(1).alias("at")))]
    for _ in range(most):
        levels.append(F.flatten(F.transform(levels[-1], less)))
    kept = [F.when(drops >= i, level).otherwise(none) for i, level in enumerate(levels)]
    return F.array_distinct(F.transform(F.concat(*kept), lambda s: F.xxhash64(s["text"])))


def _join_on_shortened(left: DataFrame, right: DataFrame, most: int, drops_of, verify: Column) -> DataFrame:
    """Verified pairs of the tables ``left_text`` and ``right_text``; ``drops_of(length)`` bounds the edits of a string."""

    def keyed(df: DataFrame, name: str) -> DataFrame:
        hashes = _shortened(F.col(name), drops_of(F.char_length(name)), most)
        return df.select(name, F.explode_outer(hashes).alias("key"))

    return _merged(keyed(left, "left_text").alias("l"), keyed(right, "right_text").alias("r"), (F.col("l.key") == F.col("r.key")) & verify)


def _join_on_segments(forms: DataFrame, probes: DataFrame, verify: Column) -> DataFrame:
    on = (
        (F.col("l.form_length") == F.col("r.form_length"))
        & (F.col("l.no") == F.col("r.no"))
        & (F.col("l.text") == F.col("r.text"))
        & verify
    )
    return _merged(probes.alias("l"), forms.alias("r"), on)


def _merged(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Both sides list many keys per string, which Spark's sizes leave out (a generator counts as its input), so it would
    broadcast either side through the driver, whatever its length; hence the sort-merge join."""
    return left.join(right.hint("merge"), on).select("left_text", "right_text")


def similar_strings(queries: DataFrame, forms: DataFrame, threshold: float = V.FUZZY_THRESHOLD) -> DataFrame:
    """Pairs ``(left_text, right_text, score)`` of the two one-column tables with score >= threshold.

    Both inputs are reduced to distinct values first. Below ``TILED_BELOW`` pieces of a string are too short to be keys and
    strings are compared in tiles (:mod:`rxlake.operators.tiles`), except the longest.
    """
    left = queries.select(F.col(queries.columns[0]).alias("left_text")).filter("left_text <> ''").distinct()
    right = forms.select(F.col(forms.columns[0]).alias("right_text")).filter("right_text <> ''").distinct()
    if threshold >= TILED_BELOW:
        return _similar_by_keys(left, right, threshold)
    n, v = F.char_length("left_text"), F.char_length("right_text")
    longest = F.greatest(n, v)
    share = F.lit(1.0) - F.col("edits") / longest
    tiled = tiles.near_strings(left.filter(n <= tiles.WORD), right, threshold).withColumn("score", F.bround(share * 100, 2))
    # A partner of a longer query has at least so many characters.
    least = math.ceil((tiles.WORD + 1) * (threshold - 0.005) / 100.0) - 1
    others = _similar_by_keys(left.filter(n > tiles.WORD), right.filter(v >= least), threshold)
    return tiled.select("left_text", "right_text", "score").filter(F.col("score") >= threshold).unionByName(others)


def _similar_by_keys(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """:func:`similar_strings` of distinct texts by equi-joins. With a threshold of 50 or less a string can differ in all its
    characters and has no unchanged segment; the key is then the length alone, still exact."""
    n, v = F.char_length("left_text"), F.char_length("right_text")
    slack = F.lit((100.0 - threshold + 0.005) / 100.0)
    longest_of = lambda size: F.floor(size / F.lit(max(1e-9, (threshold - 0.005) / 100.0))).cast("int")
    score = similarity_score(F.col("left_text"), F.col("right_text"))

    if threshold <= 50.01:
        # One number: the longest form, which ends the range of lengths when the threshold does not.
        top = right.agg(F.coalesce(F.max(v), F.lit(0))).first()[0]
        shortest = F.greatest(F.lit(1), F.ceil(n * (1 - slack)).cast("int"))
        last = F.least(F.lit(top), longest_of(n)) if threshold > 0 else F.lit(top)
        lengths = F.when(last >= shortest, F.sequence(shortest, F.greatest(shortest, last)))
        probes = left.select("left_text", F.explode(lengths).alias("form_length"))
        keyed = right.withColumn("form_length", v)
        pairs = probes.join(keyed, (probes["form_length"] == keyed["form_length"]) & (score >= threshold))
        return pairs.select("left_text", "right_text", score.alias("score"))

    parts_of = lambda size: _allowed(longest_of(size), threshold) + 1
    verify = F.levenshtein(F.col("left_text"), F.col("right_text")) <= _allowed(
        F.greatest(F.char_length("left_text"), F.char_length("right_text")), threshold
    )
    # Pairs of strings of up to ``listed`` characters meet by shortened texts, pairs with a longer one by segments.
    edits = lambda size: math.floor(size * ((100.0 - threshold + 0.005) / 100.0))
    listed = max((size for size in range(257) if LISTED_LENGTH.get(edits(size), -1) >= size), default=0)
    most = max(edits(size) for size in range(listed + 1))
    near = _join_on_shortened(
        left.filter(n <= listed), right.filter(v <= listed), most, lambda size: F.least(F.lit(most), parts_of(size) - 1), verify
    )
    # The shorter of a pair with a longer one has at least so many characters.
    least = math.ceil((listed + 1) * (threshold - 0.005) / 100.0) - 1
    keyed = right.filter(v >= least).select(
        "right_text", v.alias("form_length"), F.explode_outer(_segments(F.col("right_text"), v, parts_of(v))).alias("s")
    ).select("right_text", "form_length", "s.no", "s.text")
    shortest = F.greatest(F.lit(1), F.ceil(n * (1 - slack)).cast("int"))
    lengths = F.filter(F.sequence(shortest, longest_of(n)), lambda size: (size > listed) | (n > listed))
    sized = left.filter(n >= least).select("left_text", F.explode(lengths).alias("form_length"))
    other = F.col("form_length")
    shift = _allowed(F.greatest(n, other), threshold)
    probes = sized.select(
        "left_text", "form_length",
        F.explode_outer(_probe(F.col("left_text"), n, other, parts_of(other), shift)).alias("s"),
    ).select("left_text", "form_length", "s.no", "s.text")
    found = near.unionByName(_join_on_segments(keyed, probes, verify)).distinct()
    return found.select("left_text", "right_text", score.alias("score")).filter(F.col("score") >= threshold)


def confusable_scan(names: DataFrame, max_distance: int = 2) -> DataFrame:
    """All unordered pairs of distinct names at edit distance 1..max_distance.

    Names of up to ``max_distance`` characters have no unchanged segment; where they are not listed by their shortened
    texts they are keyed by length alone, and there are few distinct ones.
    """
    base = names.select(F.col(names.columns[0]).alias("name")).filter("name <> ''").distinct()
    a, b = F.col("left_text"), F.col("right_text")
    verify = (a < b) & F.levenshtein(a, b, max_distance).between(1, max_distance)
    parts = F.lit(max_distance + 1)
    v = F.char_length("name")
    # Pairs of names of up to ``listed`` characters meet by shortened texts, pairs with a longer one by segments.
    listed = LISTED_LENGTH.get(max_distance, 0)
    short = base.filter(v <= listed)
    near = _join_on_shortened(
        short.select(F.col("name").alias("left_text")), short.select(F.col("name").alias("right_text")), max_distance if listed else 0,
        lambda size: F.lit(max_distance), verify,
    )
    long = base.filter(v > listed - max_distance)
    own = F.when(v >= parts, _segments(F.col("name"), v, parts)).otherwise(
        F.array(F.struct(F.lit(-1).alias("no"), F.lit(0).alias("at"), F.lit("").alias("text")))
    )
    forms = long.select(F.col("name").alias("right_text"), v.alias("form_length"), F.explode_outer(own).alias("s")).select(
        "right_text", "form_length", "s.no", "s.text"
    )
    lengths = F.sequence(F.greatest(F.lit(1), v - max_distance), v + max_distance)
    sized = long.select("name", F.explode(F.filter(lengths, lambda size: (size > listed) | (v > listed))).alias("form_length"))
    other = F.col("form_length")
    cut = F.when(other >= parts, _probe(F.col("name"), v, other, parts, F.lit(max_distance))).otherwise(
        F.array(F.struct(F.lit(-1).alias("no"), F.lit("").alias("text")))
    )
    probes = sized.select(F.col("name").alias("left_text"), "form_length", F.explode_outer(cut).alias("s")).select(
        "left_text", "form_length", "s.no", "s.text"
    )
    pairs = near.unionByName(_join_on_segments(forms, probes, verify)).distinct()
    return pairs.select(
        a.alias("name_a"), b.alias("name_b"), F.levenshtein(a, b).alias("edit_distance")
    )


# --- confusable-pair blocklist -------------------------------------------------------------------

# Accepted column names per field, first non-empty wins.
BLOCKLIST_COLUMNS = {
    "name_a": ["name_a", "molecule_a", "drug_a"],
    "name_b": ["name_b", "molecule_b", "drug_b"],
    "reason": ["reason", "verdict"],
    "source": ["source", "origin"],
}


def _first_present(df: DataFrame, names: list[str]) -> Column:
    present = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def blocklist_rows(rows: DataFrame) -> DataFrame:
    """Blocklist rows with both names in key space: ``name_a, name_b, key_a, key_b, reason, source``."""
    named = rows.select("*", *[_first_present(rows, c).alias(f"__{f}") for f, c in BLOCKLIST_COLUMNS.items()])
    named = named.filter(F.col("__name_a").isNotNull() & F.col("__name_b").isNotNull())
    keyed = with_normalized(with_normalized(named, "__name_a", prefix="__a_"), "__name_b", prefix="__b_")
    order = [F.col("row_no")] if "row_no" in rows.columns else []
    return keyed.select(
        F.col("__name_a").alias("name_a"), F.col("__name_b").alias("name_b"),
        F.col("__a_normalized").alias("key_a"), F.col("__b_normalized").alias("key_b"),
        F.coalesce("__reason", F.lit("")).alias("reason"), F.coalesce("__source", F.lit("csv")).alias("source"),
        *order,
    )


def blocklist_pairs(rows: DataFrame) -> DataFrame:
    """Canonical pairs ``key_a < key_b``, one row each, the last row of a pair winning.

    A pair that normalises to a single key fails the job: the normaliser would be merging two drugs the
    list declares distinct. Rows with an empty key are left out.
    """
    keyed = blocklist_rows(rows).filter("key_a <> '' AND key_b <> ''")
    distinct = F.when(F.col("key_a") != F.col("key_b"), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("blocklisted pair normalizes to a single key: "), F.col("key_a"))).cast("boolean")
    )
    keyed = keyed.filter(distinct)
    order = F.col("row_no") if "row_no" in rows.columns else F.struct("name_a", "name_b", "reason", "source")
    return (
        keyed.groupBy(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"))
        .agg(F.max_by(F.struct("name_a", "name_b", "reason", "source"), order).alias("r"))
        .select("key_a", "key_b", "r.*")
    )


def confusable_partners(pairs: DataFrame) -> DataFrame:
    """Both directions of every pair: ``key, partner``. Their number is not known to Spark: joins with them are sort-merge."""
    return pairs.select(F.col("key_a").alias("key"), F.col("key_b").alias("partner")).unionByName(
        pairs.select(F.col("key_b").alias("key"), F.col("key_a").alias("partner"))
    ).distinct()


# --- candidates ----------------------------------------------------------------------------------


def score_molecules(keys: DataFrame, surfaces: DataFrame, threshold: float = V.FUZZY_THRESHOLD) -> DataFrame:
    """Best surface of every molecule for every key, at or above the threshold.

    ``keys`` has one column; ``surfaces`` is the output of ``surface_forms``. On equal scores the molecule's
    own name goes before its aliases, aliases in alphabetical order.
    """
    pairs = similar_strings(keys, surfaces.select("surface"), threshold)
    scored = pairs.join(surfaces, pairs["right_text"] == surfaces["surface"])
    return _best_surfaces(scored.withColumnRenamed("left_text", "normalized"))


def _best_surfaces(scored: DataFrame) -> DataFrame:
    """One row per key and molecule of ``normalized, molecule_id, inn_name, surface, is_alias, score``."""
    best = F.struct((-F.col("score")).alias("s"), "is_alias", "surface")
    return (
        scored.groupBy("normalized", "molecule_id", "inn_name")
        .agg(F.min(best).alias("b"))
        .select(
            "normalized", "molecule_id", "inn_name",
            (-F.col("b.s")).alias("score"),
            F.col("b.surface").alias("matched_string"),
            F.when(F.col("b.is_alias"), "alias").otherwise("inn_name").alias("matched_on"),
        )
    )


def rule_one_candidates(keys: DataFrame, surfaces: DataFrame, pairs: DataFrame, threshold: float = V.FUZZY_THRESHOLD) -> DataFrame:
    """The candidates that Rule 1 of :func:`guard_candidates` drops, without looking for any others.

    They are molecules that the blocklist pairs with the key itself, so keys meet them over the blocklist in equi-joins
    and only such pairs are compared.
    """
    asked = keys.select(F.col(keys.columns[0]).alias("normalized")).filter("normalized <> ''").distinct()
    direct = confusable_partners(pairs).select(F.col("key").alias("normalized"), F.col("partner").alias("inn_name"))
    met = asked.join(direct.hint("merge"), "normalized").join(surfaces.filter("surface <> ''").hint("merge"), "inn_name")
    score = similarity_score(F.col("normalized"), F.col("surface"))
    return _best_surfaces(met.withColumn("score", score).filter(F.col("score") >= threshold)).select(
        "normalized", "molecule_id", "inn_name", "score", F.lit(RULE_ONE).alias("reason"), F.col("normalized").alias("confusable_with")
    )


def guard_candidates(scored: DataFrame, pairs: DataFrame) -> DataFrame:
    """Apply both blocklist rules; adds ``reason`` and ``confusable_with`` (null for survivors).

    Rule 1 drops a candidate confusable with the query. Rule 2 drops both members of a confusable pair
    that survive for one query: every survivor is listed under the pairs it belongs to, and a pair listed
    under two names of one query is a conflict. That is survivors x known partners, in one pass over the
    candidates and with no join of candidates to candidates.
    """
    partners = confusable_partners(pairs)
    direct = partners.select(F.col("key").alias("normalized"), F.col("partner").alias("inn_name"), F.lit(True).alias("__r1"))
    known = partners.select(F.col("key").alias("inn_name"), F.col("partner").alias("__p"))
    listed = scored.join(direct.hint("merge"), ["normalized", "inn_name"], "left").join(known.hint("merge"), "inn_name", "left")
    name = F.col("inn_name")
    pair = Window.partitionBy("normalized", F.least(name, "__p"), F.greatest(name, "__p"))
    counted = F.col("__r1").isNull() & F.col("__p").isNotNull()
    survivor = F.when(counted, name)
    met = F.min(survivor).over(pair) != F.max(survivor).over(pair)
    flagged = listed.select(*scored.columns, "__r1", F.when(counted & met, F.col("__p")).alias("__r2"))
    merged = flagged.groupBy(*scored.columns).agg(F.max("__r1").alias("__r1"), F.min("__r2").alias("__r2"))
    return merged.select(
        *scored.columns,
        F.when(F.col("__r1"), RULE_ONE).when(F.col("__r2").isNotNull(), RULE_TWO).alias("reason"),
        F.when(F.col("__r1"), F.col("normalized")).otherwise(F.col("__r2")).alias("confusable_with"),
    )


def threshold_ranges(scored: DataFrame, pairs: DataFrame) -> DataFrame:
    """For which thresholds a candidate survives both blocklist rules: those above ``low`` (null: any) up to its score.

    ``scored`` holds the candidates of the lowest threshold. A candidate of Rule 1 never survives. Rule 2 drops a
    candidate as long as a confusable partner is in the set, that is up to the partner's best score; so one pass over
    the candidates answers every threshold.
    """
    partners = confusable_partners(pairs)
    direct = partners.select(F.col("key").alias("normalized"), F.col("partner").alias("inn_name"))
    known = partners.select(F.col("key").alias("inn_name"), F.col("partner").alias("__p"))
    name = F.col("inn_name")
    listed = scored.join(direct.hint("merge"), ["normalized", "inn_name"], "left_anti").join(known.hint("merge"), "inn_name", "left")
    pair = Window.partitionBy("normalized", F.least(name, "__p"), F.greatest(name, "__p"))
    first = name == F.least(name, F.col("__p"))
    score = F.col("score")
    partner = F.when(first, F.max(F.when(~first, score)).over(pair)).otherwise(F.max(F.when(first, score)).over(pair))
    flagged = listed.select(*scored.columns, F.when(F.col("__p").isNotNull(), partner).alias("__low"))
    return flagged.groupBy(*scored.columns).agg(F.max("__low").alias("low")).filter(F.col("low").isNull() | (F.col("low") < score))


def candidates_by_threshold(ranges: DataFrame, thresholds: list[float], max_candidates: int = V.MAX_CANDIDATES) -> DataFrame:
    """Ranked survivors for each of the thresholds: ``threshold`` and the columns of :func:`fuzzy_candidates`."""
    asked = F.array(*[F.lit(float(t)) for t in thresholds])
    fits = F.filter(asked, lambda t: (t <= F.col("score")) & (F.col("low").isNull() | (t > F.col("low"))))
    order = Window.partitionBy("threshold", "normalized").orderBy(F.desc("score"), "inn_name", "molecule_id")
    rows = ranges.withColumn("threshold", F.explode(fits)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max_candidates)
    return rows.select("threshold", "normalized", "rank", "molecule_id", "inn_name", "score", "matched_string", "matched_on")


def suppressed_candidates(guarded: DataFrame) -> DataFrame:
    return guarded.filter("reason IS NOT NULL").select(
        "normalized", "molecule_id", "inn_name", "score", "reason", "confusable_with"
    )


def fuzzy_candidates(guarded: DataFrame, max_candidates: int = V.MAX_CANDIDATES) -> DataFrame:
    """Survivors ranked per query; the cap comes after suppression. Never an identification."""
    order = Window.partitionBy("normalized").orderBy(F.desc("score"), "inn_name", "molecule_id")
    return (
        guarded.filter("reason IS NULL")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= max_candidates)
        .select("normalized", "rank", "molecule_id", "inn_name", "score", "matched_string", "matched_on")
    )


def review_proposals(
    unjoined: DataFrame, vocabulary: DataFrame, pairs: DataFrame,
    threshold: float = V.FUZZY_THRESHOLD, top_n: int = 3,
) -> DataFrame:
    """Top candidates for a human, per unjoined product: never written as aliases.

    Ranking is by score, so applying the threshold before or after the cut gives the same rows.
    """
    similar = similar_strings(unjoined.select("normalized_string"), vocabulary, threshold)
    blocked = confusable_partners(pairs).select(F.col("key").alias("left_text"), F.col("partner").alias("right_text"))
    order = Window.partitionBy("left_text").orderBy(F.desc("score"), "right_text")
    kept = (
        similar.join(blocked.hint("merge"), ["left_text", "right_text"], "left_anti")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top_n)
    )
    return unjoined.join(kept, unjoined["normalized_string"] == kept["left_text"]).select(
        "product_id", F.col("generic_name_raw").alias("unjoined_name"), "normalized_string",
        F.col("right_text").alias("proposed_inn_name"), "score", F.lit("PENDING_HUMAN_REVIEW").alias("status"),
    )
