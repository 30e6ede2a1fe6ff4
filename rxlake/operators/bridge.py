"""Joining vocabularies: exact keys only; what does not join is reported, never guessed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxlake.functions.normalize import with_normalized
from rxlake.operators.dedupe import first_wins, last_wins

NOT_IN_VOCABULARY = "no exact match in the canonical vocabulary"
NOT_IN_EITHER = "one or both molecules are not in the vocabulary"


def canonical_keys(*alias_tables: DataFrame) -> DataFrame:
    """Distinct keys of the tables that may create molecules."""
    out = None
    for table in alias_tables:
        keys = table.select(F.col("normalized_string").alias("inn_name")).filter("inn_name <> ''")
        out = keys if out is None else out.unionByName(keys)
    return out.distinct()


def bridge_aliases(tables: list[DataFrame], ids: DataFrame, order: list[str]) -> DataFrame:
    """Aliases of all tables that join the vocabulary; of a key the earliest table and row wins."""
    ranked = None
    for rank, table in enumerate(tables):
        extra = [c for c in order if c not in ("raw_string", "normalized_string", "source")]
        rows = table.select("raw_string", "normalized_string", "source", *extra, F.lit(rank).alias("__table"))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    chosen = first_wins(ranked.filter("normalized_string <> ''"), ["normalized_string"], ["__table", *order])
    return chosen.join(
        ids.select(F.col("inn_name").alias("normalized_string"), "molecule_id"), "normalized_string"
    ).select("raw_string", "normalized_string", "source", "molecule_id")


def bridge_products(products: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(contains, unjoined)``: products whose normalised name is a vocabulary key, and the others."""
    named = with_normalized(products, "generic_name_raw", ("normalized", "strength_value", "strength_unit"), "__")
    joined = named.join(
        ids.select(F.col("inn_name").alias("__normalized"), "molecule_id"), "__normalized", "left"
    )
    contains = joined.filter("molecule_id IS NOT NULL").select(
        "product_id", "molecule_id", F.col("__strength_value").alias("strength"), F.col("__strength_unit").alias("unit")
    )
    unjoined = joined.filter("molecule_id IS NULL").select(
        "product_id", "generic_name_raw", F.col("__normalized").alias("normalized_string"),
        F.lit(NOT_IN_VOCABULARY).alias("reason"),
    )
    return contains, unjoined


def rekey_interactions(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(edges, dropped)``: interaction rows moved from name keys to ids and re-ordered by id."""
    left = ids.select(F.col("inn_name").alias("molecule_id_a"), F.col("molecule_id").alias("__a"))
    right = ids.select(F.col("inn_name").alias("molecule_id_b"), F.col("molecule_id").alias("__b"))
    joined = rows.join(left, "molecule_id_a", "left").join(right, "molecule_id_b", "left")
    good = F.coalesce(F.col("__a") != F.col("__b"), F.lit(False))
    edges = joined.filter(good).select(
        F.least("__a", "__b").alias("molecule_id_a"), F.greatest("__a", "__b").alias("molecule_id_b"), "severity",
        "mechanism", "provenance",
    )
    dropped = joined.filter(~good).select(
        "molecule_id_a", "molecule_id_b", "severity", F.lit(NOT_IN_EITHER).alias("reason")
    )
    return edges, dropped


def rekey_coverage(by_name: DataFrame, ids: DataFrame) -> DataFrame:
    """Coverage rows moved from name keys to ids; names without a molecule are simply not covered."""
    return by_name.join(ids.select(F.col("inn_name").alias("key"), "molecule_id"), "key").select(
        "molecule_id", "atc_group"
    )


def reconcile_aliases(aliases: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(matched, unmatched)`` aliases by their re-normalised string; ``names`` maps key to molecule."""
    keyed = with_normalized(aliases, "normalized_string", ("normalized",), "__")
    joined = keyed.join(names.select(F.col("key").alias("__normalized"), F.col("molecule_id").alias("__id")), "__normalized", "left")
    fields = ["raw_string", "normalized_string", "source"]
    matched = joined.filter("__id IS NOT NULL").select(*fields, F.col("__id").alias("molecule_id"))
    return matched, joined.filter("__id IS NULL").select(*fields)


def reconcile_interactions(rows: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(edges, self_loops, unmatched)`` of raw (drug_a, drug_b) rows.

    Names are normalised once per row side and looked up; a pair of two spellings of one molecule goes
    to the self-loop report. ``unmatched`` has one row per missing name occurrence.
    """
    keyed = with_normalized(with_normalized(rows, "drug_a", prefix="__a_"), "drug_b", prefix="__b_")
    a = names.select(F.col("key").alias("__a_normalized"), F.col("molecule_id").alias("__a"))
    b = names.select(F.col("key").alias("__b_normalized"), F.col("molecule_id").alias("__b"))
    joined = keyed.join(a, "__a_normalized", "left").join(b, "__b_normalized", "left")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    ids = [F.least("__a", "__b").alias("molecule_id_a"), F.greatest("__a", "__b").alias("molecule_id_b")]
    keep = [c for c in rows.columns if c not in ("drug_a", "drug_b")]
    edges = joined.filter(both & (F.col("__a") != F.col("__b"))).select(*ids, *keep)
    loops = joined.filter(both & (F.col("__a") == F.col("__b")) & (F.col("drug_a") != F.col("drug_b"))).select(
        F.col("__a").alias("molecule_id"), "drug_a", "drug_b"
    )
    missing = joined.filter(~both).select(
        F.explode(
            F.array_compact(
                F.array(F.when(F.col("__a").isNull(), F.col("drug_a")), F.when(F.col("__b").isNull(), F.col("drug_b")))
            )
        ).alias("name")
    )
    return edges, loops, missing


def unmatched_names(missing: DataFrame, top: int = 100) -> DataFrame:
    """Names that matched nothing, most frequent first."""
    return missing.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(top)


def product_components(products: DataFrame, names: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(contains, unmatched)`` of products with ``components`` split by ``|`` and ``strength_raw`` by ``;``.

    The strength of a component is the one at its position, else the whole field. ``aliases`` is a
    key -> molecule table used after the molecule names.
    """
    parts = lambda c, sep: F.filter(
        F.transform(F.split(F.coalesce(F.col(c), F.lit("")), sep), lambda p: F.trim(p)), lambda x: x != ""
    )
    exploded = products.withColumn("__strengths", parts("strength_raw", ";")).select(
        "product_id", "strength_raw", "__strengths", F.posexplode(parts("components", r"\|")).alias("__at", "component")
    )
    stated = F.coalesce(F.get("__strengths", F.col("__at")), F.col("strength_raw"), F.lit(""))
    texts = exploded.select(
        "product_id", (F.col("__at") + 1).alias("position"), "component",
        F.concat_ws(" ", "component", stated).alias("__with_name"),
        F.concat(F.lit("drug "), stated).alias("__alone"),
    )
    fields = ("strength_value", "strength_unit")
    staged = with_normalized(texts, "component", prefix="__")
    staged = with_normalized(with_normalized(staged, "__with_name", fields, "__n_"), "__alone", fields, "__s_")
    own = names.select(F.col("key").alias("__normalized"), F.col("molecule_id").alias("__m"))
    other = aliases.select(F.col("key").alias("__normalized"), F.col("molecule_id").alias("__x"))
    joined = staged.join(own.hint("merge"), "__normalized", "left").join(other.hint("merge"), "__normalized", "left").withColumn(
        "molecule_id", F.coalesce("__m", "__x")
    )
    has = F.col("__n_strength_value").isNotNull()
    contains = joined.filter("molecule_id IS NOT NULL").select(
        "product_id", "position", "molecule_id",
        F.when(has, F.col("__n_strength_value")).otherwise(F.col("__s_strength_value")).alias("strength"),
        F.when(has, F.col("__n_strength_unit")).otherwise(F.col("__s_strength_unit")).alias("unit"),
    )
    return contains, joined.filter("molecule_id IS NULL").select("product_id", "position", "component")


def vocab_join_report(left: DataFrame, right: DataFrame, aliases: DataFrame) -> DataFrame:
    """Two one-column vocabularies joined both ways: ``side, outcome, n``.

    A left key matches exactly, or through an alias whose molecule name is a right key, or not at all.
    ``aliases`` has ``key, inn_name``.
    """
    l = left.select(F.col(left.columns[0]).alias("key")).distinct()
    r = right.select(F.col(right.columns[0]).alias("key")).distinct()
    via = aliases.join(r.withColumnRenamed("key", "inn_name").hint("merge"), "inn_name", "left_semi").select(
        "key", F.col("inn_name").alias("target")
    ).distinct()
    exact = r.withColumn("x", F.lit(1))
    matched = (
        l.join(exact.hint("merge"), "key", "left").join(via.hint("merge"), "key", "left")
        .select("key", F.when(F.col("x") == 1, "exact").when(F.col("target").isNotNull(), "alias").otherwise("unmatched").alias("outcome"),
                F.when(F.col("x") == 1, F.col("key")).otherwise(F.col("target")).alias("reached"))
    )
    reached = matched.filter("reached IS NOT NULL").groupBy(F.col("reached").alias("key")).agg(
        F.min(F.when(F.col("outcome") == "exact", 0).otherwise(1)).alias("how")
    )
    back = r.join(reached.hint("merge"), "key", "left").select(
        F.when(F.col("how") == 0, "exact").when(F.col("how") == 1, "alias").otherwise("unmatched").alias("outcome")
    )
    count = lambda df, side: df.groupBy("outcome").agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "outcome", "n")
    return count(matched.select("key", "outcome").distinct().select("outcome"), "left").unionByName(count(back, "right"))


def ceiling_coverage(product_molecules: DataFrame, ceilings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(matched, unmatched)`` molecules against a price-ceiling table.

    ``product_molecules`` has ``inn_name``; ``ceilings`` has ``molecule`` (any spelling) and
    ``ceiling_price``, empty when none is notified.
    """
    names = product_molecules.select("inn_name").distinct()
    keyed = with_normalized(ceilings, "molecule", prefix="__").filter("__normalized <> ''")
    priced = keyed.groupBy(F.col("__normalized").alias("inn_name")).agg(
        F.count("*").alias("n_formulations"), F.count("ceiling_price").alias("n_priced"),
        F.min("ceiling_price").alias("min_ceiling"), F.max("ceiling_price").alias("max_ceiling"),
    )
    return names.join(priced, "inn_name"), names.join(priced, "inn_name", "left_anti")


def alias_direction(seed: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Which way a pair of synonyms points: towards the spelling the target vocabulary carries.

    ``seed`` has ``raw_string, target_string``; ``vocabulary`` is one column of keys.
    """
    keys = vocabulary.select(F.col(vocabulary.columns[0]).alias("key")).distinct()
    staged = with_normalized(with_normalized(seed, "raw_string", prefix="__r_"), "target_string", prefix="__t_")
    joined = staged.join(
        keys.select(F.col("key").alias("__r_normalized"), F.lit(True).alias("__r_in")), "__r_normalized", "left"
    ).join(keys.select(F.col("key").alias("__t_normalized"), F.lit(True).alias("__t_in")), "__t_normalized", "left")
    r, t = F.coalesce("__r_in", F.lit(False)), F.coalesce("__t_in", F.lit(False))
    flip = r & ~t
    return joined.select(
        "raw_string", "target_string",
        F.when(flip, F.col("__t_normalized")).otherwise(F.col("__r_normalized")).alias("alias_key"),
        F.when(flip, F.col("__r_normalized")).otherwise(F.col("__t_normalized")).alias("target_key"),
        F.when(t & r, "both_present").when(t, "as_given").when(r, "flipped").otherwise("not_in_vocabulary").alias("direction"),
    )


def last_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return last_wins(rows, keys, order)
