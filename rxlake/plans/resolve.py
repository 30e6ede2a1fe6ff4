"""Drug strings to molecules: one equi-join for identifications, a similarity join for what is left."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxlake import vocab_constants as V
from rxlake.functions.normalize import with_normalized
from rxlake.operators import fuzzy
from rxlake.operators import vocab
from rxlake.sources.artifacts import stored

EMPTY_NOTE = "input normalized to an empty key"
REVIEW_NOTE = "fuzzy candidates require human review; none has been accepted"
UNGUARDED_NOTE = "confusable-pair blocklist is not loaded — fuzzy output is unguarded"


@dataclass
class Vocabulary:
    """The tables that answer resolutions. ``combinations`` is a ``combination_index``.

    The lookups below are derived on demand; :meth:`prepare` writes them once, for many queries.
    """

    molecules: DataFrame
    aliases: DataFrame
    combinations: DataFrame
    pairs: DataFrame
    alias_order: list[str]
    blocklist_missing: bool = False
    prepared: dict[str, DataFrame] = field(default_factory=dict)
    folder: str | None = None

    def index(self) -> DataFrame:
        """key -> outcome."""
        if "index" in self.prepared:
            return self.prepared["index"]
        return vocab.resolution_index(self.molecules, self.aliases, self.combinations, self.alias_order)

    def surfaces(self) -> DataFrame:
        """Every name a molecule can be found under."""
        if "surfaces" in self.prepared:
            return self.prepared["surfaces"]
        return vocab.surface_forms(self.molecules, self.aliases, self.alias_order)

    def components(self) -> DataFrame:
        """Components of the packs that are complete."""
        if "components" in self.prepared:
            return self.prepared["components"]
        return vocab.combination_components(self.combinations, self.molecules)

    def expansions(self) -> DataFrame:
        """key -> what it contributes to a prescription: one molecule, or each component of a pack."""
        if "expansions" in self.prepared:
            return self.prepared["expansions"]
        index, components = self.index(), self.components()
        single = index.filter("status = 'resolved'").select(
            "key", F.lit(0).alias("comp_pos"), F.lit("").alias("comp_name"), "molecule_id", "inn_name",
            F.lit(None).cast("string").alias("from_combination"),
        )
        complete = index.filter("status = 'combination'").select("key")
        parts = components.join(complete, components["brand_key"] == complete["key"], "left_semi").select(
            F.col("brand_key").alias("key"), F.col("position").alias("comp_pos"), F.col("listed_name").alias("comp_name"),
            "molecule_id", "inn_name", F.col("brand_raw").alias("from_combination"),
        )
        return single.unionByName(parts)

    def prepare(self, folder: str) -> Vocabulary:
        """The same vocabulary with its lookups stored in ``folder``; each is made from the stored ones
        before it."""
        made = replace(self, pairs=stored(self.pairs, folder, "pairs"), prepared={}, folder=folder)
        for name in ("index", "surfaces", "components", "expansions"):
            made.prepared[name] = stored(getattr(made, name)(), folder, name)
        return made


def identify(requests: DataFrame, index: DataFrame, column: str = "query") -> DataFrame:
    """Requests with their key and identification. No shuffle of the requests when the index is small
    enough for Spark to broadcast; status is null for keys the index does not know."""
    keyed = with_normalized(requests, column)
    return keyed.join(index.withColumnRenamed("key", "normalized"), "normalized", "left")


def missed_keys(requests: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct keys nothing identifies. Equal strings are merged before they are normalised."""
    keys = with_normalized(requests.select("query").distinct(), "query").select("normalized").filter("normalized <> ''")
    return keys.join(index.select(F.col("key").alias("normalized")), "normalized", "left_anti").distinct()


def guarded_candidates(vocabulary: Vocabulary, keys: DataFrame, threshold: float = V.FUZZY_THRESHOLD) -> DataFrame:
    scored = fuzzy.score_molecules(keys, vocabulary.surfaces(), threshold)
    return fuzzy.guard_candidates(scored, vocabulary.pairs)


def outcome_index(requests: DataFrame, vocabulary: Vocabulary, threshold: float = V.FUZZY_THRESHOLD) -> DataFrame:
    """The index extended by the missed keys of the requests that have similar names, with their counts.

    Holds vocabulary entries and distinct missed keys only, never request rows.
    """
    index = vocabulary.index()
    guarded = guarded_candidates(vocabulary, missed_keys(requests, index), threshold)
    return index.unionByName(candidate_counts(guarded), allowMissingColumns=True)


def candidate_counts(guarded: DataFrame) -> DataFrame:
    """Surviving and suppressed candidates of every key that has any."""
    return guarded.groupBy(F.col("normalized").alias("key")).agg(
        F.count(F.when(F.col("reason").isNull(), 1)).alias("n_kept"), F.count("reason").alias("n_dropped")
    )


def resolve(
    requests: DataFrame, vocabulary: Vocabulary, threshold: float = V.FUZZY_THRESHOLD,
) -> DataFrame:
    """Every request with its status; fuzzy hits only ever raise ``needs_review``.

    Requests need a ``query`` column. Similarity runs on the distinct keys nothing identified, and what it
    finds is added to the index, so the requests themselves meet one join. A prepared vocabulary stores
    that extended index first: its real size then decides whether the requests are moved at all.
    """
    outcomes = outcome_index(requests, vocabulary, threshold)
    if vocabulary.folder is not None:
        outcomes = stored(outcomes, vocabulary.folder, f"outcomes-{uuid.uuid4().hex}")
    return answer(requests, outcomes, vocabulary.blocklist_missing)


def answer(requests: DataFrame, outcomes: DataFrame, blocklist_missing: bool = False) -> DataFrame:
    """Requests with what an ``outcome_index`` says of their keys."""
    joined = identify(requests, outcomes)
    zero = F.lit(0).cast("bigint")
    kept = F.coalesce("n_kept", zero)
    open_ = F.col("status").isNull()
    status = F.coalesce("status", F.when(kept > 0, "needs_review").otherwise("unresolved"))
    guard = F.when(open_ & (F.col("normalized") != "") & F.lit(blocklist_missing), UNGUARDED_NOTE)
    note = F.nullif(
        F.concat_ws(
            "; ", F.col("note"), F.when(F.col("normalized") == "", EMPTY_NOTE), F.when(open_ & (kept > 0), REVIEW_NOTE), guard
        ),
        F.lit(""),
    )
    return joined.select(
        *requests.columns, "normalized", status.alias("status"), "path", "molecule_id", "inn_name", "category",
        "alias_raw_string", "alias_source", "brand_raw", "n_components",
        kept.alias("n_candidates"),
        F.coalesce("n_dropped", zero).alias("n_suppressed"), note.alias("note"),
    )


def identified_molecules(requests: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Every molecule a request names: its match, or all components of its pack. Candidates never count."""
    identified = identify(requests, vocabulary.index())
    single = identified.filter("status = 'resolved'").select(*requests.columns, "molecule_id", "inn_name")
    packs = identified.filter("status = 'combination'").select(*requests.columns, F.col("normalized").alias("brand_key"))
    parts = packs.join(vocabulary.components().select("brand_key", "molecule_id", "inn_name"), "brand_key")
    return single.unionByName(parts.drop("brand_key"))
