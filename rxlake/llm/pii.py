"""Personal data in texts, by weak supervision, in DataFrame expressions only.

Four kinds have a fixed pattern and test (email, ip, card, phone); their spans always stay. Further spans come from
candidates (runs of letters and digits with at least one digit, and groups of digits with separators) on which
labelers vote: regular expressions for known shapes, gazetteers of words before a value, and the characters around it.
Votes are tallied by their pattern (at most 3 ** labelers rows); expectation-maximisation on the tally estimates how
often each labeler is right. Its posteriors then train the final span classifier, a naive Bayes model over bucketed
features, whose counts are one grouped sum. Only the tallies, bounded by the number of buckets, reach the driver.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxlake.llm.common import stored

KINDS = ["email", "ip", "card", "phone", "secret", "number"]
#: Fixed patterns, written so that a search does not start inside a run which has failed from its start.
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{8,}+(?![A-Za-z0-9])"
NUMBER = r"(?<![0-9.+-])\(?[0-9]{3}\)?[\x20.-][0-9]{2,4}[\x20.-][0-9]{4}(?![0-9.-])"
#: Gazetteers: words that announce a private value, and words that announce an ordinary one.
PRIVATE = ["password", "passwd", "pwd", "secret", "token", "key", "apikey", "credential", "auth", "login", "pin", "ssn",
           "phone", "tel", "mobile", "call", "fax", "account", "iban", "passport"]
ORDINARY = ["version", "page", "year", "copyright", "isbn", "chapter", "section", "figure", "table", "vol", "no", "item"]
LABELERS = ["known", "shape", "announced", "assigned", "length"]
FEATURES = ["f_length", "f_digits", "f_upper", "f_before", "f_announced", "f_kind"]


def located(df: DataFrame, pattern: str, guard: Column, name: str) -> DataFrame:
    """Adds ``name``: structs of match, start and end (code points) of each match, and the text before and after it."""
    found, between = f"{name}_found", f"{name}_between"
    none = F.array().cast("array<string>")
    df = df.withColumn(found, F.when(guard, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(between, F.when(F.size(found) > 0, F.split("text", pattern, -1)).otherwise(none))
    place = (
        f"transform({found}, (m, i) -> struct(m as value, "
        f"aggregate(slice({between}, 1, i + 1), 0, (a, x) -> a + length(x)) + aggregate(slice({found}, 1, i), 0, (a, x) -> a + length(x)) as start, "
        f"right(element_at({between}, i + 1), 32) as before, left(element_at({between}, i + 2), 4) as after))"
    )
    df = df.withColumn(name, F.expr(place)).drop(found, between)
    return df.withColumn(name, F.expr(f"transform({name}, s -> struct(s.value, s.start, s.start + length(s.value) as end, s.before, s.after))"))


DIGITS = "regexp_replace(s.value, '[^0-9]', '')"
LUHN = (
    "aggregate(sequence(1, length({d})), 0, (a, i) -> a + if(i % 2 = 1, int(substring(reverse({d}), i, 1)), "
    "if(int(substring(reverse({d}), i, 1)) > 4, 2 * int(substring(reverse({d}), i, 1)) - 9, 2 * int(substring(reverse({d}), i, 1))))) % 10 = 0"
).format(d=DIGITS)
TESTS = {
    "email": "true",
    "ip": "forall(split(s.value, '[.]'), p -> coalesce(try_cast(p as bigint) <= 255, false))",
    "card": f"length({DIGITS}) between 14 and 19 and {LUHN}",
    "phone": f"length({DIGITS}) between 10 and 15",
}


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds ``base``: array of structs (start, no, end) of the four fixed kinds, in order of start and kind."""
    text = F.col("text")
    df = docs.withColumn("text", F.coalesce("text", F.lit("")))
    df = located(df, EMAIL, text.contains("@"), "email")
    df = located(df, IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "ip")
    df = located(df, CARD, text.rlike(CARD), "card")
    df = located(df, PHONE, text.contains("+"), "phone")
    kept = ", ".join(
        f"transform(filter({k}, s -> {TESTS[k]}), s -> struct(s.start, {i} as no, s.end))" for i, k in enumerate(KINDS[:4])
    )
    return df.withColumn("base", F.expr(f"array_sort(concat({kept}))")).drop(*KINDS[:4])


def vote(plus: str, minus: str) -> str:
    return f"case when {plus} then 1 when {minus} then -1 else 0 end"


def listed(words: list[str]) -> str:
    return "(?i)(?:^|[^a-z])(?:" + "|".join(words) + ")s?[^a-z0-9]{1,4}$"


VOTES = {
    "known": vote("rlike(s.value, '^(AKIA[0-9A-Z]{16}|[0-9a-f]{18,}|gh[a-z]_?[A-Za-z0-9]{30,})$')", "rlike(s.value, '^[A-Z]?[0-9]{1,9}[a-z]?$')"),
    "shape": vote("length({0}) >= 3 and rlike(s.value, '[A-Za-z]')".format(DIGITS) + " or s.no = 5", "length({0}) <= 2".format(DIGITS)),
    "announced": vote(f"rlike(s.before, '{listed(PRIVATE)}')", f"rlike(s.before, '{listed(ORDINARY)}')"),
    "assigned": vote("rlike(s.before, '[=:][ ]?[\"'']?$')", "rlike(s.before, '[0-9./-]$') or rlike(s.after, '^[./-][0-9]')"),
    "length": vote("length(s.value) >= 16", "length(s.value) < 10"),
}
BUCKETS = {
    "f_length": "least(length(s.value) div 4, 12)",
    "f_digits": f"least((10 * length({DIGITS})) div length(s.value), 10)",
    "f_upper": "case when rlike(s.value, '^[^a-z]*[A-Z]') then 2 when rlike(s.value, '[A-Z]') then 1 else 0 end",
    "f_before": "case when s.before = '' then 0 when rlike(s.before, '[=:]$') then 1 when rlike(s.before, '[\"'']$') then 2 when rlike(s.before, '[ \\t\\n]$') then 3 else 4 end",
    "f_announced": VOTES["announced"],
    "f_kind": "s.no",
}


def candidates(df: DataFrame) -> DataFrame:
    """Adds ``asked``: candidates with start, end, kind, votes and feature buckets, those meeting a base span left out."""
    some = F.col("text").rlike("[0-9]")
    df = located(df, TOKEN, some, "tokens")
    df = located(df, NUMBER, F.col("text").rlike(r"[0-9][\x20.-][0-9]{2,4}[\x20.-][0-9]{4}"), "numbers")
    both = "concat(transform(tokens, s -> struct(s.*, 4 as no)), transform(numbers, s -> struct(s.*, 5 as no)))"
    both = both.replace("s.*", "s.value as value, s.start as start, s.end as end, s.before as before, s.after as after")
    free = f"filter({both}, s -> not exists(base, b -> b.start < s.end and s.start < b.end))"
    fields = ", ".join(f"{e} as {n}" for n, e in {**VOTES, **BUCKETS}.items())
    return df.withColumn("asked", F.expr(f"transform({free}, s -> struct(s.start, s.no, s.end, {fields}))")).drop("tokens", "numbers")


def reliabilities(tally: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Posterior of each vote pattern. Every labeler has its own chances of +1, 0 and -1 given a true or false span."""
    labelers = len(LABELERS)
    chance = [[{v: 0.8 if v == 1 else 0.1 for v in (-1, 0, 1)} for _ in range(labelers)],
              [{v: 0.6 if v == -1 else 0.2 for v in (-1, 0, 1)} for _ in range(labelers)]]
    share, posterior = 0.5, {}
    for _ in range(rounds):
        for votes, _n in tally:
            true = math.log(share) + sum(math.log(chance[0][i][v]) for i, v in enumerate(votes))
            false = math.log(1 - share) + sum(math.log(chance[1][i][v]) for i, v in enumerate(votes))
            posterior[votes] = 1 / (1 + math.exp(max(-50.0, min(50.0, false - true))))
        total = sum(n for _, n in tally)
        weight = sum(n * posterior[v] for v, n in tally)
        share = min(0.99, max(0.01, weight / total))
        for side in (0, 1):
            for i in range(labelers):
                mass = defaultdict(lambda: 1.0)
                for votes, n in tally:
                    mass[votes[i]] += n * (posterior[votes] if side == 0 else 1 - posterior[votes])
                whole = sum(mass[v] for v in (-1, 0, 1))
                chance[side][i] = {v: mass[v] / whole for v in (-1, 0, 1)}
    return posterior


def train(asked: DataFrame) -> dict:
    """The final classifier: log-odds of each feature bucket and a prior, from all candidates of the table."""
    rows = asked.select(F.explode("asked").alias("s")).select("s.*")
    tally = rows.groupBy(*LABELERS, *FEATURES).agg(F.count("*").alias("n")).collect()  # bounded by the buckets
    if not tally:
        return {"prior": -10.0, **{f: {} for f in FEATURES}}
    votes = defaultdict(int)
    for r in tally:
        votes[tuple(r[x] for x in LABELERS)] += r["n"]
    posterior = reliabilities(sorted(votes.items()))
    true, false = {f: defaultdict(float) for f in FEATURES}, {f: defaultdict(float) for f in FEATURES}
    for r in tally:
        p = posterior[tuple(r[x] for x in LABELERS)]
        for f in FEATURES:
            true[f][r[f]] += p * r["n"]
            false[f][r[f]] += (1 - p) * r["n"]
    t, n = sum(true["f_kind"].values()), sum(false["f_kind"].values())
    model = {"prior": math.log((t + 1) / (n + 1))}
    for f in FEATURES:
        k = len(true[f])
        model[f] = {v: math.log((true[f][v] + 1) / (t + k)) - math.log((false[f][v] + 1) / (n + k)) for v in true[f]}
    return model


def decided(df: DataFrame, model: dict) -> DataFrame:
    """Adds ``spans``: base spans and the candidates that the classifier accepts, in order of start and kind."""
    score = [repr(float(model["prior"])) + "D"]
    for f in FEATURES:
        if model[f]:
            cases = " ".join(f"when {int(v)} then {w!r}D" for v, w in model[f].items())
            score.append(f"case s.{f} {cases} else 0D end")
    added = f"transform(filter(asked, s -> {' + '.join(score)} > 0D), s -> struct(s.start, s.no, s.end))"
    return df.withColumn("spans", F.expr(f"array_sort(concat(base, {added}))"))


def written(spans: str) -> str:
    names = " ".join(f"when {i} then '{k}'" for i, k in enumerate(KINDS))
    return f"array_join(transform({spans}, s -> concat(case s.no {names} end, ':', s.start, ':', s.end)), ',')"


def find_pii(docs: DataFrame, carry: list[str] = ("doc_id",)) -> DataFrame:
    """Each document with counts per kind, ``base`` and ``spans`` as text (kind:start:end, code points, end exclusive).

    Needs ``text``; null is empty. Every row gets a result, also repeated ones and those with a null id; a text
    without digits, '@' or '+' costs three searches. An empty table gives an empty result.
    """
    keep = docs.select(*[F.col(c).alias(f"keep_{i}") for i, c in enumerate(carry)], "text")
    found = stored(candidates(base_spans(keep)).drop("text"), "candidates")
    result = decided(found, train(found))
    counts = [F.expr(f"size(filter(base, s -> s.no = {i}))").cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return result.select(
        *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(carry)], *counts,
        F.sha2(F.expr(written("base")), 256).alias("base_sha256"), F.expr(written("spans")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; overlapping spans become one, named by the first.

    Null texts stay null; all columns and rows are kept. The model is trained on a first pass over the same texts.
    """
    columns = docs.columns
    model = train(stored(candidates(base_spans(docs.select("text"))).select("asked"), "candidates"))
    marked = docs.withColumn("pii_text", F.col("text")).select(
        *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(columns)], F.col("pii_text").alias("text"))
    marked = decided(candidates(base_spans(marked)), model)
    names = " ".join(f"when {i} then '[{k.upper()}]'" for i, k in enumerate(KINDS))
    folded = (
        "aggregate(spans, named_struct('at', 0, 'out', ''), (a, s) -> if(s.start < a.at, "
        "named_struct('at', greatest(a.at, s.end), 'out', a.out), named_struct('at', s.end, 'out', "
        f"concat(a.out, substring(text, a.at + 1, s.start - a.at), case s.no {names} end))), "
        "a -> concat(a.out, substring(text, a.at + 1)))"
    )
    at = columns.index("text")
    clean = F.when(F.col(f"keep_{at}").isNull(), None).when(F.size("spans") == 0, F.col("text")).otherwise(F.expr(folded))
    return marked.select(*[(clean if i == at else F.col(f"keep_{i}")).alias(c) for i, c in enumerate(columns)])
