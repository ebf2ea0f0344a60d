"""Quality rules as weak supervision: every rule votes good, votes bad or abstains; expectation-maximisation over all
documents estimates how far each rule can be trusted; a document is kept by its posterior probability of being good.

Everything is a DataFrame expression. Only the estimates (four numbers a rule and one prior) pass through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.scratch import Scratch

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """Compares 100 * ``part`` with a limit times ``whole``: votes bad at the limit ``bad`` and beyond, good at the
    limit ``good`` and beyond on the other side, and abstains in between. Without ``good`` it never votes good: having
    no fault of one kind says nothing about others."""

    name: str
    part: str
    whole: str
    bad: int
    good: int | None = None
    rising: bool = True


RULES = (
    Rule("plain_words", "n_plain_words", "n_words", bad=60, good=90, rising=False),
    Rule("symbols", "n_symbols", "word_chars", bad=4),
    Rule("repeated_words", "n_repeat_words", "n_words", bad=45),
    Rule("repeated_lines", "n_dup_lines", "n_lines", bad=50),
    Rule("capitals", "n_capitals", "word_chars", bad=50),
    Rule("exclamations", "n_exclamations", "n_words", bad=40),
    Rule("long_words", "word_chars", "n_words", bad=1500),
)
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_capitals", "n_exclamations", "n_plain_words",
)
# A letter (or anything outside ASCII), then lower-case letters, then at most one mark.
PLAIN_WORD = r"^[^\x00-\x40\x5B-\x60\x7B-\x7F][^\x00-\x60\x7B-\x7F]*[.,;:]?$"
# How often a rule votes good and bad before anything is known.
START = {"good": (0.6, 0.05), "bad": (0.1, 0.4)}


@dataclass(frozen=True)
class Model:
    """``good`` and ``bad``: for documents of that kind, how often each rule votes good and bad; else it abstains."""

    prior: float
    good: tuple[tuple[float, float], ...]
    bad: tuple[tuple[float, float], ...]


def kept_letters(text: Column, other: str) -> Column:
    return F.length(F.regexp_replace(text, other, "")).cast("long")


def repeated_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more in the array, the first occurrence included.

    Windows are compared by hash first, which never misses a repeated one; only an array with equal hashes has its
    windows sorted and compared as text.
    """

    def window(x: Column, i: Column) -> tuple[Column, ...]:
        return x, F.get(words, i + 1), F.get(words, i + 2)

    whole = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    hashes = F.transform(whole, lambda x, i: F.xxhash64(*window(x, i)))
    sorted_windows = F.sort_array(
        F.transform(whole, lambda x, i: F.struct(F.concat_ws(" ", *window(x, i)).alias("window"), i.alias("at")))
    )

    def repeats(windows: Column) -> Column:
        return F.sort_array(
            F.transform(
                F.filter(
                    windows,
                    lambda x, i: (x["window"] == F.get(windows, i - 1)["window"])
                    | (x["window"] == F.get(windows, i + 1)["window"]),
                ),
                lambda x: x["at"],
            )
        )

    def covered(places: Column) -> Column:
        return F.aggregate(
            F.transform(places, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - x, F.lit(3)))),
            F.lit(0),
            lambda total, x: total + x,
        )

    exact = F.transform(
        F.transform(F.transform(F.array(sorted_windows), repeats), covered), lambda x: x.cast("long")
    )
    some = F.transform(F.array(hashes), lambda x: F.size(F.array_distinct(x)) < F.size(x))
    return F.when(F.element_at(some, 1), F.element_at(exact, 1)).otherwise(F.lit(0).cast("long"))


def _fresh(name: str, taken: list[str]) -> str:
    while name.lower() in {other.lower() for other in taken}:
        name += "_"
    return name


def measured(docs: DataFrame, into: str) -> DataFrame:
    """``docs`` with a struct column of the counts the rules look at. No shuffle; null text counts as empty."""
    text, words, lines = (_fresh(f"{into}_{name}", docs.columns) for name in ("text", "words", "lines"))
    staged = docs.withColumn(text, F.coalesce("text", F.lit(""))).select(
        "*",
        F.array_remove(F.split(text, SPACES), "").alias(words),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias(lines),
    )
    values = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": kept_letters(F.col(text), r"[^#*$%&|<>]+"),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated_words(F.col(words)),
        "n_lines": F.size(lines),
        "n_capitals": kept_letters(F.col(text), "[^A-Z]+"),
        "n_exclamations": kept_letters(F.col(text), "[^!]+"),
        "n_plain_words": F.size(F.filter(words, lambda word: word.rlike(PLAIN_WORD))),
    }
    counts = F.struct(*(values[name].cast("long").alias(name) for name in COUNTS))
    return staged.withColumn(into, counts).drop(text, words, lines)


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def vote(rule: Rule, counts: Column) -> Column:
    """1 good, 0 bad, null abstains. A document without the counted whole (no words) makes the rule abstain."""
    part, whole = 100 * counts[rule.part], counts[rule.whole]
    beyond = part >= rule.bad * whole if rule.rising else part <= rule.bad * whole
    cast = F.when(whole == 0, None).when(beyond, 0)
    if rule.good is None:
        return cast
    return cast.when(part <= rule.good * whole if rule.rising else part >= rule.good * whole, 1)


def posterior(model: Model, votes: list[Column]) -> Column:
    good, bad = F.lit(model.prior), F.lit(1.0 - model.prior)
    for place, cast in enumerate(votes):
        good, bad = (
            kind
            * F.when(cast == 1, F.lit(said_good))
            .when(cast == 0, F.lit(said_bad))
            .otherwise(F.lit(1.0 - said_good - said_bad))
            for kind, (said_good, said_bad) in ((good, model.good[place]), (bad, model.bad[place]))
        )
    return good / (good + bad)


def fit(counts: DataFrame, column: str, scratch: Scratch, rounds: int = 20, rules: tuple[Rule, ...] = RULES) -> Model:
    """Estimates from the votes of all documents. They are first counted by pattern, which leaves at most
    3 ** len(rules) rows, so every round is a job on a tiny table. An empty table gives the starting values."""
    names = [f"vote_{place}" for place in range(len(rules))]
    patterns = scratch.write(
        counts.groupBy(*(vote(rule, F.col(column)).alias(name) for rule, name in zip(rules, names)))
        .agg(F.count("*").alias("documents"))
        .coalesce(1),
        "votes",
    )
    model = Model(0.5, (START["good"],) * len(rules), (START["bad"],) * len(rules))
    votes = [F.col(name) for name in names]
    for _ in range(rounds):
        weighed = patterns.withColumn("good", posterior(model, votes) * F.col("documents")).withColumn(
            "bad", F.col("documents") - F.col("good")
        )
        sums = [F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.sum("documents").alias("documents")]
        for name in names:
            for kind in ("good", "bad"):
                for said in (1, 0):
                    sums.append(F.sum(F.when(F.col(name) == said, F.col(kind))).alias(f"{name}_{kind}_{said}"))
        row = weighed.agg(*sums).first()
        if not row["documents"]:
            break

        def rates(kind: str) -> tuple[tuple[float, float], ...]:
            # Ten documents that vote as at the start are added, so that no rate becomes 0 or 1.
            return tuple(
                tuple(
                    ((row[f"{name}_{kind}_{said}"] or 0.0) + 10.0 * START[kind][1 - said]) / (row[kind] + 10.0)
                    for said in (1, 0)
                )
                for name in names
            )

        model = Model((row["good"] + 1.0) / (row["documents"] + 2.0), rates("good"), rates("bad"))
    scratch.drop(patterns)
    return model


def probability(model: Model, counts: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    return posterior(model, [vote(rule, counts) for rule in rules])


def judged(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, the counts, ``base_failed``, ``kept`` and ``quality``, the posterior
    probability of being good. The text is read once; votes are taken from the written counts.

    Cases: null, empty or wordless text has no words and fails the base rules; repeated rows give a row each and
    count once each; a null id is returned as it is; an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    counts = scratch.write(measured(docs.select("doc_id", "text"), "counts").select("doc_id", "counts"), "counts")
    model = fit(counts, "counts", scratch)
    counted = F.col("counts")
    return counts.select(
        "doc_id",
        *(counted[name].alias(name) for name in COUNTS[:5]),
        base_failed(counted).alias("base_failed"),
        (~base_failed(counted) & (probability(model, counted) >= least)).alias("kept"),
        F.round(probability(model, counted), 4).alias("quality"),
    )


def good_documents(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns. Rows are written with their counts, so that texts are
    measured once; were the filter a plain expression over the texts, it would be measured again for every rule."""
    scratch = Scratch(docs.sparkSession, "quality")
    into = _fresh("counts", docs.columns)
    rows = scratch.write(measured(docs, into), "rows")
    model = fit(rows, into, scratch)
    counted = F.col(into)
    passed = ~base_failed(counted) & (probability(model, counted) >= least)
    return rows.filter(passed).select(*docs.columns)


def oracle(rounds: int = 20, least: float = 0.5, rules: tuple[Rule, ...] = RULES) -> str:
    """The same in DuckDB SQL: one chain of table expressions a round."""
    names = [f"vote_{place}" for place in range(len(rules))]

    def cast(rule: Rule) -> str:
        part, whole = f"100 * {rule.part}", rule.whole
        low, high = ("<=", ">=") if rule.rising else (">=", "<=")
        good = f"WHEN {part} {low} {rule.good} * {whole} THEN 1 " if rule.good is not None else ""
        return f"CASE WHEN {whole} = 0 THEN NULL WHEN {part} {high} {rule.bad} * {whole} THEN 0 {good}END"

    def product(kind: str) -> str:
        prior = "prior" if kind == "good" else "(1.0 - prior)"
        factors = (
            f"CASE WHEN {name} = 1 THEN {kind}_{place}_1 WHEN {name} = 0 THEN {kind}_{place}_0 "
            f"ELSE 1.0 - {kind}_{place}_1 - {kind}_{place}_0 END"
            for place, name in enumerate(names)
        )
        return " * ".join([prior, *factors])

    rated = [(place, name, kind, yes) for place, name in enumerate(names) for kind in START for yes in (1, 0)]
    start = ", ".join(f"{START[kind][1 - yes]}::DOUBLE AS {kind}_{place}_{yes}" for place, _, kind, yes in rated)
    chain = [f"model_0 AS MATERIALIZED (SELECT 0.5::DOUBLE AS prior, {start})"]
    for turn in range(rounds):
        rates = ", ".join(
            f"(coalesce(sum({kind}) FILTER ({name} = {yes}), 0) + {10.0 * START[kind][1 - yes]}) / "
            f"(sum({kind}) + 10.0) AS {kind}_{place}_{yes}"
            for place, name, kind, yes in rated
        )
        chain.append(
            f"model_{turn + 1} AS MATERIALIZED (SELECT (sum(good) + 1.0) / (sum(documents) + 2.0) AS prior, {rates} "
            f"FROM (SELECT *, documents - good AS bad FROM (SELECT {', '.join(names)}, documents, documents * g / (g + b) "
            f"AS good FROM (SELECT *, {product('good')} AS g, {product('bad')} AS b "
            f"FROM patterns, model_{turn}))))"
        )
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, text,
    regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM texts),
grams AS (SELECT row, doc_id, i, w, count(*) OVER (PARTITION BY row, w) AS times FROM (
    SELECT row, doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
    FROM (SELECT row, doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM
      (SELECT row_number() OVER () AS row, doc_id, words FROM split)))),
repeats AS (SELECT doc_id, sum(least(3, coalesce(following - i, 3))) AS n_repeat_words FROM (
    SELECT doc_id, i, lead(i) OVER (PARTITION BY row ORDER BY i) AS following FROM grams WHERE times > 1)
  GROUP BY doc_id),
counts AS (SELECT split.doc_id, len(words) AS n_words,
    coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '{SYMBOLS}')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(lines) AS n_lines, len(regexp_extract_all(text, '[A-Z]')) AS n_capitals,
    len(regexp_extract_all(text, '!')) AS n_exclamations, len(list_filter(words, lambda w: regexp_matches(w, '{PLAIN_WORD}'))) AS n_plain_words
  FROM split LEFT JOIN repeats ON split.doc_id = repeats.doc_id),
voted AS (SELECT *, {", ".join(f"{cast(rule)} AS {name}" for rule, name in zip(rules, names))} FROM counts),
patterns AS MATERIALIZED (SELECT {", ".join(names)}, count(*) AS documents FROM voted GROUP BY ALL),
{", ".join(chain)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed,
  NOT failed AND g / (g + b) >= {least} AS kept, round(g / (g + b), 4) AS quality
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS failed,
    {product('good')} AS g, {product('bad')} AS b FROM voted, model_{rounds})
"""
