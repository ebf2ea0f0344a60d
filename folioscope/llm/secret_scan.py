"""Secret scan through a trigram inverted index.

From each rule's expression a Boolean query over trigrams is derived that every match implies. Postings of the
trigrams any query asks for are written as an index; a rule's candidates are the documents whose postings satisfy its
query, and only they are matched against the expression. Rules without mandatory trigrams scan all documents.
All of it is DataFrame expressions.
"""

from __future__ import annotations

import re._constants as ops
import re._parser as parser
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.scratch import Scratch

# Prefix sums over so many matches of a text at a time.
CHUNK = 256


@dataclass(frozen=True)
class Rule:
    """``expression`` finds leftmost matches; one whose ``group`` (0: all of it) is shorter than ``least`` is dropped
    and not tried again. ``base`` rules are the contract's; the others are the library's own."""

    kind: str
    expression: str
    group: int = 0
    least: int = 1
    base: bool = False


# Formats of credentials that their issuers document.
RULES = (
    Rule(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
        r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
        base=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, base=True),
    Rule("hex", r"[0-9a-f]+", least=24, base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", least=24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
)

# A query is a trigram, ("and", queries), ("or", queries) or None, which asks for nothing.
Query = str | tuple | None


def _both(left: Query, right: Query) -> Query:
    return right if left is None else left if right is None else left if left == right else ("and", (left, right))


def _strings_query(strings: set[str]) -> Query:
    """What any text with one of the strings has; nothing if one of them is too short for a trigram."""
    choices = []
    for text in sorted(text for text in strings if not any(other != text and other in text for other in strings)):
        grams = sorted({text[n : n + 3] for n in range(len(text) - 2)})
        if not grams:
            return None
        choices.append(reduce(_both, grams))
    return choices[0] if len(choices) == 1 else ("or", tuple(dict.fromkeys(choices)))


def _analyse(tokens, most: int = 48) -> tuple[set[str] | None, Query]:
    """All strings the tokens match, lower-cased, where those are few; and a query that every match implies."""
    exact: set[str] = {""}
    query: Query = None
    whole = True

    def settle(strings: set[str]) -> None:
        nonlocal query
        query = _both(query, _strings_query(strings))

    for operation, argument in tokens:
        part: set[str] | None = None
        if operation is ops.LITERAL:
            part = {chr(argument).lower()}
        elif operation is ops.IN and all(kind is ops.LITERAL for kind, _ in argument):
            part = {chr(value).lower() for _, value in argument}
        elif operation is ops.SUBPATTERN:
            part, inner = _analyse(argument[3], most)
            if part is None:
                query = _both(query, inner)
        elif operation is ops.BRANCH:
            found = [_analyse(branch, most) for branch in argument[1]]
            if all(strings is not None for strings, _ in found):
                part = set().union(*(strings for strings, _ in found))
            elif all(inner is not None for _, inner in found):
                query = _both(query, ("or", tuple(inner for _, inner in found)))
        elif operation in (ops.MAX_REPEAT, ops.MIN_REPEAT):
            low, high, body = argument
            strings, inner = _analyse(body, most)
            if strings is not None and (low, high) == (0, 1):
                part = strings | {""}
            elif strings is not None and low == high and len(strings) == 1:
                part = {next(iter(strings)) * low}
            elif low > 0 and strings is None:
                query = _both(query, inner)
        if part is None:
            settle(exact)
            exact, whole = {""}, False
            continue
        crossed = {left + right for left in exact for right in part}
        if len(crossed) > most:
            settle(exact)
            exact, whole = part, False
        else:
            exact = crossed
    settle(exact)
    return (exact if whole else None), query


def trigram_query(expression: str) -> Query:
    """The Boolean trigram query of an expression, over lower-cased text. None: it has no mandatory trigram."""
    return _analyse(parser.parse(expression))[1]


def trigrams_of(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def satisfied(query: Query, has) -> Column:
    if isinstance(query, str):
        return has(query)
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, [satisfied(part, has) for part in query[1]])


def postings(rows: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """The inverted index of some trigrams: ``trigram`` (its number), ``doc_id``, ``key``. Case is folded."""
    text = F.lower("text")
    present = F.array_compact(
        F.array(*(F.when(F.contains(text, F.lit(gram)), F.lit(n)) for n, gram in enumerate(trigrams)))
    )
    return rows.select("doc_id", "key", F.explode(present).alias("trigram"))


def candidates(index: DataFrame, rules: Sequence[Rule], trigrams: Sequence[str]) -> DataFrame:
    """``doc_id``, ``key`` and the numbers of the rules whose query the document's postings satisfy.

    Postings are intersected per document as bits, which are combined before the shuffle.
    """
    number = {gram: n for n, gram in enumerate(trigrams)}
    bit = F.expr("shiftleft(1L, cast(pmod(trigram, 62) as int))")
    words = [
        F.bit_or(F.when(F.floor(F.col("trigram") / 62) == word, bit).otherwise(0)).alias(f"bits_{word}")
        for word in range(-(-len(trigrams) // 62))
    ]

    def has(gram: str) -> Column:
        word, bit = divmod(number[gram], 62)
        return F.col(f"bits_{word}").bitwiseAND(F.lit(1 << bit)) != 0

    found = [
        F.when(satisfied(query, has), F.lit(n))
        for n, rule in enumerate(rules)
        if (query := trigram_query(rule.expression)) is not None
    ]
    return (
        index.groupBy("doc_id", "key")
        .agg(*words)
        .select("doc_id", "key", F.array_compact(F.array(*found)).alias("rules"))
        .filter(F.size("rules") > 0)
    )


def running_sums(values: Column) -> Column:
    """Sums of an array up to each element, in chunks, so that the cost does not grow with the square of its size."""

    def sums(array: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<bigint>").alias("all"))

        def add(state: Column, value: Column) -> Column:
            total = state["total"] + value
            return F.struct(total.alias("total"), F.concat(state["all"], F.array(total)).alias("all"))

        return F.aggregate(array, start, add, lambda state: state["all"])

    count = F.ceil(F.size(values) / CHUNK).cast("int")
    chunks = F.transform(
        F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda n: sums(F.slice(values, (n - 1) * CHUNK + 1, CHUNK))
    )

    def shifted(parts: Column) -> Column:
        ends = sums(F.transform(parts, lambda part: F.coalesce(F.get(part, F.size(part) - 1), F.lit(0).cast("long"))))
        return F.flatten(
            F.element_at(
                F.transform(
                    F.array(ends),
                    lambda before: F.transform(
                        parts,
                        lambda part, n: F.transform(
                            part, lambda value: value + F.coalesce(F.get(before, n - 1), F.lit(0).cast("long"))
                        ),
                    ),
                ),
                1,
            )
        )

    return F.element_at(F.transform(F.array(chunks), shifted), 1)


SPAN = "array<struct<start: bigint, kind: int, end: bigint>>"


def spans_of(text: Column, rule: Rule, kind: int) -> Column:
    """Spans of a rule in a text, in code points. The text is cut into a gap and a match each, so the place of a match
    follows from the lengths before it; only texts with a match are cut."""
    cut = rf"[\s\S]*?(?:({rule.expression})|\z)"
    tested = rule.expression
    if rule.group == 0 and rule.expression.endswith("]+") and rule.kind == "hex":
        tested = rule.expression[:-1] + f"{{{rule.least}}}"
    wholes = F.transform(F.regexp_extract_all(text, F.lit(cut), F.lit(0)), lambda x: F.length(x).cast("long"))
    matches = F.transform(F.regexp_extract_all(text, F.lit(cut), F.lit(1)), lambda x: F.length(x).cast("long"))
    asked = (
        F.transform(F.regexp_extract_all(text, F.lit(cut), F.lit(rule.group + 1)), lambda x: F.length(x).cast("long"))
        if rule.group
        else matches
    )
    zipped = F.arrays_zip(running_sums(wholes).alias("end"), matches.alias("size"), asked.alias("asked"))
    found = F.transform(
        F.filter(zipped, lambda x: (x["size"] > 0) & (x["asked"] >= rule.least)),
        lambda x: F.struct(
            (x["end"] - x["size"]).alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")
        ),
    )
    return F.when(text.rlike(tested), found).otherwise(F.array().cast(SPAN))


def joined(spans: Column, kinds: Sequence[str]) -> Column:
    names = F.array(*(F.lit(kind) for kind in kinds))
    return F.array_join(
        F.transform(
            spans, lambda span: F.concat_ws(":", F.get(names, span["kind"]), span["start"].cast("string"), span["end"].cast("string"))
        ),
        ",",
    )


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per row of ``docs``: ``doc_id`` and ``spans``, an array of start, kind (place in ``rules``) and end by start and
    kind, in code points, ends exclusive.

    Cases: a null text is empty; a match that fails its length is dropped without a further try inside it; matches of
    different kinds may overlap; rows that repeat are scanned each; a null id is returned; an empty table gives no
    rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    trigrams = sorted(set().union(*(trigrams_of(trigram_query(rule.expression)) for rule in rules)))
    index = scratch.write(postings(rows, trigrams).sortWithinPartitions("trigram"), "postings")
    chosen = candidates(index, rules, trigrams).withColumnsRenamed({"doc_id": "doc_of", "key": "key_of"})
    joined_rows = rows.join(
        chosen, F.col("doc_id").eqNullSafe(F.col("doc_of")) & F.col("key").eqNullSafe(F.col("key_of")), "left"
    )
    parts = []
    for n, rule in enumerate(rules):
        found = spans_of(F.col("text"), rule, n)
        if trigram_query(rule.expression) is not None:
            candidate = F.coalesce(F.array_contains("rules", n), F.lit(False))
            found = F.when(candidate, found).otherwise(F.array().cast(SPAN))
        parts.append(found)
    return joined_rows.select("doc_id", F.sort_array(F.concat(*parts)).alias("spans"))


def report(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The scan as counts of the base kinds, a digest of the base spans and a list of all spans."""
    found = scan(docs, rules)
    kinds = [rule.kind for rule in rules]
    base = [n for n, rule in enumerate(rules) if rule.base]

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda span: span["kind"] == kind)).cast("long").alias(f"n_{kinds[kind]}")

    return found.select(
        "doc_id",
        *map(count, base),
        F.sha2(joined(F.filter("spans", lambda span: span["kind"].isin(base)), kinds), 256).alias("base_sha256"),
        joined(F.col("spans"), kinds).alias("spans"),
    )


def oracle(rules: Sequence[Rule] = RULES) -> str:
    """The report in DuckDB SQL: every expression on every text."""
    found = " UNION ALL ".join(
        f"""SELECT doc_id, {n} AS kind, '{rule.kind}' AS name, {rule.base} AS base, ends - size AS start, ends AS stop FROM (
    SELECT doc_id, size, asked, sum(whole) OVER (PARTITION BY doc_id ORDER BY i) AS ends FROM (
      SELECT doc_id, unnest(range(len(w))) AS i, length(unnest(w)) AS whole, length(unnest(m)) AS size,
        length(unnest(g)) AS asked FROM (
        SELECT doc_id, regexp_extract_all(text, '{cut}', 0) AS w, regexp_extract_all(text, '{cut}', 1) AS m,
          regexp_extract_all(text, '{cut}', {rule.group + 1}) AS g FROM documents
        WHERE text IS NOT NULL)))
    WHERE size > 0 AND asked >= {rule.least}"""
        for n, rule in enumerate(rules)
        for cut in [(r"[\s\S]*?(?:(" + rule.expression + r")|\z)").replace("'", "''")]
    )
    counts = ", ".join(
        f"count(*) FILTER (kind = {n}) AS n_{rule.kind}" for n, rule in enumerate(rules) if rule.base
    )
    span = "name || ':' || start || ':' || stop"
    empty = ", ".join(f"coalesce(n_{rule.kind}, 0) AS n_{rule.kind}" for rule in rules if rule.base)
    return f"""
WITH found AS ({found}),
per_doc AS (SELECT doc_id, {counts}, string_agg({span}, ',' ORDER BY start, kind) FILTER (base) AS base_spans,
    string_agg({span}, ',' ORDER BY start, kind) AS spans FROM found GROUP BY doc_id)
SELECT documents.doc_id, {empty}, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN per_doc USING (doc_id)
"""
