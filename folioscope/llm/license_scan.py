"""License scan: exact set-similarity join of text blocks with license notices, by containment of the notice.

Words of the notices are put in one global order, rare before frequent, by how many documents have them. A block that
holds at least ``percent`` percent of a notice's words shares one of the first n - ceil(percent * n) + 1 of them, so
blocks and notices meet on those alone; the numbers of words on both sides and the places of the shared word rule out
most of what meets, and the rest is verified. All of it is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.scratch import Scratch

NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Phrases that name a license, and its label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Sentences by which licenses ask to be recognised.
NOTICES = {
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "cc-by": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ),
}


@dataclass(frozen=True)
class LicenseOptions:
    """A block is a line with the ``lines`` - 1 lines after it, and with as many more as a notice may be wrapped over:
    those that begin before the lines after the first have ``room`` times the notice's words. Lines without a word do
    not count."""

    percent: int = 80
    lines: int = 3
    room: int = 2
    notices: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: NOTICES)
    phrases: Mapping[str, str] = field(default_factory=lambda: PHRASES)


def lowered(text: Column) -> Column:
    """Lower-case A-Z. ``lower`` does that for texts of ASCII; in others only A-Z may change."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, NOT_WORD), "")


def _plain_words(text: str) -> list[str]:
    kept = "".join(letter if letter.isalnum() or ord(letter) > 127 else " " for letter in text)
    return kept.lower().split()


def phrase_starts(words: Column, phrases: Mapping[str, str]) -> Column:
    """Places where phrases stand, as structs of start and label."""

    def places_of(all_words: Column, places: Column, phrase: list[str], label: str) -> Column:
        def stands(place: Column) -> Column:
            held = F.get(all_words, place) == phrase[0]
            for n, word in enumerate(phrase[1:], 1):
                held = held & F.coalesce(F.get(all_words, place + n) == word, F.lit(False))
            return held

        return F.transform(
            F.filter(places, stands),
            lambda place: F.struct(place.cast("long").alias("start"), F.lit(label).alias("label")),
        )

    def found(all_words: Column) -> Column:
        firsts = sorted({_plain_words(phrase)[0] for phrase in phrases})
        places = F.array_compact(F.transform(all_words, lambda word, n: F.when(word.isin(firsts), n)))
        return F.concat(
            *(places_of(all_words, places, _plain_words(phrase), label) for phrase, label in phrases.items())
        )

    return F.element_at(F.transform(F.array(words), found), 1)


def notice_table(options: LicenseOptions) -> list[tuple[int, str, list[str]]]:
    """Number, label and distinct words of each notice. Bounded by the notices given."""
    rows = [(label, text) for label, texts in options.notices.items() for text in texts]
    return [(n, label, sorted(set(_plain_words(text)))) for n, (label, text) in enumerate(rows)]


def matched_notices(rows: DataFrame, options: LicenseOptions, scratch: Scratch) -> DataFrame:
    """``doc_id``, ``key``, ``label`` and ``contained`` (share of the notice's words), the best block of each label.

    ``rows`` has ``doc_id``, ``key`` and ``text``. Lines are reduced to words of the notices where they are read; a
    block goes on only if it has enough of them for the shortest notice.
    """
    spark = rows.sparkSession
    notices = notice_table(options)
    vocabulary = sorted({word for _, _, words in notices for word in words})
    least = min(-(-len(words) * options.percent // 100) for _, _, words in notices)
    rooms = [options.room * len(_plain_words(text)) for texts in options.notices.values() for text in texts]
    lines = F.transform(
        F.transform(F.split("text", "\n"), lambda line: words_of(F.lower(line))),
        lambda words: F.struct(
            F.array_distinct(F.filter(words, lambda word: word.isin(vocabulary))).alias("words"),
            F.size(words).alias("count"),
        ),
    )
    lines = F.filter(lines, lambda line: line["count"] > 0)
    reduced = scratch.write(rows.select("doc_id", "key", lines.alias("lines")), "reduced")
    # Over all documents: how many have each word of the notices.
    counted = (
        reduced.select(F.explode(F.array_distinct(F.flatten("lines.words"))).alias("word")).groupBy("word").count().collect()
    )
    count = {row["word"]: row["count"] for row in counted}
    rank = {word: n for n, word in enumerate(sorted(vocabulary, key=lambda word: (count.get(word, 0), word)))}
    ranks = F.create_map(*(F.lit(part) for word, n in rank.items() for part in (word, n)))
    entries = []
    for number, label, words in notices:
        ordered = sorted(rank[word] for word in words)
        needed = -(-len(ordered) * options.percent // 100)
        for place, element in enumerate(ordered[: len(ordered) - needed + 1]):
            entries.append((element, place, number, label, ordered, needed, rooms[number]))
    prefixes = spark.createDataFrame(
        entries, "element int, place int, notice int, label string, elements array<int>, needed int, room int"
    )

    most = max(rooms)

    def placed(words: Column, before: Column) -> Column:
        return F.transform(words, lambda word: F.struct(word.alias("word"), before.alias("before")))

    def window(all_lines: Column) -> Column:
        """Blocks of all lines: their words, each with how many words stand between the first line and its own; 0 in
        the lines that every block has."""

        def words_in(first: Column, count: int) -> Column:
            return F.aggregate(F.slice(all_lines, first, count), F.lit(0), lambda sum_, line: sum_ + line["count"])

        def block(line: Column, n: Column) -> Column:
            # Of slice(), places begin at 1.
            own = F.flatten(F.slice(all_lines, n + 1, options.lines)["words"])
            base, behind = placed(F.array_distinct(own), F.lit(0)), n + 1 + options.lines

            def grown(count: int) -> Column:
                return F.aggregate(
                    F.slice(all_lines, behind, count),
                    F.struct(words_in(n + 2, options.lines - 1).alias("sum"), base.alias("words")),
                    lambda held, more: F.when(held["sum"] >= most, held).otherwise(
                        F.struct(
                            (held["sum"] + more["count"]).alias("sum"),
                            F.concat(held["words"], placed(more["words"], held["sum"])).alias("words"),
                        )
                    ),
                    lambda held: held["words"],
                )

            # Only where lines are short are many of them looked at. A line has a word at least.
            return (
                F.when((words_in(n + 2, options.lines - 1) >= most) | (behind > F.size(all_lines)), base)
                .when(words_in(n + 2, 10) >= most, grown(10))
                .otherwise(grown(most))
            )

        return F.transform(all_lines, block)

    blocks = F.element_at(F.transform(F.array(F.col("lines")), window), 1)
    blocks = F.array_distinct(F.filter(blocks, lambda block: F.size(F.array_distinct(block["word"])) >= least))
    ranked = F.sort_array(
        F.transform("block", lambda each: F.struct(ranks[each["word"]].alias("rank"), each["before"].alias("before")))
    )
    # Of a word that stands in a block more than once, its first place.
    held = (
        reduced.select("doc_id", "key", F.explode(blocks).alias("block"))
        .withColumn("block", ranked)
        .withColumn(
            "block",
            F.filter("block", lambda each, n: (n == 0) | (F.get("block", n - 1)["rank"] != each["rank"])),
        )
        .select("doc_id", "key", "block", F.posexplode("block.rank").alias("at", "element"))
    )
    # The notices are constants, so their table is broadcast.
    met = held.join(F.broadcast(prefixes), "element").filter(
        # Length; then place: what follows the shared word on both sides must be enough.
        (F.size("block") >= F.col("needed"))
        & (F.least(F.size("block") - F.col("at"), F.size("elements") - F.col("place")) + F.col("place") >= F.col("needed"))
    )
    near = F.filter("block", lambda each: each["before"] < F.col("room"))
    common = F.size(F.array_intersect(near["rank"], "elements"))
    return (
        met.withColumn("common", common)
        .filter(F.col("common") >= F.col("needed"))
        .groupBy("doc_id", "key", "label")
        .agg(F.max(F.col("common") / F.size("elements")).alias("contained"))
    )


def scan(docs: DataFrame, options: LicenseOptions | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_base`` (places of phrases), ``first_word`` and ``last_word``
    (their smallest and largest start, null without one), ``base_labels``, ``labels`` (those and the notices' labels,
    distinct, sorted, comma-joined) and ``score``: 1 with a phrase, else the best containment, else 0.

    Cases: a null text is empty; a null id is returned; rows that repeat are scanned each; an empty table gives no
    rows; other columns are ignored.
    """
    options = options or LicenseOptions()
    scratch = Scratch(docs.sparkSession, "licenses")
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    last_words = sorted({_plain_words(phrase)[-1] for phrase in options.phrases})
    possible = F.lit(False)
    for word in last_words:
        possible = possible | F.contains(F.lower("text"), F.lit(word))
    counted = scratch.write(
        rows.select(
            "doc_id",
            "key",
            F.size(words_of(F.col("text"))).cast("long").alias("n_words"),
            F.when(possible, phrase_starts(words_of(lowered(F.col("text"))), options.phrases)).alias("found"),
        ),
        "phrases",
    )
    matched = (
        matched_notices(rows, options, scratch)
        .groupBy("doc_id", "key")
        .agg(F.collect_set("label").alias("near"), F.max("contained").alias("contained"))
        .withColumnsRenamed({"doc_id": "doc_of", "key": "key_of"})
    )
    both = counted.join(
        matched, F.col("doc_id").eqNullSafe(F.col("doc_of")) & F.col("key").eqNullSafe(F.col("key_of")), "left"
    )
    starts = F.transform("found", lambda place: place["start"])
    base = F.coalesce(F.array_distinct(F.transform("found", lambda place: place["label"])), F.array().cast("array<string>"))
    near = F.coalesce("near", F.array().cast("array<string>"))
    count = F.coalesce(F.size("found"), F.lit(0)).cast("long")
    count = F.when(F.col("found").isNull(), 0).otherwise(count).cast("long")
    return both.select(
        "doc_id",
        "n_words",
        count.alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, near)), ",").alias("labels"),
        F.when(count > 0, 1.0).otherwise(F.coalesce("contained", F.lit(0.0))).alias("score"),
    )


def oracle(options: LicenseOptions | None = None) -> str:
    """The scan in DuckDB SQL: every line block against every notice."""
    options = options or LicenseOptions()
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    phrases = ", ".join(
        "('{}', {})".format(label, "[" + ", ".join(f"'{part}'" for part in _plain_words(phrase)) + "]")
        for phrase, label in options.phrases.items()
    )
    notices = ", ".join(
        f"({n}, '{label}', [" + ", ".join(f"'{part}'" for part in words) + "])"
        for n, label, words in notice_table(options)
    )
    return f"""
WITH phrases(label, p) AS (VALUES {phrases}),
notices(notice, label, t) AS (VALUES {notices}),
vocabulary AS (SELECT DISTINCT unnest(t) AS word FROM notices),
texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, regexp_extract_all({low.format('text')}, '{word}') AS w FROM texts),
places AS (SELECT doc_id, start, label FROM (SELECT doc_id, w, unnest(range(len(w))) AS start FROM words), phrases
  WHERE w[start + 1] = p[1] AND w[start + 1 : start + len(p)] = p),
base AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
    list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
tokens AS (SELECT DISTINCT doc_id, n - more AS n, x FROM
    (SELECT doc_id, n, unnest(w) AS x FROM
      (SELECT doc_id, n, regexp_extract_all({low.format('line')}, '{word}') AS w FROM
        (SELECT doc_id, unnest(range(len(parts))) AS n, unnest(parts) AS line FROM
          (SELECT doc_id, string_split(text, chr(10)) AS parts FROM texts)))),
    (SELECT unnest(range({options.lines})) AS more)
  WHERE n >= more AND x IN (SELECT word FROM vocabulary)),
notice_words AS (SELECT notice, label, len(t) AS size, unnest(t) AS x FROM notices),
near AS (SELECT doc_id, list(DISTINCT label) AS labels, max(common / size) AS contained FROM
    (SELECT doc_id, n, notice, label, size, count(*) AS common FROM tokens JOIN notice_words USING (x) GROUP BY ALL)
  WHERE 100 * common >= {options.percent} * size GROUP BY doc_id)
SELECT words.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(near.labels, [])))), ','), '')
    AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(contained, 0.0) END::DOUBLE AS score
FROM words LEFT JOIN base USING (doc_id) LEFT JOIN near USING (doc_id)
"""
