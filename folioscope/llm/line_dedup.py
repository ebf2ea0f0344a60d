"""Site-relative line frequency: a line that a large part of one host's pages carries is boilerplate there."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.scratch import Scratch

SPACE = " \t\n\x0b\x0c\r"
# Spread of one host's pages over tasks where the table of dropped lines is too large to broadcast.
SALTS = 64


@dataclass(frozen=True)
class LineOptions:
    """A line goes where more than ``percent`` percent of the host's pages carry it and at least ``least_pages`` do.

    A host has at most (lines a page) * 100 / ``percent`` such lines, whatever its size. Their table is broadcast up
    to ``broadcast_lines`` rows (16 bytes each) and met by a salted shuffle beyond. Copies of one text are one page of
    their host, or, with ``copies``, a page each.
    """

    percent: int = 5
    least_pages: int = 5
    broadcast_lines: int = 1_000_000
    copies: bool = False


def line_keys(text: Column) -> Column:
    """64-bit keys of the lines of a text, trimmed; null for a line without text, which is never boilerplate."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda line: F.when(F.btrim(line, F.lit(SPACE)) != "", F.xxhash64(F.btrim(line, F.lit(SPACE)))),
    )


def boilerplate(pages: DataFrame, options: LineOptions) -> DataFrame:
    """``host``, ``line`` (key), ``pages`` and ``host_pages`` of every line to drop.

    ``pages`` has ``host`` and ``text``. A page counts once for a line it repeats. Counts are combined before the
    shuffle, so neither a host with a third of all pages nor a line on all of them makes a heavy task.
    """
    keys = F.array_distinct(line_keys(F.col("text"))).alias("keys")
    if options.copies:
        texts, each = pages.select("host", keys), pages.select("host")
    else:
        # Copies are combined before the shuffle.
        hashed = pages.withColumn("hash", F.xxhash64("text"))
        texts = hashed.select("host", "hash", keys).groupBy("host", "hash").agg(F.first("keys").alias("keys"))
        each = hashed.select("host", "hash").distinct()
    lines = texts.select("host", F.explode("keys").alias("line"))
    counted = lines.filter("line is not null").groupBy("host", "line").agg(F.count("*").alias("pages"))
    counted = counted.filter(F.col("pages") >= options.least_pages)
    hosts = each.groupBy("host").agg(F.count("*").alias("host_pages"))
    hosts = hosts.withColumnRenamed("host", "host_of")
    return (
        counted.join(hosts, F.col("host").eqNullSafe(F.col("host_of")))
        .filter(100 * F.col("pages") > options.percent * F.col("host_pages"))
        .select("host", "line", "pages", "host_pages")
    )


def without_boilerplate(docs: DataFrame, options: LineOptions | None = None, host: str = "source") -> DataFrame:
    """The rows of ``docs`` with boilerplate lines cut from ``text``; all other columns as they were.

    Cases: a null host is a host of its own; a null text stays null and counts as a page without lines; an empty or
    blank line is kept; a text of which every line goes becomes empty; repeated texts of a host count once, so a group
    of copies is not boilerplate for being one; an empty table gives no rows. A page loses every copy of a dropped line. Lines are compared after trimming and by a 64-bit key.
    """
    options = options or LineOptions()
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    pages = docs.select(F.col(host).cast("string").alias("host"), "text")
    dropped = scratch.write(boilerplate(pages, options), "dropped")
    by_host = dropped.groupBy("host").agg(F.collect_list("line").alias("lines"))
    taken = [name.lower() for name in docs.columns]
    key, gone, salt, left_salt = (
        next(name + "_" * n for n in range(99) if (name + "_" * n) not in taken)
        for name in ("host_key", "gone_lines", "host_salt", "page_salt")
    )
    by_host = by_host.select(F.col("host").alias(key), F.col("lines").alias(gone))
    same_host = docs[host].cast("string").eqNullSafe(F.col(key))
    if dropped.count() <= options.broadcast_lines:
        joined = docs.join(F.broadcast(by_host), same_host, "left")
    else:
        salted = by_host.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        page = docs.withColumn(left_salt, F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))
        joined = page.join(salted, same_host & (F.col(left_salt) == F.col(salt)), "left")
    lines = F.split("text", "\n")
    keys = line_keys(F.col("text"))
    kept = F.filter(
        F.arrays_zip(lines.alias("line"), keys.alias("key")),
        lambda pair: ~F.coalesce(F.array_contains(F.col(gone), pair["key"]), F.lit(False)),
    )
    text = F.when(
        F.coalesce(F.arrays_overlap(keys, F.col(gone)), F.lit(False)),
        F.array_join(F.transform(kept, lambda pair: pair["line"]), "\n"),
    ).otherwise(F.col("text"))
    return joined.select(*(text.alias("text") if name == "text" else F.col(f"`{name}`") for name in docs.columns))


def line_report(docs: DataFrame, options: LineOptions | None = None, host: str = "source") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_lines``, ``n_kept`` and the cleaned ``text``. Cases as in
    ``without_boilerplate``: copies of one text are one page of their host."""

    def lines(text: str) -> Column:
        return F.when(F.col(text).isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long")

    before = docs.select("doc_id", F.col(host).alias("host"), "text", lines("text").alias("n_lines"))
    cleaned = without_boilerplate(before, options, "host")
    left = F.when(F.col("text") == "", 0).otherwise(lines("text"))
    return cleaned.select("doc_id", "n_lines", left.alias("n_kept"), "text")


def oracle(options: LineOptions = LineOptions()) -> str:
    """The same in DuckDB SQL. Pages of a host are its distinct texts, null one of them."""
    return f"""
WITH numbered AS MATERIALIZED (SELECT row_number() OVER () AS rowid, doc_id, source, text FROM documents),
lines AS (SELECT id, source, spot, line, trim(line, e' \\t\\n\\x0b\\x0c\\r') AS cut, text FROM (
    SELECT id, source, text, unnest(range(1, len(parts) + 1)) AS spot, unnest(parts) AS line
    FROM (SELECT rowid AS id, source, text, string_split(text, chr(10)) AS parts FROM numbered))),
hosts AS (SELECT source, count(DISTINCT text) + max((text IS NULL)::INTEGER) AS host_pages FROM documents GROUP BY source),
dropped AS (SELECT source, cut FROM (SELECT source, cut, count(DISTINCT text) AS pages FROM lines
    WHERE cut <> '' GROUP BY source, cut) JOIN hosts USING (source)
  WHERE pages >= {options.least_pages} AND 100 * pages > {options.percent} * host_pages),
kept AS (SELECT id, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY spot) AS text FROM lines
  WHERE NOT EXISTS (SELECT 1 FROM dropped WHERE dropped.source = lines.source AND dropped.cut = lines.cut)
  GROUP BY id)
SELECT doc_id, len(string_split(numbered.text, chr(10))) AS n_lines,
  CASE WHEN coalesce(kept.text, '') = '' THEN 0 ELSE n_kept END AS n_kept, coalesce(kept.text, '') AS text
FROM numbered LEFT JOIN kept ON kept.id = numbered.rowid
"""
