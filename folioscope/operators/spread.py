"""Ways to keep one heavy key from ending up in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024
SALTS = 64
# A key is heavy from this many rows on. A table of N rows has at most N / HEAVY_ROWS heavy keys, which is
# what bounds the table that is broadcast for them.
HEAVY_ROWS = 5_000_000


def heavy_keys(rows: DataFrame, key: str, threshold: int = HEAVY_ROWS) -> DataFrame:
    """Keys with more than ``threshold`` rows. Counts are combined before the shuffle."""
    return rows.groupBy(key).count().filter(F.col("count") > threshold).select(key)


def attach(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    spread_by: Sequence[str],
    heavy: DataFrame | None = None,
) -> DataFrame:
    """Left join to a table with unique keys, with the rows of heavy keys kept out of the shuffle by key.

    Heavy keys find their partner in a broadcast table of at most N / HEAVY_ROWS rows. In the shuffle join their
    rows carry a salt no partner has, so they spread over all tasks; all other keys have salt 0.
    """
    columns = [name for name in lookup.columns if name != key]
    partner = F.struct(*columns)
    heavy = heavy_keys(rows, key) if heavy is None else heavy
    near = lookup.join(F.broadcast(heavy), key, "left_semi").select(key, partner.alias("near"))
    far = lookup.select(key, partner.alias("far"), F.lit(0).alias("salt"))
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int") + 1
    joined = (
        rows.join(F.broadcast(near), key, "left")
        .withColumn("salt", F.when(F.col("near").isNull(), 0).otherwise(salt))
        .join(far, [key, "salt"], "left")
        .withColumn("partner", F.coalesce("near", "far"))
    )
    return joined.select(*rows.columns, *(F.col("partner")[name].alias(name) for name in columns))


def block_of(position: str, block: int = BLOCK) -> Column:
    return F.floor(F.col(position) / block).cast("long")


def attach_in_blocks(rows: DataFrame, lookup: DataFrame, key: str, position: str, block: int = BLOCK) -> DataFrame:
    """Inner join to a table with unique keys, on the key and the block of the row's position.

    No block has more than ``block`` rows, so no key is heavy, and ``running`` works on the result without moving
    the rows again. The lookup is repeated once per block that occurs.
    """
    blocked = rows.withColumn("block", block_of(position, block))
    occurring = blocked.select(key, "block").distinct()
    return blocked.join(occurring.join(lookup, key), [key, "block"])


def running(
    rows: DataFrame,
    group: str,
    position: str,
    values: Mapping[str, Column],
    block: int = BLOCK,
) -> DataFrame:
    """Add ``NAME_before`` (sum over earlier rows of the group) and ``NAME_total`` for every named value.

    ``position`` is a unique whole number within the group. Rows are windowed per block of ``block`` positions, so
    no task holds a whole group; only groups that reach beyond their first block need the totals of their blocks,
    which are ``block`` times fewer narrow rows.
    """
    blocked = rows if "block" in rows.columns else rows.withColumn("block", block_of(position, block))
    for name, value in values.items():
        blocked = blocked.withColumn(name, value)
    long_groups = (
        blocked.filter((F.col(position) >= block) | (F.col(position) < 0)).select(group).distinct()
    )
    per_block = (
        blocked.join(long_groups, group, "left_semi")
        .groupBy(group, "block")
        .agg(*(F.sum(name).alias(name) for name in values))
    )
    over_blocks = Window.partitionBy(group).orderBy("block")
    earlier = over_blocks.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    offsets = per_block.select(
        group,
        "block",
        *(F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"{name}_offset") for name in values),
        *(F.sum(name).over(whole).alias(f"{name}_all") for name in values),
    )
    in_block = Window.partitionBy(group, "block").orderBy(position)
    before = in_block.rowsBetween(Window.unboundedPreceding, -1)
    all_block = Window.partitionBy(group, "block")
    windowed = blocked
    for name in values:
        windowed = windowed.withColumn(f"{name}_before", F.coalesce(F.sum(name).over(before), F.lit(0)))
        windowed = windowed.withColumn(f"{name}_total", F.sum(name).over(all_block))
    joined = windowed.join(offsets, [group, "block"], "left")
    for name in values:
        joined = joined.withColumn(
            f"{name}_before", F.col(f"{name}_before") + F.coalesce(f"{name}_offset", F.lit(0))
        ).withColumn(f"{name}_total", F.coalesce(f"{name}_all", f"{name}_total"))
    return joined.drop("block", *(f"{name}_offset" for name in values), *(f"{name}_all" for name in values))


def top_k(
    rows: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """The first ``k`` rows per group with their 1-based rank.

    With ``spread_by`` a group is first cut per salt, so one task gets at most SALTS * k rows of it.
    """
    if spread_by:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)))
        within = Window.partitionBy(*by, "salt").orderBy(*order)
        rows = rows.withColumn(rank, F.row_number().over(within)).filter(F.col(rank) <= k).drop("salt", rank)
    window = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
