"""Positions and running sums for groups of any size, in two steps: totals per block, then within the block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.session import cut_lean as cut, cut_lean_and_measure as cut_and_measure

LARGE = 1_000_000  # rows of a group from which it is numbered by range partitions

def _block_offsets(blocks: DataFrame, by: list[str], value: str) -> DataFrame:
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("_offset", F.coalesce(F.sum(value).over(before), F.lit(0)))


def position(df: DataFrame, by: list[str], key: str, out: str) -> DataFrame:
    """1-based position of every row in its group in the order of ``key``, nulls first; rows of one key follow each other in any order.

    Groups of up to ``LARGE`` rows are numbered in one shuffle by group, larger ones by range partitions. A null group is a group.
    """
    rows = cut(df)
    of_group = [F.col(c).alias(f"_l{i}") for i, c in enumerate(by)]
    large, seen = cut_and_measure(rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > LARGE).select("_n", *of_group), n=F.count(F.lit(1)))
    number = F.row_number().over(Window.partitionBy(*by).orderBy(key)).cast("bigint")
    if not seen["n"]:
        return rows.withColumn(out, number)
    same = [F.col(c).eqNullSafe(F.col(f"_l{i}")) for i, c in enumerate(by)] or [F.lit(True)]  # without keys all rows are one group
    small = rows.join(large, same, "left_anti").withColumn(out, number)
    return small.unionByName(_position_by_range(rows.join(large, same, "left_semi"), by, key, out))


def _position_by_range(df: DataFrame, by: list[str], key: str, out: str) -> DataFrame:
    """As ``position``, where no task holds a whole group.

    Rows are range-partitioned by group and key, with a number per row that lets a border fall between equal keys too, and
    sorted; so a task gets an equal part of all rows whatever group or key they belong to. What lies before each part of a group is
    added from the parts' sizes, a row per group and part.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *by, key, "_tie").sortWithinPartitions(*by, key, "_tie")
    rows = cut(ranged.withColumns({"_block": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}).drop("_tie"))
    sizes = rows.groupBy(*by, "_block").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    totals = _block_offsets(sizes, by, "_n").select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_block").alias("_b"), (F.col("_offset") - F.col("_first") + 1).alias("_shift"))
    same = [F.col("_block") == F.col("_b"), *[F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]]
    ranked = rows.join(totals, same).withColumn(out, F.col("_row") + F.col("_shift"))
    return ranked.select(*df.columns, out)


def running_sum(df: DataFrame, by: list[str], seq: str, value: Column, out: str, block: int = 1_000) -> DataFrame:
    """Sum of ``value`` up to each row of a group in the order of an integer sequence column."""
    blocked = df.withColumn("_value", value).withColumn("_block", F.floor(F.col(seq) / block))
    totals = _block_offsets(blocked.groupBy(*by, "_block").agg(F.sum("_value").alias("_total")), by, "_total").drop("_total")
    inside = Window.partitionBy(*by, "_block").orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = blocked.join(totals, [*by, "_block"]).withColumn(out, F.sum("_value").over(inside) + F.col("_offset"))
    return summed.drop("_block", "_offset", "_value")


def running_min(df: DataFrame, by: list[str], seq: str, value: Column, out: str, block: int = 1_000) -> DataFrame:
    """Smallest ``value`` of the rows before each row of a group (null for the first), in the order of ``seq``."""
    blocked = df.withColumn("_value", value).withColumn("_block", F.floor(F.col(seq) / block))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy(*by, "_block").agg(F.min("_value").alias("_least")).withColumn("_earlier", F.min("_least").over(before)).drop("_least")
    inside = Window.partitionBy(*by, "_block").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    joined = blocked.join(totals, [*by, "_block"]).withColumn("_here", F.min("_value").over(inside))
    return joined.withColumn(out, F.least("_earlier", "_here")).drop("_block", "_value", "_earlier", "_here")


def consecutive(stops: DataFrame, by: list[str], seq: str, *columns: str) -> DataFrame:
    """Each stop with the next one of its route, as an equi join on (route, seq): no task holds a whole route.

    ``seq`` counts 1, 2, 3, ... without gaps. Columns of the next stop get the prefix ``next_``.
    """
    following = stops.select(*by, (F.col(seq) - 1).alias(seq), *[F.col(c).alias(f"next_{c}") for c in columns])
    return stops.join(following, [*by, seq])
