"""Exact distinct counts that can be merged: bitmaps of ids, cut into buckets.

The ids of one group and bucket are a bitmap of 32,768 bits. Bitmaps are built in the tasks before
the shuffle, and bitmaps of several groups are merged by OR, so totals over any groups come from
the bitmaps alone and no row is read again. Ids should be dense integers (``numbered`` makes
them so): a bucket costs 4 KB however few ids it has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.sources.tables import working_dir, written


def numbered(rows: DataFrame, column: str, folder: str) -> DataFrame:
    """column and _n, a number from 1 for each different value; gaps are smaller than a range of values.

    Values are sorted in ranges, numbered within, and counted before, so no task holds all of them.
    """
    from pyspark.sql import Window

    ranges = written(rows.select(column).filter(F.col(column).isNotNull()).distinct().repartitionByRange(column).withColumn("_part", F.spark_partition_id()), folder)
    sizes = ranges.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(column))
    return ranges.withColumn("_in", within).join(before, "_part").select(column, (F.col("_before") + F.col("_in")).alias("_n"))


def distinct_bitmaps(rows: DataFrame, groups: list[str], ident: Column | str) -> DataFrame:
    """groups, _bucket and _bits: the ids (integers, nulls left out) of each group."""
    ident = (F.col(ident) if isinstance(ident, str) else ident).cast("long")
    placed = rows.select(*groups, F.bitmap_bucket_number(ident).alias("_bucket"), F.bitmap_bit_position(ident).alias("_bit")).filter("_bit IS NOT NULL")
    return placed.groupBy(*groups, "_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def merged(bitmaps: DataFrame, groups: list[str]) -> DataFrame:
    """Bitmaps of fewer groups, from those of more: an id that several groups have is there once."""
    return bitmaps.groupBy(*groups, "_bucket").agg(F.bitmap_or_agg("_bits").alias("_bits"))


def counts(bitmaps: DataFrame, groups: list[str], name: str) -> DataFrame:
    """The number of different ids of each group."""
    return bitmaps.groupBy(*groups).agg(F.sum(F.bitmap_count("_bits")).alias(name))


def rollup(rows: DataFrame, group: str, measures: dict[str, Column | str], everything: str | None = None) -> DataFrame:
    """One row per group with the distinct counts of measures (name to id); and one named everything over all groups.

    Each measure has bitmaps of its own, so rows are never multiplied by the number of measures.
    """
    folder = working_dir(rows.sparkSession)
    base = rows.select(group).distinct() if everything is None else rows.select(group).distinct().unionByName(rows.sparkSession.createDataFrame([(everything,)], f"{group} string"))
    tables = []
    for n, (name, ident) in enumerate(measures.items()):
        maps = written(distinct_bitmaps(rows, [group], ident), f"{folder}/{n}")
        own = counts(maps, [group], name)
        if everything is not None:
            whole = counts(merged(maps, []), [], name).select(F.lit(everything).alias(group), name)
            own = own.unionByName(whole)
        tables.append(own.withColumnRenamed(group, f"_g{n}"))
    joined = reduce(lambda left, n: left.join(tables[n], F.col(group).eqNullSafe(F.col(f"_g{n}")), "left").drop(f"_g{n}"), range(len(tables)), base)
    return joined.na.fill(0, list(measures))
