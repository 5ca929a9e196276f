"""An index by rank: any page of an order for the price of the first.

Rows are written once in ranges of the order, sorted within, one folder for each range, with a small table
that says at which rank each range starts. A page then reads the one or two ranges that hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallystone.sources.tables import keep_schema, kept_schema


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(kept_schema(spark, f"{path}/schema")).parquet(f"{path}/rows")


def build(rows: DataFrame, order: list[Column], path: str, ranges: int | None = None) -> None:
    """Writes rows at path in the given order, which must be total. ranges is how many files there are, by default the session's shuffle partitions."""
    spark = rows.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()).sortWithinPartitions("_range", *order)
    dealt.write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
    keep_schema(rows.withColumn("_range", F.lit(0)), f"{path}/schema")
    sizes = _rows(spark, path).groupBy("_range").agg(F.count("*").alias("n"))
    # One row per range.
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes.select("_range", "n", before.alias("start")).coalesce(1).write.mode("overwrite").parquet(f"{path}/starts")


def page(spark: SparkSession, path: str, order: list[Column], number: int, size: int) -> DataFrame:
    """Page number (from 0, clamped to those that exist) of size rows, in order."""
    starts = spark.read.parquet(f"{path}/starts")
    total = starts.agg(F.sum("n")).first()[0] or 0
    first = min(max(number, 0), max(0, -(-total // size) - 1)) * size
    held = starts.filter((F.col("start") < first + size) & (F.col("start") + F.col("n") > first)).orderBy("_range").collect()
    rows = _rows(spark, path)
    if not held:
        return rows.drop("_range").limit(0)
    near = rows.filter(F.col("_range").isin(*(r["_range"] for r in held))).drop("_range")
    return near.orderBy(*order).offset(first - held[0].start).limit(size)


def ranked(rows: DataFrame, order: list[Column], path: str, name: str = "rank", ranges: int | None = None) -> DataFrame:
    """rows with their rank from 1 in a total order: numbered within each range, and counted before."""
    build(rows, order, path, ranges)
    spark = rows.sparkSession
    placed = _rows(spark, path).withColumn("_in", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    starts = spark.read.parquet(f"{path}/starts").select("_range", "start")
    return placed.join(starts, "_range").select(*rows.columns, (F.col("start") + F.col("_in")).alias(name))
