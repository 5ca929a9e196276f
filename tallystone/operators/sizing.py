"""Size accounting that counts each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated_bytes(files: DataFrame, order: list[str]) -> DataFrame:
    """Total of known sizes, each file once: by checksum with exact size, else by canonical key.

    files: checksum_id, key, size_bytes, precision. An unknown size is not a size of zero.
    """
    ident = F.coalesce("checksum_id", "key")
    one = files.withColumn("_id", ident).groupBy("_id").agg(F.min_by(F.struct("size_bytes", "precision"), F.struct(*order)).alias("f"), F.count("*").alias("n"))
    return one.agg(
        F.coalesce(F.sum("f.size_bytes"), F.lit(0)).alias("known_bytes"), F.count_if(F.col("f.size_bytes").isNotNull()).alias("known"),
        F.count_if(F.col("f.size_bytes").isNull()).alias("unknown"), F.count_if(F.col("f.precision") == "estimated").alias("estimated"),
        F.sum(F.col("n") - 1).alias("duplicates"),
    )


def known_bytes(files: DataFrame) -> DataFrame:
    """Sum over all links, copies included."""
    return files.agg(F.sum("size_bytes").alias("known_bytes"))
