"""What the training-data operators share: table reads and the folder that all executors see."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallystone.sources.tables import delete_path, working_dir

__all__ = ["SPACE", "SPACE_CHARS", "WORD", "delete_path", "shared_dir", "table", "unused", "written"]

#: White space of the contracts, as the body of a character class.
SPACE = r"\x20\x09-\x0D"
#: A word is a longest run of other characters.
WORD = rf"[^{SPACE}]+"
#: The same white space as characters, for trimming.
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a parquet table; further columns stay unread."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir, which driver and executors share."""
    return working_dir(spark)


def written(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Cuts lineage: writes df as Parquet at a shared path and rereads it with its schema."""
    (df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
