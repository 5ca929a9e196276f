"""Content stamps, fingerprints and reports; ``generations`` replaces whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_stamp(content: Column) -> Column:
    """First 16 hex digits of the content's SHA-256."""
    return F.left(F.sha2(content.cast("binary"), 256), F.lit(16))


def surrogate_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.left(F.sha2(F.concat_ws("\n", *parts).cast("binary"), 256), F.lit(20)))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: n_rows and a fingerprint that ignores row order but not repeats.

    A row's SHA-256 is that of its JSON with sorted keys. Its eight words are summed over the rows, and
    the SHA-256 of these sums and the count is the fingerprint, so that no row is sorted or gathered.
    """
    digest = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
    words = [F.coalesce(F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for i in range(8)]
    sums = digest.agg(F.count("*").alias("n_rows"), F.concat_ws(":", F.count("*").cast("string"), *words).alias("sums"))
    return sums.select("n_rows", F.sha2("sums", 256).alias("fingerprint"))


def markdown_table(rows: list, columns: list[str]) -> str:
    """A report of a small aggregate."""
    lines = ["| " + " | ".join(columns) + " |", "|" + " - |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(str(r[c]) for c in columns) + " |" for r in rows])
