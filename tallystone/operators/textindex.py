"""A trigram index for substring search.

Postings say which rows hold which three characters in a row. They are dealt into folders by a checksum of
the trigram and sorted within, a trigram with all rows of some texts at once, so a query reads the folders of its own trigrams, and of each file
the row groups that hold them. Rows that have every trigram of the query are candidates; their
texts decide. Of long queries only the rarest trigrams are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.sources.tables import keep_schema, kept_schema, written

#: Folders of postings, and trigrams of a query that are read at most.
BUCKETS, MOST_READ = 64, 6
#: Characters of the texts whose postings a task makes at once.
CHARS = 2_000_000


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The different trigrams of each text as numbers, and the texts' places, sorted by trigram."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    place = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    inside = np.flatnonzero(place[:-2] == place[2:])  # not across the end of a text
    grams, place = codes[inside] << 42 | codes[inside + 1] << 21 | codes[inside + 2], place[inside]
    order = np.lexsort((place, grams))
    grams, place = grams[order], place[order]
    first = np.append(True, (grams[1:] != grams[:-1]) | (place[1:] != place[:-1]))[: len(grams)]
    return grams[first], place[first]


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (gram, ids) for each trigram of some texts (id, lower-cased text): as many as have CHARS characters, or one longer text."""
    for b in batches:
        texts = [t or "" for t in b.column(1).to_pylist()]
        ends = np.cumsum([len(t) for t in texts])
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHARS, "right")))
            grams, place = _trigrams(texts[lo:hi])
            starts = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])[: len(grams)])
            names = ["".join(map(chr, (g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF))) for g in grams[starts].tolist()]
            ids = pa.ListArray.from_arrays(pa.array(np.append(starts, len(grams)), pa.int32()), b.column(0).take(pa.array(place + lo)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), ids], ["gram", "ids"])
            lo = hi


def _bucket(gram: Column) -> Column:
    return (F.crc32(gram.cast("binary")) % BUCKETS).cast("int")


def _postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(kept_schema(spark, f"{path}/schema")).parquet(f"{path}/postings")


def build(rows: DataFrame, ident: str, text: str, path: str) -> None:
    """Writes the index of rows (ident, text) at path: postings, and how many rows hold each trigram."""
    lowered = rows.select(F.col(ident).alias("id"), F.lower(F.col(text)).alias("text"))
    spread = lowered.mapInArrow(_spread, f"gram string, ids array<{lowered.schema['id'].dataType.simpleString()}>").withColumn("bucket", _bucket(F.col("gram")))
    # Not by bucket alone: a trigram that a third of all rows hold fills several files.
    dealt = spread.repartition("bucket", F.pmod(F.xxhash64("ids"), F.lit(4)))
    dealt.sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    keep_schema(spread, f"{path}/schema")
    written(_postings(rows.sparkSession, path).groupBy("gram").agg(F.sum(F.size("ids")).alias("n")).sort("gram"), f"{path}/grams")


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """id of the rows that hold every trigram that is read for query; None for queries under three characters, which may be anywhere."""
    wanted = query.strip().lower()
    grams = {wanted[i : i + 3] for i in range(len(wanted) - 2)}
    if not grams:
        return None
    # At most one row per trigram of the query.
    known = {r.gram: r.n for r in spark.read.parquet(f"{path}/grams").filter(F.col("gram").isin(*grams)).collect()}
    postings = _postings(spark, path)
    if len(known) < len(grams):
        return postings.select(F.explode("ids").alias("id")).limit(0)
    rare = sorted(known, key=lambda g: (known[g], g))[:MOST_READ]
    buckets = {zlib.crc32(g.encode()) % BUCKETS for g in rare}
    read = postings.filter(F.col("bucket").isin(*buckets) & F.col("gram").isin(*rare))
    # Rows that repeat an id count once for a trigram.
    return read.select("gram", F.explode("ids").alias("id")).groupBy("id").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(rare)).select("id")


def search(rows: DataFrame, ident: str, text: str, path: str, query: str) -> DataFrame:
    """The rows whose text contains query, whatever the letter case; the same as a scan with ``facets.search``."""
    found = candidates(rows.sparkSession, path, query)
    read = rows if found is None else rows.join(found.withColumnRenamed("id", ident), ident, "left_semi")
    return read.filter(F.contains(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(query.strip().lower())))
