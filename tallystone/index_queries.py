"""Queries over indexes, nested entities, bitmaps and stateful streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tallystone.operators import bitmaps, entities, rankindex, textindex
from tallystone.registry import query
from tallystone.sources.tables import table, working_dir
from tallystone.streaming import sources

# Nested entities


def _entities(spark: SparkSession, d: str) -> DataFrame:
    """Parts as entities: one release for each supplier, flag and status of a part's lines, its lines as links."""
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity").join(
        table(spark, d, "supplier", F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey"), "l_suppkey"
    )
    kind = F.element_at(F.create_map(*(F.lit(x) for x in ("A", "base", "R", "update", "N", "other"))), F.col("l_returnflag"))
    link = F.struct("l_orderkey", "l_linenumber", F.concat_ws(" ", F.lit("order"), F.col("l_orderkey").cast("string"), F.lit("line"), F.col("l_linenumber").cast("string")).alias("label"), kind.alias("kind"), F.col("l_linestatus").alias("region"))
    release = lines.groupBy("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").agg(
        F.array_sort(F.collect_list(link)).alias("links"), F.first("s_name").alias("source"), F.first(kind).alias("kind"), (F.max("l_quantity") >= 50).alias("conflict")
    )
    fields = F.struct("l_suppkey", "l_returnflag", "l_linestatus", "source", "kind", "conflict", F.array("l_linestatus").alias("regions"), F.lit(False).alias("region_conflict"), "links")
    nested = release.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.array_sort(F.collect_list(fields)).alias("releases"))
    part = table(spark, d, "part", "p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("source"), F.array("p_type").alias("aliases"))
    return part.join(nested, "p_partkey")


_RELEASES = """
WITH l AS (SELECT l_partkey, l_suppkey, l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_quantity, 'order ' || l_orderkey || ' line ' || l_linenumber AS label,
    CASE l_returnflag WHEN 'A' THEN 'base' WHEN 'R' THEN 'update' ELSE 'other' END AS kind FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
r AS (SELECT *, max(l_quantity) OVER (PARTITION BY l_partkey, l_suppkey, l_returnflag, l_linestatus) >= 50 AS conflict FROM l),
e AS (SELECT p_partkey, count(DISTINCT l_suppkey || '/' || l_returnflag || '/' || l_linestatus) AS n_releases, count(*) AS total_links,
    lower(p_name || ' ' || p_brand || ' ' || p_type || ' ' || string_agg(label || ' ' || kind || ' ' || l_linestatus, ' ' ORDER BY l_suppkey, l_returnflag, l_linestatus, l_orderkey, l_linenumber)) AS found
  FROM r JOIN part ON p_partkey = l_partkey WHERE {facets} GROUP BY p_partkey, p_name, p_brand, p_type)
SELECT p_partkey, n_releases, total_links, md5(found) AS search_md5 FROM e WHERE contains(found, '{text}')
"""


def _found(found: DataFrame) -> DataFrame:
    return found.select("p_partkey", F.size("releases").cast("long").alias("n_releases"), F.col("total_links").cast("long").alias("total_links"), F.md5(entities.search_text(found).cast("binary")).alias("search_md5"))


@query(_RELEASES.format(facets="kind = 'update' AND NOT conflict AND l_linestatus = 'F'", text="line 7"))
def entity_search(spark: SparkSession, d: str) -> DataFrame:
    """Hits are in links that the facets left; a line 7 of another kind does not count."""
    return _found(entities.find(_entities(spark, d), " LINE 7 ", kind="update", region="F"))


@query(_RELEASES.format(facets="kind NOT IN ('base', 'update') OR conflict", text="order 1"))
def entity_search_unknown(spark: SparkSession, d: str) -> DataFrame:
    """The releases without a known kind, or with a conflict."""
    return _found(entities.find(_entities(spark, d), "order 1", kind="unknown"))


# Indexes


@query("""
SELECT 'part' AS kind, p_partkey AS id, p_name AS name FROM part WHERE lower(concat_ws(' ', p_name, p_brand, p_type)) LIKE '%bolt brand#1%'
UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier WHERE lower(s_name) LIKE '%00007%'
""")
def text_search_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Substring search by trigram postings: the same rows as a scan."""
    folder = working_dir(spark)
    part = table(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    supplier = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_name").alias("text"))
    hits = []
    for n, (rows, wanted) in enumerate([(part, " Bolt Brand#1"), (supplier, "00007 ")]):
        textindex.build(rows, "id", "text", f"{folder}/{n}")
        hits.append(textindex.search(rows, "id", "text", f"{folder}/{n}", wanted).select("kind", "id", "name"))
    return hits[0].unionByName(hits[1])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 1125 LIMIT 75")
def page_by_rank(spark: SparkSession, d: str) -> DataFrame:
    """A page deep in the order, from the ranges that hold it."""
    folder, order = working_dir(spark), [F.desc("o_totalprice"), F.asc("o_orderkey")]
    rankindex.build(table(spark, d, "orders", "o_orderkey", "o_totalprice"), order, folder, 16)
    return rankindex.page(spark, folder, order, 15, 75)


# Mergeable distinct counts


@query("""
WITH l AS (SELECT n_name AS region, l_orderkey, l_partkey, l_suppkey, l_returnflag FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)
SELECT region, count(DISTINCT l_orderkey) AS n_links, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS n_base_entities FROM l GROUP BY region
UNION ALL SELECT 'all', count(DISTINCT l_orderkey), count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_suppkey END) FROM l
""")
def nation_totals(spark: SparkSession, d: str) -> DataFrame:
    """Distinct counts per nation and over all nations; the total merges the nations' bitmaps."""
    nation = table(spark, d, "supplier", F.col("s_suppkey").alias("l_suppkey"), "s_nationkey").join(table(spark, d, "nation", F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("region")), "s_nationkey")
    lines = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_returnflag").join(nation, "l_suppkey")
    return bitmaps.rollup(lines, "region", {"n_links": "l_orderkey", "n_base_entities": F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))}, everything="all")


# State per source

_BREAKER = """
WITH RECURSIVE e AS (SELECT user_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (
  SELECT user_id, 0::BIGINT AS n, NULL::TIMESTAMP AS held_at, 0::BIGINT AS run, 0::BIGINT AS n_done, 0::BIGINT AS n_waiting, 0::BIGINT AS n_opened FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT s.user_id, e.n,
    CASE WHEN event_type = 'signup' THEN NULL WHEN held_at IS NOT NULL THEN held_at WHEN event_type = 'error' AND run >= 1 THEN e.ts END,
    CASE WHEN event_type = 'signup' THEN 0 WHEN held_at IS NOT NULL THEN run WHEN event_type = 'error' THEN run + 1 ELSE 0 END,
    n_done + CASE WHEN event_type = 'signup' OR held_at IS NULL THEN 1 ELSE 0 END, n_waiting + CASE WHEN event_type <> 'signup' AND held_at IS NOT NULL THEN 1 ELSE 0 END,
    n_opened + CASE WHEN event_type = 'error' AND held_at IS NULL AND run >= 1 THEN 1 ELSE 0 END
  FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT user_id, held_at IS NOT NULL AS held, held_at, run, n_done, n_waiting, n_opened FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1
"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


@query(_BREAKER)
def source_breaker(spark: SparkSession, d: str) -> DataFrame:
    """Two errors in a row hold a user's events until the next signup."""
    rows = sources.breaker_batch(_events(spark, d), "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "signup", 2)
    return rows.withColumn("held_at", F.col("held_at").cast("timestamp_ntz"))


#: Files of a batch. A user's events of one batch are in one file, so wherever a stream parts files into batches, it has them in their order.
_FILES = 16


def _in_files(events: DataFrame, batch: Column, most: int, folder: str) -> str:
    """Writes events as files of each batch number below most, in that order; by many tasks, and each row read once by its batch."""
    events.withColumn("_batch", batch).write.partitionBy("_batch").parquet(f"{folder}-staged")
    staged = events.sparkSession.read.schema(StructType([*events.schema.fields, StructField("_batch", IntegerType())])).parquet(f"{folder}-staged")
    for n in range(most):
        staged.filter(F.col("_batch") == n).drop("_batch").repartition(_FILES, "user_id").write.mode("append").parquet(folder)
    return folder


@query(_BREAKER)
def source_breaker_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stream of six batches, the breaker carried in the state."""
    days = F.datediff("ts", F.lit("2024-01-01"))
    path = _in_files(_events(spark, d), F.least(F.greatest(F.floor(days / 5), F.lit(0)), F.lit(5)), 6, f"{working_dir(spark)}/batches")
    rows = sources.streamed(spark, path, lambda events: sources.breaker_stream(events, length=2), sources.BREAKER, "user_id", _FILES)
    return rows.withColumn("held_at", F.col("held_at").cast("timestamp_ntz"))


@query("""
WITH k AS (SELECT user_id * 100 + date_diff('day', TIMESTAMP '2024-01-01', ts) AS user_id, event_id, ts, value FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM k)
SELECT user_id, event_id, value FROM l WHERE n = 1 AND ts + INTERVAL 5 DAY > (SELECT max(ts) FROM events) - INTERVAL 2 DAY
""")
def latest_retained(spark: SparkSession, d: str) -> DataFrame:
    """Latest values of keys from batches out of order; keys without news for five days have left the state."""
    days = F.datediff("ts", F.lit("2024-01-01"))
    events = _events(spark, d).withColumn("user_id", F.col("user_id") * 100 + days)
    late = F.floor((days + F.col("event_id") % 2) / 6)
    path = _in_files(events, F.least(F.greatest(late, F.lit(0)), F.lit(5)), 6, f"{working_dir(spark)}/batches")
    rows = sources.streamed(spark, path, lambda e: sources.latest_stream(e, "2 days", 5), "user_id long, ts timestamp, event_id long, value double, gone boolean", "user_id", _FILES)
    return rows.filter("NOT gone").select("user_id", "event_id", "value")


# Trigrams of documents: which rows an index would read


@query("""
WITH w AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)
SELECT doc_id FROM w WHERE contains(t, 'licen')
""")
def document_search_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts in the index, very long ones too."""
    folder, docs = working_dir(spark), table(spark, d, "documents", "doc_id", "text")
    textindex.build(docs, "doc_id", "text", folder)
    return textindex.search(docs, "doc_id", "text", folder, "LICEN").select("doc_id")
