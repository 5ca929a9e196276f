"""Queries over identities, families, documents of mixed shape, pages in SQL, and states with revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.functions import api, dates, html, text, versions
from tallystone.functions.api import ApiRule
from tallystone.operators import coverage, facets, identity, incremental, links, recommend, sizing, versioned
from tallystone.operators.versioned import Migration
from tallystone.registry import ORACLE_SQL, query
from tallystone.sources import sinks, variants
from tallystone.sources.tables import explode_links, table

# Identities in full

_KEYS = """
WITH p AS (SELECT p_partkey AS id, lower(p_name) AS k1, lower(p_brand || p_type) AS k2, p_size % 3 = 0 AS codes, p_size % 2 = 0 AS plat, p_partkey - p_partkey % 8 AS root FROM part),
n AS (SELECT c_custkey AS name_id, CASE c_custkey % 4 WHEN 0 THEN lower(p_name) WHEN 1 THEN 'no such name ' || c_custkey ELSE 'none' END AS k1,
    CASE WHEN c_custkey % 4 = 2 THEN lower(p_brand || p_type) ELSE 'none' END AS k2, c_custkey % 3 = 0 AS codes, CASE WHEN c_custkey % 10 = 0 THEN c_custkey * 7 END AS known_id,
    CASE WHEN c_custkey % 4 = 3 THEN lower(p_name) END AS l1, CASE WHEN c_custkey % 4 = 3 THEN CASE WHEN c_custkey % 8 = 3 THEN lower(p_name) ELSE 'elsewhere' END END AS r1
  FROM customer JOIN part ON p_partkey = 1 + c_custkey * 3 % (SELECT count(*) FROM part)),
c AS (SELECT name_id, 1 AS tier, n.codes, p.* EXCLUDE (codes) FROM n JOIN p ON n.k1 = p.k1 UNION ALL SELECT name_id, 2, n.codes, p.* EXCLUDE (codes) FROM n JOIN p ON n.k2 = p.k2),
f AS (SELECT * FROM c QUALIFY tier = min(tier) OVER (PARTITION BY name_id)),
g AS (SELECT name_id, min(tier) AS tier, count(DISTINCT root) AS roots, coalesce(min(id) FILTER (WHERE id = root), min(id)) AS pick, bool_or(codes) AS codes,
    count(DISTINCT root) FILTER (WHERE plat) AS p_roots, min(id) FILTER (WHERE plat) AS p_id, list(DISTINCT id) AS ids FROM f GROUP BY name_id),
side AS (SELECT k1, count(DISTINCT root) AS roots, min(root) AS root, min(id) AS least FROM p GROUP BY k1),
pair AS (SELECT name_id, l.least AS id FROM n JOIN side l ON n.l1 = l.k1 JOIN side r ON n.r1 = r.k1 WHERE l.roots = 1 AND r.roots = 1 AND l.root = r.root),
known AS (SELECT name_id, known_id FROM n WHERE known_id IN (SELECT id FROM p)),
t AS (SELECT n.name_id, CASE WHEN known.known_id IS NOT NULL THEN 0 WHEN g.tier IS NOT NULL THEN g.tier WHEN pair.id IS NOT NULL THEN 3 END AS tier,
    coalesce(known.known_id, CASE WHEN g.tier IS NULL THEN pair.id WHEN roots = 1 THEN pick WHEN g.codes AND p_roots = 1 THEN p_id END) AS ref_id, g.tier AS asked, ids
  FROM n LEFT JOIN g ON g.name_id = n.name_id LEFT JOIN pair ON pair.name_id = n.name_id LEFT JOIN known ON known.name_id = n.name_id),
m AS (SELECT name_id, tier, ref_id, CASE WHEN ref_id IS NOT NULL THEN 'matched' WHEN asked IS NULL THEN 'unmatched' ELSE 'ambiguous' END AS status,
    CASE WHEN ref_id IS NULL AND asked IS NOT NULL THEN array_to_string(list_slice(list_sort(ids), 1, 20), ',') ELSE '' END AS candidates FROM t)
"""


def _matched(spark: SparkSession, d: str) -> DataFrame:
    """Customers as names that carry a part's id, its name, its looser key, or two names as halves."""
    part = table(spark, d, "part")
    strict, relaxed = F.lower("p_name"), F.lower(F.concat("p_brand", "p_type"))
    ref = part.select(F.col("p_partkey").alias("ref_id"), strict.alias("strict"), relaxed.alias("relaxed"), (F.col("p_size") % 2 == 0).alias("on_platform"), (F.col("p_partkey") - F.col("p_partkey") % 8).alias("root_id"))
    k, n = F.col("c_custkey"), part.count()
    of = part.select("p_partkey", strict.alias("_s"), relaxed.alias("_r"))
    names = table(spark, d, "customer", "c_custkey").withColumn("p_partkey", 1 + k * 3 % n).join(of, "p_partkey")
    case = lambda r, c: F.when(k % 4 == r, c)
    names = names.select(
        k.alias("name_id"), F.coalesce(case(0, F.col("_s")), case(1, F.concat(F.lit("no such name "), k.cast("string"))), F.lit("none")).alias("strict"), F.coalesce(case(2, F.col("_r")), F.lit("none")).alias("relaxed"),
        (k % 3 == 0).alias("has_codes"), F.when(k % 10 == 0, k * 7).alias("known_id"), case(3, F.col("_s")).alias("left"), case(3, F.when(k % 8 == 3, F.col("_s")).otherwise("elsewhere")).alias("right"),
        F.lit(None).cast("string").alias("nothing"),
    )
    keys = ("strict", "relaxed")
    return identity.tiered_match(names, [(c, identity.candidate_index(ref, c)) for c in keys], ref.select("ref_id"), [("left", "right"), ("nothing", "nothing")], [identity.candidate_lists(ref, c) for c in keys])


@query(_KEYS + "SELECT * FROM m")
def tiered_match_full(spark: SparkSession, d: str) -> DataFrame:
    """Known ids, two tiers, pairs of halves, and the candidates of what stays undecided."""
    return _matched(spark, d).withColumn("candidates", F.array_join(F.col("candidates").cast("array<string>"), ","))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part", F.col("p_partkey").alias("node"), "p_size")
    roots = identity.hierarchy_roots(part.select("node", F.when(F.col("node") % 8 != 0, F.col("node") - 1).alias("parent")))
    types = part.select(F.col("node").alias("id"), F.when(F.col("p_size") % 5 == 0, "tool").when(F.col("p_size") % 5 < 4, "main").alias("type"))
    return identity.resolve(_matched(spark, d).select("name_id", "ref_id"), roots, types, ["main"], ["tool"])


_RESOLVED = _KEYS + """
, o AS (SELECT m.name_id, m.ref_id, r.p_partkey AS canonical_id, CASE WHEN r.p_size % 5 = 0 THEN 'non_game' WHEN r.p_size % 5 < 4 THEN 'identified' ELSE 'review' END AS outcome
  FROM m LEFT JOIN part r ON r.p_partkey = m.ref_id - m.ref_id % 8)
"""


@query(_RESOLVED + "SELECT name_id, ref_id, canonical_id, outcome FROM o")
def resolve_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Each name's root and what the root's type makes of it; roots that the reference lacks are for review."""
    return _resolved(spark, d)


@query(_RESOLVED + """
SELECT count(*) AS listings, count(*) FILTER (WHERE outcome = 'identified') AS identified, count(DISTINCT canonical_id) FILTER (WHERE outcome = 'identified') AS unique_games,
  count(*) FILTER (WHERE outcome = 'non_game') AS non_game, count(*) FILTER (WHERE outcome = 'review') AS unresolved, count(*) FILTER (WHERE name_id % 6 = 0) AS reviewed, 0::BIGINT AS local_games,
  count(*) FILTER (WHERE outcome = 'identified' AND ref_id <> canonical_id) AS editions,
  count(*) FILTER (WHERE outcome = 'identified') - count(DISTINCT canonical_id) FILTER (WHERE outcome = 'identified') AS duplicates FROM o
""")
def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return identity.outcome_summary(_resolved(spark, d).withColumn("reviewed_at", F.when(F.col("name_id") % 6 == 0, F.lit("2024-01-01"))))


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 9 = 0 THEN p_partkey - p_partkey % 4 - 2 WHEN p_partkey % 4 <> 0 THEN p_partkey - 1 END AS up FROM part),
w AS (SELECT node, node AS place, up, 0 AS n FROM e UNION ALL SELECT w.node, e.node, e.up, n + 1 FROM w JOIN e ON e.node = w.up WHERE n < 400)
SELECT e.node, r.root FROM e LEFT JOIN (SELECT node, place AS root FROM w WHERE up IS NULL) r USING (node)
""")
def alias_roots(spark: SparkSession, d: str) -> DataFrame:
    """Parents within fours; every ninth part is an alias of one two before its four, which wins over its parent."""
    k = F.col("node")
    part = table(spark, d, "part", F.col("p_partkey").alias("node"))
    parents = part.select("node", F.when(k % 4 != 0, k - 1).alias("parent"))
    return identity.hierarchy_roots(identity.with_aliases(parents, part.filter(k % 9 == 0).select("node", (k - k % 4 - 2).alias("target"))))


# Families from raw releases

_RANKS = ["b.example.org", "c.example.org"]


@query("""
WITH l AS (SELECT l_partkey AS game, printf('CUSA%05d', l_suppkey % 100000) AS code, ['EU', 'us', 'JPN', ''][1 + l_linenumber % 4] AS region, l_linestatus AS edition, 'https://x.example.org/' || l_partkey AS page,
    l_discount > 0.09 AS conflict, ['a', 'b', 'c', 'd'][1 + l_orderkey % 4] || '.example.org' AS host, CASE l_returnflag WHEN 'A' THEN 'base' WHEN 'R' THEN 'update' ELSE 'dlc' END AS kind,
    printf('%d.%02d', l_linenumber, l_quantity::INT) AS version, l_orderkey * 10 + l_linenumber AS pos FROM lineitem),
k AS (SELECT *, CASE WHEN NOT conflict AND region <> '' THEN '["' || code || '","' || CASE region WHEN 'EU' THEN 'EUR' WHEN 'us' THEN 'USA' ELSE 'JPN' END || '","' || edition || '","' || page || '",""]' END AS family,
    CASE host WHEN 'a.example.org' THEN 0 WHEN 'b.example.org' THEN 1 WHEN 'c.example.org' THEN 2 ELSE 10 END AS host_rank, split_part(version, '.', 1)::INT * 100 + split_part(version, '.', 2)::INT AS v FROM l),
f AS (SELECT game, family, min(pos) AS first_pos, count(*) FILTER (WHERE kind = 'base') AS bases, count(*) FILTER (WHERE kind = 'dlc') AS dlc FROM k WHERE family IS NOT NULL GROUP BY ALL HAVING bases > 0),
b AS (SELECT game, family, pos AS base, host_rank, v AS base_v FROM k WHERE kind = 'base' AND family IS NOT NULL QUALIFY row_number() OVER (PARTITION BY game, family ORDER BY v DESC, host_rank, pos) = 1),
u AS (SELECT k.game, k.family, k.pos AS update FROM k JOIN b USING (game, family) WHERE kind = 'update' AND k.v > base_v QUALIFY row_number() OVER (PARTITION BY k.game, k.family ORDER BY k.v DESC, k.host_rank, k.pos) = 1)
SELECT f.game, f.family, base, update, dlc AS n_dlc FROM f JOIN b USING (game, family) LEFT JOIN u USING (game, family)
QUALIFY row_number() OVER (PARTITION BY f.game ORDER BY host_rank, update IS NULL, first_pos) = 1
""")
def family_from_releases(spark: SparkSession, d: str) -> DataFrame:
    """Family keys and host ranks made from the releases' own fields, then the choice."""
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    rows = table(spark, d, "lineitem")
    code, page = F.format_string("CUSA%05d", F.col("l_suppkey") % 100000), F.concat(F.lit("https://x.example.org/"), F.col("l_partkey").cast("string"))
    family = recommend.family_key(code, pick(["EU", "us", "JPN", ""], F.col("l_linenumber") % 4), F.col("l_linestatus"), page, F.lit(None).cast("string"), F.col("l_discount") > 0.09, F.lit(None).cast("int"))
    rank = recommend.domain_rank(F.concat(pick("abcd", F.col("l_orderkey") % 4), F.lit(".example.org")), "a.example.org", _RANKS)
    kind = F.when(F.col("l_returnflag") == "A", "base").when(F.col("l_returnflag") == "R", "update").otherwise("dlc")
    releases = rows.select(
        F.col("l_partkey").alias("game"), family.alias("family"), kind.alias("kind"), F.format_string("%d.%02d", "l_linenumber", F.col("l_quantity").cast("int")).alias("version"), F.lit(None).cast("string").alias("variant"),
        rank.alias("host_rank"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
    )
    return recommend.choose_families(releases, F.lit(True))


# File names and stated sizes


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 5 AS k, p_size, printf('CUSA%05d', p_partkey % 100000) AS code FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'base' WHEN 1 THEN 'update' WHEN 2 THEN 'dlc' END AS kind, CASE WHEN k IN (0, 1) THEN '1.' || (10 + p_size) END AS version, CASE WHEN k <> 4 THEN code END AS product_code,
  CASE k WHEN 0 THEN '9.00' WHEN 3 THEN '5.05/6.72' END AS requirement, CASE WHEN k = 3 THEN p_size::VARCHAR WHEN k IN (0, 1) THEN '1.' || (10 + p_size) END AS stated FROM p
""")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    """What file names say, and the whole number that a label states where it has no dotted version."""
    k, size = F.col("p_partkey") % 5, F.col("p_size")
    code, dotted = F.format_string("CUSA%05d", F.col("p_partkey") % 100000), F.concat(F.lit(" v1."), (size + 10).cast("string"))
    name = F.when(k == 0, F.concat(F.lit("Base_"), code, dotted, F.lit(" [9.00]"))).when(k == 1, F.concat(F.lit("update-"), code, dotted)).when(k == 2, F.concat(F.lit("Some DLC "), code)).when(
        k == 3, F.concat(F.lit("My base "), code, F.lit(" v"), size.cast("string"), F.lit(" [5.05-6.72]"))
    ).otherwise(F.lit("nothing said"))
    said = text.file_details(name)
    return table(spark, d, "part", "p_partkey", "p_size").select("p_partkey", *(said[c].alias(c) for c in ("kind", "version", "product_code", "requirement")), text.stated_version(name, whole_numbers=True).alias("stated"))


@query("""
SELECT p_partkey AS page_id, CASE WHEN p_size % 4 IN (0, 1) THEN p_size * 1000000 WHEN p_size % 4 = 2 THEN p_size END::BIGINT AS size_bytes, CASE WHEN p_size % 4 = 2 THEN 'exact' ELSE 'estimated' END AS precision
FROM part WHERE p_size % 4 < 3
""")
def stated_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes beside their label, on the next line, in bytes, or two that differ."""
    k, n = F.col("p_size") % 4, F.col("p_size").cast("string")
    body = (
        F.when(k == 0, F.concat(F.lit("<p>limit 5 GB</p><b>File size</b><i>: "), n, F.lit(" MB</i>"))).when(k == 1, F.concat(F.lit("<p>File Size: "), n, F.lit(" MB</p><p>file size "), n, F.lit("MB</p>")))
        .when(k == 2, F.concat(F.lit("<td>FILE SIZE:</td><td>"), n, F.lit(" bytes</td>"))).otherwise(F.concat(F.lit("<p>File size: "), n, F.lit(" MB</p><p>File size: 1 GB</p>")))
    )
    return html.labelled_sizes(html.text_lines(table(spark, d, "part", F.col("p_partkey").alias("page_id"), body.alias("html"))))


# Documents of mixed shape


@query("""
SELECT user_id, date_diff('day', TIMESTAMP '2024-01-01', ts) AS day, count(*) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total,
  count(*) FILTER (WHERE event_type = 'error' AND event_id % 2 = 0) AS n_errors FROM events WHERE user_id % 4 <> 3 GROUP BY ALL
""")
def mixed_documents(spark: SparkSession, d: str) -> DataFrame:
    """A user's events of a day as one document: a list, an object with records, one with a graph, or no JSON at all."""
    day, k = F.datediff(F.col("ts").cast("timestamp"), F.lit("2024-01-01")), F.col("user_id") % 4
    events = table(spark, d, "events").select("user_id", day.alias("day"), F.struct(F.col("event_type").alias("@type"), F.when(F.col("event_id") % 2 == 0, F.lit("even")).otherwise("odd").alias("id"), F.from_json("props", "k long").alias("props")).alias("e"))
    docs = events.groupBy("user_id", "day").agg(F.to_json(F.collect_list("e")).alias("list"))
    raw = F.when(k == 0, F.col("list")).when(k == 1, F.concat(F.lit('{"records":'), F.col("list"), F.lit(',"n":1}'))).when(k == 2, F.concat(F.lit('{"@graph":'), F.col("list"), F.lit("}"))).otherwise("{broken")
    read = docs.withColumn("v", F.try_parse_json(raw))
    graph = F.try_variant_get("v", "$['@graph']", "array<variant>")
    records = F.coalesce(graph, variants.records_of(F.col("v")))
    errors = F.size(variants.typed_parts(F.when(k == 1, F.try_variant_get("v", "$.records", "variant")).otherwise(F.col("v")), "$['@type']", ("error",), "$.id", F.lit("even")))
    total = F.aggregate(F.transform(records, lambda x: F.coalesce(F.try_variant_get(x, "$.props.k", "bigint"), F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return read.filter("v IS NOT NULL").select("user_id", F.col("day").cast("bigint").alias("day"), F.size(records).cast("bigint").alias("n"), total.alias("total"), errors.cast("bigint").alias("n_errors"))


# Pages from SQL

@query(ORACLE_SQL["html_links"])
def html_links_sql(spark: SparkSession, d: str) -> DataFrame:
    """The links of all pages by a table function in SQL, for each page its own."""
    html.register_page_functions(spark)
    table(spark, d, "pages", "page_id", F.col("url").alias("page_url"), "html").createOrReplaceTempView("tallystone_pages")
    return spark.sql("SELECT page_id, link.pos, link.url, link.label FROM tallystone_pages, LATERAL page_links(html, page_url) AS link")


# State with revisions

_MIGRATED = """
WITH s AS (SELECT event_id, event_type, value, 1 + event_id % 4 AS revision FROM events)
SELECT event_id, event_type, greatest(revision, 4)::INT AS revision FROM s
WHERE NOT (revision < 2 AND event_type = 'error') AND NOT (revision < 3 AND event_type = 'view' AND value > 50) AND NOT (revision < 4 AND event_type = 'click' AND value < 10)
"""


def _migrations() -> list[Migration]:
    kind, value = F.col("event_type"), F.col("value")
    return [Migration(4, (kind == "click") & (value < 10)), Migration(2, kind == "error"), Migration(3, (kind == "view") & (value > 50))]


@query(_MIGRATED)
def migrated_state(spark: SparkSession, d: str) -> DataFrame:
    """Three migrations over rows of four revisions, in two goes; those that ran before are passed over."""
    state = table(spark, d, "events", "event_id", "event_type", "value").withColumn("revision", (1 + F.col("event_id") % 4).cast("int"))
    state, applied = versioned.migrate(state, _migrations()[1:2])
    state, applied = versioned.migrate(state, _migrations(), applied)
    return versioned.migrate(state, _migrations(), applied)[0].select("event_id", "event_type", "revision")


@query("""
WITH h AS (SELECT user_id, min(ts) AS at FROM events WHERE event_type = 'error' GROUP BY user_id), r AS (SELECT user_id FROM h WHERE user_id % 3 <> 1 OR user_id % 2 = 0)
SELECT event_id, CASE WHEN event_type = 'view' THEN 'pending' ELSE event_type END AS status FROM events
WHERE user_id NOT IN (SELECT user_id FROM r) AND event_type = 'view' AND user_id % 5 <> 4
UNION ALL SELECT -user_id, 'pending' FROM (SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM r))
""")
def queue_after_retry(spark: SparkSession, d: str) -> DataFrame:
    """A queue after sources were held, one reason was released once, keys were enqueued and others dropped."""
    events = table(spark, d, "events", "event_id", "user_id", "event_type", "ts")
    failures = events.filter("event_type = 'error'").select(F.col("user_id").alias("source"), F.col("ts").alias("at"), F.when(F.col("user_id") % 2 == 0, F.lit("limit")).otherwise("refused").alias("reason"))
    holds = incremental.hold_sources(failures.limit(0), failures, "source")
    queue = events.select("event_id", F.col("user_id").alias("source"), F.when(F.col("event_type") == "view", "pending").otherwise(F.col("event_type")).alias("status"))
    kept = incremental.retain(queue, queue.filter(F.col("source") % 5 != 4), "event_id")
    found = queue.select((-F.col("source")).alias("event_id"), "source").distinct()
    grown = incremental.enqueue(kept.drop("source"), found, "event_id")
    sources = queue.select("event_id", "source").unionByName(found)
    open_holds = holds.filter(~((F.col("source") % 3 == 1) & (F.col("reason") == "refused")))
    return incremental.runnable(grown.join(sources, "event_id"), open_holds, "source").select("event_id", "status")


# Small rules on whole tables

_API = [
    ApiRule("a.example.org", missing=("$.message", r"(?i)not found #\d+"), restricted=("$.message", r"(?i)not allowed #\d+"), checksum="whirlpool"),
    ApiRule("b.example.org", missing=("$.exist", "false"), ok=("$.exist", "true")),
]


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 3 AS h, p_size % 6 AS k, p_size, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS name, sha256(p_name) AS sha, md5(p_name) AS md FROM part)
SELECT p_partkey, CASE WHEN k = 0 AND h < 2 THEN 'missing' WHEN k = 1 AND h = 0 THEN 'restricted_file' WHEN k IN (2, 3) THEN 'known' ELSE 'unknown' END AS status,
  CASE WHEN k IN (2, 3) THEN p_size END::BIGINT AS size_bytes, CASE WHEN k IN (2, 3) OR k = 4 AND h = 1 THEN name END AS filename,
  CASE WHEN k = 2 THEN 'sha256=' || sha WHEN k = 3 THEN 'md5=' || md WHEN k = 4 AND h = 1 THEN '' END AS checksums FROM p
""")
def api_file_states(spark: SparkSession, d: str) -> DataFrame:
    """Answers of three hosts: files gone, restricted, stated in full, without a size, and no objects."""
    h, k, size = F.col("p_partkey") % 3, F.col("p_size") % 6, F.col("p_size")
    exist = F.when(k == 0, F.lit(False)).when(k.isin(2, 3, 4), F.lit(True))
    message = F.when(k == 0, F.lit("Not found #12")).when(k == 1, F.lit("NOT ALLOWED #7"))
    answer = F.to_json(F.struct(
        F.when(h == 0, message).alias("message"), F.when(h == 1, exist).alias("exist"), F.when(k.isin(2, 3, 4), F.concat(F.lit(" "), F.col("p_name"), F.lit(" "))).alias("filename"),
        F.when(k.isin(2, 3), size.cast("string")).when(k == 4, F.lit("12 MB")).alias("size"), F.when(k == 2, F.upper(F.sha2("p_name", 256))).when(k == 3, F.left(F.sha2("p_name", 256), F.lit(63))).alias("sha256"),
        F.when(k == 3, F.md5(F.col("p_name").cast("binary"))).alias("md5"),
    ))
    document = F.try_parse_json(F.when(k == 5, F.lit("[1]")).otherwise(answer))
    host = F.element_at(F.array(*map(F.lit, ("a", "b", "c"))), (h + 1).cast("int"))
    said = api.file_state(F.concat(F.lit("https://"), host, F.lit(".example.org/f")), document, _API)
    sums = F.array_join(F.transform(F.map_entries(said["checksums"]), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return table(spark, d, "part", "p_partkey", "p_size", "p_name").select("p_partkey", said["status"].alias("status"), said["size_bytes"].alias("size_bytes"), said["filename"].alias("filename"), sums.alias("checksums"))


@query("""
SELECT l_partkey, grp, i - 1 AS pos, 'https://x.example.org/' || l_orderkey AS url FROM (
  SELECT l_partkey, l_returnflag AS grp, l_orderkey, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey, l_linenumber) AS i FROM lineitem)
""")
def exploded_links(spark: SparkSession, d: str) -> DataFrame:
    """Grouped links of listings, one row each, in their order."""
    url = F.concat(F.lit("https://x.example.org/"), F.col("l_orderkey").cast("string"))
    groups = table(spark, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", url.alias("url")))), lambda x: x["url"]).alias("urls"))
    listings = groups.groupBy("l_partkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "urls"))).alias("download_links"))
    rows = explode_links(listings.select(F.col("l_partkey").cast("string").alias("name"), F.lit(None).cast("string").alias("page_url"), "download_links"))
    return rows.select(F.col("name").cast("bigint").alias("l_partkey"), "grp", F.col("pos").cast("bigint").alias("pos"), "url")


@query("""
SELECT p_partkey, 'p-' || left(sha256(lower(p_name) || chr(10) || p_brand), 20) AS id, left(sha256(p_type), 16) AS stamp, regexp_replace(trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g')), '^_+|_+$', '', 'g') AS slug,
  upper(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS shown FROM part
""")
def surrogate_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        "p_partkey", sinks.surrogate_id("p", F.lower("p_name"), F.col("p_brand")).alias("id"), sinks.content_stamp(F.col("p_type")).alias("stamp"), text.slug(F.col("p_type")).alias("slug"), text.upper_clean(F.col("p_name")).alias("shown")
    )


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey % 3 = 0 AS of_source, l_returnflag = 'A' AS of_kind, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_linestatus END AS region, l_discount > 0.09 AS conflict FROM lineitem)
SELECT l_orderkey, l_linenumber, of_kind AS in_view FROM l WHERE of_source AND coalesce(region = 'F', false) AND NOT conflict
""")
def context_releases(spark: SparkSession, d: str) -> DataFrame:
    """Releases of a source and region: in view if of the kind too, else kept for the recommendation."""
    regions = F.when(F.col("l_linenumber") % 5 != 0, F.array("l_linestatus"))
    rows = table(spark, d, "lineitem").withColumn("regions", regions)
    region = facets.region_facet(F.col("regions"), F.col("l_discount") > 0.09, "F")
    return facets.recommendation_context(rows, F.col("l_suppkey") % 3 == 0, region, F.col("l_returnflag") == "A").select("l_orderkey", "l_linenumber", "in_view")


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice BETWEEN 1000 AND 300000 AND o_orderkey % 7 <> 0 THEN o_totalprice END AS price,
  CASE o_orderkey % 4 WHEN 0 THEN o_orderkey WHEN 1 THEN NULL WHEN 2 THEN 9007199254740991 ELSE NULL END::BIGINT AS size FROM orders
""")
def numeric_guards(spark: SparkSession, d: str) -> DataFrame:
    """Finite values within bounds, and whole numbers up to 2^53 - 1 from texts."""
    k = F.col("o_orderkey")
    price = F.when(k % 14 == 0, F.lit(float("nan"))).when(k % 7 == 0, F.lit(float("inf"))).otherwise(F.col("o_totalprice"))
    size = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, F.concat(k.cast("string"), F.lit(".0"))).when(k % 4 == 2, F.lit("9007199254740991")).otherwise("9007199254740992")
    return table(spark, d, "orders").select("o_orderkey", versions.finite(price, 1000, 300000).alias("price"), versions.safe_integer(size).alias("size"))


@query("""
WITH e AS (SELECT o_orderkey, o_orderdate::DATE AS day, ['F', 'O', 'P'][1 + o_orderkey % 3] AS kind FROM orders)
SELECT year(day)::INT AS year, count(*) FILTER (WHERE o_orderkey % 5 IN (1, 2) AND kind <> 'P') AS n, max(last_day(day)) FILTER (WHERE o_orderkey % 5 IN (1, 2) AND kind <> 'P' AND last_day(day) <= DATE '1998-06-30')::VARCHAR AS last
FROM e GROUP BY 1
""")
def qualifying_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates on two platforms whose status is a release, and the last that lies in the past."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    status = F.element_at(F.array(F.lit("Full release"), F.lit("Offline"), F.lit("Cancelled early")), (k % 3 + 1).cast("int"))
    ok = dates.qualifies((k % 5).cast("int"), [1, 2], status)
    end = dates.end_of_period(F.lit(None).cast("string"), F.lit("YYYYMM"), F.lit(None).cast("bigint"), F.year(at), F.month(at), F.lit("1998-06-30").cast("date"), 1990)
    rows = table(spark, d, "orders").select(F.year(at).alias("year"), ok.alias("ok"), end.alias("end"))
    return rows.groupBy("year").agg(F.count_if("ok").alias("n"), F.max(F.when(F.col("ok"), F.col("end"))).cast("string").alias("last"))


@query("""
WITH l AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
b AS (SELECT sum(n_chars)::BIGINT AS known_bytes FROM documents)
SELECT (SELECT count(*) FROM customer) AS n_listings, (SELECT sum(n) FROM l JOIN customer ON c_custkey = o_custkey)::BIGINT AS n_links, known_bytes FROM b
""")
def table_totals(spark: SparkSession, d: str) -> DataFrame:
    """Listings and their links, and bytes over all copies."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list("o_orderkey").alias("links"))
    counted = coverage.totals(table(spark, d, "customer", "c_custkey").join(orders, "c_custkey", "left"), "links")
    return counted.withColumn("_one", F.lit(1)).join(sizing.known_bytes(table(spark, d, "documents", F.col("n_chars").alias("size_bytes"))).withColumn("_one", F.lit(1)), "_one").drop("_one")


@query("""
SELECT event_id, user_id, event_type AS status FROM events WHERE NOT (user_id = 3 AND event_type = 'error')
""")
def retried_once(spark: SparkSession, d: str) -> DataFrame:
    """One source's held results are dropped for a retry; the same request again changes nothing."""
    state = table(spark, d, "events", "event_id", "user_id", F.when(F.col("event_type") == "error", "held").otherwise(F.col("event_type")).alias("status"))
    holds = spark.createDataFrame([(3, "limit"), (4, "limit"), (5, "refused")], "user_id long, reason string")
    markers = spark.createDataFrame([], "marker string")
    for name, reason, marker in ((3, "limit", "first"), (4, "limit", "first"), (5, "limit", "second")):
        state, holds, markers = incremental.retry_once(state, holds, markers, marker, "user_id", name, reason)
    return state.withColumn("status", F.when(F.col("status") == "held", "error").otherwise(F.col("status")))


_HOST = "regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '')"
_PATH = "regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '')"


@query(f"""
WITH p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
r AS (SELECT *, (host = 'example.org' OR host LIKE '%.example.org') AS org, (host = 'example.com' OR host LIKE '%.example.com') AS com FROM p)
SELECT page_id, CASE WHEN org AND regexp_matches(path, '^/(es|fr)/') THEN 'translated' WHEN com THEN 'shop' WHEN org THEN 'community' WHEN host LIKE '%.net' THEN 'network' ELSE host END AS label,
  CASE WHEN org AND regexp_matches(path, '^/(es|fr)/') THEN 'main' WHEN com THEN 'side' WHEN org THEN 'main' WHEN host LIKE '%.net' THEN 'side' ELSE 'other' END AS grp FROM r
""")
def link_rules(spark: SparkSession, d: str) -> DataFrame:
    """Pages classified by a table of rules: a path of a domain before the domain, and a rule for a whole top domain."""
    rules = [(1, "example.org", "^/(es|fr)/", "translated", "main"), (2, "example.com", None, "shop", "side"), (3, "example.org", None, "community", "main"), (4, "example.org", "^/es/", "never", "never"), (5, "net", None, "network", "side")]
    table_of = spark.createDataFrame(rules, "ord int, domain string, path string, label string, grp string")
    return links.classified(table(spark, d, "pages", "page_id", "url"), table_of).select("page_id", "label", "grp")
