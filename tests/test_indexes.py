"""Nested entities, trigram and rank indexes, bitmaps: against plain Python, and what their plans read."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallystone.operators import bitmaps, entities, rankindex, textindex

LINK = "array<struct<label:string,kind:string,version:string>>"
ENTITY = f"name string, source string, aliases array<string>, releases array<struct<source:string,kind:string,conflict:boolean,regions:array<string>,region_conflict:boolean,links:{LINK}>>"


def release(kind, region, labels, source=None, conflict=None, region_conflict=None):
    return (source, kind, conflict, [region] if region else [], region_conflict, [(x, kind, None) for x in labels])


@pytest.fixture(scope="module")
def shelf(spark):
    data = [
        ("Alpha", "one", ["First"], [release("base", "EUR", ["disc", "mirror"]), release("update", "EUR", ["patch 2"], source="two"), release("dlc", "USA", ["extra"])]),
        ("Beta", "two", None, [release("update", "JPN", ["fix 7"]), release("update", "JPN", ["quarrel"], conflict=True), release(None, None, ["odd"])]),
        ("Gamma", "one", [], []),
        ("Delta", None, [None, "Fourth"], [(None, "base", None, None, None, None)]),
    ]
    return spark.createDataFrame(data, ENTITY)


def names(df):
    return sorted(r.name for r in df.collect())


def test_facets_narrow_links_and_search(shelf):
    assert names(entities.find(shelf)) == ["Alpha", "Beta", "Delta", "Gamma"]
    alpha = entities.find(shelf, kind="update", region="EUR").collect()
    assert [(r.name, r.total_links, [x.label for x in r.links], len(r.recommendation_releases)) for r in alpha] == [("Alpha", 1, ["patch 2"], 2)]
    # The mirror is a base's, so it is not found once only updates are in view.
    assert names(entities.find(shelf, "mirror")) == ["Alpha"] and names(entities.find(shelf, "MIRROR", kind="update")) == []
    assert names(entities.find(shelf, "first", kind="update")) == ["Alpha"] and names(entities.find(shelf, " fourth ")) == ["Delta"]


def test_source_conflict_and_unknown_facets(shelf):
    assert names(entities.find(shelf, source="two")) == ["Alpha", "Beta"] and names(entities.find(shelf, source="one")) == ["Alpha"]
    assert entities.find(shelf, source="two").filter("name = 'Alpha'").first().total_links == 1
    assert [(r.name, [x.label for x in r.links]) for r in entities.find(shelf, kind="unknown").collect()] == [("Beta", ["quarrel", "odd"])]
    assert names(entities.find(shelf, region="unknown")) == ["Beta", "Delta"]


def test_entities_are_not_taken_apart(shelf):
    plan = entities.find(shelf, "x", kind="base")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(2)
    data = [(i, " ".join(rnd.choice(["Bolt", "brand#12", "ring", "Straße", "日本語", "aaaa", "x"]) for _ in range(rnd.randint(0, 6)))) for i in range(300)]
    return [*data, (900, None), (901, ""), (902, "ab"), (903, "long " * 40_000 + "needle in it")]


@pytest.mark.parametrize("wanted", ["bolt BRAND", "aaaa", "needle", " straße ", "日本語", "ab", "x", "", "nowhere at all", "brand#12 ring bolt", "AAA"])
def test_trigram_search_equals_scan(spark, texts, tmp_path_factory, wanted):
    rows = spark.createDataFrame(texts, "id long, text string")
    path = str(tmp_path_factory.getbasetemp() / "trigrams")
    if not hasattr(test_trigram_search_equals_scan, "built"):
        textindex.build(rows, "id", "text", path)
        test_trigram_search_equals_scan.built = True
    q = wanted.strip().lower()
    assert sorted(r.id for r in textindex.search(rows, "id", "text", path, wanted).collect()) == [i for i, t in texts if q in (t or "").lower()]


def test_trigram_plan_reads_matching_postings(spark, texts, tmp_path):
    textindex.build(spark.createDataFrame(texts, "id long, text string"), "id", "text", str(tmp_path))
    found = textindex.candidates(spark, str(tmp_path), "needle")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|INSET|=)", plan) and re.search(r"PushedFilters: \[In\(gram", plan)
    scanned = found._jdf.queryExecution().executedPlan()
    assert [r.id for r in found.collect()] == [903] and scanned is not None
    assert textindex.candidates(spark, str(tmp_path), "ab") is None and textindex.candidates(spark, str(tmp_path), "zzz").count() == 0


def test_postings_are_one_row_for_many_texts(spark, tmp_path):
    """A trigram of many texts is one row of postings for a batch of them; rows that repeat an id are found."""
    rows = spark.createDataFrame([(n // 2, f"needle {n}" if n % 3 else "none") for n in range(400)], "id long, text string").coalesce(1)
    textindex.build(rows, "id", "text", str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/postings").filter("gram = 'nee'").count() == 1
    assert spark.read.parquet(f"{tmp_path}/grams").filter("gram = 'nee'").first().n == sum(n % 3 > 0 for n in range(400))
    assert textindex.search(rows, "id", "text", str(tmp_path), "Needle").count() == sum(n % 3 > 0 for n in range(400))


def test_bitmaps_count_and_merge(spark):
    rnd = random.Random(3)
    data = [(rnd.choice(["a", "b", None]), rnd.choice([None, 0, 5, 32767, 32768, 32769, 10**7 + rnd.randint(0, 50)]), rnd.choice([1, 2, None])) for _ in range(500)]
    rows = spark.createDataFrame(data, "g string, x long, y long")
    want = defaultdict(set)
    for g, x, _ in data:
        want[g].add(x)
        want["all"].add(x)
    got = {r.g: r.n for r in bitmaps.rollup(rows, "g", {"n": "x", "m": "y"}, everything="all").collect()}
    assert got == {g: len(xs - {None}) for g, xs in want.items()}
    plan = bitmaps.counts(bitmaps.merged(bitmaps.distinct_bitmaps(rows, ["g"], "x"), []), [], "n")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    assert bitmaps.rollup(rows.limit(0), "g", {"n": "x"}).count() == 0


def test_numbered_values_are_dense(spark, tmp_path):
    rows = spark.createDataFrame([(x,) for x in ["b", "a", None, "c", "b", "é"]], "v string")
    assert {r.v: r["_n"] for r in bitmaps.numbered(rows, "v", str(tmp_path)).collect()} == {"a": 1, "b": 2, "c": 3, "é": 4}


@pytest.mark.parametrize("number", [-3, 0, 7, 13, 14, 99])
def test_any_page_reads_one_or_two_ranges(spark, tmp_path, number):
    rnd = random.Random(4)
    data = [(i, rnd.choice([None, 1.5, 2.5, rnd.random()])) for i in range(1007)]
    order = [F.desc_nulls_last("v"), F.asc("id")]
    rankindex.build(spark.createDataFrame(data, "id long, v double"), order, str(tmp_path), 9)
    want = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    first = min(max(number, 0), 13) * 75
    page = rankindex.page(spark, str(tmp_path), order, number, 75)
    assert [tuple(r) for r in page.collect()] == want[first : first + 75]
    plan = page._jdf.queryExecution().executedPlan().toString()
    read = re.search(r"PartitionFilters: \[(?:isnotnull\(_range#\d+\), )?_?\(?_range#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan)
    assert read and len((read[1] or read[2]).split(",")) <= 2


def test_ranks_and_empty_index(spark, tmp_path):
    rows = spark.createDataFrame([(i, i * 7 % 50) for i in range(200)], "id long, v long")
    got = rankindex.ranked(rows, [F.asc("v"), F.desc("id")], str(tmp_path / "a"), "place", 5)
    assert [(r.v, r.id) for r in got.orderBy("place").collect()] == sorted(((r[1], r[0]) for r in rows.collect()), key=lambda x: (x[0], -x[1]))
    assert sorted(r.place for r in got.collect()) == list(range(1, 201))
    rankindex.build(rows.limit(0), [F.asc("v")], str(tmp_path / "b"), 3)
    assert rankindex.page(spark, str(tmp_path / "b"), [F.asc("v")], 2, 10).count() == 0
