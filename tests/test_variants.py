"""Documents whose shape each file decides, pages as table functions, and states with revisions."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from tallystone.functions import html
from tallystone.operators import versioned
from tallystone.operators.versioned import Migration, StateTable
from tallystone.sources import variants


def test_lists_and_objects_side_by_side(spark, tmp_path):
    files = {
        "a.json": json.dumps([{"name": "x", "n": 1}, {"name": "y", "n": "2"}]), "b.json": json.dumps({"records": [{"name": "z", "n": 3.5, "tags": ["p", "q"]}, 7, None], "checked": {}}),
        "c.json": json.dumps({"name": "alone", "tags": "p"}), "d.json": json.dumps({"records": {"not": "a list"}}), "e.json": "[]", "f.json": "{broken", "g.json": "", "h.json": "17",
    }
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    rows = variants.read_records(spark, str(tmp_path), "name string, n double, tags array<string>").collect()
    got = sorted((r.file[-6:-5], r.pos, r.name, r.n, r.tags) for r in rows)
    assert got == [
        ("a", 0, "x", 1.0, None), ("a", 1, "y", 2.0, None), ("b", 0, "z", 3.5, ["p", "q"]), ("b", 1, None, None, None), ("b", 2, None, None, None), ("c", 0, "alone", None, None),
    ]


def test_types_and_ids_match(spark):
    docs = [
        {"@type": "MediaObject", "id": "7"}, {"@type": ["Thing", "MediaObject"], "id": 7}, {"@type": "MediaObject", "id": "8"}, {"@graph": [{"@type": "MediaObject", "id": "7"}, {"@type": "Page", "id": "7"}]},
        [{"@type": "MediaObject", "id": "7"}, {"@type": "MediaObject", "id": "7"}, 5], {"@type": "Page", "id": "7"}, "text", None,
    ]
    df = spark.createDataFrame([(n, json.dumps(d)) for n, d in enumerate(docs)] + [(98, "{bad"), (99, None)], "n int, j string").withColumn("v", F.try_parse_json("j"))
    parts = variants.typed_parts(F.col("v"), "$['@type']", ("MediaObject",), "$.id", F.lit("7"))
    assert {r.n: r.k for r in df.select("n", F.size(parts).alias("k")).collect()} == {0: 1, 1: 1, 2: 0, 3: 1, 4: 2, 5: 0, 6: 0, 7: 0, 98: 0, 99: 0}


def test_pages_as_table_functions(spark, sf):
    """From SQL the same links as from the DataFrame function, and as a walk with a regular expression."""
    html.register_page_functions(spark)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages.createOrReplaceTempView("some_pages")
    got = {tuple(r) for r in spark.sql("SELECT page_id, l.pos, l.url, l.label FROM some_pages, LATERAL page_links(html, url) AS l").collect()}
    assert got == {tuple(r) for r in html.links(pages).collect()}
    want = set()
    for p in pages.collect():
        body = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1>", "", p.html)
        seen = dict.fromkeys(re.match(r"https?://[^/?#]+", p.url)[0] + href for href in re.findall(r'<a href="([^"]*)">', body))
        want |= {(p.page_id, n, url) for n, url in enumerate(seen)}
    assert {g[:3] for g in got} == want and want
    lines = spark.sql("SELECT page_id, l.pos, l.line FROM some_pages, LATERAL page_lines(html) AS l")
    assert {tuple(r) for r in lines.collect()} == {tuple(r) for r in html.text_lines(pages).collect()}
    assert spark.sql("SELECT * FROM page_links(NULL, NULL)").count() == 0
    plan = spark.sql("SELECT count(*) FROM some_pages, LATERAL page_links(html, url) AS l")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPythonUDTF" in plan


STATE = "key string, status string"


def migrations():
    status = F.col("status")
    return [Migration(2, status == "unknown"), Migration(3, (F.col("key") == "c") & (status == "held")), Migration(4, F.col("key").isin("a", "d"))]


def test_migrations_run_once_in_any_split(spark):
    rows = [("a", "known", 1), ("b", "unknown", 1), ("c", "held", 2), ("d", "known", 4), ("e", "unknown", 2), ("f", "held", None), ("g", None, 1)]
    state = spark.createDataFrame(rows, "key string, status string, revision int")
    want = {("d", "known", 4), ("e", "unknown", 4), ("f", "held", 4), ("g", None, 4)}
    for split in ([[0, 1, 2]], [[0], [1], [2]], [[0, 1], [2]], [[0], [0, 1, 2], [2, 1, 0]]):
        now, applied = state, []
        for part in split:
            now, applied = versioned.migrate(now, [migrations()[n] for n in part], applied)
        assert {tuple(r) for r in now.collect()} == want and applied == [2, 3, 4]
    # A result that was made anew since is not dropped again.
    again = now.unionByName(spark.createDataFrame([("b", "unknown", 4)], now.schema))
    assert versioned.migrate(again, migrations(), applied)[0].count() == 5


def test_state_table(spark, tmp_path):
    """Results, migrations and their record are one generation; dropped keys are open again."""
    table = StateTable(spark, str(tmp_path / "state"), "key", STATE)
    assert table.read().count() == 0 and table.applied() == []
    table.record(spark.createDataFrame([("a", "known"), ("b", "unknown"), ("c", "held")], STATE), 1)
    assert table.migrate(migrations()[:2]) == [2, 3] and table.migrate(migrations()[:2]) == [] and table.applied() == [2, 3]
    assert {tuple(r) for r in table.read().collect()} == {("a", "known", 3)}
    candidates = spark.createDataFrame([("a",), ("b",), ("z",), ("b",)], "key string")
    assert sorted(r.key for r in table.open_keys(candidates).collect()) == ["b", "z"]
    table.record(spark.createDataFrame([("b", "known"), ("a", "unknown")], STATE), 2)  # a late result of older rules changes nothing newer
    assert {tuple(r) for r in table.read().collect()} == {("a", "known", 3), ("b", "known", 2)}
    table.retain(candidates.filter("key = 'b'"))
    assert [r.key for r in table.read().collect()] == ["b"] and table.applied() == [2, 3]


def test_a_failed_migration_changes_nothing(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "state"), "key", STATE)
    table.record(spark.createDataFrame([("a", "known")], STATE), 1)
    with pytest.raises(Exception, match="broken rule"):
        table.migrate([Migration(2, F.col("status") == "unknown"), Migration(3, F.raise_error(F.lit("broken rule")).cast("boolean"))])
    assert table.applied() == [] and [tuple(r) for r in table.read().collect()] == [("a", "known", 1)]
