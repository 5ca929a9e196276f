"""Published generations: a reader sees one whole generation, wherever the writer stops."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallystone.sources import generations
from tallystone.sources.generations import LostRace, TooFewRows, current, publish, read_published, sweep


class Killed(BaseException):
    """A writer that dies; nothing of its clean-up runs."""


def rows(df):
    return sorted(r.id for r in df.collect())


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "t")


def test_publish_read_and_keep(spark, path, tmp_path):
    first = publish(spark.range(3), path, least_rows=2)
    assert first.rows == 3 and first.number == 1 and rows(read_published(spark, path)) == [0, 1, 2]
    publish(read_published(spark, path).union(spark.range(10, 12)), path, least_rows=2)  # reads itself
    assert rows(read_published(spark, path)) == [0, 1, 2, 10, 11]
    reader = read_published(spark, path)
    publish(spark.range(5), path, least_rows=2)
    assert rows(reader) == [0, 1, 2, 10, 11] and rows(read_published(spark, path)) == [0, 1, 2, 3, 4]  # the one before still stands
    for n in range(4):
        publish(spark.range(n + 2), path, least_rows=1)
    folders = [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("generation-")]
    assert len(folders) == 2 and rows(read_published(spark, path)) == [0, 1, 2, 3, 4]


def test_bad_results_leave_the_table(spark, path, tmp_path):
    publish(spark.range(3), path, least_rows=2)
    failing = spark.range(3).select(F.raise_error(F.lit("broken")).cast("long").alias("id"))
    with pytest.raises(TooFewRows):
        publish(spark.range(1), path, least_rows=2)
    with pytest.raises(Exception, match="broken"):
        publish(failing, path, least_rows=2)
    assert rows(read_published(spark, path)) == [0, 1, 2] and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("generation-")]) == 1


def test_before_the_first(spark, path):
    assert current(spark, path) is None and read_published(spark, path, "id long").count() == 0
    with pytest.raises(FileNotFoundError):
        read_published(spark, path)


@pytest.mark.parametrize("step", ["before the rows", "after the rows", "at the pointer", "in the pointer", "after the pointer", "while retiring"])
@pytest.mark.parametrize("had", [True, False])
def test_killed_at_each_step(spark, path, monkeypatch, step, had):
    """The old generation until the pointer is whole, the new one from then on; the next writer is not hindered."""
    if had:
        publish(spark.range(3), path, least_rows=1)
    create, delete = generations._create, generations.delete_path

    def die(*_):
        raise Killed

    def cut_short(spark, at, text):
        create(spark, at, text[: len(text) // 2])
        raise Killed

    def created(spark, at, text):
        create(spark, at, text)
        raise Killed

    class Broken:
        schema, sparkSession = spark.range(1).schema, spark

        @property
        def write(self):
            raise Killed

    with monkeypatch.context() as m:
        m.setattr(generations, "delete_path", lambda *_: None)  # a dead writer cleans nothing up
        if step == "while retiring":
            m.setattr(generations, "retire", die)
        elif step != "before the rows":
            m.setattr(generations, "_create", {"after the rows": die, "at the pointer": die, "in the pointer": cut_short, "after the pointer": created}[step])
        with pytest.raises(Killed):
            publish(Broken() if step == "before the rows" else spark.range(100, 105), path, least_rows=1)
    new = step in ("after the pointer", "while retiring")
    want = list(range(100, 105)) if new else [0, 1, 2] if had else []
    assert rows(read_published(spark, path, "id long")) == want
    assert generations.delete_path is delete
    publish(spark.range(7), path, least_rows=1)
    assert rows(read_published(spark, path)) == list(range(7))
    stray = sweep(spark, path, hours=0)
    assert len(stray) == (0 if new or step == "before the rows" else 1) and rows(read_published(spark, path)) == list(range(7))


def test_two_writers(spark, path, monkeypatch):
    """The slower of two writers leaves the table as the faster one made it."""
    publish(spark.range(2), path, least_rows=1)
    create = generations._create

    def late(spark, at, text):
        monkeypatch.setattr(generations, "_create", create)
        publish(spark.range(50, 53), path, least_rows=1)
        return create(spark, at, text)

    monkeypatch.setattr(generations, "_create", late)
    with pytest.raises(LostRace):
        publish(spark.range(9), path, least_rows=1)
    assert rows(read_published(spark, path)) == [50, 51, 52]


def test_pointer_is_one_line_of_json(spark, path, tmp_path):
    publish(spark.range(4), path, least_rows=1)
    (pointer,) = [p for p in (tmp_path / "t" / "_pointers").iterdir() if p.name.isdigit()]
    assert json.loads(pointer.read_text())["rows"] == 4 and pointer.read_text().count("\n") == 1
