"""Tables that are replaced whole: generations in folders of their own, and pointers that say which one is current.

    path/generation-<uuid>/     the rows, as Parquet, never changed once written
    path/_pointers/<number>     one line of JSON that names a generation; the highest whole one is current

A new generation is written and counted beside the old ones. It becomes the table at one instant, when a pointer
with the next number is created, which fails if another writer took that number. Readers resolve the
pointer first, and so see one whole generation, whatever a writer does or where it dies: a pointer that was
cut short is passed over. The generations before the current one stay for readers that are still on
them, ``keep`` in all; what dead writers left behind goes with ``sweep``.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from tallystone.sources.tables import delete_path


class TooFewRows(RuntimeError):
    """A result so small that the last output is kept instead."""


class LostRace(RuntimeError):
    """Another writer published first; the table is as that writer left it."""


@dataclass(frozen=True)
class Generation:
    """What a pointer says: number, folder, rows, schema (JSON), when it was published, and older folders that still stand."""

    number: int
    folder: str
    rows: int
    schema: str
    published_at: float
    older: tuple[str, ...] = ()


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _pointer(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/_pointers/{number:012d}"


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all pointers, whole or not, highest first."""
    fs, at = _file_system(spark, f"{path.rstrip('/')}/_pointers")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted((int(n) for n in names if n.isdigit()), reverse=True)


def _read(spark: SparkSession, path: str) -> str | None:
    fs, at = _file_system(spark, path)
    try:
        stream = fs.open(at)
    except Py4JJavaError:
        return None  # removed since it was listed
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file that must not exist yet."""
    fs, at = _file_system(spark, path)
    try:
        stream = fs.create(at, False)
    except Py4JJavaError:
        if fs.exists(at):
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def current(spark: SparkSession, path: str) -> Generation | None:
    """The generation that readers see; None before the first one."""
    for number in _numbers(spark, path):
        text = _read(spark, _pointer(path, number))
        if text and text.endswith("\n"):  # whole
            found = json.loads(text)
            return Generation(**found | {"older": tuple(found["older"])})
    return None


def read_published(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows of the current generation; an empty table of schema, if that is given, before the first one."""
    now = current(spark, path)
    if now is None:
        if schema is None:
            raise FileNotFoundError(f"nothing was published at {path}")
        return spark.createDataFrame([], schema)
    from pyspark.sql.types import StructType

    return spark.read.schema(StructType.fromJson(json.loads(now.schema))).parquet(f"{path.rstrip('/')}/{now.folder}")


def publish(df: DataFrame, path: str, least_rows: int = 1000, keep: int = 2) -> Generation:
    """Makes df the table at path, unless it has too few rows, fails, or another writer is faster; then the table stays as it is.

    df may read the table itself.
    """
    spark, root = df.sparkSession, path.rstrip("/")
    before, taken = current(spark, root), _numbers(spark, root)
    folder = f"generation-{uuid.uuid4().hex}"
    published = False
    try:
        df.write.mode("errorifexists").parquet(f"{root}/{folder}")
        rows = spark.read.schema(df.schema).parquet(f"{root}/{folder}").count()
        if rows < least_rows:
            raise TooFewRows(f"{rows} rows, fewer than {least_rows}: the last output stays")
        older = ((before.folder, *before.older) if before else ())[: keep + 8]
        new = Generation((taken[0] if taken else 0) + 1, folder, rows, df.schema.json(), time.time(), older)
        published = _create(spark, _pointer(root, new.number), json.dumps(asdict(new)) + "\n")
    finally:
        if not published:
            delete_path(spark, f"{root}/{folder}")
    if not published:
        raise LostRace(f"{root} was published by another writer")
    retire(spark, root, new, keep)
    return new


def retire(spark: SparkSession, path: str, now: Generation, keep: int) -> None:
    """Removes what was published longer ago than keep generations: pointers first, so that none names a folder that is gone."""
    for number in _numbers(spark, path):
        if number < now.number:
            delete_path(spark, _pointer(path, number))
    for folder in now.older[keep - 1 :]:
        delete_path(spark, f"{path.rstrip('/')}/{folder}")


def sweep(spark: SparkSession, path: str, hours: float = 24) -> list[str]:
    """Removes generations that no pointer names and that are older than any running writer's; returns their names."""
    fs, at = _file_system(spark, path)
    now, gone = current(spark, path), []
    named = {now.folder, *now.older} if now else set()
    for found in fs.listStatus(at):
        name = found.getPath().getName()
        if name.startswith("generation-") and name not in named and time.time() - found.getModificationTime() / 1000 >= 3600 * hours:
            delete_path(spark, f"{path.rstrip('/')}/{name}")
            gone.append(name)
    return gone
