"""Reads: typed, optional and enveloped tables, XML site maps, keyed JSON objects."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

RELEASE = (
    "url string, kind string, version string, product_code string, region string, requirement string, variant string, edition string, "
    "section string, label string, evidence string, filename string, conflict boolean"
)
LISTING = f"name string, page_url string, source string, catalog_id string, download_links map<string,array<string>>, release_links array<struct<{', '.join(x.replace(' ', ':', 1) for x in RELEASE.split(', '))}>>"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


class NoSharedFolder(RuntimeError):
    """A cluster session that names no folder which all executors see."""


def working_dir(spark: SparkSession) -> str:
    """A new folder's path under spark.checkpoint.dir, which driver and executors share.

    Only a local session that names none (as in tests) gets a local one; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tallystone-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tallystone-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Cuts lineage: writes df at a shared path and rereads it with its schema."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a folder in whichever file system holds it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def keep_schema(df: DataFrame, path: str) -> None:
    """Writes the schema of a table beside it, since an empty table in folders has no file that says it."""
    df.sparkSession.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def kept_schema(spark: SparkSession, path: str) -> StructType:
    return StructType.fromJson(json.loads(spark.read.text(path).first().value))


def read_json_array(spark: SparkSession, path: str, schema: str = LISTING) -> DataFrame:
    """A JSON array of records; a file that is no array of objects fails."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_optional(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A table that may be absent: then it is empty, with its schema."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_envelope(spark: SparkSession, path: str, record: str) -> DataFrame:
    """The records of an object {records: [...]} as rows."""
    df = spark.read.schema(f"records array<struct<{record}>>").option("multiLine", True).json(path)
    return df.select(F.explode("records").alias("r")).select("r.*")


def read_keyed(spark: SparkSession, path: str, field: str, value: str) -> DataFrame:
    """An object of keyed values as rows (key, value columns)."""
    df = spark.read.schema(f"{field} map<string,struct<{value}>>").option("multiLine", True).json(path)
    return df.select(F.explode(field).alias("key", "v")).select("key", "v.*")


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """url and lastmod of an XML site map."""
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path).withColumnRenamed("loc", "url")


def explode_links(listings: DataFrame) -> DataFrame:
    """name, page_url, grp, pos, url: the grouped links of listings in their order."""
    groups = listings.select("name", "page_url", F.explode_outer("download_links").alias("grp", "urls"))
    return groups.select("name", "page_url", "grp", F.posexplode("urls").alias("pos", "url"))
