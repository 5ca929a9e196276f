"""JSON whose shape is decided by each file or value: lists, objects with records, and typed parts of other documents.

Documents are read whole as variants; a path is asked for as a type and is null where it is something else, so no
schema has to hold for all of them, and none is inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """file and document (variant) of each JSON file; null where a file is no JSON."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("document"))


def records_of(document: Column, field: str = "records") -> Column:
    """The records of a document that is a list of them, or an object with a list in a field; an object without one is a record itself."""
    as_list = F.try_variant_get(document, "$", "array<variant>")
    in_field = F.try_variant_get(document, f"$.{field}", "array<variant>")
    is_object = F.schema_of_variant(document).startswith("OBJECT")
    return F.coalesce(as_list, in_field, F.when(is_object & F.try_variant_get(document, f"$.{field}", "variant").isNull(), F.array(document)))


def read_records(spark: SparkSession, path: str, schema: str, field: str = "records") -> DataFrame:
    """file, pos and the fields of schema of every record of the JSON files at path, lists and objects alike.

    A field that is missing or of another type is null; a record that is no object has null fields. Files
    without records give no rows.
    """
    each = read_documents(spark, path).select("file", F.posexplode(records_of(F.col("document"), field)).alias("pos", "record"))
    fields = spark.createDataFrame([], schema).schema
    return each.select("file", "pos", *(F.try_variant_get("record", f"$['{f.name}']", f.dataType.simpleString()).alias(f.name) for f in fields))


def typed_parts(document: Column, kind_path: str, kinds: tuple[str, ...], id_path: str, ident: Column) -> Column:
    """The parts of a document, itself or those in its list or @graph, whose type is one of kinds and whose id is ident.

    A type may be one text or a list of them. Ids are compared as text.
    """
    parts = F.coalesce(
        F.try_variant_get(document, "$", "array<variant>"), F.try_variant_get(document, "$['@graph']", "array<variant>"), F.when(document.isNotNull(), F.array(document)),
        F.array().cast("array<variant>"),
    )
    kind = lambda v: F.coalesce(F.try_variant_get(v, kind_path, "array<string>"), F.array(F.try_variant_get(v, kind_path, "string")))
    of_kind = lambda v: F.coalesce(F.arrays_overlap(kind(v), F.array(*map(F.lit, kinds))), F.lit(False))
    return F.filter(parts, lambda v: of_kind(v) & F.coalesce(F.try_variant_get(v, id_path, "string") == ident, F.lit(False)))
