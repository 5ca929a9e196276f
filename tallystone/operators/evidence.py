"""Evidence with explicit unknown and conflict states, and context carried through documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_conflict(rows: DataFrame, key: str, identity: list[str], pos: list[str]) -> DataFrame:
    """Per key: conflict if its rows state different identities (null as empty), else the last row's."""
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity]
    tuple_ = F.concat_ws("\x1f", *plain)
    agg = rows.groupBy(key).agg(
        (F.min(tuple_) != F.max(tuple_)).alias("conflict"),
        F.max_by(F.struct(*identity), F.struct(*pos)).alias("_last"),
    )
    return agg.select(key, "conflict", *(F.when(~F.col("conflict"), F.col(f"_last.{c}")).alias(c) for c in identity))


def unique_or_null(values: Column) -> Column:
    """Aggregate: the only distinct value, else null."""
    return F.when(F.min(values) == F.max(values), F.max(values))


def intersect_evidence(sources: list[Column]) -> tuple[Column, Column]:
    """Codes that all non-empty sources share, and identified, multiple, unknown or conflict."""
    given = F.filter(F.array(*sources), lambda s: F.size(s) > 0)
    first = F.coalesce(F.try_element_at(given, F.lit(1)), F.array().cast("array<string>"))
    common = F.aggregate(given, first, lambda acc, s: F.array_intersect(acc, s))
    n = F.size(common)
    status = F.when((F.size(given) > 1) & (n == 0), F.lit("conflict")).when(n > 1, F.lit("multiple")).when(n == 1, F.lit("identified")).otherwise(F.lit("unknown"))
    return F.array_sort(common), status


def intersect_grouped(rows: DataFrame, key: str, source: str, code: str) -> DataFrame:
    """key, codes (sorted, joined by /), status: codes that every source of a key names."""
    per = rows.select(key, source, code).distinct()
    n_sources = per.groupBy(key).agg(F.count_distinct(source).alias("n_sources"))
    shared = per.groupBy(key, code).agg(F.count("*").alias("n")).join(n_sources, key).groupBy(key).agg(
        F.max("n_sources").alias("n_sources"), F.array_sort(F.collect_list(F.when(F.col("n") == F.col("n_sources"), F.col(code)))).alias("_codes")
    )
    n = F.size("_codes")
    status = F.when((n == 0) & (F.col("n_sources") > 1), "conflict").when(n > 1, "multiple").when(n == 1, "identified").otherwise("unknown")
    return shared.select(key, "n_sources", F.array_join("_codes", " / ").alias("codes"), status.alias("status"))


def layered(*layers: Column) -> Column:
    """The value of the strongest layer that states one; strongest first."""
    return F.coalesce(*layers)


def null_on_conflict(a: Column, b: Column) -> tuple[Column, Column]:
    """The value that two layers agree on (or only one states), and whether they differ."""
    differ = F.coalesce(a != b, F.lit(False))
    return F.when(~differ, F.coalesce(a, b)), differ


def carry_forward(rows: DataFrame, doc: str, order: list[str], resets: Column, context: Column) -> DataFrame:
    """Adds context: the last one stated since the last reset. A statement replaces it whole."""
    along = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.withColumn("_scope", F.sum(F.when(resets, 1).otherwise(0)).over(along)).withColumn("_stated", context)
    within = Window.partitionBy(doc, "_scope").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("context", F.last("_stated", ignorenulls=True).over(within)).drop("_scope", "_stated")


def value_after_label(rows: DataFrame, doc: str, order: list[str], is_label: Column, value: Column) -> DataFrame:
    """Rows that are a label, with value from the next row of the document."""
    w = Window.partitionBy(doc).orderBy(*order)
    return rows.withColumn("value", F.lead(value).over(w)).filter(is_label)
