"""Reconciliation of a catalogue with a dated reference: matched, gaps, outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds; null if none does."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, rule in rules:
        out = out.when(F.coalesce(rule, F.lit(False)), F.lit(name))
    return out


def reconcile(reference: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """key, state (matched, gap, outside), n_entries. Both sides are reduced to one row per key first."""
    ref = reference.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_ref", F.lit(True))
    cat = catalogue.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_entries"))
    state = F.when(F.col("_ref").isNull(), "outside").when(F.col("n_entries").isNull(), "gap").otherwise("matched")
    return ref.join(cat, key, "full_outer").select(key, state.alias("state"), F.coalesce("n_entries", F.lit(0)).alias("n_entries"))


def invariant(reconciled: DataFrame, reference: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """Counts and two differences that must be zero: matched + outside = local, matched + gaps = reference."""
    n = lambda s: F.count_if(F.col("state") == s)
    states = reconciled.agg(n("matched").alias("matched"), n("gap").alias("gaps"), n("outside").alias("outside"))
    local = catalogue.agg(F.count_distinct(key).alias("local"))
    listed = reference.agg(F.count_distinct(key).alias("listed"))
    # Three one-row tables, joined by a constant.
    rows = [t.withColumn("_one", F.lit(1)) for t in (states, local, listed)]
    return rows[0].join(rows[1], "_one").join(rows[2], "_one").select(
        "matched", "gaps", "outside", (F.col("matched") + F.col("outside") - F.col("local")).alias("local_difference"),
        (F.col("matched") + F.col("gaps") - F.col("listed")).alias("reference_difference"),
    )


def eligible(games: DataFrame, roots: DataFrame, dates: DataFrame, in_scope: Column, unreleased: Column) -> tuple[DataFrame, DataFrame]:
    """Reference titles by root, and how many games each reason excludes; the first reason that holds counts.

    games: id and what in_scope and unreleased read. roots: node, root. dates: id, day, label; only
    qualifying days. A game needs a root, a type in scope for itself and for its root, a status that
    is not unreleased, and a day of its own. It is credited to its root: root, reference_ids,
    first_release and the label of that day (of equal days the first label).
    """
    own = games.withColumns({"_scope": F.coalesce(in_scope, F.lit(False)), "_unreleased": F.coalesce(unreleased, F.lit(False))}).select("id", "_scope", "_unreleased")
    first = dates.groupBy("id").agg(F.min(F.struct("day", "label")).alias("_first"))
    of_root = own.select(F.col("id").alias("root"), F.col("_scope").alias("_root_scope"))
    rows = own.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").join(of_root, "root", "left").join(first, "id", "left")
    reason = first_reason([
        ("unresolved parent", F.col("root").isNull()), ("type out of scope", ~(F.col("_scope") & F.coalesce("_root_scope", F.lit(False)))),
        ("unreleased status", F.col("_unreleased")), ("no qualifying date", F.col("_first").isNull()),
    ])
    judged = rows.withColumn("reason", reason)
    kept = judged.filter("reason IS NULL").groupBy("root").agg(F.array_sort(F.collect_list("id")).alias("reference_ids"), F.min("_first").alias("_first"))
    reasons = judged.filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))
    return kept.select("root", "reference_ids", F.col("_first.day").alias("first_release"), F.col("_first.label").alias("label")), reasons


def totals(listings: DataFrame, links: str) -> DataFrame:
    """n_listings and n_links of listings with an array column of links."""
    return listings.agg(F.count("*").alias("n_listings"), F.coalesce(F.sum(F.greatest(F.size(links), F.lit(0))), F.lit(0)).alias("n_links"))


def dates_of(games: DataFrame, dates: DataFrame) -> DataFrame:
    """Each game's dates, one row each; games without one have a row without a date."""
    return games.join(dates, "id", "left")


def titles_per_region(reference: DataFrame, regions: DataFrame) -> DataFrame:
    """region and n_titles: reference titles (root) that the catalogue has with that region (root, region); each counts once in a region."""
    pairs = regions.select("root", "region").distinct()
    return pairs.join(reference.select("root").distinct(), "root", "left_semi").groupBy("region").agg(F.count("*").alias("n_titles"))
