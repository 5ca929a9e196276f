"""Faceted filter, search, ordering and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facet_filter(releases: DataFrame, entity: str, wanted: Column) -> DataFrame:
    """Entities with a release that meets the facets, with the number of those releases."""
    return releases.filter(F.coalesce(wanted, F.lit(False))).groupBy(entity).agg(F.count("*").alias("n_releases"))


def kind_facet(kind: Column, conflict: Column, known: list[str], wanted: str) -> Column:
    """unknown is no kind, a kind outside the known ones, or a conflict; a specific kind excludes conflicts."""
    in_conflict = F.coalesce(conflict, F.lit(False))
    if wanted == "unknown":
        return in_conflict | kind.isNull() | ~kind.isin(*known)
    return F.coalesce((kind == wanted) & ~in_conflict, F.lit(False))


def region_facet(regions: Column, conflict: Column, wanted: str) -> Column:
    """Empty wants all; unknown wants rows without regions; a conflict is in no region."""
    if not wanted:
        return F.lit(True)
    if wanted == "unknown":
        return (F.size(F.coalesce(regions, F.array().cast("array<string>"))) == 0) & ~F.coalesce(conflict, F.lit(False))
    return F.coalesce(F.array_contains(regions, wanted) & ~F.coalesce(conflict, F.lit(False)), F.lit(False))


def recommendation_context(releases: DataFrame, source: Column, region: Column, kind: Column) -> DataFrame:
    """releases with in_view (all facets) and in_context (all but kind), which bases of a family keep while updates alone are viewed.

    Entities without a release in view go; the rest of their releases stays for the recommendation.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    marked = releases.withColumns({"in_context": yes(source) & yes(region), "in_view": yes(source) & yes(region) & yes(kind)})
    return marked.filter("in_context")


def scope_filter(rows: DataFrame, scope: str, query: str = "", market: str = "") -> DataFrame:
    """Rows (name, listings, catalogued, outside, regions) of one scope: gaps, matched, all or outside.

    query is looked for in the name and the listings' names. A market holds for reference rows only.
    """
    wanted = {"outside": F.col("outside"), "gaps": ~F.col("outside") & ~F.col("catalogued"), "matched": ~F.col("outside") & F.col("catalogued")}.get(scope, ~F.col("outside"))
    hit = search([F.col("name"), F.array_join("listings", " ")], query) if query.strip() else F.lit(True)
    of_market = F.array_contains("regions", market) if market and scope != "outside" else F.lit(True)
    return rows.filter(F.coalesce(wanted & hit & of_market, F.lit(False)))


def name_order(name: Column | str, descending: bool = False) -> Column:
    """The order of names that readers expect: accents and letter case decide last (the root locale's collation)."""
    collated = F.collate(name, "UNICODE")
    return collated.desc() if descending else collated.asc()


def folded(name: Column) -> Column:
    """Lower case in which spellings of one letter are one: ß is ss, a final sigma a sigma."""
    return F.translate(F.replace(F.lower(name), F.lit("ß"), F.lit("ss")), "ς", "σ")


def section_order(section: Column) -> list[Column]:
    """Sections with # first, then in the order of names."""
    return [F.when(section == "#", 0).otherwise(1).asc(), name_order(section)]


def search(fields: list[Column], query: str) -> Column:
    """Case-insensitive substring over the joined fields."""
    return F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(query.strip().lower()))


def unknown_last(column: str, descending: bool) -> Column:
    """Order that puts unknown values last in both directions; 0 is a known value."""
    return F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()


def paginate(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page, clamped to the pages that exist. order must be total.

    Each task keeps offset + size rows, so this is for pages near the front; ``page_after`` takes
    any page at the cost of the first.
    """
    pages = max(1, -(-rows.count() // size))
    return rows.orderBy(*order).offset(min(max(page, 0), pages - 1) * size).limit(size)


def page_after(rows: DataFrame, keys: list[tuple[str, bool]], last: tuple | None, size: int) -> DataFrame:
    """The page that follows the row with the key values last (the first page for None).

    keys: (column, descending), together total and without nulls. The filter reaches the scan, and
    each task keeps size rows, however deep the page lies.
    """
    beyond, equal = F.lit(last is None), F.lit(True)
    for (name, descending), value in zip(keys, last or (), strict=False):
        beyond = beyond | equal & (F.col(name) < F.lit(value) if descending else F.col(name) > F.lit(value))
        equal = equal & (F.col(name) == F.lit(value))
    return rows.filter(beyond).orderBy(*(F.desc(n) if d else F.asc(n) for n, d in keys)).limit(size)
