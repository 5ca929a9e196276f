"""Entities with nested releases: facets on the releases, and everything that follows from the releases that survive.

An entity is a row with ``name``, ``source``, ``aliases`` and an array ``releases`` of structs, which have at
least ``links``, an array of structs. Releases are filtered where they lie, so that no entity is taken
apart and grouped again, and the facets of one entity cost one pass over its own array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.operators.facets import kind_facet, region_facet

#: Fields of a link whose texts are searched, in their order.
LINK_FIELDS = ("label", "kind", "version", "product_code", "region", "requirement", "edition", "source_label", "section")


def release_facets(source: str = "", kind: str = "", region: str = "", kinds: tuple[str, ...] = ("base", "update", "dlc", "fix", "patch", "bundle")) -> tuple[Callable[[Column, Column], Column], Callable[[Column, Column], Column]]:
    """(in_view, in_context): whether a release, given the entity's own source, meets all facets, and all but the kind. Empty facets want all."""
    yes = lambda c: F.coalesce(c, F.lit(False))

    def in_context(release: Column, own_source: Column) -> Column:
        of_source = yes(F.coalesce(F.nullif(release["source"], F.lit("")), own_source) == source) if source else F.lit(True)
        return of_source & (region_facet(release["regions"], release["region_conflict"], region) if region else F.lit(True))

    def in_view(release: Column, own_source: Column) -> Column:
        of_kind = kind_facet(release["kind"], release["conflict"], list(kinds), kind) if kind else F.lit(True)
        return in_context(release, own_source) & of_kind

    return in_view, in_context


def narrow(entities: DataFrame, in_view: Callable[[Column, Column], Column], in_context: Callable[[Column, Column], Column]) -> DataFrame:
    """Entities with a release in view: releases, links and total_links of what is in view, and recommendation_releases of what is in context."""
    kept = entities.withColumns({
        "recommendation_releases": F.filter("releases", lambda r: in_context(r, F.col("source"))),
        "releases": F.filter("releases", lambda r: in_view(r, F.col("source"))),
    }).filter(F.size("releases") > 0)
    return with_links(kept)


def with_links(entities: DataFrame) -> DataFrame:
    """links and total_links, made anew from the releases in their order."""
    links = F.flatten(F.array_compact(F.transform("releases", lambda r: r["links"])))
    return entities.withColumn("links", links).withColumn("total_links", F.greatest(F.size("links"), F.lit(0)))


def search_text(entities: DataFrame) -> Column:
    """The lower-cased text that a search looks through: the name, the source, aliases and the surviving links' fields."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    fields = [f.name for f in entities.schema["links"].dataType.elementType.fields]
    of_link = F.flatten(F.transform("links", lambda x: F.array(*(blank(x[f]) for f in LINK_FIELDS if f in fields))))
    none = F.array().cast("array<string>")
    return F.lower(F.array_join(F.concat(F.array(blank(F.col("name")), blank(F.col("source"))), F.coalesce(F.transform("aliases", blank), none), F.coalesce(of_link, none)), " "))


def find(entities: DataFrame, query: str = "", source: str = "", kind: str = "", region: str = "") -> DataFrame:
    """Entities that meet the facets and hold the query, a piece of text, in what survives of them.

    A link that the facets removed is not found by its label any more.
    """
    found = narrow(entities, *release_facets(source, kind, region)) if source or kind or region else with_links(entities).withColumn("recommendation_releases", F.col("releases"))
    wanted = query.strip().lower()
    return found.filter(F.contains(search_text(found), F.lit(wanted))) if wanted else found
