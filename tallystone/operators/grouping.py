"""Union, first-wins and last-wins rows, release groups and entity groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """UNION ALL with source_ord, which decides who comes first later on."""
    tagged = [s.withColumn("source_ord", F.lit(n)) for n, s in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def first_wins(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key. order must be total; the aggregate combines before it shuffles."""
    return _one(rows, keys, order, F.min_by)


def last_wins(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The last row of each key: an upsert of arrivals, or the latest observation."""
    return _one(rows, keys, order, F.max_by)


def _one(rows: DataFrame, keys: list[str], order: list[Column | str], pick: object) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*rows.columns)


def valid_listings(listings: DataFrame) -> DataFrame:
    """Listings whose name is a text of its own: not blank and no address."""
    name = F.trim(F.coalesce("name", F.lit("")))
    return listings.filter((name != "") & ~name.rlike(r"(?i)^(?:https?:)?//"))


def claims(listings: DataFrame, links: DataFrame, ident: str, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first listing of each key among those that still have a link; a listing without one claims no key.

    links: ident of each surviving link.
    """
    return first_wins(listings.join(links.select(ident).distinct(), ident, "left_semi"), keys, order)


def release_rows(assets: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """assets with their place among those of one release, and its first position; no release is gathered."""
    normal = assets.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys})
    along = Window.partitionBy(*keys).orderBy(pos)
    return normal.withColumns({"place": F.row_number().over(along), "first_pos": F.first(pos).over(along)})


def release_groups(assets: DataFrame, keys: list[str], pos: str, url: str, metadata: list[str] = ()) -> DataFrame:
    """One row per release: null keys count as empty, n_assets, metadata as first seen, and its assets in order.

    The assets of one release are one array; ``release_rows`` gives them as rows, where releases may be large.
    """
    normal = assets.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys})
    grouped = normal.groupBy(*keys).agg(F.count("*").alias("n_assets"), F.min(pos).alias("first_pos"), F.sort_array(F.collect_list(F.struct(pos, url))).alias("_assets"), *(F.min_by(c, pos).alias(c) for c in metadata))
    return grouped.withColumn("assets", F.col("_assets")[url]).drop("_assets")


def label_ordinals(assets: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """ordinal: the place of an asset among those of one release and label."""
    return assets.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def entity_groups(listings: DataFrame, key: str, ref_id: str, order: list[str]) -> DataFrame:
    """entity_key per listing. The first id seen under a key owns it; rows without an id join it,
    and rows with another id go to key|id. The owner is one aggregate, so that a common key is
    pre-combined and never sorted as a group."""
    owners = listings.filter(F.col(ref_id).isNotNull()).groupBy(key).agg(F.min_by(ref_id, F.struct(*order)).alias("_owner"))
    rows = listings.join(owners, key, "left")
    own = F.col(ref_id).isNull() | F.col(ref_id).eqNullSafe(F.col("_owner"))
    return rows.withColumn("entity_key", F.when(own, F.col(key)).otherwise(F.concat_ws("|", F.col(key), F.col(ref_id).cast("string")))).drop("_owner")
