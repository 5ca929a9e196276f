"""Version-aware choice of rows per family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.functions.text import region_alias, upper_clean
from tallystone.functions.versions import version_key


def newest_flag(rows: DataFrame, family: list[str], version: str, eligible: Column) -> DataFrame:
    """Adds newest: eligible, the family has more than one version, and this is the largest.

    The family's versions are aggregated and joined back, so a large family is pre-combined.
    """
    usable = eligible & F.col(version).isNotNull()
    stats = rows.filter(usable).groupBy(*family).agg(F.min(version).alias("_lo"), F.max(version).alias("_hi"))
    flag = usable & (F.col("_lo") < F.col("_hi")) & (F.col(version) == F.col("_hi"))
    return rows.join(stats, family, "left").withColumn("newest", F.coalesce(flag, F.lit(False))).drop("_lo", "_hi")


def best_per_family(rows: DataFrame, family: list[str], order: list[Column]) -> DataFrame:
    """The first row of each family. Ends with a position: ties are never left to chance.

    Spark's window group limit keeps one row per family and task before the shuffle, so a large
    family is not gathered.
    """
    w = Window.partitionBy(*family).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def updates_over_base(bases: DataFrame, updates: DataFrame, family: list[str], version: str) -> DataFrame:
    """Updates newer than their family's chosen base; all versioned ones if the base has no version."""
    b = bases.select(*family, F.col(version).alias("_base"))
    newer = F.col(version).isNotNull() & (F.col("_base").isNull() | (F.col(version) > F.col("_base")))
    return updates.join(b, family).filter(newer).drop("_base")


def domain_rank(domain: Column, preferred: str | None, tested: list[str]) -> Column:
    """0 for the preferred domain, then the tested ones in order, then 10."""
    out = F.when(domain == preferred, 0) if preferred else F.when(F.lit(False), 0)
    for n, d in enumerate(tested, 1):
        out = out.when(domain == d, n)
    return out.otherwise(10)


def family_key(product: Column, region: Column, edition: Column, page: Column, section: Column, conflict: Column, n_regions: Column, codes: str = "CUSA") -> Column:
    """JSON of the five fields; null for a conflict, a missing page or region, a product code of another kind, or not exactly one region.

    n_regions is null where a release carries no list of regions.
    """
    said = lambda c: upper_clean(F.coalesce(c, F.lit("")))
    area = region_alias(F.coalesce(region, F.lit("")))
    ok = said(product).rlike(rf"^{codes}\d{{5}}$") & (F.coalesce(n_regions, F.lit(1)) == 1) & ~F.coalesce(conflict, F.lit(False)) & (F.coalesce(page, F.lit("")) != "") & (area != "")
    return F.when(ok, F.to_json(F.array(said(product), area, said(edition), page, said(section))))


def choose_families(releases: DataFrame, fits: Column, wanted: DataFrame | None = None) -> DataFrame:
    """One family per game: game, family, base and update (positions of the releases chosen), n_dlc.

    releases: game, family (family_key, rows without one are left out), kind, version, variant,
    host_rank, pos. Of a family's bases that fit: versioned first, newest first, those without a
    variant first, best host, first position. Its update is chosen alike among those newer than the
    base, or all versioned ones if the base has no version. Families need a base, fitting or not.
    They are ranked by the base's host (100 without a chosen base), those with an update first, then
    by position; a family that wanted (game, family) names comes before all. DLC count only with a base.
    """
    key = ["game", "family"]
    # Rows without a family are told by their count of bases; a filter would work every key out twice.
    rows = releases.filter(F.col("kind").isin("base", "update", "dlc")).withColumns({"_fits": F.coalesce(fits, F.lit(False)), "_v": version_key(F.col("version"))})
    # The larger, the better.
    better = F.struct(F.col("_v").isNotNull().alias("a"), F.col("_v").alias("b"), (F.coalesce("variant", F.lit("")) == "").alias("c"), (-F.col("host_rank")).alias("d"), (-F.col("pos")).alias("e"))
    fitting = lambda kind: F.when((F.col("kind") == kind) & F.col("_fits"), better)
    # An update has to be newer than the base only, and the newest is the first choice, so the best of all updates decides.
    families = rows.groupBy(*key).agg(
        F.min("pos").alias("_first"), F.count_if((F.col("kind") == "base") & F.col("family").isNotNull()).alias("_bases"), F.count_if(F.col("kind") == "dlc").alias("_dlc"),
        F.max_by(F.struct("pos", "host_rank", "_v"), fitting("base")).alias("_base"), F.max_by(F.struct("pos", "_v"), fitting("update")).alias("_new"),
    ).filter("_bases > 0")
    newer = F.col("_base").isNotNull() & F.col("_new._v").isNotNull() & (F.col("_base._v").isNull() | (F.col("_new._v") > F.col("_base._v")))
    scored = families.withColumn("_update", F.when(newer, F.col("_new.pos")))
    if wanted is not None:
        scored = scored.join(wanted.select(*key).distinct().withColumn("_wanted", F.lit(True)), key, "left")
    order = F.struct(
        (F.lit(True) if wanted is None else F.col("_wanted").isNull()).alias("a"), F.coalesce("_base.host_rank", F.lit(100)).alias("b"), F.col("_update").isNull().alias("c"), F.col("_first").alias("d")
    )
    best = scored.groupBy("game").agg(F.min_by(F.struct("family", "_base", "_update", "_dlc"), order).alias("f"))
    n_dlc = F.when(F.col("f._base").isNotNull(), F.col("f._dlc")).otherwise(F.lit(0))
    return best.select("game", "f.family", F.col("f._base.pos").alias("base"), F.col("f._update").alias("update"), n_dlc.alias("n_dlc"))
