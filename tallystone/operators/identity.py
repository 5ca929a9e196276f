"""Entity resolution against a reference table with aliases, parents and reviewed overrides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.sources.tables import working_dir, written


def unique_match(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """name_id, ref_id, status: matched only if a key has exactly one candidate id.

    Aliases are reduced to one row per key before the join, so common keys do not multiply rows.
    """
    index = aliases.groupBy("key").agg(F.min("ref_id").alias("lo"), F.max("ref_id").alias("hi"))
    found = names.join(index, "key", "left").groupBy("name_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    status = F.when(F.col("lo").isNull(), "unmatched").when(F.col("lo") == F.col("hi"), "matched").otherwise("ambiguous")
    return found.select("name_id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("ref_id"), status.alias("status"))


#: How many candidates an undecided name lists, the smallest ids first.
MOST_LISTED = 20


def candidate_index(reference: DataFrame, key: str) -> DataFrame:
    """What a tier needs to know about a key's candidates, one row per key, from one aggregate.

    reference: the key, ref_id, root_id, on_platform. pick is the candidate that is a root, else the
    one with the smallest id; least is the smallest id. A candidate without a root makes its key ambiguous.
    """
    on = F.coalesce("on_platform", F.lit(False))
    return reference.groupBy(F.col(key).alias("key")).agg(
        F.min("root_id").alias("lo"), F.max("root_id").alias("hi"), F.bool_or(F.col("root_id").isNull()).alias("loose"),
        F.min(F.when(F.col("root_id") == F.col("ref_id"), F.col("ref_id"))).alias("top"), F.min("ref_id").alias("least"),
        F.min(F.when(on, F.col("root_id"))).alias("plo"), F.max(F.when(on, F.col("root_id"))).alias("phi"), F.bool_or(on & F.col("root_id").isNull()).alias("ploose"), F.min(F.when(on, F.col("ref_id"))).alias("pid"),
    )


def candidate_lists(reference: DataFrame, key: str) -> DataFrame:
    """key and ids, the smallest candidates of a key; ranks are cut before the shuffle, so that a common key is never gathered."""
    ranked = reference.select(F.col(key).alias("key"), "ref_id").distinct().withColumn("_rank", F.row_number().over(Window.partitionBy("key").orderBy("ref_id")))
    return ranked.filter(F.col("_rank") <= MOST_LISTED).groupBy("key").agg(F.array_sort(F.collect_list("ref_id")).alias("ids"))


def tiered_match(
    names: DataFrame, tiers: list[tuple[str, DataFrame]], known: DataFrame | None = None, pairs: list[tuple[str, str]] = (), lists: list[DataFrame] = ()
) -> DataFrame:
    """name_id, tier, ref_id and status of names (name_id, has_codes and one key column per tier).

    tiers: (key column, candidate_index) from strict to loose. Tier 0 is an id that the name carries
    (column known_id) and that known (ref_id) holds. Then the first tier with any candidate decides:
    one root gives its pick; several give the one root on the platform, if the name has product
    codes; else the name is ambiguous, and looser tiers are not asked. Names without any candidate
    come to the pair tier: pairs has the key columns of both halves of ``left (right)`` names per tier, and the
    first tier in which each half has one root, the same one, gives the left half's smallest id. A
    name may have several rows (aliases); their candidates count together. With lists, the
    candidate_lists of the tiers, undecided names list the smallest candidates of the tier that failed them.
    """
    rows = names
    for n, (key, index) in enumerate(tiers):
        rest = [c for c in index.columns if c != "key"]
        rows = rows.join(index.select(F.col("key").alias(key), *(F.col(c).alias(f"_t{n}_{c}") for c in rest)), key, "left")
    low, high, any_of = ("lo", "top", "least", "plo", "pid"), ("hi", "phi"), ("loose", "ploose")
    found = [f(f"_t{n}_{c}").alias(f"_t{n}_{c}") for n in range(len(tiers)) for f, columns in ((F.min, low), (F.max, high), (F.bool_or, any_of)) for c in columns]
    found.append(F.bool_or("has_codes").alias("codes"))
    if known is not None:
        rows = rows.join(known.select(F.col("ref_id").alias("known_id")).distinct().withColumn("_known", F.col("known_id")), "known_id", "left")
        found.append(F.min("_known").alias("_known"))
    one_row = rows.groupBy("name_id").agg(*found)
    if known is None:
        one_row = one_row.withColumn("_known", F.lit(None).cast("long"))
    one_row = one_row.withColumn("_pair", F.lit(None).cast("long")) if not pairs else one_row.join(_paired(names, tiers, pairs), "name_id", "left")
    has = [F.col(f"_t{n}_least").isNotNull() for n in range(len(tiers))]
    decides = F.coalesce(*(F.when(h, F.lit(n + 1)) for n, h in enumerate(has)))

    def of_tier(n: int) -> Column:
        t = lambda c: F.col(f"_t{n}_{c}")
        one = (t("lo") == t("hi")) & ~t("loose")
        platform = F.coalesce(F.col("codes"), F.lit(False)) & (t("plo") == t("phi")) & ~t("ploose")
        return F.when(one, F.coalesce(t("top"), t("least"))).when(platform, t("pid"))

    chosen = F.lit(None).cast("long")
    for n in reversed(range(len(tiers))):
        chosen = F.when(has[n], of_tier(n)).otherwise(chosen)
    pair = F.when(decides.isNull(), F.col("_pair"))
    ref = F.coalesce("_known", chosen, pair)
    tier = F.when(F.col("_known").isNotNull(), 0).when(decides.isNotNull(), decides).when(pair.isNotNull(), len(tiers) + 1)
    status = F.when(ref.isNotNull(), "matched").when(decides.isNull(), "unmatched").otherwise("ambiguous")
    out = one_row.select("name_id", tier.alias("tier"), ref.alias("ref_id"), status.alias("status"))
    return _listed(out, names, tiers, lists) if lists else out


def _listed(decided: DataFrame, names: DataFrame, tiers: list[tuple[str, DataFrame]], lists: list[DataFrame]) -> DataFrame:
    """decided with candidates: of undecided names those of their tier, of others none."""
    parts = []
    for n, ((key, _), ids) in enumerate(zip(tiers, lists, strict=True)):
        open_names = decided.filter((F.col("status") == "ambiguous") & (F.col("tier") == n + 1)).select("name_id")
        parts.append(names.select("name_id", F.col(key).alias("key")).join(open_names, "name_id", "left_semi").join(ids, "key").select("name_id", "ids"))
    each = reduce(DataFrame.unionByName, parts).groupBy("name_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, MOST_LISTED).alias("candidates"))
    return decided.join(each, "name_id", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<long>")))


def _paired(names: DataFrame, tiers: list[tuple[str, DataFrame]], pairs: list[tuple[str, str]]) -> DataFrame:
    """name_id and _pair, the id that the first deciding tier's pairs give."""
    rows = names
    for n, ((left, right), (_, index)) in enumerate(zip(pairs, tiers, strict=True)):
        for side, key in (("l", left), ("r", right)):
            facts = F.struct("lo", "hi", "loose", F.col("least").alias("id")).alias(f"_{side}{n}")
            rows = rows.join(index.select(F.col("key").alias(key), facts), key, "left")
    agree = [
        F.when((F.col(f"_l{n}.lo") == F.col(f"_l{n}.hi")) & (F.col(f"_r{n}.lo") == F.col(f"_r{n}.hi")) & (F.col(f"_l{n}.lo") == F.col(f"_r{n}.lo")) & ~F.col(f"_l{n}.loose") & ~F.col(f"_r{n}.loose"), F.col(f"_l{n}.id"))
        for n in range(len(pairs))
    ]
    return rows.groupBy("name_id").agg(F.min(F.coalesce(*agree)).alias("_pair"))


def name_halves(name: Column) -> tuple[Column, Column]:
    """The halves of a ``left (right)`` name; null for other names."""
    pattern = r"^(.+?)\s*\(([^()]+)\)\s*$"
    half = lambda n: F.nullif(F.regexp_extract(name, pattern, n), F.lit(""))
    return half(1), half(2)


def hierarchy_roots(edges: DataFrame, hops: int = 3) -> DataFrame:
    """node, root of every node of edges (node, parent; parent null for roots), one row per node.

    Pointers are lengthened round by round: each round replaces an open node's pointer by the pointer
    hops steps on, so that a chain of any length n is settled after about log(n) / log(hops + 1) rounds.
    Settled nodes are written once and stay; only open nodes are written again. A dangling parent gives
    null. While open nodes lead to a root, each round settles some; once one settles none, the rest lead
    to cycles, and get null too. Equal rows are one edge, and of several parents of a node the smallest
    counts. Each round joins a table with itself, so it is written first; else plans would grow too.
    """
    spark, folder = edges.sparkSession, working_dir(edges.sparkSession)
    one = edges.groupBy("node").agg(F.min("parent").alias("parent"))
    step = written(one.select("node", F.coalesce("parent", "node").alias("up"), F.col("parent").isNull().alias("done")), f"{folder}/pointers-0")
    settled, n, still_open = [step.filter("done")], 0, step.filter("NOT done").count()
    rest = step.filter("NOT done")
    while still_open:
        above = reduce(DataFrame.unionByName, [*settled, rest]).select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("done").alias("_done"))
        moved = rest
        for _ in range(hops):
            # A dangling pointer has no row above it, and is settled as null; a settled one stays where it is.
            moved = moved.join(above, "up", "left").select("node", F.when(F.col("up").isNotNull(), F.col("_up")).alias("up"), (F.col("done") | F.coalesce("_done", F.lit(True))).alias("done"))
        n += 1
        step = written(moved, f"{folder}/pointers-{n}")
        rest, left = step.filter("NOT done"), step.filter("NOT done").count()
        settled.append(step.filter("done"))
        if left == still_open:
            break
        still_open = left
    out = reduce(DataFrame.unionByName, settled).select("node", F.col("up").alias("root"))
    return out.unionByName(rest.select("node", F.lit(None).cast(out.schema["root"].dataType).alias("root"))) if still_open else out


def with_aliases(parents: DataFrame, aliases: DataFrame) -> DataFrame:
    """node, parent where an alias edge (node, target) wins over the parent."""
    a = aliases.select(F.col("node"), F.col("target"))
    return parents.join(a, "node", "left").select("node", F.coalesce("target", "parent").alias("parent"))


def guarded_override(entries: DataFrame, overrides: DataFrame, reference: DataFrame | None = None, types: tuple[str, ...] = ()) -> DataFrame:
    """name, ref_id, canonical_id, status and reason: reviewed decisions, where they still hold; other entries keep their own id.

    entries: name, sources, ref_id. overrides: name, sources, and one decision of three: a status (review or
    non_game); a ref_id; or a local identity, with canonical_id ``local:...``, canonical_name and a type of
    types. A decision whose sources are no more the entry's goes to review, and so does an id that
    reference (ref_id) does not hold: it is not replaced by a guess. A decision that is none of the
    three raises, as soon as an entry meets it.
    """
    for column, kind in (("status", "string"), ("canonical_id", "string"), ("canonical_name", "string"), ("type", "string")):
        if column not in overrides.columns:
            overrides = overrides.withColumn(column, F.lit(None).cast(kind))
    o = overrides.select(
        "name", F.struct("sources", "ref_id", "status", "canonical_id", "canonical_name", "type").alias("_o"),
    ).dropDuplicates(["name"])
    rows = entries.join(o, "name", "left")
    if reference is not None:
        held = reference.select(F.col("ref_id").alias("_held")).distinct()
        rows = rows.join(held, F.col("_o.ref_id") == F.col("_held"), "left")
    else:
        rows = rows.withColumn("_held", F.col("_o.ref_id"))
    same = F.coalesce(F.arrays_overlap("sources", "_o.sources"), F.lit(False))
    local = F.coalesce(F.col("_o.canonical_id").rlike("^local:[a-z0-9-]+$") & (F.col("_o.canonical_name") != "") & F.col("_o.type").isin(*types), F.lit(False)) if types else F.lit(False)
    broken = F.raise_error(F.concat(F.lit("malformed reviewed identity for "), F.col("name").cast("string"))).cast("string")
    status = (
        F.when(F.col("_o").isNull(), "unreviewed").when(~same, "review").when(F.col("_o.status").isin("review", "non_game"), F.col("_o.status"))
        .when(F.col("_o.ref_id").isNotNull(), F.when(F.col("_held").isNull(), "review").otherwise("override")).when(local, "local").otherwise(broken)
    )
    reason = F.when(F.col("_o").isNull(), F.lit(None).cast("string")).when(~same, "sources changed").when(F.col("_o.status").isNull() & F.col("_o.ref_id").isNotNull() & F.col("_held").isNull(), "reviewed id unavailable")
    judged = rows.select("name", "ref_id", "_o", status.alias("status"), reason.alias("reason"))
    ref = F.when(F.col("status") == "unreviewed", F.col("ref_id")).when(F.col("status") == "override", F.col("_o.ref_id"))
    return judged.select("name", ref.alias("ref_id"), F.when(F.col("status") == "local", F.col("_o.canonical_id")).alias("canonical_id"), "status", "reason")


def fresh_identity(listings: DataFrame, identities: DataFrame, key: str) -> DataFrame:
    """Adds fresh: the identity was made from the same input id and a source that still holds."""
    i = identities.select(F.col(key), F.col("input_id").alias("_input"), F.col("sources").alias("_sources"))
    same = F.col("ref_id").eqNullSafe(F.col("_input")) & F.arrays_overlap("sources", "_sources")
    return listings.join(i, key, "left").withColumn("fresh", F.coalesce(same, F.lit(False))).drop("_input", "_sources")


def identity_summary(decided: DataFrame) -> DataFrame:
    """listings, unique, matched, ambiguous, unmatched, duplicates; they add up to the listings."""
    n = lambda s: F.count_if(F.col("status") == s)
    return decided.agg(
        F.count("*").alias("listings"), F.count_distinct("ref_id").alias("unique_ids"), n("matched").alias("matched"),
        n("ambiguous").alias("ambiguous"), n("unmatched").alias("unmatched"),
        (n("matched") - F.count_distinct("ref_id")).alias("duplicates"),
    )


def resolve(matches: DataFrame, roots: DataFrame, types: DataFrame, in_scope: list[str], out_of_scope: list[str]) -> DataFrame:
    """matches (name_id, ref_id and more) with canonical_id and outcome: identified, non_game or review.

    roots: node, root. types: id, type. The root's type decides; without a match, a root or a known
    type the name is for review.
    """
    rows = matches.join(roots.select(F.col("node").alias("ref_id"), F.col("root").alias("canonical_id")), "ref_id", "left")
    typed = rows.join(types.select(F.col("id").alias("canonical_id"), F.col("type").alias("_type")), "canonical_id", "left")
    outcome = F.when(F.col("_type").isin(*in_scope), "identified").when(F.col("_type").isin(*out_of_scope), "non_game").otherwise("review")
    return typed.withColumn("outcome", outcome).drop("_type").select(*matches.columns, "canonical_id", "outcome")


def outcome_summary(resolved: DataFrame) -> DataFrame:
    """One row over resolved names (outcome, canonical_id as text, ref_id, reviewed_at): how many of each outcome, distinct and local identities, editions, reviews and duplicates.

    An identity that no reference holds has a canonical_id that begins with ``local:``. An edition is
    an identified name whose own id is not its root. Duplicates are identified names beyond the first of an identity.
    """
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    identified, canonical = F.col("outcome") == "identified", F.col("canonical_id").cast("string")
    unique = F.count_distinct(F.when(identified, canonical))
    return resolved.agg(
        F.count("*").alias("listings"), n(identified).alias("identified"), unique.alias("unique_games"), n(F.col("outcome") == "non_game").alias("non_game"), n(F.col("outcome") == "review").alias("unresolved"),
        n(F.col("reviewed_at").isNotNull()).alias("reviewed"), F.count_distinct(F.when(identified & canonical.startswith("local:"), canonical)).alias("local_games"),
        n(identified & (F.col("ref_id").cast("string") != canonical)).alias("editions"), (n(identified) - unique).alias("duplicates"),
    )
