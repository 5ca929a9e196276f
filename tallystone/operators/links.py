"""Links: classification, allow and deny rules, fallback metadata, and links appended to rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions import urls


def classify(url: Column, rules: list[tuple[str, str, str]], default: tuple[str, str]) -> tuple[Column, Column]:
    """label and group of the first rule (domain, label, group) whose domain holds the URL."""
    host = F.coalesce(urls.domain(url), F.lit(""))
    label = group = None
    for domain, name, kind in rules:
        hit = urls.in_domain(host, domain)
        label = label.when(hit, F.lit(name)) if label is not None else F.when(hit, F.lit(name))
        group = group.when(hit, F.lit(kind)) if group is not None else F.when(hit, F.lit(kind))
    return (label.otherwise(F.lit(default[0])), group.otherwise(F.lit(default[1]))) if label is not None else (F.lit(default[0]), F.lit(default[1]))


def classified(links: DataFrame, rules: DataFrame, default: tuple[str | None, str] = (None, "other")) -> DataFrame:
    """links (url) with label and grp of the first rule that holds; without one the default, whose label is the bare domain if None.

    rules: ord, domain, path (a pattern that is looked for in the path, or null for all paths), label,
    grp. A rule holds for its domain and those below it. The rules are a table of any size: each
    address is joined with those of the domains that it lies in, and addresses are classified once.
    """
    domain = F.coalesce(urls.domain(F.col("url")), F.lit(""))
    each = links.select("url").filter("url IS NOT NULL").distinct().select("url", urls.path_of(F.col("url")).alias("_path"), F.explode(urls.enclosing_domains(domain)).alias("domain"))
    held = each.join(rules.select("ord", "domain", "path", "label", "grp"), "domain").filter(F.col("path").isNull() | F.regexp_like("_path", "path"))
    first = held.groupBy("url").agg(F.min_by(F.struct("label", "grp"), "ord").alias("_rule"))
    label, grp = F.coalesce("_rule.label", domain if default[0] is None else F.lit(default[0])), F.coalesce("_rule.grp", F.lit(default[1]))
    return links.join(first, "url", "left").withColumns({"label": label, "grp": grp}).select(*links.columns, "label", "grp")


def allowed(url: Column, domains: list[str]) -> Column:
    host = F.coalesce(urls.domain(url), F.lit(""))
    return reduce(lambda a, b: a | b, [urls.in_domain(host, d) for d in domains], F.lit(False))


def is_navigation(url: Column, closed: list[str], pages: list[tuple[str, str]] = (), only: list[tuple[str, str]] = ()) -> Column:
    """Links that lead to no file: hosts that are closed or for sharing, named pages of a host, and all of a host but some paths.

    pages: (domain, path). only: (domain, pattern of the paths that do lead to files). The path is
    compared without final slashes.
    """
    host, path = F.coalesce(urls.domain(url), F.lit("")), urls.path_of(url)
    rules = [urls.in_any_domain(host, closed)]
    rules += [urls.in_domain(host, d) & (path == p.rstrip("/")) for d, p in pages]
    rules += [urls.in_domain(host, d) & ~path.rlike(pattern) for d, pattern in only]
    return reduce(lambda a, b: a | b, rules)


def surviving(links: DataFrame, key: str, missing: list[DataFrame], excluded: DataFrame | None = None) -> DataFrame:
    """Links without those that any evidence table calls missing, and without excluded ones."""
    rows = links
    for table in [*missing, *([excluded] if excluded is not None else [])]:
        rows = rows.join(table.select(key), key, "left_anti")
    return rows


def distinct_keys(tables: list[DataFrame], key: str) -> DataFrame:
    """The distinct keys of several evidence tables."""
    return reduce(DataFrame.union, [t.select(key) for t in tables]).distinct()


def with_fallback(rows: DataFrame, details: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A row's own fields win; missing ones come from details by key."""
    d = details.select(key, *(F.col(f).alias(f"__{f}") for f in fields))
    joined = rows.join(d, key, "left")
    return joined.withColumns({f: F.coalesce(f, f"__{f}") for f in fields}).drop(*(f"__{f}" for f in fields))


def append_links(rows: DataFrame, found: DataFrame, key: str, links: str, order: str) -> DataFrame:
    """Adds the found links (key, url, order) to a row's array of links, in order, without repeats."""
    grouped = found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "url"))), lambda x: x["url"]).alias("__found"))
    both = F.array_distinct(F.concat(F.col(links), F.coalesce("__found", F.array().cast("array<string>"))))
    return rows.join(grouped, key, "left").withColumn(links, both).drop("__found")


def update_by_membership(rows: DataFrame, ident: str, links: str, changes: DataFrame, status: str) -> DataFrame:
    """A row takes the status of a change whose url is among its links; of several the largest."""
    hits = rows.select(ident, F.explode(links).alias("url")).join(changes.select("url", F.col(status).alias("__new")), "url").groupBy(ident).agg(F.max("__new").alias("__new"))
    return rows.join(hits, ident, "left").withColumn(status, F.coalesce("__new", status)).drop("__new")


#: Order of kinds on a page.
KIND_ORDER = {"base": 0, "update": 1, "dlc": 2, "fix": 3, "patch": 4, "bundle": 5}


def kind_rank(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in KIND_ORDER.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.coalesce(kind, F.lit(""))), F.lit(6))


def release_order(kind: Column, suggested: Column, version_key: Column, pos: str, product: Column | None = None, region: Column | None = None) -> list[Column]:
    """Suggested releases first, then by kind, newer versions before older ones, then by position.

    Versions are compared within one product and region only: with these given, they come before
    the version, so that rows of different products never trade places for their versions.
    """
    within = [F.coalesce(c, F.lit("")).asc() for c in (product, region) if c is not None]
    return [F.when(suggested, 0).otherwise(1).asc(), kind_rank(kind).asc(), *within, version_key.desc_nulls_last(), F.asc(pos)]
