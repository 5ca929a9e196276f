"""URL validity, canonical keys, domains and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that say how a reader came to a page, not which page it is.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)="


def with_scheme(url: Column) -> Column:
    plain = F.trim(url)
    return F.when(plain.startswith("//"), F.concat(F.lit("https:"), plain)).otherwise(plain)


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(with_scheme(url), F.lit("HOST")))


def is_valid(url: Column) -> Column:
    """http or https, a plain host name, no user data."""
    full = with_scheme(url)
    return F.coalesce(full.rlike("(?i)^https?://") & host(url).rlike(r"^[a-z0-9.-]+$") & F.try_parse_url(full, F.lit("USERINFO")).isNull(), F.lit(False))


def domain(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def in_domain(name: Column, of: str) -> Column:
    """Equal to a domain or below it; a name that merely contains it does not count."""
    return (name == of) | name.endswith("." + of)


def canonical_key(url: Column) -> Column:
    """Key of a page: lower-case host without www, path without a final slash, parameters without
    tracking ones in sorted order, no fragment. Null for invalid URLs."""
    full = with_scheme(url)
    path = F.regexp_replace(F.coalesce(F.try_parse_url(full, F.lit("PATH")), F.lit("")), "/+$", "")
    kept = F.filter(F.split(F.coalesce(F.try_parse_url(full, F.lit("QUERY")), F.lit("")), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(kept), "&")
    return F.when(is_valid(url), F.concat(domain(url), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def lenient_decode(text: Column) -> Column:
    """Percent decoding that keeps + and leaves bad input as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def file_name(url: Column, extensions: str = "pkg|zip|rar|7z|iso|html|pdf") -> Column:
    """The last path part that has a known extension."""
    parts = F.filter(F.split(F.try_parse_url(with_scheme(url), F.lit("PATH")), "/"), lambda p: p.rlike(rf"(?i)\.({extensions})$"))
    return F.try_element_at(F.transform(parts, lenient_decode), F.lit(-1))


#: Extensions of archives that a number of three digits follows when they are cut.
NUMBERED = ("7z", "zip", "pkg")


def multipart(name: Column) -> tuple[Column, Column]:
    """Group and part number of names such as x.part2.rar (group x) and x.7z.003 (group x.7z); null for others."""
    parts = F.split(name, r"\.")
    last, before, n = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2)), F.size(parts)
    of_rar = (F.lower(last) == "rar") & before.rlike(r"(?i)^part\d+$") & (n > 2)
    cut = last.rlike(r"^\d{3}$") & F.lower(before).isin(*NUMBERED) & (n > 2)
    group = F.when(of_rar, F.array_join(F.slice(parts, F.lit(1), n - 2), ".")).when(cut, F.array_join(F.slice(parts, F.lit(1), n - 1), "."))
    number = F.when(of_rar, F.substr(before, F.lit(5))).when(cut, last)
    return group, number.cast("int")


#: Where the id of a hosted file stands in its address.
PATH, QUERY = "path", "query"


def asset_key(url: Column, hosts: list[tuple[tuple[str, ...], str, str, str, bool]]) -> Column:
    """Key of a hosted file: known hosts keep the file's id only, under one of their domains; others the canonical key.

    hosts: (domains, where, pattern with one group for the id, prefix of the key, whether ids ignore
    letter case). Alias domains of a host come in one tuple. Where an address of a known host has no
    id, its canonical key holds.
    """
    full = with_scheme(url)
    query = F.coalesce(F.try_parse_url(full, F.lit("QUERY")), F.lit(""))
    path = F.coalesce(F.try_parse_url(full, F.lit("PATH")), F.lit(""))
    kept = []
    for domains, where, pattern, prefix, any_case in hosts:
        ident = F.regexp_extract(path if where == PATH else query, pattern, 1)
        of_host = in_any_domain(host(url), domains)
        kept.append(F.when(of_host & (ident != ""), F.concat(F.lit(prefix), F.lower(ident) if any_case else ident)))
    return F.when(is_valid(url), F.coalesce(*kept, canonical_key(url)))


def in_any_domain(name: Column, domains: tuple[str, ...] | list[str]) -> Column:
    found = F.lit(False)
    for d in domains:
        found = found | F.coalesce(in_domain(name, d), F.lit(False))
    return found


def path_of(url: Column) -> Column:
    """The path without final slashes; empty for none."""
    return F.regexp_replace(F.coalesce(F.try_parse_url(with_scheme(url), F.lit("PATH")), F.lit("")), "/+$", "")


def is_catalogue_page(url: Column, domains: list[str]) -> Column:
    """Whether an address is an https page of exactly these hosts, without user data."""
    full = with_scheme(url)
    return F.coalesce(full.startswith("https://") & host(url).isin(*domains) & is_valid(url), F.lit(False))


def enclosing_domains(name: Column) -> Column:
    """A domain and all that it lies in, the longest first: a.b.org, b.org, org."""
    labels = F.split(name, r"\.")
    return F.when(name != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
