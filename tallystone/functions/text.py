"""Title keys, whitespace, slugs, region codes and what a label states. Three title keys exist and differ on purpose."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Packaging words that may end a title, and the word that may follow them.
PACKAGING = ("ps4", "fpkg", "pkg")
AFTER_PACKAGING = "download"
#: Roman numerals that a relaxed key reads as digits; v and x are left alone.
ROMAN = {"ii": "2", "iii": "3", "iv": "4", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "xi": "11", "xii": "12", "xiii": "13"}
#: Characters that a strict or relaxed key drops inside words.
DROPPED = "'’‘`​﻿"
#: Spellings of region codes.
REGIONS = {
    "US": "USA", "USA": "USA", "NORTH AMERICA": "USA", "NORTH AMERICAN": "USA", "UNITED STATES": "USA",
    "EU": "EUR", "EUR": "EUR", "EUROPE": "EUR", "EUROPEAN": "EUR", "JP": "JPN", "JPN": "JPN", "JAPAN": "JPN",
    "ASIA": "ASIA", "ASIAN": "ASIA", "KR": "KOR", "KOR": "KOR", "KOREA": "KOR", "SOUTH KOREA": "KOR",
    "CN": "CHN", "CHN": "CHN", "CHINA": "CHN", "AU": "AUS", "AUS": "AUS", "AUSTRALIA": "AUS",
    "NZ": "NZL", "NZL": "NZL", "NEW ZEALAND": "NZL", "UK": "UK", "UNITED KINGDOM": "UK", "WORLD": "WORLD", "WORLDWIDE": "WORLD",
}
#: Codes that count in running text, and those that a label may state.
PLAIN_CODES = ("USA", "EUR", "JPN", "ASIA", "KOR", "CHN", "AUS", "NZL")
LABEL_CODES = ("EUR", "USA", "JPN", "ASIA", "KOR", "UK", "EU", "US", "JP")


def group_key(title: Column) -> Column:
    """Key that groups listings: native, keeps letters from U+00C0 up, drops packaging words at the end.

    A title keeps its first word, unless white space stands before it. The word that may follow packaging
    belongs to the title where no packaging stands before it.
    """
    words = F.filter(F.split(title, r"\s+"), lambda w: w != "")
    packed = lambda w: F.lower(w).isin(*PACKAGING)
    after = lambda w: F.lower(w) == AFTER_PACKAGING
    keep = lambda w, i: ~(packed(w) | after(w)) | ((i == 0) & ~title.rlike(r"^\s"))
    # The place after the last word of the title, then after the words that only packaging would take along.
    last = F.coalesce(F.array_max(F.transform(words, lambda w, i: F.when(keep(w, i), i + 1).otherwise(0))), F.lit(0))
    rest = F.slice(words, last + 1, F.size(words))
    alone = F.coalesce(F.array_min(F.transform(rest, lambda w, i: F.when(after(w), F.size(rest)).otherwise(i))), F.lit(0))
    name = F.array_join(F.slice(words, F.lit(1), last + alone), " ")
    return F.trim(F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")), r"[^a-z0-9\x{c0}-\x{10ffff}]+", " "))


def _without_packaging(text: str) -> list[str]:
    """The words of a text but for packaging words at its end. A title keeps its first word."""
    words = text.split()
    last = len(words)
    while last > (0 if text[:1].isspace() else 1) and words[last - 1] in (*PACKAGING, AFTER_PACKAGING):
        last -= 1
    while last < len(words) and words[last] == AFTER_PACKAGING:  # belongs to the title unless packaging precedes it
        last += 1
    return words[:last]


def _plain_words(text: str, dropped: str) -> Iterator[str]:
    """Runs of letters and digits without accents; an ampersand is a word of its own."""
    word = ""
    for c in unicodedata.normalize("NFKD", text):
        if c.isalnum() or c == "_":
            word += c
        elif c == "×" and dropped:
            word += "x"
        elif not unicodedata.combining(c) and c not in dropped:
            if word:
                yield word
            if c == "&":
                yield "and"
            word = ""
    if word:
        yield word


def title_words(title: str, dropped: str = "") -> list[str]:
    """The words of a title that its keys are made of, case folded."""
    return [w for part in _without_packaging(html.unescape(title).casefold()) for w in _plain_words(part, dropped)]


def import_title(title: str | None) -> str | None:
    return None if title is None else " ".join(title_words(title))


def strict_title(title: str | None) -> str | None:
    """As the import key, but apostrophes do not part words, and × is an x."""
    return None if title is None else " ".join(title_words(title, DROPPED))


def relaxed_title(title: str | None) -> str | None:
    """As the strict key, with roman numerals read as digits and no spaces."""
    return None if title is None else "".join(ROMAN.get(w, w) for w in title_words(title, DROPPED))


@F.pandas_udf(StringType())
def import_key(titles: pd.Series) -> pd.Series:
    return titles.map(import_title)


@F.pandas_udf(StringType())
def strict_key(titles: pd.Series) -> pd.Series:
    return titles.map(strict_title)


@F.pandas_udf(StringType())
def relaxed_key(titles: pd.Series) -> pd.Series:
    return titles.map(relaxed_title)


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def upper_clean(text: Column) -> Column:
    return F.upper(clean(text))


def _spaced(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "_", " ")


def _codes(names: Column) -> Column:
    """The codes of an array of upper-case region names; null for other names."""
    table = F.create_map(*(F.lit(x) for kv in REGIONS.items() for x in kv))
    return F.transform(names, lambda n: F.try_element_at(table, F.trim(n)))


def _sorted_set(codes: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(codes)))


def parse_regions(text: Column) -> Column:
    """Sorted distinct codes of a list with any of the delimiters , / | + & ; between."""
    return _sorted_set(_codes(F.split(F.translate(F.upper(_spaced(text)), "/|+&;", ",,,,,"), ",")))


def region_tokens(text: Column) -> Column:
    """Sorted distinct codes in running text: long upper-case codes, codes in brackets, and lists tagged Region.

    Codes are read as written, in upper case. Short ones count in brackets and tagged lists only, so that the
    word us is no region. A tagged list has letters and list marks only, up to two spaces, a line's end, a
    semicolon or a bracket.
    """
    plain = _spaced(text)
    words = F.filter(F.split(plain, "[^A-Za-z0-9]+"), lambda w: w.isin(*PLAIN_CODES))
    closed = F.split(F.translate(plain, "({", "[["), r"[\])}]")
    bracketed = F.transform(F.slice(closed, 1, F.size(closed) - 1), lambda s: F.get(F.split(s, r"\[", 2), F.lit(1)))
    tagged = F.split(plain, r"(?i)\bregion\s*[:=-]\s*")
    # What follows each tag, to the end of the text; a tag within is no list mark.
    follows = F.transform(F.slice(tagged, 2, F.size(tagged)), lambda _, i: F.array_join(F.slice(tagged, i + 2, F.size(tagged)), ":"))
    lists = F.filter(F.transform(follows, lambda s: F.split(s, r"\s{2}|[;\]\n()]", 2)[0]), lambda s: s.rlike("^[A-Za-z /,+&|]*$"))
    return _sorted_set(F.concat(words, F.flatten(F.transform(F.concat(F.array_compact(bracketed), lists), parse_regions))))


def region_alias(code: Column) -> Column:
    """The narrow alias that family keys use."""
    up = upper_clean(code)
    return F.when(up == "EU", F.lit("EUR")).when(up == "US", F.lit("USA")).otherwise(up)


def section_key(title: Column) -> Column:
    """First letter A to Z, else #."""
    first = F.upper(F.left(F.trim(title), F.lit(1)))
    return F.when(first.rlike("^[A-Z]$"), first).otherwise(F.lit("#"))


def _only(values: Column) -> Column:
    """The single distinct value of an array, else null."""
    distinct = F.array_distinct(values)
    return F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0)))


def label_words(label: Column) -> Column:
    """The lower-case words of a label, without empty ones."""
    return F.filter(F.split(F.lower(_spaced(label)), "[^a-z0-9]+"), lambda w: w != "")


def stated_version(label: Column, whole_numbers: bool = False) -> Column:
    """The only dotted version that v, version or update marks; with whole_numbers else the only v followed by a whole number."""
    words = F.filter(F.split(F.lower(_spaced(label)), "[^a-z0-9.]+"), lambda w: w != "")
    marks = ("v", "version", "update")
    placed = F.transform(words, lambda w, i: F.struct(w.alias("word"), F.when(i > 0, F.get(words, i - 1)).alias("before")))
    number = lambda w: F.regexp_extract(w, r"^(?:update)?(?:v|version)?(\d{1,3}\.\d{1,3}(?:\.\d+)?)", 1)
    marked = F.filter(placed, lambda x: (number(x["word"]) != "") & (~x["word"].rlike(r"^\d") | x["before"].isin(*marks)))
    dotted = F.transform(marked, lambda x: number(x["word"]))
    whole = F.transform(F.filter(words, lambda w: w.rlike(r"^v\d+$")), lambda w: F.substr(w, F.lit(2)))
    return F.when(F.size(dotted) > 0, _only(dotted)).otherwise(_only(whole)) if whole_numbers else _only(dotted)


def product_code(label: Column, digits: str = "5") -> Column:
    """The only product code in a label, upper case; digits says how many follow its letters, as in a pattern's braces."""
    return F.upper(_only(F.filter(F.split(_spaced(label), "[^A-Za-z0-9]+"), lambda w: w.rlike(rf"(?i)^cusa\d{{{digits}}}$"))))


def stated_requirement(label: Column, brackets: str = "()") -> Column:
    """The first bracket that holds requirement versions and nothing else: versions with / between, as one text without spaces.

    A version is 9.00 or 7.xx; in round brackets words for firmware before it and blanks, in all a plus after it may stand. Dashes and plus signs between versions read as they are, but for hyphens, which are slashes.
    """
    opening, closing = brackets
    closed = F.slice(F.split(_spaced(label), "\\" + closing), 1, F.greatest(F.size(F.split(_spaced(label), "\\" + closing)) - 1, F.lit(0)))
    inside = F.transform(F.filter(closed, lambda s: F.contains(s, F.lit(opening))), lambda s: F.lower(F.substring_index(s, opening, -1)))
    bare = inside if opening == "[" else F.transform(inside, lambda s: F.regexp_replace(F.regexp_replace(s, r"\s+", ""), "^(?:fix|fw|firmware)", ""))
    version = lambda x: x.rlike(r"^\d+\.(?:\d+|xx)$")
    listed = lambda s: F.split(F.when(s.endswith("+"), F.substr(s, F.lit(1), F.char_length(s) - 1)).otherwise(s), r"[/+\x{2013}-]")
    return F.translate(F.get(F.filter(bare, lambda s: F.forall(listed(s), version)), F.lit(0)), "-", "/")


def label_details(label: Column, of_file: bool = False, digits: str = "5") -> dict[str, Column]:
    """kind, version, product_code, region, variant and requirement stated by a release label.

    Only explicit markers count. A file name (of_file) states no region, and its requirement may be
    in square brackets. A product code has as many digits as product_code is told.
    """
    words = label_words(label)
    says = lambda *any_of: F.exists(words, lambda w: w.isin(*any_of))
    starts = lambda *any_of: F.coalesce(F.get(words, F.lit(0)).isin(*any_of), F.lit(False))
    hits = {"base": says("base") | starts("game"), "update": says("update", "patch"), "dlc": says("dlc", "dlcpack", "dlcs")}
    named = F.array_compact(F.array(*(F.when(hit, F.lit(kind)) for kind, hit in hits.items())))
    of_patch = F.when(~says("patch") | starts("update", "patch"), F.lit("update")).when(starts("fix", "backport"), F.lit("fix")).otherwise(F.lit("patch"))
    kind = F.when(F.size(named) > 1, F.lit("bundle")).when(F.get(named, F.lit(0)) == "update", of_patch).when(F.size(named) == 1, F.get(named, F.lit(0))).when(starts("fix", "backport"), F.lit("fix"))
    numbered = F.exists(F.arrays_zip(words.alias("w"), F.slice(words, 2, F.size(words)).alias("next")), lambda x: (x["w"] == "fix") & F.coalesce(x["next"].rlike(r"^\d"), F.lit(False)))
    region = _only(F.filter(F.split(F.upper(F.coalesce(label, F.lit(""))), "[^A-Z0-9_]+"), lambda w: w.isin(*LABEL_CODES)))
    requirement = stated_requirement(label)
    return {
        "kind": kind, "version": stated_version(label), "product_code": product_code(label, digits), "region": F.lit(None).cast("string") if of_file else region,
        "variant": F.when(says("backport") | numbered, F.lit("Backport / fix")), "requirement": F.coalesce(requirement, stated_requirement(label, "[]")) if of_file else requirement,
    }


def file_details(name: Column) -> dict[str, Column]:
    """What a catalogue page reads off a file name; narrower than label_details: a kind only from how the name begins, or DLC in it."""
    plain, words = _spaced(name), label_words(name)
    says = lambda *any_of: F.exists(words, lambda w: w.isin(*any_of))
    begins = lambda word: F.coalesce(F.lower(plain).startswith(word + " ") | F.lower(plain).startswith(word + "-"), F.lit(False))
    only_v = F.filter(F.split(F.lower(plain), r"\b(?=v(?:ersion)?\s*\d)"), lambda s: s.startswith("v"))
    version = _only(F.filter(F.transform(only_v, lambda s: F.regexp_extract(s, r"^v(?:ersion)?\s*(\d{1,3}\.\d{1,3}(?:\.\d+)?)", 1)), lambda v: v != ""))
    kind = F.when(begins("base"), F.lit("base")).when(begins("update"), F.lit("update")).when(says("dlc", "dlcpack", "dlcs"), F.lit("dlc"))
    return {"kind": kind, "version": version, "product_code": product_code(name), "variant": F.when(says("backport"), F.lit("Backport / fix")), "requirement": stated_requirement(name, "[]")}


#: Parts of labels that name no release, and parts of status names that mean not yet or never released.
NO_RELEASE = ("guide", "changelog", "dlc content", "content list")
UNRELEASED = ("cancel", "alpha", "beta", "early_access", "advanced_access", "rumor", "rumour", "unreleased")


def _holds(text: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda part: F.contains(text, part))


def is_listed_label(kind: Column, label: Column) -> Column:
    """A row is a release only if it has a kind and its label names no guide, change log or content list."""
    return F.coalesce(kind, F.lit("")).__ne__("") & ~_holds(F.lower(clean(F.coalesce(label, F.lit("")))), NO_RELEASE)


def is_unreleased(status: Column) -> Column:
    """Whether a status name says that a title is not out: the words count anywhere in it."""
    return _holds(slug(F.coalesce(status, F.lit(""))), UNRELEASED)


def names_platform(text: Column, word: str = "ps4") -> Column:
    """Whether a text has the platform as a word of its own, in any letter case."""
    return F.array_contains(label_words(text), word)


def item_count(label: Column) -> Column:
    """The number in ``DLC (n)``; null without one."""
    found = F.regexp_extract(label, r"(?i)\bdlc\s*\((\d{1,9})\)", 1)
    return F.nullif(found, F.lit("")).cast("int")


def with_thousands(n: Column) -> Column:
    """A count with thousands separators."""
    return F.format_number(n, 0)
