"""Versions, requirement labels, byte sizes and checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of each unit.
UNITS = {"B": 1, "KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12, "KIB": 2**10, "MIB": 2**20, "GIB": 2**30, "TIB": 2**40}
#: Checksums from strongest to weakest, with their hex lengths.
CHECKSUMS = {"sha256": 64, "whirlpool": 128, "sha1": 40, "md5": 32}
LARGEST = 2**53 - 1


def version_key(version: Column) -> Column:
    """An array that compares as versions do, whatever their length; null if not dotted numbers.

    A number is its count of digits and the digits themselves, without leading zeros, so that numbers
    of any size compare. Numbers 0 at the end are left out, since 1.0 is 1.
    """
    bare = F.regexp_replace(version, r"(?:\.0+)+$", "")
    part = lambda p: F.coalesce(F.nullif(F.ltrim(p, F.lit("0")), F.lit("")), F.lit("0"))
    parts = F.transform(F.split(bare, r"\."), part)
    return F.when(version.rlike(r"^[0-9]+(?:\.[0-9]+)*$"), F.transform(parts, lambda p: F.struct(F.length(p).alias("digits"), p.alias("number"))))


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1; versions that cannot be read tie with all."""
    x, y = version_key(a), version_key(b)
    return F.when(x.isNull() | y.isNull() | (x == y), F.lit(0)).when(x < y, F.lit(-1)).otherwise(F.lit(1))


def requirement_state(target: Column, label: Column, variant: Column, conflict: Column) -> Column:
    """unchecked, invalid, unknown, fits or not-listed."""
    tokens = F.split(label, "/")
    number = lambda x: F.regexp_extract(x, r"^(\d{1,2})\.", 1).cast("int") * 100 + F.regexp_extract(x, r"\.(\d{2})", 1).cast("int")
    major = lambda x: F.regexp_extract(x, r"^(\d{1,2})\.", 1).cast("int")
    minimum = (F.size(tokens) == 1) & (F.coalesce(variant, F.lit("")) == "")
    fits = F.transform(tokens, lambda raw: F.transform(F.array(F.trim(raw)), lambda t: (
        F.when(t.rlike(r"^\d{1,2}\.xx$"), major(target) == major(t))
        .when(~t.rlike(r"^\d{1,2}\.\d{2}\+?$"), F.lit(None).cast("boolean"))
        .when(t.endswith("+") | minimum, number(target) >= number(t))
        .otherwise(number(target) == number(t))
    ))[0])
    return (
        F.when(F.coalesce(target, F.lit("")) == "", F.lit("unchecked"))
        .when(~target.rlike(r"^\d{1,2}\.\d{2}$"), F.lit("invalid"))
        .when(F.coalesce(conflict, F.lit(False)) | (F.coalesce(label, F.lit("")) == ""), F.lit("unknown"))
        .when(F.exists(fits, lambda x: F.coalesce(x, F.lit(False))), F.lit("fits"))
        .when(F.exists(fits, lambda x: x.isNull()), F.lit("unknown"))
        .otherwise(F.lit("not-listed"))
    )


def safe_integer(text: Column) -> Column:
    """A whole number from 0 to 2^53 - 1, else null."""
    n = F.try_to_number(F.when(text.rlike(r"^[0-9]{1,16}$"), text), F.lit("9" * 16)).cast("bigint")
    return F.when(n.between(0, LARGEST), n)


def finite(number: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """The number where it is finite and within the bounds, else null."""
    ok = ~F.isnan(number.cast("double")) & (F.abs(number.cast("double")) != float("inf"))
    ok = ok & (number >= lo) if lo is not None else ok
    return F.when(ok & (number <= hi) if hi is not None else ok, number)


def parse_size(text: Column) -> tuple[Column, Column]:
    """Bytes and precision (exact only for whole bytes) of a text that is a size and nothing else."""
    pattern = r"(?i)^\s*([0-9]{1,12})(\.[0-9]{1,6})?\s*(bytes?|b|[kmgt]i?b)\s*$"
    unit = F.upper(F.regexp_replace(F.regexp_extract(text, pattern, 3), "(?i)^bytes?$", "B"))
    amount = F.concat(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)).cast("decimal(18,6)")
    factor = F.try_element_at(F.create_map(*(F.lit(x) if isinstance(x, str) else F.lit(x).cast("bigint") for kv in UNITS.items() for x in kv)), unit)
    n = (amount * factor.cast("decimal(14,0)")).cast("bigint")
    ok = F.coalesce(text.rlike(pattern), F.lit(False))
    exact = (unit == "B") & (F.regexp_extract(text, pattern, 2) == "")
    return F.when(ok & (n <= LARGEST), n), F.when(ok & (n <= LARGEST), F.when(exact, F.lit("exact")).otherwise(F.lit("estimated")))


def format_size(n: Column) -> Column:
    """Decimal units, at most two decimals, none for bytes."""
    shown = F.when(n < 1000, F.concat(n.cast("string"), F.lit(" B")))
    for unit in ("KB", "MB", "GB", "TB"):
        factor = UNITS[unit]
        number = F.regexp_replace(F.round(n.cast("decimal(16,0)") / F.lit(factor).cast("decimal(14,0)"), 2).cast("decimal(18,2)").cast("string"), r"\.?0+$", "")
        text = F.concat(number, F.lit(f" {unit}"))
        shown = shown.when(n < factor * 1000, text) if unit != "TB" else shown.otherwise(text)
    return F.when(n.isNotNull(), shown)


def strongest_checksum(checksums: Column, size: Column, precision: Column) -> Column:
    """algorithm:hex:size of the strongest valid checksum, for exact sizes only."""
    best = F.coalesce(*(F.when(F.try_element_at(checksums, F.lit(a)).rlike(f"(?i)^[0-9a-f]{{{n}}}$"), F.concat(F.lit(a + ":"), F.lower(F.try_element_at(checksums, F.lit(a))))) for a, n in CHECKSUMS.items()))
    return F.when((precision == "exact") & size.isNotNull(), F.concat(best, F.lit(":"), size.cast("string")))
