"""What a host's own file service says about a file: one document per answer, rules per host."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallystone.functions import urls
from tallystone.functions.text import clean
from tallystone.functions.versions import CHECKSUMS, safe_integer


@dataclass(frozen=True)
class ApiRule:
    """A host's answers. Each of missing, restricted and ok is a path and a pattern of the whole value there (as text).

    Without ok, an answer is one of a file if it has a name and a size. checksum names the algorithm of a field ``checksum``.
    """

    domain: str
    missing: tuple[str, str] | None = None
    restricted: tuple[str, str] | None = None
    ok: tuple[str, str] | None = None
    checksum: str | None = None


def _value(document: Column, path: str) -> Column:
    return F.try_variant_get(document, path, "string")


def file_state(url: Column, document: Column, rules: list[ApiRule]) -> dict[str, Column]:
    """status (known, missing, restricted_file or unknown), size_bytes, filename and checksums of a variant document.

    Only a host's own word says that a file is missing or restricted; an answer that is no object, or of a
    host without a rule that does not state a name and a size, is unknown. Sizes are whole numbers from 0 to
    2^53 - 1, as numbers or digits. A checksum counts only with all its hex digits, and is in lower case.
    """
    domain = F.coalesce(urls.domain(url), F.lit(""))
    name = clean(F.coalesce(_value(document, "$.filename"), _value(document, "$.name")))
    name = F.when(name != "", name)
    size = safe_integer(_value(document, "$.size"))
    stated = _value(document, "$.filename").isNotNull() & size.isNotNull()
    says = lambda at: F.coalesce(_value(document, at[0]).rlike(f"^(?:{at[1]})$"), F.lit(False))
    is_object = F.coalesce(F.schema_of_variant(document).startswith("OBJECT"), F.lit(False))
    status = F.when(~is_object, F.lit("unknown"))
    ok, named = stated & F.coalesce(_value(document, "$.status") == "OK", F.lit(True)), {}
    for rule in rules:
        here = urls.in_domain(domain, rule.domain)
        for what, at in (("missing", rule.missing), ("restricted_file", rule.restricted)):
            status = status.when(here & says(at), F.lit(what)) if at else status
        ok = F.when(here, says(rule.ok)).otherwise(ok) if rule.ok else ok
        if rule.checksum:
            named[rule.checksum] = F.when(here, _value(document, "$.checksum"))
    status = status.when(~F.coalesce(ok, F.lit(False)) | size.isNull(), F.lit("unknown")).otherwise(F.lit("known"))
    is_file = is_object & F.coalesce(ok, F.lit(False)) & ~status.isin("missing", "restricted_file")
    sums = [
        F.struct(F.lit(a).alias("key"), F.lower(F.coalesce(named.get(a, F.lit(None).cast("string")), _value(document, f"$.{a}"))).alias("value"), F.lit(n).alias("n")) for a, n in CHECKSUMS.items()
    ]
    whole = F.filter(F.array(*sums), lambda x: F.coalesce(x["value"].rlike("^[0-9a-f]+$") & (F.length(x["value"]) == x["n"]), F.lit(False)))
    checksums = F.map_from_entries(F.transform(whole, lambda x: F.struct(x["key"], x["value"])))
    only = lambda c: F.when(is_file, c)
    return {"status": status, "size_bytes": only(size), "filename": only(name), "checksums": only(checksums)}
