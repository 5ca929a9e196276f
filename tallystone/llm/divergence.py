"""Source divergence audit: how far the word use of each source lies from its language and from the other sources.

Terms are counted in every whole text. A language keeps the terms that ``least_docs`` of its documents
hold; each group, a (lang, source) or a whole language, then gives each kept term a smoothed share in
whole parts of 10^9. Two reports follow: the terms that a source uses most above its language, and the sum
of absolute differences between every two sources of a language.

Ranks come from radix selection. Histograms over the bits of the value find the value of each group's
k-th row in three scans, whatever the size of the group; rows above it are taken, and rows that tie with
it are settled by histograms over their UTF-8 bytes. Only then are the k rows of a group sorted.

A pair of sources is never compared term by term. A source gives every term that it lacks one baseline
share, so a pair's sum is V times the difference of two baselines, corrected by the terms that either
source has: histograms of counts in one source, and joint histograms for terms in both.

Defined cases: null text, lang and source read as ''. Rows that repeat a doc_id are documents of their own; doc_id
itself is not read. A language without kept terms gives pairs of value 0 and no terms. Extra input columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.llm.common import shared_dir, written

#: What a byte of a text becomes, so that splitting at spaces gives the terms: A-Z lower case, a-z and bytes of characters beyond ASCII themselves.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Entries that a task holds before it passes its counts on.
MOST_ENTRIES = 200_000
UNIT, SMOOTHING = 1_000_000_000, 5
GROUP = ["lang", "source"]


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and n_docs of docs (text, lang, source); tasks count before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = defaultdict(Counter)
        n_docs: dict[tuple, Counter] = defaultdict(Counter)

        def passed_on() -> Iterator[pa.RecordBatch]:
            for key, found in n.items():
                terms = list(found)
                holders = n_docs[key]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key[0]] * len(terms), pa.string()), pa.array([key[1]] * len(terms), pa.string()), pa.array(terms, pa.binary()),
                     pa.array(found.values(), pa.int64()), pa.array([holders[t] for t in terms], pa.int64())], ["lang", "source", "term", "n", "n_docs"],
                )
            n.clear()
            n_docs.clear()

        entries = 0
        for b in batches:
            for text, lang, source in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                terms, found = text.translate(FOLDED).split(), n[lang, source]
                entries -= len(found)
                found.update(terms)
                entries += len(found)
                n_docs[lang, source].update(set(terms))
                if entries > MOST_ENTRIES:
                    yield from passed_on()
                    entries = 0
        yield from passed_on()

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counted = rows.withColumn("text", F.col("text").cast("binary")).mapInArrow(count, "lang string, source string, term binary, n long, n_docs long")
    return counted.withColumn("term", F.col("term").cast("string")).groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def share(count: Column | str, total: Column | str, kept: Column | str) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), exact; null if nothing is kept."""
    big = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")
    top = F.lit(UNIT).cast("decimal(10,0)") * (big(count) + F.lit(SMOOTHING)).cast("decimal(20,0)")
    below = (big(total) + F.lit(SMOOTHING) * big(kept)).cast("decimal(24,0)")
    return F.when(F.col(kept) > 0 if isinstance(kept, str) else kept > 0, 1 + F.call_function("div", top, below)).cast("long")


def kept_terms(counts: DataFrame, least_docs: int = 30) -> DataFrame:
    """lang, term and n, for the terms that least_docs documents of the language hold."""
    return counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("held_by")).filter(F.col("held_by") >= least_docs).drop("held_by")


def group_totals(docs: DataFrame, terms: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per (lang, source) of docs, even without terms: n_source, n_lang, n_kept and base, the share of a term that the source lacks."""
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP)).distinct()
    own = cells.groupBy(*GROUP).agg(F.sum("own").alias("n_source"))
    whole = terms.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.count("*").alias("n_kept"))
    rows = groups.join(own, GROUP, "left").join(whole, "lang", "left").na.fill(0, ["n_source", "n_lang", "n_kept"])
    return rows.withColumn("base", share(F.lit(0), "n_source", "n_kept"))


def top_by_radix(rows: DataFrame, group: list[str], value: str, item: str, k: int, folder: str, bits: int = 30, digit: int = 10) -> DataFrame:
    """The k rows of each group with the largest value, ties by item ascending in UTF-8 bytes; items differ within a group.

    rows should be a table that was written: it is read once for each digit. Values are below 2^bits
    and not negative; group columns have no nulls.
    """
    falling = Window.partitionBy(*group).orderBy(F.desc("_d"))
    bound = None
    for shift in range(bits - digit, -1, -digit):
        at = rows if bound is None else rows.join(bound, group).filter(F.shiftright(value, shift + digit) == F.col("_d"))
        need = F.lit(k) if bound is None else F.col("_need")
        counts = at.groupBy(*group, F.shiftright(value, shift).alias("_d"), need.alias("_need")).agg(F.count("*").alias("_n"))
        # At most 2^digit rows for a group: the first digit at which enough rows were passed, or the last.
        passed = counts.withColumn("_passed", F.sum("_n").over(falling)).withColumn("_last", F.lead("_d").over(falling).isNull())
        enough = passed.filter(((F.col("_passed") >= F.col("_need")) & (F.col("_passed") - F.col("_n") < F.col("_need"))) | (F.col("_last") & (F.col("_passed") < F.col("_need"))))
        bound = enough.select(*group, "_d", (F.col("_need") - F.col("_passed") + F.col("_n")).alias("_need"), F.col("_n").alias("_ties"))
    bound = written(bound, f"{folder}/bound")
    at = rows.join(bound, group)
    taken = [at.filter((F.col(value) > F.col("_d")) | ((F.col(value) == F.col("_d")) & (F.col("_ties") <= F.col("_need")))).select(rows.columns)]
    tied = at.filter((F.col(value) == F.col("_d")) & (F.col("_ties") > F.col("_need"))).select(*rows.columns, "_need")
    start, width, n = 1, 2, 0
    rising = Window.partitionBy(*group).orderBy("_b")
    while True:
        tied = written(tied, f"{folder}/tied-{n}")
        if tied.isEmpty():
            break
        # Wider from round to round, so that long common beginnings are passed in a few.
        cut = tied.withColumn("_b", F.substring(F.col(item).cast("binary"), start, width))
        counts = cut.groupBy(*group, "_b").agg(F.count("*").alias("_n"), F.first("_need").alias("_left"))
        before = F.coalesce(F.sum("_n").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        wanted = counts.withColumn("_before", before).filter(F.col("_before") < F.col("_left")).select(*group, "_b", "_n", (F.col("_left") - F.col("_before")).alias("_left"))
        wanted = cut.join(wanted, [*group, "_b"])
        taken.append(wanted.filter(F.col("_n") <= F.col("_left")).select(rows.columns))
        tied = wanted.filter(F.col("_n") > F.col("_left")).select(*rows.columns, F.col("_left").alias("_need"))
        start, width, n = start + width, 2 * width, n + 1
    return reduce(DataFrame.unionByName, taken)


def distinctive_terms(cells: DataFrame, totals: DataFrame, folder: str, most: int = 50) -> DataFrame:
    """lang, source, item and value: the terms of each source with the largest shares above those of its language."""
    over = share("own", "n_source", "n_kept") - share("n", "n_lang", "n_kept")
    rows = cells.join(totals, GROUP).select(*GROUP, F.col("term").alias("item"), over.alias("value")).filter("value > 0")
    return top_by_radix(written(rows, f"{folder}/over"), GROUP, "value", "item", most, folder)


def source_pairs(cells: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, source, item (each other source of the language) and value, the sum of absolute differences of their shares."""
    side = lambda s: totals.select("lang", *(F.col(c).alias(f"{c}_{s}") for c in ("source", "n_source", "base")), *(["n_kept"] if s == "a" else []))
    pairs = side("a").join(side("b"), "lang").filter("source_a < source_b")
    gap = F.abs(F.col("base_a") - F.col("base_b"))
    p = {s: share(f"n_{s}", f"n_source_{s}", "n_kept") for s in "ab"}
    sums = [pairs.select("lang", "source_a", "source_b", (F.col("n_kept") * gap).alias("value"))]
    own = cells.groupBy("lang", F.col("source").alias("s"), F.col("own").alias("n")).agg(F.count("*").alias("terms"))
    for s, o in ("ab", "ba"):
        one = own.withColumnsRenamed({"s": f"source_{s}", "n": f"n_{s}"}).join(pairs, ["lang", f"source_{s}"])
        sums.append(one.select("lang", "source_a", "source_b", (F.col("terms") * (F.abs(p[s] - F.col(f"base_{o}")) - gap)).alias("value")))
    # A term has one cell per source; what it adds is counted in the task, so that a row per pair and pair of counts is shuffled.
    cell = lambda s: cells.select("lang", "term", F.col("source").alias(f"source_{s}"), F.col("own").alias(f"n_{s}"))
    both = cell("a").join(cell("b"), ["lang", "term"]).filter("source_a < source_b")
    both = both.groupBy("lang", "source_a", "source_b", "n_a", "n_b").agg(F.count("*").alias("terms")).join(pairs, ["lang", "source_a", "source_b"])
    correction = F.abs(p["a"] - p["b"]) - F.abs(p["a"] - F.col("base_b")) - F.abs(p["b"] - F.col("base_a")) + gap
    sums.append(both.select("lang", "source_a", "source_b", (F.col("terms") * correction).alias("value")))
    total = reduce(DataFrame.unionByName, sums).groupBy("lang", "source_a", "source_b").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value"))
    sides = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    return total.select("lang", "value", sides.alias("x")).select("lang", "x.source", "x.item", "value")


def audit(docs: DataFrame, least_docs: int = 30, most_terms: int = 50) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank of docs (text, lang, source)."""
    folder = shared_dir(docs.sparkSession)
    counts = written(term_counts(docs), f"{folder}/counts")
    terms = written(kept_terms(counts, least_docs), f"{folder}/terms")
    cells = written(counts.drop("n_docs").withColumnRenamed("n", "own").join(terms, ["lang", "term"]), f"{folder}/cells")
    totals = written(group_totals(docs, terms, cells), f"{folder}/totals")
    parts = [("pair", source_pairs(cells, totals)), ("term", distinctive_terms(cells, totals, folder, most_terms))]
    rows = reduce(DataFrame.unionByName, (rows.select(*GROUP, F.lit(part).alias("part"), "item", "value") for part, rows in parts))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*GROUP, "part").orderBy(F.desc("value"), "item")))
