"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit
per rule; policies are versioned masks over those bits, so a policy change or an ablation reads
the ledger and never the texts again.

Defined cases: a null or empty text has no words, so it fails ``few_words``. A null doc_id is
kept as it is. Repeated rows each get their own ledger row. Extra input columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import SPACE_CHARS, WORD, written

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks")

#: Bit positions, in order. A rule keeps its bit for ever; a new rule takes the next free one.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "odd_word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "shouting": "2 * n_upper > n_letters",
    "exclaiming": "5 * n_marks > n_words",
}

#: A policy rejects a document that fails any of its rules.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "many_symbols", "odd_word_length", "repeated_lines"),
    "v2": tuple(RULES),
}


def mask(rules: tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


_word = re.compile(WORD)
_symbol = re.compile(r"[#*$%&|<>]")
_mark = re.compile(r"[!?]{2,}")
_upper = re.compile(r"[A-Z]")
_letter = re.compile(r"[A-Za-z]")


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text."""
    text = text or ""
    words = _word.findall(text)
    lines = [x for x in text.split("\n") if x.strip(SPACE_CHARS)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    repeated, covered_to = 0, 0  # covered_to: words before it are counted
    if len(counts) < len(windows):
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 3 - max(i, covered_to)
                covered_to = i + 3
    return (
        len(words), sum(map(len, words)), len(_symbol.findall(text)), len(lines) - len(set(lines)), repeated,
        len(lines), len(_upper.findall(text)), len(_letter.findall(text)), len(_mark.findall(text)),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        columns = zip(*map(measure, b.column(1).to_pylist()), strict=True) if b.num_rows else [[]] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_bits (long); one row per row of docs (doc_id, text)."""
    measured = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _measured, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
    )
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    return measured.withColumn("fail_bits", sum(bits[1:], bits[0]).cast("long"))


def written_ledger(docs: DataFrame, path: str) -> DataFrame:
    """The ledger of docs (doc_id, text), stored at a shared path. Policies and ablations read it from there, never the texts."""
    return written(ledger(docs), path)


def passes(policy: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(rows: DataFrame, policies: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """For each policy and rule: documents rejected, and rejected if that one rule were left out.

    The ledger is first reduced to one count per bit pattern (2 ** rules rows at most), so all
    policies and ablations come from that small table by bitwise aggregation.
    """
    policies = policies or POLICIES
    names = list(RULES)
    patterns = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    grid = [(p, r, mask(rules), mask(rules) & ~(1 << names.index(r))) for p, rules in policies.items() for r in rules]
    cases = rows.sparkSession.createDataFrame(grid, "policy string, rule string, all_mask long, less_mask long")
    hit = lambda m: F.col("fail_bits").bitwiseAND(F.col(m)) != 0
    # One row per policy and rule even for an empty ledger. Both sides are small by construction:
    # 2 ** rules patterns and policies x rules cases, whatever the corpus.
    return (
        cases.crossJoin(F.broadcast(patterns.unionByName(rows.sparkSession.createDataFrame([(0, 0)], "fail_bits long, n long"))))
        .groupBy("policy", "rule")
        .agg(
            F.coalesce(F.sum(F.when(hit("all_mask"), F.col("n"))), F.lit(0)).alias("n_rejected"),
            F.coalesce(F.sum(F.when(hit("less_mask"), F.col("n"))), F.lit(0)).alias("n_rejected_without"),
            F.coalesce(F.bit_or(F.when(hit("all_mask"), F.col("fail_bits").bitwiseAND(F.col("all_mask")))), F.lit(0)).alias("rules_that_fired"),
        )
    )
