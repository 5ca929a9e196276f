"""Corpus pipeline over ``documents``: toxicity, line dedup, near-duplicates, benchmark, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the
last return the columns of documents; the last returns one row of token digests per document kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm import bpe, decontamination, line_dedup, simhash, toxicity
from tallystone.llm.common import shared_dir, table, written
from tallystone.llm.queries import default_vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labels outside the held-out third."""
    return toxicity.remove_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in one of them; n_chars follows the text."""
    rows, cut = line_dedup.rewrite(docs), F.col("__line_dedup.n_dropped") > 0
    text = F.when(cut, F.col("__line_dedup.kept_text")).otherwise(F.col("text"))
    n_chars = F.when(cut, F.char_length("__line_dedup.kept_text").cast("long")).otherwise(F.col("n_chars"))
    return rows.withColumns({"text": text, "n_chars": n_chars}).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id: SimHash finds candidates, five-word shingles confirm them."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return bpe.encode_documents(docs.select("doc_id", "text"), default_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Toxicity and BPE have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each result written to the shared folder and read again."""
    folder = shared_dir(spark)
    docs = table(spark, sf_dir, "documents", "*")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/stage-{n}")
    return STAGES[-1][1](spark, docs, sf_dir)
