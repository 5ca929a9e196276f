"""Answers of file services, host by host."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallystone.functions.api import ApiRule, file_state

RULES = [
    ApiRule("a.example.org", missing=("$.message", r"(?i)not found #\d+"), restricted=("$.message", "held back"), checksum="whirlpool"),
    ApiRule("b.example.org", missing=("$.exist", "false"), ok=("$.exist", "true")),
]
A, B, C = (f"https://{h}.example.org/f" for h in "abc")
FULL = {"filename": " a  b.zip ", "size": "12"}


@pytest.mark.parametrize(("url", "answer", "want"), [
    (A, FULL, ("known", 12, "a b.zip", {})), (C, FULL, ("known", 12, "a b.zip", {})), (C, FULL | {"status": "OK"}, ("known", 12, "a b.zip", {})), (C, FULL | {"status": "KO"}, ("unknown", None, None, None)),
    (A, {"message": "Not found #3"}, ("missing", None, None, None)), (A, {"message": "Not found #3 or so"}, ("unknown", None, None, None)), (C, {"message": "not found #3"}, ("unknown", None, None, None)),
    (A, FULL | {"message": "held back"}, ("restricted_file", None, None, None)), (B, {"exist": False}, ("missing", None, None, None)), (A, {"exist": False}, ("unknown", None, None, None)),
    (B, {"exist": True, "name": "n", "size": 2**53 - 1}, ("known", 2**53 - 1, "n", {})), (B, {"exist": True, "name": "n", "size": 2**53}, ("unknown", None, "n", {})), (B, FULL, ("unknown", None, None, None)),
    (C, FULL | {"size": True}, ("unknown", None, None, None)), (C, FULL | {"size": 1.5}, ("unknown", None, None, None)), (C, FULL | {"size": 0}, ("known", 0, "a b.zip", {})), (C, FULL | {"size": -1}, ("unknown", None, None, None)),
    (C, FULL | {"md5": "AB" * 16, "sha1": "ab" * 19, "sha256": 5}, ("known", 12, "a b.zip", {"md5": "ab" * 16})), (A, FULL | {"checksum": "0F" * 64}, ("known", 12, "a b.zip", {"whirlpool": "0f" * 64})),
    (C, FULL | {"checksum": "0F" * 64, "md5": "g" * 32}, ("known", 12, "a b.zip", {})), (C, [FULL], ("unknown", None, None, None)), (C, "text", ("unknown", None, None, None)), (C, None, ("unknown", None, None, None)),
    ("https://a.example.org.evil.test/f", {"message": "not found #3"}, ("unknown", None, None, None)), (None, FULL, ("known", 12, "a b.zip", {})),
])
def test_file_states(spark, url, answer, want):
    df = spark.createDataFrame([(url, json.dumps(answer))], "url string, j string").withColumn("v", F.try_parse_json("j"))
    row = df.select(*(c.alias(n) for n, c in file_state(F.col("url"), F.col("v"), RULES).items())).first()
    assert tuple(row) == want


def test_no_document(spark):
    df = spark.createDataFrame([(C, "{bad"), (C, None)], "url string, j string").withColumn("v", F.try_parse_json("j"))
    assert [tuple(r) for r in df.select(*file_state(F.col("url"), F.col("v"), RULES).values()).collect()] == [("unknown", None, None, None)] * 2
