"""The pipeline against a brute-force version of each stage, in order."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tests.llm.test_operators import contaminated, dedup_lines, similar_groups


def test_pipeline(spark, sf):
    import corpus_pipeline
    from tallystone.llm import queries
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    data = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    toxic = {r.doc_id for r in queries.op4_toxicity(spark, sf).filter("predicted = 1").collect()}
    data = [(i, t) for i, t in data if i not in toxic]
    data = [(i, t) for i, _, t in dedup_lines(data)]
    groups = similar_groups(data)
    data = [(i, t) for i, t in data if groups[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {i for i, _ in contaminated(data, items)}
    data = [(i, t) for i, t in data if i not in leaks]
    lib = Tokenizer.from_file(queries.default_vocabulary())
    lib.no_truncation()
    lib.no_padding()
    digest = lambda ids: hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    want = {i: digest(lib.encode(t, add_special_tokens=False).ids) for i, t in data}
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and leaks


def test_stages_keep_columns_and_odd_rows(spark, sf):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "some words here", "en", "s", 15), (3, "some words here", "en", "s", 15), (None, "other text", None, None, 10)], schema)
    odd = odd.withColumns({c: F.lit(7) for c in ("key", "fp", "n_lines", "kept_text", "tokens", "component_id")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns and out.count() >= 4
        assert stage(spark, odd.limit(0), sf).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd, sf).count() == 5
