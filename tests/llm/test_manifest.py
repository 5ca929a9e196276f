"""The Merkle manifest against plain trees in lists."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallystone.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_tree(nodes):
    """The last node, and each first node's siblings level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for n, place in enumerate(at):
            run = place // 16 * 16
            paths[n].append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + 16])))
            at[n] = place // 16
        nodes = [digest("".join(nodes[run : run + 16])) for run in range(0, len(nodes), 16)]
    return nodes[0], paths


def plain_audit(data):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = {}
    for i, source, lang, n, text in data:
        start = field(i) + field(source) + field(lang) + field(n)
        spoilt = lower(text) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else text
        by.setdefault(source, []).append((i is not None, i or 0, digest(start + field(text)), i, digest(start + field(spoilt))))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(by[s])]) for s in sources}
    if not sources:
        return []
    root, tops = plain_tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for (_, _, leaf, i, acc), path in zip(sorted(by[s]), trees[s][1], strict=True):
            for before, after in path + top:
                acc = digest(before + acc + after)
            out.append((i, leaf, trees[s][0], root, digest("".join(b + a for b, a in path + top)), acc, acc == root))
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def odd_rows(n, seed):
    """Null and repeated ids, negative and huge ones, null and empty fields, sources of one row."""
    pick = random.Random(seed).choice
    data = [(pick([None, 5, -3, 2**62, -(2**63), i]), pick([None, "", "a", "é"]), pick([None, "en"]), pick([None, 4]), pick([None, "", "Ab", "XY z"])) for i in range(n)]
    return data + [(7, "lone", None, 1, "Q" * 70_000), (8, "s" * 300, "en", 0, "")]


@pytest.mark.parametrize("most_in_range", [20_000, 3])
def test_audit_equals_plain_trees(spark, monkeypatch, most_in_range):
    """Crowded ranges of ids are split by digits of the leaf, with the same ranks."""
    ranked = manifest.ranked
    monkeypatch.setattr(manifest, "ranked", lambda leaves, folder: ranked(leaves, folder, most_in_range))
    data = odd_rows(600, 1)
    docs = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit(7) for c in ("grp", "idx", "kids", "leaf", "key", "path", "start", "h")})
    assert rows(manifest.audit(docs)) == plain_audit(data)


@pytest.mark.parametrize("sizes", [[1], [1, 1], [2], [16], [17], [256, 257, 1], [1] * 18])
def test_heights(spark, sizes):
    """Lone leaves, runs of one, and groups on either side of a power of the fanout."""
    data = [(1000 * s + i, f"s{s}", "en", i, "Some Text") for s, n in enumerate(sizes) for i in range(n)]
    assert rows(manifest.audit(spark.createDataFrame(data, SCHEMA))) == plain_audit(data)


def test_empty_table(spark):
    assert manifest.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ranks_are_exact_without_gaps(spark):
    random.seed(4)
    ids = random.sample(range(-(2**63), 2**63), 500) + list(range(300)) + [9] * 40
    data = [(i, "s", "en", n, str(n)) for n, i in enumerate(ids)]
    leaves = manifest.leaves(spark.createDataFrame(data, SCHEMA))
    from tallystone.llm.common import shared_dir, written

    folder = shared_dir(spark)
    got = manifest.ranked(written(leaves, f"{folder}/leaves"), folder, 50).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(len(ids))) and [r.doc_id for r in got] == sorted(ids)
