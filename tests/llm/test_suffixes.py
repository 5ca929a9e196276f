"""Exact substring dedup against a set of all windows, and its parts against plain sorting."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystone.llm import queries, suffixes

DOC = "doc_id long, text string"


def plain_result(data):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of documents in their order, each window looked up in a set."""
    seen, out = set(), []
    for i, text in data:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            window = raw[s : s + 100]
            if window in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(c for c, x in zip(raw, gone, strict=True) if not x)
        n_spans = sum(1 for j, x in enumerate(gone) if x and (j == 0 or not gone[j - 1]))
        out.append((i, len(raw), sum(gone), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def hard_texts():
    """Copies, shifted and edited copies, passages in new contexts, periods, runs of one byte, and windows of just 100 bytes."""
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdeéß日 ") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base, passage = prose(300), prose(40)
    out = [None, "", "short", base, base, base[3:], base[:500] + "X" + base[501:], "a" * 99, "a" * 100, "a" * 101, "a" * 5000, "na " * 400, "an " * 70 + "na " * 70]
    out += [prose(rnd.randint(5, 60)) + passage + prose(rnd.randint(5, 60)) for _ in range(40)]
    out += [passage.encode()[: 100 + k].decode(errors="ignore") for k in range(-3, 8)]
    near = list(base)
    for _ in range(12):
        near[rnd.randrange(len(near))] = rnd.choice("xyz")
        out.append("".join(near))
    rnd.shuffle(out)
    return list(enumerate(out, 10))


@pytest.mark.parametrize("options", [{}, {"most_stretches": 4, "sample": 1}])
def test_equals_all_windows(spark, options):
    """Also where crowded anchors are cut to single windows."""
    data = hard_texts()
    docs = spark.createDataFrame(data, DOC).repartition(3).withColumns({c: F.lit(7) for c in ("doc", "tie", "loc", "anchor", "frame", "spans", "start", "end", "n_chars")})
    assert rows(suffixes.dedup_substrings(docs, **options)) == plain_result(data)


def test_small_chunks_and_buckets(spark, monkeypatch):
    """Texts longer than a chunk are cut with a window in common; buckets and shards are many."""
    monkeypatch.setattr(suffixes, "BUCKET", 50)
    data = hard_texts()
    long = "".join(t or "" for _, t in data)
    data.append((500, long * 2))
    for n in (256, 1000):
        buf = [(x[0], x[1], bytes(x[2])) for part in _cut(suffixes, n, [long.encode()]) for x in part]
        assert all(long.encode()[at : at + len(p)] == p for _, at, p in buf) and max(at + len(p) for _, at, p in buf) == len(long.encode())
    assert rows(suffixes.dedup_substrings(spark.createDataFrame(data, DOC))) == plain_result(data)


def _cut(module, n, texts):
    old, module.CHUNK = module.CHUNK, n
    try:
        return list(module._pieces([memoryview(t) for t in texts]))
    finally:
        module.CHUNK = old


def test_repeated_and_missing_ids(spark):
    """Rows equal in id and text are one document; other rows of an id, and rows without one, go by their text's hash."""
    passage = "".join(chr(97 + i % 26) * (i % 5 + 1) for i in range(80))
    data = [(5, passage), (5, passage), (5, "q" + passage), (None, passage + "z"), (None, passage), (3, "p" + passage[:130]), (2**63 - 1, passage), (-4, passage[20:])]
    docs = spark.createDataFrame(data, DOC)
    tie = {(r.doc_id, r.text): r.t for r in docs.select("doc_id", "text", F.shiftrightunsigned(F.xxhash64("text", F.lit(1)), 2).alias("t")).collect()}
    unique = sorted(set(data), key=lambda r: (r[0] is None, r[0] or 0, tie[r]))
    by_place = {r[0]: r[1:] for r in plain_result((n, text) for n, (_, text) in enumerate(unique))}
    of = {r: (r[0], *by_place[n]) for n, r in enumerate(unique)}
    assert rows(suffixes.dedup_substrings(docs)) == sorted((of[r] for r in data), key=repr)


def test_kept_bytes_and_spans(spark):
    data = [(1, "x" * 150), (2, "ab" + "x" * 120 + "é")]
    got = {r.doc_id: r for r in suffixes.dedup_substrings(spark.createDataFrame(data, DOC), keep=True).collect()}
    assert [tuple(s) for s in got[1].spans] == [(1, 150)] and bytes(got[1].kept) == b"x"
    assert [tuple(s) for s in got[2].spans] == [(2, 122)] and bytes(got[2].kept) == "abé".encode() and got[2].n_spans == 1


def test_empty_table(spark):
    assert suffixes.dedup_substrings(spark.createDataFrame([], DOC)).count() == 0


def phases(symbols):
    """Each phase's suffixes with the block before, in sorted order; ends sort first and by their slot."""
    out, slot = [], 0
    for s in symbols:
        for at in range(len(s) + 1):
            stop = len(s) - (len(s) - at) % 4
            out.append(([s[i : i + 4] for i in range(at, stop, 4)], slot + stop, s[at - 4 : at] if at >= 4 else None))
        slot += len(s) + 1
    return sorted(out, key=lambda x: ([(1, b) for b in x[0]] + [(0, x[1])],))


def merged(parts):
    codes = np.unique(np.concatenate([p[0] for p in parts]))
    dense = [np.where(o, 0, np.searchsorted(codes, c) + 1).astype(np.uint16) for c, o in parts]
    return dense, codes


def test_transform_equals_sorted_suffixes():
    rnd = random.Random(3)
    symbols = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(60, 92))) for _ in range(12)]
    codes, opening = suffixes.transform(symbols)
    want = phases(symbols)
    assert [None if o else int(c).to_bytes(4, "big") for c, o in zip(codes, opening, strict=True)] == [x[2] for x in want]


def test_walk_reads_places_back():
    rnd = random.Random(4)
    symbols = [bytes(rnd.choice(b"ab") for _ in range(70)) for _ in range(9)]
    (codes,), _ = merged([suffixes.transform(symbols)])
    end, blocks = suffixes.walk(codes, 4 * len(symbols))
    want = phases(symbols)
    slots = [j * 71 + 67 + k for j in range(9) for k in range(4)]
    assert [(slots[e], b) for e, b in zip(end, blocks, strict=True)] == [(x[1], len(x[0])) for x in want]


@pytest.mark.parametrize("rounds", [1, 2, 5])
def test_interleave_equals_intervals_of_sorted_suffixes(rounds):
    """Intervals after some rounds are the runs of suffixes with so many blocks in common, in one order over all shards."""
    rnd = random.Random(5)
    passage = bytes(rnd.choice(b"abc") for _ in range(50))
    shards = [[passage[rnd.randint(0, 9) :] + bytes(rnd.choice(b"abc") for _ in range(30)) for _ in range(6)] for _ in range(3)]
    parts, _ = merged([suffixes.transform(s) for s in shards])
    source, interval = suffixes.interleave(parts, [4 * len(s) for s in shards], rounds)
    everything = phases([x for s in shards for x in s])
    sizes = sorted(np.bincount(np.unique(interval, return_inverse=True)[1]).tolist())
    prefix = {}
    for blocks, end, _ in everything:
        key = tuple(blocks[:rounds]) if len(blocks) >= rounds else (tuple(blocks), end)
        prefix[key] = prefix.get(key, 0) + 1
    assert sizes == sorted(prefix.values()) and np.bincount(source).tolist() == [len(p) for p in parts]


def test_query_equals_all_windows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = queries.op12_suffix_dedup(spark, sf)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and rows(got) == plain_result(map(tuple, docs))
