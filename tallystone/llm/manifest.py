"""Merkle manifest of a dataset: one tree per source, one tree over the sources, and a proof for each document.

A document is a leaf; per source the leaves ascend by doc_id, every ``FANOUT`` consecutive nodes become
the hash of their digests until one remains, and the sources' nodes likewise give the root.

A leaf's place needs its exact rank in its source. No group is sorted for it: histograms over the digits of
doc_id, each level the sums of the finer one, say where every small range of ids starts, and only the
rows of such a range are ordered. Ranks written in base FANOUT are the keys of a trie: the node above
a node has its key without the last digit, so that each level is one grouping by the longer prefix.
Proofs come down the same trie, one join a level, and meet the leaves sixteen at a time.

Defined cases: rows without a doc_id come first in their source, ordered by their leaf. Rows that repeat a
doc_id are ordered by their leaf; rows equal in all five fields are one leaf each, side by side. An
id that repeats in so many rows that its range would be large has the range split by digits of the leaf.
Null fields are told from empty ones. An empty table gives no rows. Extra input columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.llm.common import shared_dir, written

#: Consecutive nodes under one node, and the bits of a rank that name a node among them.
FANOUT, FANOUT_BITS = 16, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bits of doc_id below each level of the histograms, finest first.
ID_SHIFTS = (8, 24, 40, 56)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(**fields: Column) -> Column:
    """Hash of the fields in the order of FIELDS, each with its length in bytes; a null is a dash."""
    text = {name: fields[name].cast("string") for name in FIELDS}
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text.values())), 256)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text after the audit's tampering: lower case where the id's checksum is a multiple of 5, else null."""
    chosen = F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
    return F.when(chosen, F.translate(text, _UPPER, _LOWER))


def leaves(docs: DataFrame) -> DataFrame:
    """grp, has_id, key, leaf, bad and n_rows for each different row of docs.

    grp sorts as source does, nulls first. key is the id, or for rows without one 60 bits of the leaf.
    bad is the leaf after tampering, where that differs.
    """
    own = {name: F.col(name).cast("string" if name in ("source", "lang", "text") else "long") for name in FIELDS}
    spoilt = tampered_text(own["doc_id"], own["text"])
    rows = docs.select(
        F.coalesce(F.concat(F.lit("s"), own["source"]), F.lit("n")).alias("grp"), own["doc_id"].alias("doc_id"), leaf_digest(**own).alias("leaf"),
        F.when(spoilt != own["text"], leaf_digest(**own | {"text": spoilt})).alias("bad"),
    )
    key = F.coalesce("doc_id", F.conv(F.left("leaf", F.lit(15)), 16, 10).cast("long"))
    keyed = rows.select("grp", F.col("doc_id").isNotNull().cast("int").alias("has_id"), key.alias("key"), "leaf", "bad")
    return keyed.groupBy("grp", "has_id", "key", "leaf", "bad").agg(F.count("*").alias("n_rows"))


def starts(counts: DataFrame, chain: list[str], n: str) -> DataFrame:
    """The columns of chain, start and n_grp for counts (chain, n), which has one row for each value of chain.

    Each prefix of chain is a level of histograms: a node starts where its parent does, plus the rows
    of its earlier siblings. n_grp is the count of the first column's value.
    """
    rows = counts.groupBy(chain[0]).agg(F.sum(n).alias("n_grp")).withColumn("start", F.lit(0).cast("long"))
    for depth in range(2, len(chain) + 1):
        up, level = chain[: depth - 1], counts.groupBy(*chain[:depth]).agg(F.sum(n).alias("_n"))
        earlier = Window.partitionBy(*up).orderBy(chain[depth - 1]).rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        rows = level.join(rows, up).select(*chain[:depth], "n_grp", (F.col("start") + F.col("_before")).alias("start"))
    return rows


def ranked(rows: DataFrame, folder: str, most_in_range: int = 20_000) -> DataFrame:
    """grp, idx (exact rank from 0), n_grp, doc_id, digest and bad of written leaves, one row for each of n_rows."""
    low, high = rows.agg(F.min("key"), F.max("key")).first()
    # Digits that all ids share need no level.
    shifts = [s for s in ID_SHIFTS if s == ID_SHIFTS[0] or low is None or low >> s != high >> s]
    chain = ["grp", "has_id", *(f"_id{s}" for s in reversed(shifts))]
    split = rows.withColumns({f"_id{s}": F.shiftright("key", s) for s in shifts})
    counts = written(split.groupBy(*chain).agg(F.sum("n_rows").alias("_rows"), F.count("*").alias("_kinds")), f"{folder}/counts")
    crowded = counts.filter(F.col("_kinds") > most_in_range).select(*chain)
    if not crowded.isEmpty():  # few ids in very many rows: the next digits are the id's last ones and the leaf's first ones
        digits = F.shiftleft(F.col("key").bitwiseAND(255), 20).bitwiseOR(F.conv(F.left("leaf", F.lit(5)), 16, 10).cast("long"))
        split = split.join(crowded.withColumn("_crowded", F.lit(True)), chain, "left").withColumn("_d", F.when(F.col("_crowded"), digits).otherwise(0))
        split = split.withColumns({"_leaf12": F.shiftright("_d", 12), "_leaf0": F.col("_d")}).drop("_d", "_crowded")
        chain += ["_leaf12", "_leaf0"]
        counts = written(split.groupBy(*chain).agg(F.sum("n_rows").alias("_rows")), f"{folder}/counts-split")
    within = Window.partitionBy(*chain).orderBy("key", "leaf", "bad").rowsBetween(Window.unboundedPreceding, -1)
    placed = split.withColumn("_at", F.coalesce(F.sum("n_rows").over(within), F.lit(0))).join(starts(counts, chain, "_rows"), chain)
    first = F.col("start") + F.col("_at")
    each = F.explode(F.sequence(first, first + F.col("n_rows") - 1))
    return placed.select("grp", each.alias("idx"), "n_grp", F.when(F.col("has_id") == 1, F.col("key")).alias("doc_id"), F.col("leaf").alias("digest"), "bad")


def height(n: Column) -> Column:
    """Levels above n nodes: the least h with FANOUT^h >= n."""
    return F.when(n <= 1, 0).otherwise(F.ceil(F.length(F.bin(n - 1)) / FANOUT_BITS)).cast("int")


def reduce_trie(nodes: DataFrame, levels: int, folder: str, payload: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level, and grp, h and digest of each group's last node, from nodes (grp, idx, h, digest, payload).

    A run is up to FANOUT nodes with one longer prefix: grp, idx (the prefix, which is the parent's
    key), h, its kids in order, and the digest of them. The payload stays with level 0.
    """
    roots, runs = [nodes.filter("h = 0").select("grp", "h", "digest")], []
    for level in range(levels):
        kid = F.struct(F.col("idx").bitwiseAND(FANOUT - 1).cast("int").alias("pos"), "digest", *(payload if not level else ()))
        run = nodes.filter(F.col("h") > level).groupBy("grp", F.shiftright("idx", FANOUT_BITS).alias("idx"), "h").agg(F.array_sort(F.collect_list(kid)).alias("kids"))
        run = written(run.withColumn("digest", F.sha2(F.array_join("kids.digest", ""), 256)), f"{folder}-{level}")
        runs.append(run)
        roots.append(run.filter(F.col("h") == level + 1).select("grp", "h", "digest"))
        nodes = run.select("grp", "idx", "h", "digest")
    return runs, reduce(DataFrame.unionByName, roots)


def _siblings(pos: Column) -> Column:
    """The digests before and after the kid at pos, each joined."""
    return F.struct(
        F.array_join(F.slice("kids.digest", F.lit(1), pos), "").alias("before"),
        F.array_join(F.slice("kids.digest", pos + 2, F.lit(FANOUT)), "").alias("after"),
    )


def proofs(runs: list[DataFrame], tops: DataFrame, payload: tuple[str, ...] = ()) -> DataFrame:
    """grp, digest, payload, path and top's other columns of the nodes at level 0 of runs.

    tops has grp, h and path, which is what follows a group's last node; a path holds a pair of
    joined siblings for each level, from the node upwards.
    """
    rest = [c for c in tops.columns if c not in ("grp", "h", "path")]
    above = None
    for level in range(len(runs) - 1, -1, -1):
        here = tops.filter(F.col("h") == level + 1).select("grp", F.lit(0).cast("long").alias("idx"), "path", *rest)
        here = here if above is None else here.unionByName(above)
        kids = runs[level].select("grp", "idx", "kids").join(here, ["grp", "idx"]).select("*", F.explode("kids").alias("kid"))
        path = F.concat(F.array(_siblings(F.col("kid.pos"))), F.col("path"))
        if level:
            above = kids.select("grp", (F.shiftleft("idx", FANOUT_BITS) + F.col("kid.pos")).alias("idx"), path.alias("path"), *rest)
    return kids.select("grp", "kid.digest", *(f"kid.{c}" for c in payload), path.alias("path"), *rest)


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda acc, level: F.sha2(F.concat(level["before"], acc, level["after"]), 256))


def source_ranks(roots: DataFrame, folder: str) -> DataFrame:
    """grp and idx, its rank: sorted ranges of groups, numbered within, and counted before."""
    ranges = written(roots.select("grp").repartitionByRange("grp").select("grp", F.spark_partition_id().alias("part")), f"{folder}/ranges")
    sizes = ranges.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranges.join(before, "part").select("grp", (F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("grp")) - 1).alias("idx"))


def audit(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of docs (FIELDS).

    folded_root is what the proof gives for the leaf after tampering, or for the leaf where that changes nothing.
    """
    folder, extra = shared_dir(docs.sparkSession), ("doc_id", "bad")
    rows = written(leaves(docs), f"{folder}/leaves")
    nodes = ranked(rows, folder).withColumn("h", height(F.col("n_grp"))).drop("n_grp")
    largest = rows.groupBy("grp").agg(F.sum("n_rows").alias("n")).agg(F.max(height(F.col("n"))), F.count("*")).first()
    nodes = written(nodes, f"{folder}/nodes") if largest[0] == 0 else nodes
    runs, roots = reduce_trie(nodes, largest[0] or 0, f"{folder}/runs", extra)
    roots = written(roots, f"{folder}/subroots")
    top_h = height(F.lit(largest[1]))
    top_nodes = roots.join(source_ranks(roots, folder), "grp").select(F.lit("").alias("grp"), "idx", top_h.alias("h"), "digest", F.col("grp").alias("of"), F.col("h").alias("of_h"))
    top_nodes = written(top_nodes, f"{folder}/top")
    levels = top_nodes.agg(F.max("h")).first()[0] or 0
    top_runs, top_roots = reduce_trie(top_nodes, levels, f"{folder}/top-runs", ("of", "of_h"))
    root = top_roots.select("digest").first()
    root = F.lit(root.digest if root else None).cast("string")
    no_path = F.array().cast("array<struct<before:string,after:string>>")
    if levels:
        over = proofs(top_runs, top_roots.select("grp", "h", no_path.alias("path")), ("of", "of_h"))
    else:
        over = top_nodes.withColumn("path", no_path)
    tops = written(over.select(F.col("of").alias("grp"), F.col("of_h").alias("h"), "path", F.col("digest").alias("subroot")), f"{folder}/tops")
    columns = ["digest", *extra, "path", "subroot"]
    # A source of one document has no run: its leaf is its last node.
    lone = rows.join(tops.filter("h = 0"), "grp").select(F.col("leaf").alias("digest"), F.when(F.col("has_id") == 1, F.col("key")).alias("doc_id"), "bad", "path", "subroot")
    found = proofs(runs, tops, extra).select(columns).unionByName(lone) if runs else lone
    folded = fold(F.col("path"), F.coalesce("bad", "digest"))
    proof = F.sha2(F.array_join(F.transform("path", lambda level: F.concat(level["before"], level["after"])), ""), 256)
    out = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
