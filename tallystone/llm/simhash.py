"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into blocks. Two fingerprints that differ in at most k bits agree on all but
k blocks, so they share the key of some choice of (blocks - k) blocks; the choices are bit masks.
Rows that share a key meet in one task, where the Hamming distance is verified.

No step emits all pairs of a group. Equal fingerprints are one row from the start. Fingerprints
under one key are linked by a spanning forest, which has fewer links than members. A key with
more than ``max_group`` fingerprints is dealt out again by finer masks whose groups are bounded
by the few bits that they leave free, so no group grows with the corpus and no link is lost.

Defined cases: null, empty and blank texts have fingerprint zero, linked like any other; texts
with fewer words than a shingle hash the whole sequence. A null doc_id takes part, and gets its
group's smallest id. Repeated rows are one fingerprint. Extra input columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import WORD, delete_path, shared_dir, written

_word = re.compile(WORD)
_lower = {c: c + 32 for c in range(65, 91)}
_BATCH = 65_536


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """64-bit SimHash of the word shingles, repeats included; bit set if set in over half."""
    words = _word.findall((text or "").translate(_lower))
    if not words:
        return 0
    data = " ".join(words).encode("utf-8", "surrogatepass")
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32).tolist() + [len(data)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    n = max(1, len(words) - shingle_words + 1)
    ends = ends[-1:] if n == 1 else ends[shingle_words - 1 :]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _BATCH):
        hashes = np.array([digest(data[a:b], 42) for a, b in zip(starts[at : min(n, at + _BATCH)], ends[at : at + _BATCH], strict=False)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle_words) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _cut(bits: list[int], n: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(np.array(bits), n)]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def block_masks(blocks: int, max_distance: int, bits: list[int] | None = None) -> list[int]:
    """Masks of every choice of (blocks - max_distance) blocks of the given bit positions."""
    parts = _cut(bits or list(range(64)), blocks)
    return [_mask(sum(chosen, [])) for chosen in combinations(parts, blocks - max_distance)]


def finer_masks(mask: int, max_distance: int, free_bits: int = 12) -> list[int]:
    """Masks that add to mask all but about free_bits of the other bits, losing no close pair."""
    rest = [b for b in range(64) if not mask >> b & 1]
    width = max(1, free_bits // max_distance)
    blocks = max(max_distance + 1, -(-len(rest) // width))
    return [mask | m for m in block_masks(blocks, max_distance, rest)]


def spanning_links(fps: np.ndarray, max_distance: int) -> list[tuple[int, int]]:
    """Index pairs within max_distance that connect all that such pairs connect, fewer than len(fps).

    Breadth first: each reached fingerprint is compared once with those not reached yet.
    """
    links, rest = [], np.arange(len(fps))
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            a = queue.pop()
            near = np.bitwise_count(fps[rest] ^ fps[a]) <= max_distance
            if near.any():
                found = rest[near]
                links += [(a, int(x)) for x in found]
                queue += found.tolist()
                rest = rest[~near]
    return links


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(fps: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """Each fingerprint once under each (t, mask)."""
    keys = F.array(*(F.struct(F.lit(t).cast("int").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for t, m in masks))
    return fps.select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp")


def _runs(columns: list[np.ndarray]) -> Iterator[tuple[tuple, int, int]]:
    """Each key and where its rows start and stop, in rows sorted by the key columns."""
    changes = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        changes |= c[1:] != c[:-1]
    cuts = np.flatnonzero(changes) + 1
    starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(columns[0])]])
    matter = stops - starts > 1  # a key with one row here matters only if its run may go on in another batch
    matter[[0, -1]] = True
    for lo, hi in zip(starts[matter].tolist(), stops[matter].tolist(), strict=True):
        yield tuple(int(c[lo]) for c in columns), lo, hi


def _link_groups(keyed: DataFrame, max_distance: int, max_group: int) -> DataFrame:
    """Rows (a, b, again): links between fingerprints, or in a the fingerprint of an oversized key.

    Rows are dealt out and sorted by key; a task reads its run of a key as a stream and holds at
    most max_group + 1 of them.
    """

    def close(parts: list[np.ndarray], out: list) -> None:
        fp = np.concatenate(parts)
        if len(fp) > 1:
            out += [(int(fp[i]), int(fp[j]), -1) for i, j in spanning_links(fp.view(np.uint64), max_distance)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        parts: list[np.ndarray] = []
        held = 0
        out: list[tuple[int, int, int]] = []
        for b in batches:
            if not b.num_rows:
                continue
            t, key, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for this, lo, hi in _runs([t, key]):
                if this != now:
                    if 1 < held <= max_group:
                        close(parts, out)
                    now, parts, held = this, [], 0
                before, held = held, held + hi - lo
                if held <= max_group:
                    parts.append(fp[lo:hi])
                else:  # too many under one key: all of them go on to finer masks
                    if before <= max_group:
                        out += [(int(x), 0, this[0]) for p in parts for x in p]
                        parts = []
                    out += [(int(x), 0, this[0]) for x in fp[lo:hi]]
            if len(out) > 50_000:
                yield _links(out)
                out = []
        if 1 < held <= max_group:
            close(parts, out)
        yield _links(out)

    return keyed.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(run, "a long, b long, again int")


def _links(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32())], ["a", "b", "again"])


def fingerprint_links(fps: DataFrame, folder: str, max_distance: int = 3, blocks: int = 6, max_group: int = 40_000) -> DataFrame:
    """Links (a, b) between the fingerprints fp of fps, each of which is one row.

    Any two fingerprints within max_distance are connected by the links. More blocks mean longer
    keys and more copies of each row: blocks is a trade of shuffle against candidates, not of recall.
    """
    masks = block_masks(blocks, max_distance)
    first = written(_link_groups(_keyed(fps, list(enumerate(masks))), max_distance, max_group), f"{folder}/links")
    links = first.filter("again < 0").select("a", "b")
    over = first.filter("again >= 0").select(F.col("a").alias("fp"), "again")
    hot = [r[0] for r in over.select("again").distinct().collect()]  # numbers of masks, len(masks) at most
    for n, t in enumerate(hot):
        finer = list(enumerate(finer_masks(masks[t], max_distance)))
        members = over.filter(F.col("again") == t).select("fp").distinct()
        # A finer key leaves at most 2 ** 12 fingerprints, so this round has no oversized keys.
        links = links.unionByName(written(_link_groups(_keyed(members, finer), max_distance, 1 << 16), f"{folder}/links-{n}").select("a", "b"))
    return links


def components(links: DataFrame, folder: str, most_rounds: int = 60) -> DataFrame:
    """node and component (its smallest reachable node) of every node of links (a, b).

    Large-star and small-star rounds (Kiveris et al., 2014), each written to the shared folder, so
    that a lost executor costs one round at most. A star hangs a node's larger neighbours on the
    smallest one; nodes keep no lists, and a hot node is only ever a group-by key.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{folder}/edges")
    last = None
    for n in range(most_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        path = f"{folder}/edges-{n}"
        edges = written(small.filter("u <> v").distinct(), path)
        state = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if n:
            delete_path(edges.sparkSession, f"{folder}/edges-{n - 1}")
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def near_duplicates(docs: DataFrame, shingle_words: int = 3, max_distance: int = 3, blocks: int = 6, max_group: int = 40_000) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable) of every row of docs (doc_id, text).

    The nodes are fingerprints, so that rows without a doc_id bridge others like any; only a group
    in which no row has one gets a null component_id.
    """
    folder = shared_dir(docs.sparkSession)
    rows = written(fingerprints(docs, shingle_words), f"{folder}/fingerprints")
    reps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), f"{folder}/reps")
    found = components(fingerprint_links(reps.select("fp"), folder, max_distance, blocks, max_group), folder)
    grouped = reps.join(found, reps.fp == found.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_fp = grouped.join(least, "component").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


# Similar texts: wide fingerprints find candidates, five-word shingles decide

#: 64-bit lanes of a wide fingerprint, and odd numbers that spread a hash over them (fixed).
LANES = 4
_SPREAD = (np.arange(1, 2 * LANES, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Bits of a block. Each lane has as many blocks as fit, 16 in all, each of them a key. Longer blocks
#: part more texts and find fewer pairs: of n texts about n / 2 ** BLOCK_BITS share one by chance.
BLOCK_BITS = 13


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WideHasher:
    """Wide SimHash over word pairs; one per Python worker, as it keeps the hashes of words."""

    def __init__(self, most_words: int = 500_000) -> None:
        self.most_words = most_words
        self.known: dict[str, int] = {}

    def _word(self, word: str) -> int:
        h = self.known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
        return h

    def _words(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.most_words:
            self.known.clear()
        known = self.known.get
        return np.array([known(w) or self._word(w) for w in words], np.uint64)

    @staticmethod
    def _runs(h: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all runs of n words; of the whole sequence if there are fewer."""
        n = min(n, len(h))
        out = np.zeros(len(h) - n + 1 if n else 0, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                out = _mixed(out * np.uint64(31) + h[k : len(h) - n + 1 + k])
        return out

    def read(self, text: str | None) -> tuple[bytes, np.ndarray]:
        """A 128-bit digest of the lower-cased words, and the lanes of their fingerprint."""
        words = shingle_source(text)
        pairs = self._runs(self._words(words), 2)
        ones = np.zeros(64 * LANES, np.int64)
        with np.errstate(over="ignore"):
            for at in range(0, len(pairs), _BATCH):
                lanes = _mixed(pairs[at : at + _BATCH, None] * _SPREAD[None, :])
                ones += np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(-1, 8 * LANES), axis=1, bitorder="little").sum(0, dtype=np.int64)
        return word_digest(words), np.packbits(2 * ones > len(pairs), bitorder="little").view("<u8")

    def shingles(self, words: list[str], n: int) -> np.ndarray:
        """The distinct 64-bit hashes of the runs of n words."""
        return np.unique(self._runs(self._words(words), n)).view(np.int64)


def word_digest(words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))


def shingle_source(text: str | None) -> list[str]:
    return _word.findall((text or "").translate(_lower))


#: Links up to so many bits leave no doubt; a node whose link in the tree is longer gets so many more.
SURE, MORE = 10, 8


def nearest_links(lanes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """The minimum spanning tree by Hamming distance (Prim), without links longer than radius.

    Whatever threshold a later check sets, closest texts are linked first, so that cutting links
    there leaves the groups that the threshold gives. As distances tell similarities only roughly,
    nodes that hang on a longer link are linked to their next nearest as well. These links are checked
    first, since they join most of what belongs together; ``other_links`` are the rest.
    """
    n = len(lanes)
    free = np.ones(n, bool)
    best, parent = np.full(n, 64 * LANES + 1, np.int32), np.zeros(n, np.int64)
    at, links = 0, set()
    for _ in range(n):
        free[at] = False
        d = np.bitwise_count(lanes ^ lanes[at]).sum(1, dtype=np.int32)
        if best[at] <= radius:
            links.add((int(parent[at]), at))
        if best[at] > SURE:
            d[at] = 64 * LANES + 1
            near = np.argpartition(d, MORE)[: MORE + 1] if n > MORE + 1 else np.arange(n)
            links.update((int(x), at) for x in near if d[x] <= radius)
        nearer = free & (d < best)
        best[nearer], parent[nearer] = d[nearer], at
        at = int(np.where(free, best, 64 * LANES + 2).argmin())
    return list({(min(x), max(x)): x for x in links}.values())


def other_links(lanes: np.ndarray, groups: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """All pairs within radius whose groups differ."""
    for i in range(len(lanes) - 1):
        near = (np.bitwise_count(lanes[i + 1 :] ^ lanes[i]).sum(1, dtype=np.int32) <= radius) & (groups[i + 1 :] != groups[i])
        yield from ((i, i + 1 + int(x)) for x in np.flatnonzero(near))


_WIDE = "node binary, " + ", ".join(f"w{i} long" for i in range(LANES))


def wide_prints(docs: DataFrame) -> DataFrame:
    """doc_id, node (digest of the words) and the lanes w0.. of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WideHasher()
        for b in batches:
            read = [hasher.read(t) for t in b.column(1).to_pylist()]
            lanes = np.array([x[1] for x in read], np.uint64).reshape(-1, LANES)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in read], pa.binary()), *(pa.array(np.ascontiguousarray(lanes[:, i]).view(np.int64)) for i in range(LANES))], ["doc_id", "node", *(f"w{i}" for i in range(LANES))]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, {_WIDE}")


def _linked_runs(keyed: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Links (a, b) within each run of the key columns, whose sizes the keys bound: the nearest, or with a column grp all between its values."""
    n, by_group = len(keys), "grp" in keyed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        nodes: list[list] = []
        lanes: list[np.ndarray] = []
        groups: list[list] = []
        a: list[bytes] = []
        b: list[bytes] = []

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            if len(a) > least:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
                a.clear()
                b.clear()

        def close() -> Iterator[pa.RecordBatch]:
            held = [x for part in nodes for x in part.to_pylist()]
            if len(held) > 1:
                wide = np.concatenate(lanes)
                if by_group:
                    numbers: dict[bytes, int] = {}
                    of = np.array([numbers.setdefault(x, len(numbers)) for part in groups for x in part.to_pylist()])
                    links = other_links(wide, of, radius) if len(numbers) > 1 else ()
                else:
                    links = nearest_links(wide, radius)
                for i, j in links:
                    a.append(held[i])
                    b.append(held[j])
                    yield from flush(50_000)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n)]
            wide = np.column_stack([batch.column(n + 1 + i).to_numpy(zero_copy_only=False) for i in range(LANES)]).view(np.uint64)
            for this, lo, hi in _runs(columns):
                if this != now:
                    yield from close()
                    now, nodes, lanes, groups = this, [], [], []
                nodes.append(batch.column(n).slice(lo, hi - lo))
                lanes.append(wide[lo:hi])
                if by_group:
                    groups.append(batch.column(n + 1 + LANES).slice(lo, hi - lo))
        yield from close()
        yield from flush(-1)

    return keyed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a binary, b binary")


def wide_links(prints: DataFrame, folder: str, radius: int, max_group: int = 4096) -> DataFrame:
    """Links (a, b) between nodes of prints (node and lanes; one row per node) that share a block. With a column grp: all pairs of different groups.

    Each block is a key. A key with more than max_group nodes is cut into parts, and
    each pair of parts meets in a task of its own: the trees of all pairs together hold the tree of
    the whole key, so nothing is lost and no task holds more than two parts.
    """
    blocks = [F.shiftrightunsigned(f"w{i}", BLOCK_BITS * k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int") for i in range(LANES) for k in range(64 // BLOCK_BITS)]
    keys = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), c.alias("key")) for t, c in enumerate(blocks)))).alias("k")
    wide = ["node", *(f"w{i}" for i in range(LANES)), *(c for c in prints.columns if c == "grp")]
    keyed = prints.select(keys, *wide).select("k.t", "k.key", *wide)
    sizes = written(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > max_group), f"{folder}/sizes")
    # A prints table of n rows has at most 16 * n / max_group such keys.
    parts = sizes.select("t", "key", F.ceil(F.col("n") / max_group).cast("int").alias("parts"))
    dealt = keyed.join(F.broadcast(parts) if sizes.count() <= 100_000 else parts, ["t", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.struct(F.least(own, other).alias("lo"), F.greatest(own, other).alias("hi")))
    spread = dealt.select("t", "key", F.explode(pair).alias("p"), *wide).select("t", "key", "p.lo", "p.hi", *wide)
    return written(_linked_runs(spread, ["t", "key", "lo", "hi"], radius).distinct(), f"{folder}/candidates")


def similar(links: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The links (a, b) whose sets of shingles (node, shingles) have that share of their union in common."""
    with_a = links.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
    both = with_a.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    counted = both.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("shared"), (F.size("of_a") + F.size("of_b")).alias("both"))
    return counted.filter(F.col("shared") >= F.lit(least) * (F.col("both") - F.col("shared"))).select("a", "b")


def keep_one(docs: DataFrame, n_words: int = 5, least: float = 0.8, radius: int = 40, most_bytes: int = 16_000_000) -> DataFrame:
    """The rows of docs whose document is the smallest of its group of similar texts; all columns stay.

    Texts are linked if they share at least least of their distinct n_words-word shingles, which is
    checked on the whole texts by 64-bit hashes of the shingles. Candidates are pairs of wide fingerprints (256 bits over word
    pairs) that share one of 16 blocks and differ in at most radius bits: all pairs with up to 15
    differing bits do, and of pairs at a similarity of 0.8 (21 to 24 bits on average) 99 in 100.
    Each candidate counts: the nearest ones are checked first, then all between texts that these left in different groups.
    Rows that repeat a doc_id stay together; rows without a doc_id stay.
    """
    folder = shared_dir(docs.sparkSession)
    rows = written(wide_prints(docs.filter("doc_id IS NOT NULL")), f"{folder}/prints")
    lanes = [f"w{i}" for i in range(LANES)]
    nodes = written(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), *(F.first(w).alias(w) for w in lanes)), f"{folder}/nodes")
    links = wide_links(nodes, folder, radius)
    wanted = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = written(nodes.join(wanted, "node").select("node", F.col("rep").alias("doc_id")), f"{folder}/wanted")
    n_bytes = 24 * ids.count()
    # Rows that repeat a doc_id with another text are told apart by their node.
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids) if n_bytes <= most_bytes else ids, "doc_id")
    sets = written(shingle_sets(found, n_words), f"{folder}/sets")
    near = written(similar(links, sets, least), f"{folder}/similar")
    # Whoever has a candidate has a nearest one, so no node beyond wanted is in a further pair.
    first_groups = components(near, f"{folder}/near")
    placed = nodes.join(wanted, "node").join(first_groups, "node", "left").select("node", *lanes, F.coalesce("component", "node").alias("grp"))
    rest = wide_links(written(placed, f"{folder}/placed"), f"{folder}/rest", radius)
    groups = components(near.unionByName(written(similar(rest, sets, least), f"{folder}/further")), folder)
    grouped = nodes.join(groups, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    first = grouped.groupBy("component").agg(F.min("rep").alias("first_id"))
    placed = rows.select("doc_id", "node").join(grouped.join(first, "component").select("node", "first_id"), "node")
    stays = placed.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("first_id")).alias("stays"))
    gone = written(stays.filter("NOT stays").select(F.col("doc_id").alias("__gone")), f"{folder}/gone")
    small = F.broadcast(gone) if 8 * gone.count() <= most_bytes else gone
    return docs.join(small, docs["doc_id"].cast("long") == small["__gone"], "left_anti")


def shingle_sets(rows: DataFrame, n_words: int) -> DataFrame:
    """node and shingles (distinct hashes) of the rows (doc_id, text, node) whose words have the node's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WideHasher()
        for b in batches:
            found = [(n, hasher.shingles(words, n_words)) for n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if word_digest(words := shingle_source(t)) == n]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.binary()), pa.array([x for _, x in found], pa.list_(pa.int64()))], ["node", "shingles"])

    return rows.select("node", "text").mapInArrow(run, "node binary, shingles array<bigint>")
