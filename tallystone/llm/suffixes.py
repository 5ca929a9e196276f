"""Exact substring dedup: bytes that a repeated string of ``LENGTH`` bytes covers go, but for its first occurrence.

Windows of LENGTH bytes are compared in three steps, none of which sorts all suffixes of the corpus.

1. Every window is given to its anchor, the K bytes within it whose hash is smallest (the leftmost of equal
   ones). Equal windows have equal anchors at equal places, so only stretches with one anchor need be
   compared: runs of consecutive windows of a text with the same anchor. Sorted by anchor and stretch,
   equal stretches stand beside each other; all but the first are repeats, whole.
2. Anchors with several different stretches are left. Each document shard turns its stretches (the anchor
   shortened to one symbol) into a Burrows-Wheeler transform over blocks of ``STRIDE`` bytes.
3. The transforms of a bucket of anchors are merged by interleave refinement (Holt and McMillan, 2014): a
   stable sort of the interleave by the symbols it spells orders it by one symbol more, and where
   neighbours came apart says how long their common prefix is. After as many rounds as a window has
   symbols, each interval that still stands is one repeated window. Where the suffixes lie in their
   texts is read by walking the transforms backwards.

Anchors with more than about ``most_stretches`` different stretches (found in a sample, which only chooses the
way, never the result) are cut to single windows, which step 1 settles alone.

Defined cases: null and empty texts have no window. Rows without a doc_id come after all others. Rows that repeat a
doc_id are ordered by a hash of their text; rows equal in id and text are one document, and alike in
the result. Extra input columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import shared_dir, written

#: Bytes of a window and of an anchor. A window's symbols besides the anchor, LENGTH - K + 1, are a multiple of STRIDE.
LENGTH, K, STRIDE = 100, 41, 4
SYMBOLS = LENGTH - K + 1
#: Bytes that are hashed together, so that arrays stay in the processor's cache.
CHUNK = 1 << 19
#: Stretches in a bucket, on average.
BUCKET = 12_000
SHARDS = 3
#: The symbol that stands for an anchor, and the place of a missing one.
MARK, NONE = 0xFF, 127

_A, _B = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_U = np.uint64


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cumprod(np.full(n, base, _U)), np.cumprod(np.full(n, pow(base, -1, 2**64), _U))


class _Hashes:
    """Hashes of substrings of a buffer, by prefix sums of its bytes times powers of a base, modulo 2^64."""

    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, buf: np.ndarray, base: int) -> None:
        if base not in self.tables:
            self.tables[base] = _powers(base, CHUNK + 2 * LENGTH + 1)
        up, self.down = self.tables[base]
        self.sums = np.zeros(len(buf) + 1, _U)
        np.cumsum((buf.astype(_U) + _U(1)) * up[: len(buf)], out=self.sums[1:])

    def all(self, n: int) -> np.ndarray:
        """Of every n bytes."""
        return _mixed((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n], 32)

    def of(self, start: np.ndarray, end: np.ndarray, shift: int) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start], shift)


def _mixed(h: np.ndarray, shift: int) -> np.ndarray:
    h ^= h >> _U(shift)
    h *= _U(_B)
    h ^= h >> _U(29)
    return h


def stretches(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """anchor and stretch hashes, first byte, length and the anchor's place, of all windows of texts that stand in buf.

    Stretches whose anchor is in cut come as single windows, hashed twice, without an anchor's place.
    """
    h = _Hashes(buf, _A)
    kmers = h.all(K)
    # The place is in the low bits, so that the leftmost of equal hashes is smallest.
    least = (kmers >> _U(24) << _U(24)) | np.arange(len(kmers), dtype=_U)
    width, want = 1, LENGTH - K + 1
    while 2 * width <= want:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if want > width:
        least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    place = (least & _U((1 << 24) - 1)).astype(np.int64)
    inside = np.zeros(len(place) + 1, np.int64)
    long = lengths >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, np.minimum(starts[long] + lengths[long] - LENGTH + 1, len(place)), -1)
    place[np.cumsum(inside)[:-1] == 0] = -1
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    end = np.r_[first[1:], len(place)] - 1 + LENGTH
    kept = place[first] >= 0
    first, end = first[kept], end[kept]
    at = place[first]
    out = kmers[at], h.of(first, end, 31), first, end - first, at - first
    if cut is None or not len(cut):
        return out
    spot = np.minimum(np.searchsorted(cut, out[0]), len(cut) - 1)
    crowded = cut[spot] == out[0]
    n = out[3][crowded] - LENGTH + 1
    each = np.repeat(out[2][crowded], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    again = _Hashes(buf, _B)
    windows = h.of(each, each + LENGTH, 33), again.of(each, each + LENGTH, 31), each, np.full(len(each), LENGTH), np.full(len(each), NONE)
    return tuple(np.concatenate([x[~crowded], y]) for x, y in zip(out, windows, strict=True))


def _pieces(texts: list[memoryview]) -> Iterator[list[tuple[int, int, memoryview]]]:
    """Lists of (text, offset, bytes) of about CHUNK bytes; long texts are cut, with a window less one byte in common."""
    held, size = [], 0
    for n, text in enumerate(texts):
        for at in range(0, max(len(text) - LENGTH + 1, 0), CHUNK):
            part = text[at : at + CHUNK + LENGTH - 1]
            if held and size + len(part) > CHUNK:
                yield held
                held, size = [], 0
            held.append((n, at, part))
            size += len(part)
    if held:
        yield held


STRETCH = "route long, content long, doc long, tie long, loc long"


def _packed(start: np.ndarray, n: np.ndarray, known: np.ndarray, place: np.ndarray) -> np.ndarray:
    return start << 16 | n << 8 | known.astype(np.int64) << 7 | place


def stretch_rows(docs: DataFrame, cut: np.ndarray | None = None) -> DataFrame:
    """STRETCH rows of docs (doc, tie, text as binary): the anchor's and the stretch's hash, and where it lies.

    loc packs the first byte, the length (8 bits), whether an earlier equal stretch is known and the
    anchor's place (7 bits). Repeats within a batch of documents are known at once: they do not meet
    under their anchor, so that what very many texts share is not dealt to one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, tie = (b.column(i).to_numpy() for i in range(2))
            order = np.lexsort((tie, doc))
            texts = [memoryview(b.column(2)[int(i)].as_buffer()) for i in order]
            found = []
            for part in _pieces(texts):
                sizes = np.array([len(x[2]) for x in part])
                starts = np.cumsum(sizes) - sizes
                route, content, first, n, place = stretches(np.frombuffer(b"".join(x[2] for x in part), np.uint8), starts, sizes, cut)
                of = np.searchsorted(starts, first, side="right") - 1
                text, base = (np.array([x[i] for x in part]) for i in range(2))
                found.append((route, content, order[text[of]], first - starts[of] + base[of], n, place))
            if not found:
                continue
            route, content, row, start, n, place = (np.concatenate(x) for x in zip(*found, strict=True))
            # In the order of documents and places, so that the first of equal stretches is the earliest.
            same = np.lexsort((content, route))
            equal = np.r_[False, (route[same][1:] == route[same][:-1]) & (content[same][1:] == content[same][:-1])]
            known = np.zeros(len(route), bool)
            known[same[equal]] = True
            # A row that repeats id and text is the same document, not a repeat.
            twin = np.r_[False, (doc[row][same][1:] == doc[row][same][:-1]) & (tie[row][same][1:] == tie[row][same][:-1]) & (start[same][1:] == start[same][:-1])] & equal
            kept = np.ones(len(route), bool)
            kept[same[twin]] = False
            route[known] = _mixed(content[known] ^ (row[known].astype(_U) + start[known].astype(_U) * _U(_A)), 30)
            columns = route.view(np.int64), content.view(np.int64), doc[row], tie[row], _packed(start, n, known, place)
            yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in columns], ["route", "content", "doc", "tie", "loc"])

    return docs.select("doc", "tie", "text").mapInArrow(run, STRETCH)


def sort_out(rows: DataFrame) -> DataFrame:
    """doc, tie, anchor and loc of STRETCH rows: repeats (anchor null), and stretches to be compared with others of their anchor.

    Rows meet by anchor, sorted, and stream past once; nothing of a group is held but its first row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = held = None  # the row before, and the only stretch so far of its anchor
        several = False
        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(5)]
            known = (cols[4] >> 7 & 1).astype(bool)
            out = [[c[known] for c in cols[2:]]]
            anchor, content, doc, tie, loc = cols = [c[~known] for c in cols]
            compare = [np.zeros(0, np.int64)] * 4
            if len(anchor):
                before = [np.r_[last[i] if last else ~c[0], c[:-1]] for i, c in enumerate(cols)]
                if not last:
                    before[0][0] = ~anchor[0]
                new_anchor = anchor != before[0]
                new = new_anchor | (content != before[1])
                twin = ~new & (doc == before[2]) & (tie == before[3]) & (loc == before[4])
                out.append([c[~new & ~twin] for c in (doc, tie, loc)])
                first = [c[new] for c in (anchor, doc, tie, loc)]
                goes_on = last is not None and last[0] == anchor[0]
                if goes_on and held:
                    first = [np.r_[h, c] for h, c in zip(held, first, strict=True)]
                group = np.cumsum(np.r_[True, first[0][1:] != first[0][:-1]]) - 1 if len(first[0]) else np.zeros(0, np.int64)
                many = np.bincount(group, minlength=1) > 1
                if goes_on and several and len(group) and first[0][0] == anchor[0]:
                    many[0] = True
                if len(group):
                    compare = [c[many[group]] for c in first]
                    if first[0][-1] == anchor[-1]:
                        several = bool(many[-1])
                        held = None if several else [c[-1] for c in first]
                last = [c[-1] for c in cols]
            gone = [np.concatenate(x) for x in zip(*out, strict=True)]
            n = len(gone[0])
            nulls = pa.array(np.r_[np.zeros(n, np.int64), compare[0]], mask=np.r_[np.ones(n, bool), np.zeros(len(compare[0]), bool)])
            yield pa.RecordBatch.from_arrays([*(pa.array(np.r_[g, c]) for g, c in zip(gone[:2], compare[1:3], strict=True)), nulls, pa.array(np.r_[gone[2], compare[3]])], ["doc", "tie", "anchor", "loc"])

    order = ["route", "content", "doc", "tie", "loc"]
    return rows.repartition("route").sortWithinPartitions(*order).mapInArrow(run, "doc long, tie long, anchor long, loc long")


def _zipped(docs: DataFrame) -> DataFrame:
    """doc, tie and the text in a zstd frame, which is what joins with texts shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([squeeze(x.as_buffer()) for x in b.column(2)], pa.binary())], ["doc", "tie", "frame"])

    return docs.select("doc", "tie", "text").mapInArrow(run, "doc long, tie long, frame binary")


def _cut_out(docs: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
    """bucket, shard, anchor, doc, tie, start, place and the symbols of the wanted stretches (doc, tie, anchor, loc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, tie, frame, items in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                text = unpack(frame.as_buffer()) if frame.as_buffer().size else b""
                for x in items.values.to_pylist():
                    start, n, place = x["loc"] >> 16, x["loc"] >> 8 & 255, x["loc"] & 127
                    part = text[start : start + n]
                    symbols = part if place == NONE else part[:place] + bytes([MARK]) + part[place + K :]
                    for column, value in zip(out, (x["anchor"], doc, tie, start, place, symbols), strict=True):
                        column.append(value)
            anchor = pa.array(out[0], pa.int64())
            # Whole windows have more symbols, and so buckets of their own.
            whole = np.array(out[4], np.int64) == NONE
            bucket = np.where(whole, -1 - anchor.to_numpy() % buckets, anchor.to_numpy() % buckets)
            shard = np.array(out[1], np.int64) % SHARDS
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(shard), anchor, *(pa.array(c, pa.int64()) for c in out[1:5]), pa.array(out[5], pa.binary())], ["bucket", "shard", "anchor", "doc", "tie", "start", "place", "symbols"])

    items = wanted.groupBy("doc", "tie").agg(F.collect_list(F.struct("anchor", "loc")).alias("items"))
    joined = _zipped(docs).join(items, ["doc", "tie"]).select("doc", "tie", "frame", "items")
    return joined.mapInArrow(run, "bucket long, shard long, anchor long, doc long, tie long, start long, place long, symbols binary")


def block_grams(symbols: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The STRIDE symbols at each slot, and each slot's string and offset. A string of c symbols has c + 1 slots.

    It is read in STRIDE phases, each a string of blocks that ends at one of the last STRIDE slots;
    slots there have no block of their own and stand for the ends.
    """
    sizes = np.array([len(x) for x in symbols])
    string = np.repeat(np.arange(len(symbols)), sizes + 1)
    base = np.cumsum(sizes + 1) - sizes - 1
    offset = np.arange(len(string)) - base[string]
    flat = np.frombuffer(b"\0".join(symbols) + b"\0" * STRIDE, np.uint8).astype(np.uint32)
    n = len(string)
    grams = flat[:n] << 24 | flat[1 : n + 1] << 16 | flat[2 : n + 2] << 8 | flat[3 : n + 3]
    return grams, string, offset


def transform(symbols: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The blocks before each suffix in sorted order, and which suffixes start their phase (and have none before).

    Ends sort first, in the order of the slots, and all differ, so that every suffix has one rank.
    """
    grams, string, offset = block_grams(symbols)
    sizes = np.array([len(x) for x in symbols])
    ends = offset > sizes[string] - STRIDE
    n, n_ends = len(grams), int(ends.sum())
    rank = np.empty(n, np.int64)
    rank[ends] = np.arange(n_ends)
    rank[~ends] = n_ends + np.unique(grams[~ends], return_inverse=True)[1]
    step = STRIDE
    while True:  # each round sorts by twice as many symbols
        later = np.zeros(n, np.int64)
        later[:-step] = rank[step:]
        later[ends] = 0
        kinds, rank = np.unique(rank * n + later, return_inverse=True)
        if len(kinds) == n:
            break
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    opening = offset[order] < STRIDE
    return np.where(opening, 0, grams[np.maximum(order - STRIDE, 0)]).astype(np.uint32), opening


def walk(codes: np.ndarray, n_ends: int) -> tuple[np.ndarray, np.ndarray]:
    """For each rank of a transform (code 0: no block before), the end that its phase leads to and the blocks up to there."""
    inner = np.flatnonzero(codes)
    forward = np.empty(len(codes), np.int64)
    forward[inner[np.argsort(codes[inner], kind="stable")]] = n_ends + np.arange(len(inner))
    end, blocks = np.empty(len(codes), np.int64), np.empty(len(codes), np.int64)
    at, who, n = np.arange(n_ends), np.arange(n_ends), 0
    while len(at):
        end[at], blocks[at] = who, n
        on = codes[at] != 0
        at, who, n = forward[at[on]], who[on], n + 1
    return end, blocks


def interleave(parts: list[np.ndarray], n_ends: list[int], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Which transform each place of the merged one comes from, and the interval it is in after some rounds.

    parts are the transforms' codes. A round reads the symbol that each place spells and sorts the
    interleave by it, stably. Intervals part where symbols or the intervals behind them differ: after n
    rounds, places in one interval have n symbols in common, and others have fewer.
    """
    sizes, ends = [len(x) for x in parts], sum(n_ends)
    source = np.repeat(np.arange(len(parts), dtype=np.uint8), sizes)
    interval = np.zeros(len(source), np.int32)
    spelt = np.empty(len(source), parts[0].dtype)
    first = np.repeat(np.arange(len(parts), dtype=np.uint8), n_ends)
    for _ in range(rounds):
        for n, codes in enumerate(parts):
            spelt[source == n] = codes
        inner = np.flatnonzero(spelt)
        symbol = spelt[inner]
        order = np.argsort(symbol, kind="stable")
        symbol, inner = symbol[order], inner[order]
        behind = interval[inner]
        source = np.r_[first, source[inner]]
        apart = (symbol[1:] != symbol[:-1]) | (behind[1:] != behind[:-1])
        interval = np.arange(len(source), dtype=np.int32)
        interval[ends + 1 :] = ends + np.cumsum(apart)
    return source, interval


SHARD = "bucket long, shard long, codes binary, opening binary, n_strings long, sizes binary, anchor binary, doc binary, tie binary, start binary, place binary"


def _shard_transform(t: pa.Table) -> pa.Table:
    """One row: the transform of a shard's stretches in a bucket, and where they come from."""
    ids = np.stack([t[c].to_numpy() for c in ("anchor", "doc", "tie", "start")])
    order = np.lexsort(ids[::-1])
    order = order[np.r_[True, (ids[:, order][:, 1:] != ids[:, order][:, :-1]).any(0)]]  # rows that repeat id and text
    symbols = [t["symbols"][int(i)].as_py() for i in order]
    codes, opening = transform(symbols)
    sizes = np.array([len(x) for x in symbols], np.int64)
    raw = [x.tobytes() for x in (codes, np.packbits(opening))], [x.tobytes() for x in (sizes, *ids[:, order], t["place"].to_numpy()[order])]
    return pa.table({
        "bucket": t["bucket"][:1], "shard": t["shard"][:1], "codes": [raw[0][0]], "opening": [raw[0][1]], "n_strings": pa.array([len(symbols)], pa.int64()),
        **{c: pa.array([x], pa.binary()) for c, x in zip(("sizes", "anchor", "doc", "tie", "start", "place"), raw[1], strict=True)},
    })


def _merged_windows(t: pa.Table) -> pa.Table:
    """doc, tie, start and end of what is repeated in a bucket: all windows of an interval but the first, joined where they overlap."""
    rows = t.to_pylist()
    rounds = (LENGTH if rows[0]["bucket"] < 0 else SYMBOLS) // STRIDE
    raw = [np.frombuffer(r["codes"], np.uint32) for r in rows]
    opening = [np.unpackbits(np.frombuffer(r["opening"], np.uint8), count=len(c)).astype(bool) for r, c in zip(rows, raw, strict=True)]
    kinds = np.unique(np.concatenate(raw))
    kind = np.uint16 if len(kinds) < 65_535 else np.uint32
    parts = [np.where(o, 0, np.searchsorted(kinds, c) + 1).astype(kind) for c, o in zip(raw, opening, strict=True)]
    n_ends = [STRIDE * r["n_strings"] for r in rows]
    source, interval = interleave(parts, n_ends, rounds)
    found = []
    for n, (r, codes) in enumerate(zip(rows, parts, strict=True)):
        end, blocks = walk(codes, n_ends[n])
        whole = np.flatnonzero(blocks >= rounds)  # as many symbols follow as a window has
        of = {c: np.frombuffer(r[c], np.int64)[end[whole] // STRIDE] for c in ("sizes", "anchor", "doc", "tie", "start", "place")}
        at = of["sizes"] - (STRIDE - 1 - end[whole] % STRIDE) - STRIDE * blocks[whole]
        found.append((interval[source == n][whole], of["anchor"], of["place"] - at, of["doc"], of["tie"], of["start"] + at))
    found = [np.concatenate(x) for x in zip(*found, strict=True)]
    order = np.lexsort(found[::-1])
    found = [x[order] for x in found]
    repeat = np.r_[False, np.logical_and.reduce([x[1:] == x[:-1] for x in found[:3]])] if len(order) else np.zeros(0, bool)
    doc, tie, start = (x[repeat] for x in found[3:])
    order = np.lexsort((start, tie, doc))
    doc, tie, start = doc[order], tie[order], start[order]
    first = np.r_[True, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] > start[:-1] + LENGTH)][: len(doc)]
    last = np.r_[first[1:], True][: len(doc)]
    return pa.table({"doc": doc[first], "tie": tie[first], "start": start[first], "end": start[last] + LENGTH})


def repeated_spans(docs: DataFrame, folder: str, most_stretches: int = 50_000, sample: int = 64) -> DataFrame:
    """doc, tie, start and end of the bytes to remove from docs (doc, tie, text as binary); spans may overlap."""
    cut = None
    if docs.count() > most_stretches:
        # One document in sample. An anchor is listed if about most_stretches of its stretches differ, so
        # the list has at most one entry for so many stretches; the result is the same without it.
        some = stretch_rows(docs.filter(F.pmod(F.xxhash64("doc", "tie"), F.lit(sample)) == 0))
        crowded = some.filter((F.shiftright("loc", 7).bitwiseAND(1)) == 0).groupBy("route").count().filter(F.col("count") > most_stretches // sample)
        cut = np.sort(np.array([r.route for r in crowded.select("route").collect()], np.int64).view(_U))
    found = written(sort_out(stretch_rows(docs, cut)), f"{folder}/found")
    place, n = F.shiftright("loc", 16), F.shiftright("loc", 8).bitwiseAND(255)
    gone = found.filter("anchor IS NULL").select("doc", "tie", place.alias("start"), (place + n).alias("end"))
    wanted = found.filter("anchor IS NOT NULL")
    buckets = max(1, wanted.count() // BUCKET)
    shards = _cut_out(docs, wanted, buckets).groupBy("bucket", "shard").applyInArrow(_shard_transform, SHARD)
    windows = shards.groupBy("bucket").applyInArrow(_merged_windows, "doc long, tie long, start long, end long")
    return gone.unionByName(written(windows, f"{folder}/windows"))


def _rewritten(joined: DataFrame, keep: bool) -> DataFrame:
    """The result's columns from doc_id, frame and spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for frame, spans in zip(b.column(1), b.column(2), strict=True):
                text = unpack(frame.as_buffer()) if frame.as_buffer().size else b""
                runs: list[list[int]] = []
                for x in sorted((x["start"], x["end"]) for x in spans.values.to_pylist()) if spans.is_valid else ():
                    if runs and x[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x[1])
                    else:
                        runs.append(list(x))
                edges = [0, *(e for r in runs for e in r), len(text)]
                kept = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                row = len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept if keep else None, [{"start": s, "end": e} for s, e in runs] if keep else None
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))][: 7 if keep else 5], ["doc_id", *names][: 7 if keep else 5])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<start:long,end:long>>" * keep
    return joined.mapInArrow(run, schema)


def dedup_substrings(docs: DataFrame, keep: bool = False, **options: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs (doc_id, text); kept and spans too if keep.

    kept are the remaining bytes, which need not be whole characters; spans are the maximal removed runs.
    """
    folder = shared_dir(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    plain = ids.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty()
    # Ids that do not tell rows apart are followed by 62 bits of a hash of the text; those of rows without an id sort behind all others.
    digest = F.shiftrightunsigned(F.xxhash64("text", F.lit(1)), 2)
    tie = F.lit(0) if plain else F.when(F.col("doc_id").isNull(), digest + F.lit(2**62)).otherwise(digest)
    keyed = ids.select("doc_id", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), tie.cast("long").alias("tie"), F.col("text").cast("binary").alias("text"))
    spans = repeated_spans(keyed, folder, **options).groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    null = F.when((F.col("doc") != 2**63 - 1) | (F.col("tie") < 2**62), F.col("doc"))
    joined = _zipped(keyed).join(spans, ["doc", "tie"], "left").select(null.alias("doc_id"), "frame", "spans")
    return _rewritten(joined, keep)
