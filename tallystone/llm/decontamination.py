"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A seed is a fixed mask over consecutive tokens; positions outside the mask are ignored, so a seed
still hits where those tokens were substituted. Seeds of benchmark items are joined with seeds at
every token position of every document; at each shift that a hit names, the item is laid over the
document and equal tokens are counted, which tolerates substitutions. The masks are chosen by an
item's length so that no qualifying overlap is without a hit, wherever its substitutions are.

A seed that stands at many places of a document and of an item names more pairs of places than there
are shifts between the two; then all shifts of its range are taken instead, so that repetitive texts cost
no more than their lengths added. A document is laid against an item in one row, at all its shifts.

The benchmark is the broadcast side, and its size is checked: beyond ``most_seeds`` it is dealt
into blocks by item, each under the bound, and the documents are read once per block.

Defined cases: null and empty texts have no tokens and no overlap. Items of fewer than SPAN tokens say
too little to be found inside a text; they overlap the documents that have just these tokens. Several rows with one
doc_id or item_id are one document or item in the result, at their best overlap; null ids are kept. Extra input
columns are kept by ``remove_contaminated``, whatever their names, and not read otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import shared_dir, unused, written

#: Token positions that each mask reads. However 2 of 10 or 3 of 15 tokens are substituted, one of
#: MASKS still fits between them. As any window of 10 or more tokens can be dealt into blocks of 10
#: and 15 (and a rest), and one block holds no more than its fifth of the substitutions, this proves
#: all windows from 10 tokens with up to a fifth substituted. SHORT_MASKS do it for 1 of 5 to 9.
MASKS = ((0, 1, 3, 4, 5), (0, 1, 5, 7, 8), (0, 1, 2, 3, 4))
SHORT_MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))
#: Tokens that an item needs to be searched inside texts.
SPAN = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def token_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased words of a text, in order."""
    words = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x20\x09-\x0D]+", -1)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def masks_for(window: int, least_share: float) -> tuple[tuple[int, ...], ...]:
    """Masks of which one hits in any window of that many tokens with at least least_share equal."""
    free = max(k for k in range(window + 1) if window - k >= least_share * window or k == 0)
    if 1 <= free <= window // 5:
        return MASKS if window >= 10 else SHORT_MASKS
    run = max(1, -(-(window - free) // (free + 1)))  # some run between substitutions is that long
    return (tuple(range(min(run, 5))),)


def _placed(rows: DataFrame, ident: str, place: str, masks: dict[tuple[int, ...], list[int] | None], window: int) -> DataFrame:
    """ident, place and seed, one row per seed of rows (ident, tokens). No row carries the tokens.

    Each mask is placed wherever its own span fits. The values of masks are the window lengths of
    the items that it is for; None places it in all rows.
    """
    steps = range(max((m[-1] for m in masks), default=0) + 1)
    beside = F.arrays_zip(*(F.slice("tokens", p + 1, F.size("tokens")).alias(f"t{p}") for p in steps))
    # Not in lambdas, which Spark interprets: a row per position with the tokens from there on.
    at = rows.select(ident, F.least(F.lit(window), F.size("tokens")).alias("_w"), F.posexplode(beside).alias(place, "_t"))

    def seed(mask: tuple[int, ...], lengths: list[int] | None) -> Column:
        fits = F.col(f"_t.t{mask[-1]}").isNotNull()
        fits = fits if lengths is None else fits & F.col("_w").isin(lengths)
        return F.when(fits, F.xxhash64(F.lit(",".join(map(str, mask))), *(F.col(f"_t.t{p}") for p in mask)))

    seeds = F.array(*(seed(m, n) for m, n in masks.items())) if masks else F.array().cast("array<bigint>")
    return at.select(ident, place, F.explode(seeds).alias("seed")).filter("seed IS NOT NULL")


def _tokenised(rows: DataFrame, *idents: str) -> DataFrame:
    return rows.select(*(F.col(c).cast("long").alias(c) for c in idents), token_hashes(F.col("text").cast("string")).alias("tokens"))


def shifts_between(at: Column, pos: Column) -> Column:
    """The differences of places in a document and in an item; all of their range where that is fewer than the pairs."""
    low, high = F.array_min(at) - F.array_max(pos), F.array_max(at) - F.array_min(pos)
    pairs = F.flatten(F.transform(at, lambda a: F.transform(pos, lambda p: a - p)))
    return F.when(F.size(at).cast("long") * F.size(pos) > high - low + 1, F.sequence(low, high)).otherwise(F.array_distinct(pairs))


#: Most equal tokens in a window of n_window tokens of item, at one of shifts, that lies within tokens. One
#: walk along the item for each shift; none is walked any more once a window is equal throughout.
_BEST = """aggregate(shifts, 0, (best, shift) -> if(best >= n_window, best, greatest(best, aggregate(
  sequence(0, size(item) - 1), named_struct('now', 0, 'most', 0),
  (s, q) -> named_struct(
    'now', s.now + {eq_q} - if(q >= n_window, {eq_out}, 0),
    'most', if(q >= n_window - 1 AND shift + q - n_window + 1 >= 0 AND shift + q < size(tokens), greatest(s.most, s.now + {eq_q} - if(q >= n_window, {eq_out}, 0)), s.most)),
  s -> s.most))))""".format(
    eq_q="if(shift + q >= 0 AND shift + q < size(tokens), if(tokens[greatest(shift + q, 0)] = item[q], 1, 0), 0)",
    eq_out="if(shift + q - n_window >= 0 AND shift + q - n_window < size(tokens), if(tokens[greatest(shift + q - n_window, 0)] = item[greatest(q - n_window, 0)], 1, 0), 0)",
)


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 25, least_share: float = 0.8, most_seeds: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, n_equal and n_window per contaminated document and item it overlaps.

    A hit names a document, an item and a shift between them. At that shift some min(window, item
    length) consecutive item tokens, of which at least least_share equal the document's tokens
    opposite, make the document contaminated. most_seeds bounds the broadcast rows (24 bytes each).
    """
    folder = shared_dir(docs.sparkSession)
    # Rows are told apart by a hash of id and text; where two share one, each is still judged by its own tokens.
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")))
    items = _tokenised(benchmark, "item_id").filter(F.size("tokens") > 0)
    # At most one row per window length.
    lengths = items.groupBy(F.least(F.lit(window), F.size("tokens")).alias("w")).agg(F.sum(F.size("tokens")).alias("n")).filter(F.col("w") >= SPAN).collect()
    masks: dict[tuple[int, ...], list[int]] = {}
    for r in lengths:
        for mask in masks_for(r.w, least_share):
            masks.setdefault(mask, []).append(r.w)
    n_seeds = sum(r.n * len(masks_for(r.w, least_share)) for r in lengths)
    blocks = max(1, -(-n_seeds // most_seeds))
    tokens = _tokenised(docs, "doc_id", "row")
    seeded = _placed(tokens, "row", "at", dict.fromkeys(masks), window)
    long_items, hits = items.filter(F.size("tokens") >= SPAN), []
    for n in range(blocks):
        part = long_items if blocks == 1 else long_items.filter(F.pmod(F.xxhash64("item_id", "tokens"), F.lit(blocks)) == n)
        placed = _placed(part, "item_id", "pos", masks, window).groupBy("item_id", "seed").agg(F.collect_list("pos").alias("pos"))
        at = seeded.join(F.broadcast(placed.select("seed").distinct()), "seed", "left_semi").groupBy("row", "seed").agg(F.collect_list("at").alias("at"))
        hits.append(at.join(F.broadcast(placed), "seed").select("row", "item_id", shifts_between(F.col("at"), F.col("pos")).alias("shifts")))
    shifts = reduce(DataFrame.unionByName, hits).groupBy("row", "item_id").agg(F.array_distinct(F.flatten(F.collect_list("shifts"))).alias("shifts"))
    shifts = written(shifts, f"{folder}/shifts")
    # Texts of documents with hits only: their rows are a small table by then, of known size.
    touched = _tokenised(docs.join(shifts.select("row").distinct(), "row", "left_semi"), "doc_id", "row")
    beside = shifts.join(items.select(F.col("item_id").alias("_item"), F.col("tokens").alias("item")), F.col("item_id").eqNullSafe(F.col("_item")))
    laid = beside.join(touched, "row").withColumn("n_window", F.least(F.lit(window), F.size("item"))).filter(F.col("n_window") >= SPAN)
    scored = laid.select("doc_id", "item_id", "n_window", F.expr(_BEST).alias("n_equal"))
    found = scored.filter(F.col("n_equal") >= F.lit(least_share) * F.col("n_window"))
    # Short items: as many tokens, and the same.
    short = items.filter(F.size("tokens") < SPAN).select("item_id", F.xxhash64("tokens").alias("all"), F.col("tokens").alias("item"))
    whole = tokens.filter(F.size("tokens") < SPAN).withColumn("all", F.xxhash64("tokens")).join(short, "all").filter("tokens = item")
    found = found.unionByName(whole.select("doc_id", "item_id", F.size("item").alias("n_window"), F.size("item").alias("n_equal")))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_equal", "n_window")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.n_equal").cast("long").alias("n_equal"), F.col("best.n_window").cast("long").alias("n_window"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options: float) -> DataFrame:
    """The rows of docs that overlap no benchmark item; all columns stay.

    A row is judged by its own text: rows are told apart by a 64-bit hash of id and text, so that
    one contaminated row without an id, or with a repeated one, takes no other with it.
    """
    (bad,) = unused(docs.columns, "_bad")
    ident = F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    found = overlaps(docs.select(ident.alias("doc_id"), "text"), benchmark, **options).select(F.col("doc_id").alias(bad)).distinct()
    return docs.join(found, ident == F.col(bad), "left_anti")
