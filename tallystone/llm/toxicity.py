"""Toxicity by a learned lexicon, matched with Levenshtein automata and scored in context.

The lexicon is learned from labelled documents: words and word beginnings that toxic documents use
and clean ones do not. It is held as a trie; the Levenshtein automata of its terms, intersected with the trie, are
run as one automaton whose states are sets of (trie node, edits), made when first reached. So a
word costs one step per letter however long the lexicon is. A hit counts fully in plain speech,
and less inside quotation marks or after words of reporting within a window around it.

Defined cases: null and empty texts have no hit and score the base rate. Labels of documents that
do not exist are ignored, and so are null labels and null ids; rows that repeat a doc_id count
each. With no labelled rows all scores are 0. Extra input columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import shared_dir, written

_word = re.compile(r"\w+")
_quote = re.compile(r"[\"“”„«»‹›]")
#: Words of reporting in the corpus's languages.
_report = re.compile(r"(?i)\b(?:said|says|quote[sd]?|called|wrote|sagte|schrieb|nannte|dijo|dice|llamó|disait|appelé)\b")
WINDOW = 48
QUOTED = 0.35
#: Lengths of the word beginnings that are tried as stems.
STEM_LETTERS = (5, 6, 7)
#: Letters from which a learned term or stem is found with one edit, and a term with two.
ONE_EDIT, TWO_EDITS = 4, 9
#: A term or stem that misspells more words of clean documents than this lies among the plain words
#: of a language: edits of it are told from those by no list, so it is found as spelled only.
MOST_NEAR = 24


def held_out(doc_id: Column) -> Column:
    """Documents kept for evaluation: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


#: In place of a letter that is due: the word goes on after a stem.
AFTER = "*"


class FuzzyLexicon:
    """Weighted terms and stems; finds the best one within the edits that its length allows.

    A term is a whole word; a stem matches any word that begins with it. Those of at least
    long_word letters also match with one edit, at a discount, and terms of at least two_edits
    letters with two, at the discount's square. With swaps, two letters exchanged are one edit.
    Entries in as_spelled (stems end in *) match without edits.
    """

    def __init__(self, weights: dict[str, float], stems: dict[str, float], allowed: set[str], long_word: int = 7, discount: float = 0.5, most_states: int = 200_000, two_edits: float = math.inf, swaps: bool = False, as_spelled: frozenset[str] = frozenset()) -> None:
        self.weights, self.allowed, self.most_states, self.swaps = weights, allowed, most_states, swaps
        self.next: list[dict[str, int]] = [{}]
        self.best: list[tuple[float, ...]] = [(0.0, 0.0, 0.0)]  # weight of what ends at a node, with no, one and two edits
        self.entry: list[str] = [""]
        self.most: list[int] = [0]  # edits that any entry through a node allows
        self.stem: list[tuple[float, ...]] = [(0.0, 0.0, 0.0)]  # of these the weight of a stem, which any letters may follow
        for entry, is_stem in sorted([(t, False) for t in weights] + [(t, True) for t in stems]):
            at, edits = 0, 0 if len(entry) < long_word or entry + "*" * is_stem in as_spelled else 1 if is_stem or len(entry) < two_edits else 2
            self.most[0] = max(edits, self.most[0])
            for c in entry:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.best.append((0.0, 0.0, 0.0))
                    self.most.append(0)
                    self.entry.append(self.entry[at] + c)
                    self.stem.append((0.0, 0.0, 0.0))
                at = self.next[at][c]
                self.most[at] = max(edits, self.most[at])
            w = stems[entry] if is_stem else weights[entry]
            worth = tuple(w * discount**e if e <= edits else 0.0 for e in range(3))
            self.best[at] = tuple(map(max, worth, self.best[at]))
            if is_stem:
                self.stem[at] = worth
        self._reset()

    def _reset(self) -> None:
        self._sets: list[frozenset[tuple[int, str, int]]] = []
        self._number: dict[frozenset[tuple[int, str, int]], int] = {}
        self._steps: list[dict[str, int]] = []
        self._ends: list[tuple[float, bool]] = []
        self._add(self._closed({(0, "", 0)}))

    def _closed(self, states: set[tuple[int, str, int]]) -> frozenset[tuple[int, str, int]]:
        """With the states that one more letter of the term (missing from the word) reaches."""
        least: dict[tuple[int, str], int] = {}
        for node, due, e in states:
            if e <= self.most[node]:
                least[node, due] = min(e, least.get((node, due), e))
        todo = [(node, e) for (node, due), e in least.items() if not due]
        while todo:
            node, e = todo.pop()
            for child in self.next[node].values():
                if e < self.most[child] and e + 1 < least.get((child, ""), 3):
                    least[child, ""] = e + 1
                    todo.append((child, e + 1))
        return frozenset((node, due, e) for (node, due), e in least.items())

    def _add(self, states: frozenset[tuple[int, str, int]]) -> int:
        if states not in self._number:
            self._number[states] = len(self._sets)
            self._sets.append(states)
            self._steps.append({})
            ends = [(e, (self.stem if due else self.best)[n][e]) for n, due, e in states if due in ("", AFTER)]
            plain = max((w for e, w in ends if e == 0), default=0.0)
            edited = max((w for e, w in ends if e), default=0.0)
            self._ends.append((plain, False) if plain else (edited, edited > 0))
        return self._number[states]

    def _step(self, state: int, c: str) -> int:
        """States are (trie node, letter due, edits): a letter is due in the middle of a swap, AFTER marks letters that follow a stem."""
        new: set[tuple[int, str, int]] = set()
        for node, due, e in self._sets[state]:
            if due == AFTER:
                new.add((node, AFTER, e))
                continue
            if due:
                if c == due:
                    new.add((node, "", e))
                continue
            if c in self.next[node]:
                new.add((self.next[node][c], "", e))
            if self.stem[node][e]:
                new.add((node, AFTER, e))
            if e < self.most[node]:
                new.add((node, "", e + 1))  # a letter too many
                new.update((child, "", e + 1) for x, child in self.next[node].items() if x != c)  # another letter
                if self.swaps:
                    new.update((self.next[child][c], x, e + 1) for x, child in self.next[node].items() if x != c and c in self.next[child])
        to = self._steps[state][c] = self._add(self._closed(new))
        return to

    def weight(self, word: str) -> tuple[float, bool]:
        """The word's own weight, or that of its stem or of a term some edits away (then True); else 0."""
        if word in self.weights:
            return self.weights[word], False
        if word in self.allowed:
            return 0.0, False
        if len(self._sets) > self.most_states:
            self._reset()
        at = 0
        for c in word:
            known = self._steps[at].get(c)
            at = self._step(at, c) if known is None else known
            if not self._sets[at]:
                return 0.0, False
        return self._ends[at]


    def near(self, word: str) -> set[str]:
        """The terms, and the stems with *, that the word matches with edits."""
        at = 0
        for c in word:
            known = self._steps[at].get(c)
            at = self._step(at, c) if known is None else known
        found = set()
        for n, due, e in self._sets[at]:
            if e and due in ("", AFTER):
                found |= {self.entry[n] + "*"} if self.stem[n][e] else {self.entry[n]} if not due and self.best[n][e] else set()
        return found


class Scorer:
    """Hit features of a text; one per Python worker, as it caches words."""

    def __init__(self, lexicon: FuzzyLexicon, cache_size: int = 300_000) -> None:
        self.lexicon, self.cache_size = lexicon, cache_size
        self.known: dict[str, tuple[float, bool]] = {}

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Logs of the summed context-weighted hits: exact ones, misspelled ones, exact ones per 100 words."""
        text = (text or "").lower()
        words = _word.findall(text)
        if len(self.known) > self.cache_size:
            self.known.clear()
        found = {}
        for w in set(words):
            x = self.known.get(w)
            if x is None:
                x = self.known[w] = self.lexicon.weight(w)
            if x[0]:
                found[w] = x
        total = [0.0, 0.0]
        if found:
            for m in _word.finditer(text):
                if x := found.get(m[0]):
                    before, after = text[max(0, m.start() - WINDOW) : m.start()], text[m.end() : m.end() + WINDOW]
                    quoted = len(_quote.findall(before)) % 2 == 1 and _quote.search(after) or _report.search(before)
                    total[x[1]] += x[0] * (QUOTED if quoted else 1.0)
        return math.log1p(total[0]), math.log1p(total[1]), math.log1p(100 * total[0] / max(1, len(words)))


@dataclass
class Model:
    weights: dict[str, float]
    stems: dict[str, float]
    allowed: set[str]
    coefficients: tuple[float, float, float, float]
    base_rate: float
    as_spelled: frozenset[str] = frozenset()

    def lexicon(self) -> FuzzyLexicon:
        return FuzzyLexicon(self.weights, self.stems, self.allowed, ONE_EDIT, two_edits=TWO_EDITS, swaps=True, as_spelled=self.as_spelled)

    def score(self, features: tuple[float, float, float]) -> float:
        if not any(features):
            return min(self.base_rate, 0.05)
        z = self.coefficients[0] + sum(c * x for c, x in zip(self.coefficients[1:], features, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-5, rounds: int = 50) -> np.ndarray:
    """Newton steps of a ridge-penalised logistic regression, first coefficient free."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1)) * len(x)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, least_docs: int = 4) -> Model:
    """Learns from about sample_rows labelled rows outside the held-out third (all if there are fewer).

    The sample is a hash threshold on the id, so it is the same however the table is split, and
    sample_rows bounds the (id, label) pairs that are broadcast to pick the texts without a shuffle.
    Word counts are made on the executors. What reaches the driver is bounded by the sample alone: the
    words of at least least_docs toxic texts that few clean ones hold, the words of clean texts
    that such terms are near to, and three features per text of half of the sample.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        "doc_id IS NOT NULL AND toxic IS NOT NULL"
    ).filter(~held_out(F.col("doc_id")))
    n = usable.count()
    share = min(1.0, sample_rows / max(1, n))
    picked = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select("text", "toxic")
    rows = rows.filter("text IS NOT NULL")
    words = rows.groupBy(F.xxhash64("text").alias("copy")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))  # copies count once
    words = written(words, f"{shared_dir(docs.sparkSession)}/sample")
    split = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w+)"), F.lit(1)))
    stems_of = F.flatten(F.transform(split, lambda w: F.transform(F.filter(F.array(*map(F.lit, STEM_LETTERS)), lambda k: F.char_length(w) > k), lambda k: F.concat(F.substr(w, F.lit(1), k), F.lit("*")))))
    entries = F.array_distinct(F.concat(split, stems_of))
    halved = words.withColumn("half", F.pmod("copy", F.lit(2)) == 1)
    tally = [F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"), F.sum(F.when(~F.col("half"), F.col("toxic"))).alias("first_bad"), F.sum(F.when(~F.col("half"), 1 - F.col("toxic"))).alias("first_good")]
    counts = halved.select("toxic", "half", F.explode(entries).alias("entry")).groupBy("entry").agg(*tally).filter(F.col("bad") >= least_docs).na.fill(0)
    totals = halved.agg(*tally).na.fill(0).first()
    rows_of = counts.filter("good * 20 < bad OR first_good * 20 < first_bad").collect()

    def lexicon_of(bad_name: str, good_name: str, least: int) -> tuple[dict[str, float], dict[str, float]]:
        all_bad, all_good = max(1, totals[bad_name]), max(1, totals[good_name])
        lifts = {r.entry: math.log((r[bad_name] + 0.5) / all_bad) - math.log((r[good_name] + 0.5) / all_good) for r in rows_of if r[bad_name] >= least and 20 * r[good_name] < r[bad_name]}
        support = {r.entry: r[bad_name] / (r[bad_name] + 20) for r in rows_of}  # rare entries count for less
        found = {e: round(x / 2 * support[e], 6) for e, x in lifts.items() if x > 3}
        return {e: w for e, w in found.items() if not e.endswith("*")}, {e[:-1]: w for e, w in found.items() if e.endswith("*")}

    weights, stems = lexicon_of("bad", "good", least_docs)
    bad, good = totals.bad, totals.good

    def clean_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Model(weights, stems, set(), (0.0,) * 4, 0.0).lexicon()
        for b in batches:
            hits: set[tuple[str, bool]] = set()
            for t, half in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                hits.update((w, half) for w in set(_word.findall(t.lower())) if w not in weights and lexicon.weight(w)[0])
            rows = sorted(hits)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_())], ["word", "half"])

    # Words that clean documents use are no misspellings of the terms they are near to. What hits
    # are worth is learned from half of the sample, with terms and such words from the other half.
    # Entries among many such words get no edits.
    near = halved.filter("toxic = 0").select("text", "half").mapInArrow(clean_neighbours, "word string, half boolean")
    seen = near.groupBy("word").agg(F.bool_or(~F.col("half")).alias("first_half")).collect()
    whole = Model(weights, stems, set(), (0.0,) * 4, 0.0).lexicon()
    close = [(r, e) for r in seen for e in whole.near(r.word)]
    crowded = lambda n: frozenset(e for e, k in n.items() if k > MOST_NEAR)
    first_crowded = crowded(Counter(e for r, e in close if r.first_half))
    first = Model(*lexicon_of("first_bad", "first_good", (least_docs + 1) // 2), {r.word for r in seen if r.first_half}, (0.0,) * 4, 0.0, first_crowded)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(first.lexicon())
        for b in batches:
            x = [scorer.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in x], pa.float64()) for k in range(3)), b.column(1)], ["exact", "fuzzy", "density", "toxic"])

    table = np.array([tuple(r) for r in halved.filter("half").select("text", "toxic").mapInArrow(features, "exact double, fuzzy double, density double, toxic int").collect()], float).reshape(-1, 4)
    # Labelled rows may hold few misspellings, so each row counts once more with its exact hits misspelled.
    misspelled = np.column_stack([0 * table[:, 0], np.log1p(np.expm1(table[:, 1]) + 0.5 * np.expm1(table[:, 0])), 0 * table[:, 2], table[:, 3]])
    table = np.concatenate([table, misspelled])
    model = Model(weights, stems, {r.word for r in seen}, (-30.0, 0.0, 0.0, 0.0), bad / (bad + good) if bad else 0.0, crowded(Counter(e for _, e in close)))
    if len(set(table[:, 3])) == 2:
        order = np.lexsort(table.T)
        model.coefficients = tuple(float(c) for c in _logistic(table[order, :3], table[order, 3]))
    elif weights or stems:
        model.coefficients = (-2.0, 4.0, 0.0, 0.0)  # too few rows to learn from: one plain hit decides
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        scorer = Scorer(m.lexicon())
        for b in batches:
            scores = [m.score(scorer.features(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score below threshold; all columns stay, texts are read once."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        scorer = Scorer(m.lexicon())
        for b in batches:
            yield b.filter(pa.array([m.score(scorer.features(t)) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
