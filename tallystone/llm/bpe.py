"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one vocabulary token can be the last token of the prefix's
encoding. An automaton over the vocabulary's suffixes (suffix links, as Aho-Corasick builds them)
lists the tokens that end at a position; the one that is compatible with the last token of the
prefix before it is that unique token. Back-pointers from the end of the word give the ids, with
no merge loop. Two tokens are compatible if applying the merges in rank order to their joined
symbols never merges across their border.

Defined cases: null and empty texts have no tokens. Special tokens written in a text get their
own ids, as the vocabulary's library does. Repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unicode's White_Space, as the body of a character class.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_spaces = regex.compile(rf"[{_WS}]+")
_pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WS}\p{{L}}\p{{N}}]+")
#: Added to the code of a word's last byte: a byte at a word's end is a symbol of its own.
_END = 256


def load_spec(path: str) -> dict:
    """Merges, token texts and special tokens of a word-end BPE vocabulary file."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    model = raw["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return {"vocab": model["vocab"], "merges": merges, "special": {t["content"]: t["id"] for t in raw["added_tokens"]}, "suffix": model["end_of_word_suffix"]}


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, to the byte."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes by one vocabulary; built once in each Python worker."""

    def __init__(self, spec: dict, cache_size: int = 300_000) -> None:
        vocab, suffix = spec["vocab"], spec["suffix"]
        self.token_of = {i: t for t, i in vocab.items()} | {i: t for t, i in spec["special"].items()}
        self.special = spec["special"]
        self._special_cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        symbols: dict[int, str] = {}
        for letter, byte in _byte_letters().items():
            symbols[vocab[letter]] = chr(byte)
            symbols[vocab[letter + suffix]] = chr(byte + _END)
        self._base = {s: i for i, s in symbols.items()}
        self._parts: dict[int, tuple[int, int]] = {}
        self._rank: dict[tuple[int, int], int] = {}
        self._made: dict[int, float] = {}  # the rank of the merge that makes a token
        for rank, (a, b) in enumerate(spec["merges"]):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self._rank[left, right] = rank
            if whole not in symbols:
                self._parts[whole], self._made[whole] = (left, right), rank
                symbols[whole] = symbols[left] + symbols[right]
        self._length = {i: len(s) for i, s in symbols.items()}
        self._fits: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._automaton = ahocorasick.Automaton()
        for i, s in symbols.items():
            if self._reachable(i):
                self._automaton.add_word(s, i)
        self._automaton.make_automaton()
        self._words: dict[str, tuple[int, str, str]] = {}
        self._cache_size = cache_size

    def _spine(self, token: int, side: int) -> list[int]:
        """The tokens at one edge of a token's merge tree, from the single symbol up."""
        out = [token]
        while token in self._parts:
            out.append(token := self._parts[token][side])
        return out[::-1]

    def _border_holds(self, a: int, b: int, upto: float = math.inf) -> bool:
        """Whether no merge ranked below upto joins the edge of a with the edge of b."""
        left, right = self._spine(a, 1), self._spine(b, 0)
        i = j = 0
        while True:
            grow_left = self._made[left[i + 1]] if i + 1 < len(left) else math.inf
            grow_right = self._made[right[j + 1]] if j + 1 < len(right) else math.inf
            across = self._rank.get((left[i], right[j]), math.inf)
            # Of equal merges the leftmost goes first: growth inside a before, inside b after.
            if across < upto and across < grow_left and across <= grow_right:
                return False
            if grow_left == grow_right == math.inf:
                return True
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1

    def _reachable(self, token: int) -> bool:
        """Whether encoding the token's own symbols gives the token."""
        if token not in self._whole:
            parts = self._parts.get(token)
            self._whole[token] = parts is None or self._reachable(parts[0]) and self._reachable(parts[1]) and self._border_holds(*parts, self._made[token])
        return self._whole[token]

    def compatible(self, a: int, b: int) -> bool:
        if (known := self._fits.get((a, b))) is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            known = self._fits[a, b] = self._border_holds(a, b)
        return known

    def word_ids(self, word: str) -> list[int]:
        """The ids of one piece of normalised text."""
        data = word.encode("utf-8")
        symbols = data[:-1].decode("latin-1") + chr(data[-1] + _END)
        last: list[int] = [-1] * (len(symbols) + 1)
        for end, token in self._automaton.iter(symbols):
            before = end + 1 - self._length[token]
            if last[end + 1] < 0 and (before == 0 or last[before] >= 0 and self.compatible(last[before], token)):
                last[end + 1] = token
        ids, at = [], len(symbols)
        while at:
            ids.append(last[at])
            at -= self._length[last[at]]
        return ids[::-1]

    def _word(self, word: str) -> tuple[int, str, str]:
        ids = self.word_ids(word)
        if len(self._words) >= self._cache_size:
            self._words.clear()
        known = len(ids), " ".join(map(str, ids)), self.decode(ids)
        if len(word) <= 64:
            self._words[word] = known
        return known

    def pieces(self, text: str) -> Iterator[tuple[int, str, str]]:
        """For each piece: number of tokens, their ids and their decoded text, joined by spaces."""
        known = self._words.get
        for part in self._special_cut.split(text) if self._special_cut else [text]:
            if part in self.special:
                yield 1, str(self.special[part]), part
                continue
            part = _spaces.sub(" ", unicodedata.normalize("NFC", part)).replace("Σ", "σ").lower()
            for w in _pieces.findall(part):
                yield known(w) or self._word(w)

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for _, ids, _ in self.pieces(text or "") for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by one space; the vocabulary file names no decoder."""
        return " ".join(self.token_of[i] for i in ids)


_codecs: dict[str, Codec] = {}


def codec(spec: dict, key: str) -> Codec:
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(spec)
    return _codecs[key]


def encode_documents(docs: DataFrame, vocabulary: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded if keep_ids) per row of docs.

    vocabulary: path of the vocabulary file, read once on the driver and broadcast; its size is
    that of the vocabulary, whatever the corpus.
    """
    spec = load_spec(vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value, vocabulary)
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for text in b.column(1).to_pylist():
                found = list(c.pieces(text or ""))
                joined, decoded = " ".join(x[1] for x in found), " ".join(x[2] for x in found)
                row = sum(x[0] for x in found), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), [int(i) for i in joined.split()] if keep_ids else None, decoded if keep_ids else None
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            arrays = [b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                arrays += [pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
