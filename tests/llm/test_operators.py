"""The training-data operators against brute force, and their defined results on odd input."""

from __future__ import annotations

import hashlib
import html as entities
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from tallystone.llm import bpe, decontamination, line_dedup, pii, quality_rules, queries, sharding, simhash, toxicity, warc, wrapper

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string"
#: Extra columns whose names are also used inside the operators.
CLASH = ("key", "fp", "rep", "batch", "line", "lines", "tokens", "host", "seed", "n", "shard", "bucket", "toxic", "drop", "tries", "entity", "payload", "n_chars", "_bad", "_lost", "_kept", "_own", "_part", "_id", "__kept", "__part", "__lost")


def clash(df, without=()):
    return df.withColumns({c: F.lit(7) for c in CLASH if c not in without})


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, a very long text, ties, repeated rows and clashing columns."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    data = [(1, None), (2, ""), (3, " \t\n "), (4, long), (5, "one two"), (5, "one two"), (None, "one two"), (6, "é" * 50 + "\n" + "Straße 5"), (7, "one two")]
    return clash(spark.createDataFrame(data, DOC))


@pytest.fixture(scope="module")
def empty(spark):
    return clash(spark.createDataFrame([], DOC))


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    mine = queries.QUERIES[name](spark, sf)
    theirs = con.execute(queries.ORACLE_SQL[name])
    order = [d[0] for d in theirs.description]
    assert sorted(mine.columns) == sorted(order)
    assert rows(mine.select(*order)) == sorted(theirs.fetchall(), key=repr)


# 1 quality rules


def test_quality_ablation(spark, odd, empty):
    led = quality_rules.ledger(odd)
    assert led.count() == 9 and quality_rules.ledger(empty).count() == 0
    bits = [r.fail_bits for r in led.collect()]
    for r in quality_rules.ablations(led).collect():
        m = quality_rules.mask(quality_rules.POLICIES[r.policy])
        without = m & ~quality_rules.mask((r.rule,))
        assert r.n_rejected == sum(b & m != 0 for b in bits) and r.n_rejected_without == sum(b & without != 0 for b in bits)
    assert quality_rules.measure("a b c a b c")[4] == 6 and quality_rules.measure("x\nx\n\n\nx")[3] == 2
    assert quality_rules.measure(None)[:5] == (0, 0, 0, 0, 0)


# 2 BPE


def test_bpe_equals_library(spark, texts, odd, empty):
    from tokenizers import Tokenizer

    path = queries.default_vocabulary()
    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    codec = bpe.Codec(bpe.load_spec(path))
    rng = random.Random(3)
    made = ["".join(rng.choice("abinthe'.!  s1é😀ñÀΣß\n") for _ in range(rng.randint(0, 40))) for _ in range(800)]
    hard = ["<|endoftext|>x<|startoftext|>", "ΑΣΣ ΟΔΟΣ", "a" * 300, "'sfoo 'll'd", "日本語 한국어", "\x1c a\x85b​", "İI ﬁ"]
    for text in [*texts.values(), *made, *hard]:
        want = lib.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == want
        assert codec.decode(want) == lib.decode(want, skip_special_tokens=False)
    got = {r.doc_id: r for r in bpe.encode_documents(odd, path, keep_ids=True).collect()}
    assert got[1].n_tokens == got[2].n_tokens == got[3].n_tokens == 0 and got[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[4].n_tokens == len(got[4].ids) >= 30_000
    assert bpe.encode_documents(empty, path).count() == 0


# 3 sharding


def jump(key, n):
    b, j = -1, 0
    key &= (1 << 64) - 1
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(docs, texts, odd, empty):
    out = sharding.shard(docs, 16).collect()
    slots = defaultdict(list)
    for r in out:
        assert r.shard == jump(r.doc_id, 16) and r.grown_shard == jump(r.doc_id, 17) and r.grown_shard in (r.shard, 16)
        data = texts[r.doc_id].encode()
        assert r.size == len(data) + 1 and r.text_crc32 == zlib.crc32(data) and r.law == "key"
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(out) == len(texts)
    got = sharding.shard(odd, 16).collect()
    assert len(got) == 9 and next(r for r in got if r.doc_id == 1).size == 1 and next(r for r in got if r.doc_id is None).shard == 0
    assert sharding.shard(empty, 16).count() == 0


# 4 toxicity


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries.op4_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    out = scored.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    held = [r for r in out if r.held_out]
    wrong = sum(r.predicted and not r.toxic for r in held)
    assert sum(r.predicted and r.toxic for r in held) >= 0.6 * sum(r.toxic for r in held) and wrong <= 0.02 * len(held)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, x, b, i)
    return row[-1]


def _next(row, x, b, i):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
    return new


def test_levenshtein_automaton():
    terms = {"worthless": 1.0, "stupids": 2.0, "idiot": 1.5}
    lex = toxicity.FuzzyLexicon(terms, {"pathet": 3.0}, {"worthles"})
    rng = random.Random(5)
    for term in terms:
        for _ in range(400):
            w = list(term)
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(w))
                w[k : k + rng.choice((0, 1))] = rng.choice(("", "x", "s"))
            word = "".join(w)
            want = max((v * (1 if word == t else 0.5) for t, v in terms.items() if word == t or edits(word, t) <= 1 and len(t) >= 7), default=0.0)
            if word != "worthles":
                assert lex.weight(word)[0] == want, word
    assert lex.weight("worthles") == (0.0, False) and lex.weight("pathetically") == (3.0, False) and lex.weight("") == (0.0, False)


def edits_with_swaps(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
            if i > 1 and j > 1 and a[i - 2 : i] == y + b[j - 2] and x != y:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_short_misspelled_terms():
    terms = {"worthless": 1.0, "stupid": 2.0, "idiot": 1.5, "scum": 1.0, "ass": 3.0, "clown": 2.5}
    lex = toxicity.Model(terms, {"pathet": 3.0}, {"crown"}, (0.0,) * 4, 0.0, frozenset({"clown"})).lexicon()
    rng = random.Random(6)
    free = lambda t: 0 if len(t) < 4 or t == "clown" else 1 if len(t) < 9 else 2
    for term in terms:
        for _ in range(400):
            w = list(term)
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(w) - 1)
                w[k : k + 2] = rng.choice(("x" + w[k + 1], w[k] + "s" + w[k + 1], w[k + 1], w[k + 1] + w[k]))
            word = "".join(w)
            n = {t: edits_with_swaps(word, t) for t in terms}
            assert lex.weight(word)[0] == (terms.get(word) or max((v * 0.5 ** n[t] for t, v in terms.items() if n[t] <= free(t)), default=0.0)), word
    assert all(lex.weight(w)[1] for w in ("stupd", "idoit", "scvm", "worhtles", "pahtetically")) and lex.weight("crown")[0] == lex.weight("clwon")[0] == 0
    assert lex.near("stupd") == {"stupid"} and lex.near("pahtetically") == {"pathet*"}


def test_toxicity_finds_misspelled_abuse(spark):
    rng = random.Random(8)
    plain = [f"word{chr(97 + k)}{chr(98 + k)}{chr(99 + k)}" for k in range(20)]
    abuse = ("stupid", "idiot", "clown", "loser")
    data = [(i, " ".join(rng.sample(plain, 8) + (rng.sample(abuse, 2) if i % 3 == 0 else []))) for i in range(400)]
    docs = spark.createDataFrame(data, DOC)
    model = toxicity.train(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in data], "doc_id long, toxic int"))
    found = toxicity.score(spark.createDataFrame([(1, "worda you stupd idoit"), (2, "you cl0wn and lozer"), (3, "wordabc wordbcd")], DOC), model)
    assert {r.doc_id: r.predicted for r in found.collect()} == {1: 1, 2: 1, 3: 0}


def test_toxicity_equals_plain_scoring(spark, docs, texts):
    """Every score again from the model's tables alone: dynamic programming per word and entry, no automaton."""
    sf = "/root/testdata/sf0.01"
    read = lambda t, *c: spark.read.parquet(f"{sf}/{t}.parquet").select(*c)
    model = toxicity.train(read("documents", "doc_id", "text"), read("labels", "doc_id", "toxic"))
    entries = [(t, w, False) for t, w in model.weights.items()] + [(t, w, True) for t, w in model.stems.items()]
    letters = {t: Counter(t) for t, _, _ in entries}
    known = {}

    def weight(word):
        if word in model.weights or word in model.allowed:
            return model.weights.get(word, 0.0), False
        own, plain, edited = Counter(word), 0.0, 0.0
        for t, w, stem in entries:
            free = 0 if len(t) < 4 or t + "*" * stem in model.as_spelled else 1 if stem or len(t) < 9 else 2
            if (letters[t] - own).total() <= free and (stem or abs(len(t) - len(word)) <= free):
                n = min(edits_with_swaps(word[:k], t) for k in range(len(word) + 1)) if stem else edits_with_swaps(word, t)
                plain, edited = (max(plain, w), edited) if n == 0 else (plain, max(edited, w * 0.5**n if n <= free else 0.0))
        return (plain, False) if plain else (edited, edited > 0)

    def score(text):
        text = (text or "").lower()
        total, n = [0.0, 0.0], 0
        for m in re.finditer(r"\w+", text):
            n += 1
            w, fuzzy = known.setdefault(m[0], None) or known.__setitem__(m[0], weight(m[0])) or known[m[0]]
            before, after = text[max(0, m.start() - 48) : m.start()], text[m.end() : m.end() + 48]
            quoted = w and (sum(c in "\"“”„«»‹›" for c in before) % 2 and any(c in "\"“”„«»‹›" for c in after) or toxicity._report.search(before))
            total[fuzzy] += w * (0.35 if quoted else 1.0)
        x = [math.log1p(total[0]), math.log1p(total[1]), math.log1p(100 * total[0] / max(1, n))]
        z = model.coefficients[0] + sum(c * v for c, v in zip(model.coefficients[1:], x, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) if any(x) else min(model.base_rate, 0.05)

    out = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(entries) > 3 and any(x > 0.7 for x in out.values())
    assert all(math.isclose(score(t), out[i], abs_tol=1e-9) for i, t in texts.items())


def test_toxicity_odd_input(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (99, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    assert toxicity.score(odd, model).count() == 9 and toxicity.score(empty, model).count() == 0
    nothing = toxicity.train(empty, labels.limit(0))
    assert {r.predicted for r in toxicity.score(odd, nothing).collect()} == {0}
    assert toxicity.remove_toxic(odd, nothing).columns == odd.columns
    plain = toxicity.Scorer(toxicity.FuzzyLexicon({"idiot": 1.0}, {}, set()))
    assert plain.features("you idiot")[0] > plain.features('they wrote "idiot" there')[0] > 0


# 5 line dedup


def dedup_lines(data):
    held = defaultdict(set)
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    for i, t in data:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(i)
    return [(i, len((t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if not (len(key(x)) >= 40 and len(held[key(x)]) >= 5 and max(held[key(x)]) != i))) for i, t in data]


def test_line_dedup(spark, docs, texts, odd, empty):
    hot = "Same Line of more than forty characters, for everyone here"
    data = [(i, f"own line number {i} that is long enough to be a key of its own\n  {hot if i % 2 else hot.upper()}\t\n{hot}\nshort") for i in range(12)]
    out = line_dedup.rewrite(spark.createDataFrame(data, DOC), batches=5).select("doc_id", "__line_dedup.*")
    assert rows(out.select("doc_id", "n_lines", "kept_text")) == sorted(dedup_lines(data), key=repr)
    got = line_dedup.rewrite(docs).select("doc_id", "__line_dedup.*")
    assert rows(got.select("doc_id", "n_lines", "kept_text")) == sorted(dedup_lines(list(texts.items())), key=repr)
    kept = line_dedup.rewrite(odd)
    assert kept.count() == 9 and set(odd.columns) < set(kept.columns)
    assert {r.kept_text for r in kept.filter("doc_id in (1, 2)").select("__line_dedup.*").collect()} == {""}
    assert line_dedup.rewrite(empty).count() == 0


def test_line_dedup_counts_documents(spark):
    """Repeated ids are one document, rows without an id one each; Spark, SQL and brute force agree."""
    hot, warm, cool = (f"{w} line that is far more than forty characters long" for w in ("hot", "warm", "cool"))
    data = [(1, hot)] * 4 + [(2, hot)] + [(i, warm) for i in (3, 3, 4, 5, 6, 7)] + [(None, f"{cool}\nx")] * 3 + [(8, cool), (9, f"{cool}\n{warm}")] + [(None, "all without an id, but in more than five rows of these")] * 6
    docs = spark.createDataFrame(data, DOC)
    held = defaultdict(set)
    for n, (i, t) in enumerate(data):
        for line in t.split("\n"):
            held[line].add((i, n if i is None else 0))
    owner = {x: max((i for i, _ in of if i is not None), default=None) for x, of in held.items()}
    want = []
    for i, t in data:
        kept = [x for x in t.split("\n") if not (len(x) >= 40 and len(held[x]) >= 5 and owner[x] != i)]
        want.append((i, t.count("\n") + 1, t.count("\n") + 1 - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    got = line_dedup.rewrite(docs).select("doc_id", "__line_dedup.*")
    assert rows(got.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256))) == sorted(want, key=repr)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    assert sorted(con.execute(queries.OP5_SQL).fetchall(), key=repr) == sorted(want, key=repr)
    assert [w[2] for w in want[:5]] == [0] * 5 and sum(w[2] for w in want) == 10


def test_line_dedup_keeps_columns_and_removes_its_tables(spark, monkeypatch):
    names = {"_lost": 1, "_kept": 2, "_own": 3, "_part": 4, "_id": 5, "__lost": 6}
    docs = spark.createDataFrame([(i, "a line of more than forty characters, again and again") for i in range(6)], DOC).withColumns({k: F.lit(v) for k, v in names.items()})
    out = line_dedup.rewrite(docs).orderBy("doc_id").collect()
    assert [r["__line_dedup"].n_dropped for r in out] == [1] * 5 + [0] and all(r[k] == v for r in out for k, v in names.items())
    before = {t.name for t in spark.catalog.listTables()}
    monkeypatch.setattr(line_dedup.LineRuns, "merged", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        line_dedup.rewrite(docs)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_line_runs_compact(spark, tmp_path):
    """Levels fill and merge; owners come from the first batch that holds a key, counts from all."""
    runs = line_dedup.LineRuns(spark, str(tmp_path), fanout=2, buckets=3)
    count, owner = Counter(), {}
    for n in range(5):
        batch = [((5 - n) * 10 + k, f"line {k % (n + 2)} " + "x" * 40) for k in range(6)]
        runs.add(line_dedup.document_keys(spark.createDataFrame(batch, DOC)))
        for i, t in batch:
            key = hashlib.md5(t.encode()).digest()
            count[key] += 1
            owner[key] = max(owner.get(key, 0), i)
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {bytes(r.key): (r.n_docs, r.owner) for r in runs.merged().collect()} == {k: (count[k], owner[k]) for k in count}
    known = runs.runs()[-1]
    assert known.filter("owner IS NULL").count() == 5  # the last batch brought one new line and five known ones
    runs.close()
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("line_run")]


def test_line_runs_are_not_shuffled_again(spark, tmp_path):
    """Merge joins read the buckets of old runs as they lie; only the new batch is exchanged."""
    runs = line_dedup.LineRuns(spark, str(tmp_path), fanout=9, buckets=3)
    for n in (2, 1):
        runs.add(line_dedup.document_keys(spark.createDataFrame([(n * 10 + k, f"line {k} " + "x" * 40) for k in range(6)], DOC)))
    a, b = runs.runs()
    for joined in (a.join(b.select("key").hint("merge"), "key", "left_anti"), line_dedup._merged([a, b])):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.close()


# 6 decontamination


def contaminated(data, items, window=25, share=0.8):
    out = set()
    for i, t in data:
        w = WORDS.findall(lower(t or ""))
        for k, x in items:
            b = WORDS.findall(lower(x or ""))
            n = min(window, len(b))
            if len(b) < decontamination.SPAN:
                if b and w == b:
                    out.add((i, k))
                continue
            if len(w) < n:
                continue
            for s in range(len(b) - n + 1):
                if any(sum(p == q for p, q in zip(w[at : at + n], b[s : s + n], strict=True)) >= share * n for at in range(len(w) - n + 1)):
                    out.add((i, k))
                    break
    return out


def test_decontamination(spark, empty):
    rng = random.Random(1)
    vocab = [f"v{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(9, 40)))) for k in range(6)] + [(90, None), (91, "")]
    data = []
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        part = items[i % 6][1].split()
        step = rng.choice((4, 5, 6, 9, 100))
        part = [("zz" if p % step == step - 1 else x) for p, x in enumerate(part)]
        if i % 3:
            words[len(words) // 2 : len(words) // 2] = part if i % 2 else part[: rng.randint(5, len(part))]
        data.append((i, " ".join(words).upper() if i % 5 == 0 else "\n".join(words)))
    data += [(100, None), (101, ""), (3, data[3][1])]
    d, b = clash(spark.createDataFrame(data, DOC)), clash(spark.createDataFrame(items, "item_id long, text string"))
    want = contaminated(data, items)
    got = decontamination.overlaps(d, b)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 10
    assert {(r.doc_id, r.item_id) for r in decontamination.overlaps(d, b, most_seeds=30).collect()} == want  # in blocks
    clean = decontamination.remove_contaminated(d, b)
    assert clean.columns == d.columns and sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _ in data if i not in {x for x, _ in want})
    assert decontamination.overlaps(empty, b).count() == 0 and decontamination.overlaps(d, b.limit(0)).count() == 0


def test_rows_without_id_are_judged_alone(spark):
    item = " ".join(f"item{k}" for k in range(20))
    data = [(None, "x " + item), (None, "clean text"), (7, item), (7, "other clean text"), (8, "words")]
    out = decontamination.remove_contaminated(spark.createDataFrame(data, DOC), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert rows(out) == sorted([(None, "clean text"), (7, "other clean text"), (8, "words")], key=repr)


def test_short_items_are_whole_texts(spark):
    """An item of a word or two takes no document that only holds it."""
    items = spark.createDataFrame([(1, "the"), (2, "two words"), (3, "The four word item"), (4, " "), (5, None)], "item_id long, text string")
    data = [(1, "the cat"), (2, "THE"), (3, "two  words\n"), (4, "two words more"), (5, "the four word item"), (6, ""), (None, "the")]
    got = decontamination.overlaps(spark.createDataFrame(data, DOC), items)
    assert rows(got) == sorted([(2, 1, 1, 1), (3, 2, 2, 2), (5, 3, 4, 4), (None, 1, 1, 1)], key=repr)
    assert {r.doc_id for r in decontamination.remove_contaminated(spark.createDataFrame(data, DOC), items).collect()} == {1, 4, 6}


def test_decontamination_of_repetitive_texts(spark):
    """Texts and items of one or two words over and over: as many hits as places in one times places in the other."""
    items = [(1, "na " * 300), (2, "na ba " * 150), (3, "ba na na " * 20 + "x"), (4, ("na " * 4 + "q ") * 12)]
    data = [(1, "na " * 20_000), (2, "na ba " * 700), (3, "na " * 24), (4, "na " * 25), (5, "x " + "ba na na " * 30), (6, "na " * 10 + "ba " * 10 + "na " * 10)]
    began = time.monotonic()
    got = decontamination.overlaps(spark.createDataFrame(data, DOC), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert time.monotonic() - began < 90
    small = [(i, " ".join(t.split()[:400])) for i, t in data]  # the same windows, as the texts repeat
    assert found == contaminated(small, items)


def test_shifts_between(spark):
    cases = [([3], [1]), ([1, 5, 9], [2, 4]), (list(range(50)), list(range(30))), ([7] * 1, [0, 7])]
    df = spark.createDataFrame([(n, a, p) for n, (a, p) in enumerate(cases)], "n int, at array<int>, pos array<int>").select("n", decontamination.shifts_between(F.col("at"), F.col("pos")).alias("s"))
    for r in df.collect():
        at, pos = cases[r.n]
        assert {a - p for a in at for p in pos} <= set(r.s) and len(r.s) <= max(at) - min(at) + max(pos) - min(pos) + 1


def test_decontamination_masks_are_proven():
    """Wherever a fifth of the tokens is substituted, a mask fits between; 20 and 25 follow from 10 and 15."""
    for w, k in [(5, 1), (6, 1), (9, 1), (10, 2), (15, 3), (20, 4)]:
        placed = [sum(1 << p + at for p in m) for m in decontamination.masks_for(w, 0.8) for at in range(w - m[-1])]
        assert all(any(not x & lost for x in placed) for lost in (sum(1 << p for p in c) for c in combinations(range(w), k)))


def test_decontamination_at_random_places(spark):
    """Every item length from 1 to 30 with as many substitutions as the rule allows, anywhere in its window."""
    rng, data, items = random.Random(7), [], []
    for n in range(1, 31):
        item = [f"i{n}w{p}" for p in range(n)]
        items.append((n, " ".join(item)))
        for copy in range(20):
            w = min(25, n)
            start = rng.randrange(n - w + 1)
            part, lost = item[start : start + w], set(rng.sample(range(w), w // 5))
            around = [[f"d{rng.random()}" for _ in range(rng.randint(0, 9))] for _ in range(2)]
            data.append((100 * n + copy, " ".join(around[0] + ["zz" if p in lost else x for p, x in enumerate(part)] + around[1])))
            if n < decontamination.SPAN:  # only the whole text counts
                data[-1] = (100 * n + copy, " ".join(item))
                data.append((10_000 + 100 * n + copy, " ".join([*item, "more"])))
            elif w // 5 < w - 1:  # one more substitution than allowed
                lost |= {next(p for p in range(w) if p not in lost)}
                data.append((10_000 + 100 * n + copy, " ".join("zz" if p in lost else x for p, x in enumerate(part))))
    got = decontamination.overlaps(spark.createDataFrame(data, DOC), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(i, i // 100) for i, _ in data if i < 10_000}


# 7 PII

KEY = "the key of the tests"


def test_pii(spark, odd, empty):
    known = [
        "a.b42@mail8.example.com", "+1 (383) 555-6083", "4111 1111 1111 1111", "42.144.35.254", "password=b7db7aa4a5fcc78305",
        "123-45-6789", "DE89 3704 0044 0532 0130 00", "Frau Anna Schmidt", "Mr. John Smith", "Herr Иван Петров",
    ]
    data = [(i, f"vor {e} nach, again {e}") for i, e in enumerate(known)] + [(50, "A.B42@MAIL8.example.com is the same"), (51, "no data, 12 things in 3 boxes")]
    out = {r.doc_id: r for r in pii.replace_entities(spark.createDataFrame(data, DOC), KEY).collect()}
    made = []
    for i, e in enumerate(known):
        m = re.fullmatch(r"vor (.*) nach, again (.*)", out[i].text)
        assert m and m[1] == m[2] != e and out[i].n_entities == 2
        made.append(m[1])
    assert len(set(made)) == len(known)
    assert out[50].text.split(" is ")[0] == made[0] and out[51].text == data[-1][1] and out[51].n_entities == 0
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", made[1]) and re.fullmatch(r"4\d{3} \d{4} \d{4} \d{4}", made[2])
    digits = [int(c) for c in made[2] if c.isdigit()][::-1]
    assert sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(digits)) % 10 == 0
    assert all(0 <= int(x) < 256 for x in made[3].split(".")) and re.fullmatch(r"password=[a-z0-9]{18}", made[4])
    assert made[7].startswith("Frau ") and made[7].split()[1] in pii.GIVEN["latin"]["f"] and made[8].split()[1] in pii.GIVEN["latin"]["m"]
    assert re.fullmatch(r"Herr \w+ [А-Я][а-я]+", made[9])
    got = pii.replace_entities(odd, KEY)
    assert got.count() == 9 and set(odd.columns) | {"n_entities"} == set(got.columns)
    assert rows(got.select("doc_id", "text")) == rows(odd.select("doc_id", "text")) and pii.replace_entities(empty, KEY).count() == 0


def replaced(spark, texts):
    out = pii.replace_entities(spark.createDataFrame(list(enumerate(texts)), DOC), KEY).collect()
    return [r.text for r in sorted(out, key=lambda r: r.doc_id)], [r.n_entities for r in sorted(out, key=lambda r: r.doc_id)]


def test_pii_finds_further_forms_and_leaves_lookalikes(spark):
    forms = ["+14155550123", "+442071838750", "+49 30 1234567", "06 12 34 56 78", "+33 6 12 34 56 78", "tel: 5551234567", "030 123456", "John Smith", "Dr. John Smith", "г-н Петров", "Dr. Anna Schmidt", "Анна Петрова"]
    new, n = replaced(spark, [f"a {x} b" for x in forms])
    assert n == [1] * len(forms) and all(x not in t for x, t in zip(forms, new, strict=True)) and new[4].startswith("a +33 ") and new[9].startswith("a г-н ")
    plain = ["order 5551234567 of", "4111 1111 1111 1112", "part 0595765450607129 x", "Then Smith went", "version 1.2.3", "12 34", "The Mr", "x@y", None, ""]
    new, n = replaced(spark, plain)
    assert new == plain and not any(n)


def test_pii_coreference(spark):
    (a, b, c, d, e, f, g, h), _ = replaced(spark, ["Mr Smith", "Mr. John Smith", "John Smith", "Mrs Mary Smith", "Mr. Schmidt", "ann@corp.example.com", "bob@corp.example.com", "ANN@Corp.example.com"])
    surname = a.split()[-1]
    assert surname not in ("Smith", e.split()[-1]) and [x.split()[-1] for x in (b, c, d)] == [surname] * 3
    assert b.split()[1] == c.split()[0] in pii.GIVEN["latin"]["m"] and d.split()[1] in pii.GIVEN["latin"]["f"]
    assert f.split("@")[1] == g.split("@")[1] and f.split("@")[0] != g.split("@")[0] and h.lower() == f


def test_pii_iban_check_digits(spark):
    rest = lambda x: int("".join(str(int(c, 36)) for c in (x[4:] + x[:4]))) % 97
    ibans = ["DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606", "DE88370400440532013000"]
    new, _ = replaced(spark, ibans)
    assert [rest(x) for x in ibans] == [rest(x) for x in new] == [1, 1, 1, 0] and all(x[:2] == y[:2] and x != y for x, y in zip(ibans, new, strict=True))


def test_pii_collisions_are_resolved(spark):
    """Also where one letter and one domain letter stand for far more addresses than there are."""
    data = [f"x a{i:02d}@b.cd y" for i in range(100)] + [f"to {chr(0x4E00 + i)}@{chr(0x4E00 + i // 20)}.cd" for i in range(300)] + [f"Mr {chr(65 + i % 26)}{chr(97 + i // 26)} here" for i in range(500)]
    new, n = replaced(spark, data)
    assert len(set(new)) == len(data) and not set(new) & set(data) and set(n) == {1}


def test_pii_secrets_of_symbols_and_few_values(spark):
    """Secrets without letters or digits, and more secrets of one digit than there are digits, keep apart."""
    data = ["my password: ********", "token=!!!!!!!!!!", "pwd: --------"] + [f"secret: {'#' * (8 + i % 5)}{i % 10}{'*' * (i // 50 % 8)}{'+' * (i // 400)}" for i in range(10_000)]
    new, n = replaced(spark, data)
    before, after = set(data), set(new)
    assert set(n) == {1} and len(after) == len(before) and not after & before
    assert all(re.fullmatch(r"(my password: |token=|pwd: |secret: )\S{8,}", x) for x in new)


def test_pii_full_number_spaces_get_longer_numbers(spark):
    """All numbers of four free digits are real; no surrogate is one of them."""
    data = [f"call +999 {i:04d}" for i in range(0, 10_000, 7)] + [f"+99 8 {i:05d}" for i in range(60)]
    data = data + [f"+999 123{i:02d}{j}" for i in range(100) for j in range(10)]
    new, n = replaced(spark, data)
    found = [x for x, k in zip(data, n, strict=True) if k]
    assert len({x for x, k in zip(new, n, strict=True) if k}) == len(set(found)) and not {x for x, k in zip(new, n, strict=True) if k} & set(data)


def test_pii_hyphens_and_scripts(spark):
    """Hyphenated given names go whole; surnames keep their script."""
    (a, b, c, d, e), n = replaced(spark, ["x Anna-Lena Schmidt y", "Dr. Παπαδόπουλος ήρθε", "Κύριος Νίκος Παπαδόπουλος", "to שלום@דואר.co.il", "well-Anna Schmidt"])
    assert n == [1, 1, 1, 1, 0] and e == "well-Anna Schmidt"
    assert re.fullmatch(r"x ([A-Z][a-z]+)-([A-Z][a-z]+) [A-Z][a-z]+ y", a) and not set(re.findall(r"\w+", a)) & {"Anna", "Lena", "Schmidt"}
    assert re.fullmatch(r"Dr\. [Α-Ω][α-ωά-ώ]+ ήρθε", b) and re.fullmatch(r"Κύριος [Α-Ω][α-ωά-ώ]+ [Α-Ω][α-ωά-ώ]+", c) and c.split()[2] == b.split()[1]
    assert re.fullmatch(r"to [א-ת]+@[א-ת]+\.example\.il", d)


def test_pii_surrogates_depend_on_the_key(spark):
    docs = spark.createDataFrame([(1, "write to ann@corp.example.com")], DOC)
    a, b, c = (pii.replace_entities(docs, k).first().text for k in ("one", "two", "one"))
    assert a == c != b


def test_pii_keyed_is_hmac(spark):
    import hmac

    for key in ("k", "long" * 60):
        got = spark.createDataFrame([(1, "Straße")], DOC).select(pii._keyed(F.col("text"), key)).first()[0]
        assert got == hmac.new(key.encode(), "Straße".encode(), "sha512").hexdigest()


def test_pii_is_linear_in_unbroken_text(spark):
    words = ["a" * 1_000_000, "A." * 400_000, "1 " * 300_000, "x@" + "a." * 300_000, "password " * 50_000]
    began = time.monotonic()
    new, _ = replaced(spark, words)
    assert time.monotonic() - began < 60 and new[0] == words[0] and new[4] == words[4]


def test_pii_equals_a_plain_replacement(spark, docs, texts):
    """Cut at every entity by Python's regex and joined again, each entity has one replacement, each replacement one entity."""
    import regex

    pattern = regex.compile("|".join(f"(?:{p})" for p in pii.PATTERNS.values()), regex.V0)
    luhn = lambda x: sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate([int(c) for c in x if c.isdigit()][::-1])) % 10
    card = regex.compile(pii.PATTERNS["card"])
    seen, back = {}, {}
    for r in pii.replace_entities(docs, KEY).collect():
        found = [m for m in pattern.finditer(texts[r.doc_id] or "") if not (card.fullmatch(m[0]) and luhn(m[0]))]
        assert r.n_entities == len(found)
        at = shift = 0
        for m in found:
            assert r.text[at + shift : m.start() + shift] == texts[r.doc_id][at : m.start()]
            tail = texts[r.doc_id][m.end() : m.end() + 12]
            end = r.text.index(tail, m.start() + shift + 1) if tail else len(r.text)
            new = r.text[m.start() + shift : end]
            assert seen.setdefault(m[0].lower(), new.lower()) == new.lower() and back.setdefault(new.lower(), m[0].lower()) == m[0].lower()
            at, shift = m.end(), end - m.end()
        assert r.text[at + shift :] == texts[r.doc_id][at:]
    assert len(seen) > 10 and not set(seen) & set(back)


# 8 SimHash


def fingerprint(text):
    w = WORDS.findall(lower(text or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), seed=42) for i in range(max(1, len(w) - 2))]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))


def classes(data):
    fps = {i: fingerprint(t) for i, t in data}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (f"{fps[i]:016x}", find(i)) for i in ids}


def test_simhash(spark, sf, texts, odd, empty):
    want = classes(list(texts.items()))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash(spark, sf).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(odd).collect()}
    bridge = [(None, None), (None, ""), (9, "one two"), (None, "three")]
    found = simhash.near_duplicates(spark.createDataFrame(bridge, DOC)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in found), key=repr) == [(9, 9), (None, None), (None, None), (None, None)]
    assert near[1] == near[2] == near[3] == 1 and near[5] == near[7] == near[None] == 5 and near[4] == 4
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()) == [1, 4, 5, 5, 6]
    assert kept.filter("doc_id IS NULL").count() == 1


def similar_groups(data, n_words=5, least=0.8):
    """Smallest id reachable over pairs with that share of their distinct shingles in common."""
    sets = {}
    for i, t in data:
        w = WORDS.findall(lower(t or ""))
        sets[i] = frozenset(zip(*(w[k:] for k in range(n_words)), strict=False)) if len(w) >= n_words else frozenset([tuple(w)])
    root, by, ids = {i: i for i in sets}, defaultdict(list), sorted(sets)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for b in ids:  # pairs that share a shingle, counted from an index of all
        shared = Counter(a for g in sets[b] for a in by[g])
        for a, n in shared.items():
            if n >= least * (len(sets[a]) + len(sets[b]) - n) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
        for g in sets[b]:
            by[g].append(b)
    return {i: find(i) for i in ids}


def near_copies(rng, n, vocab, edits):
    base = [rng.choice(vocab) for _ in range(200)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice(([], ["new"], [w[k], "new"]))
        yield " ".join(w)


def test_keep_one_finds_similar_texts(spark):
    """Against all pairs: nothing else goes, and at most a thirtieth of what should go stays; also where a block is hot."""
    rng = random.Random(12)
    vocab = [f"w{k}" for k in range(900)]
    data = list(enumerate(t for n in (2, 3, 5, 120) for _ in range(6 if n < 100 else 1) for t in near_copies(rng, n, vocab, 5)))
    data += [(1000 + i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(2000, None), (2001, " \n"), (2002, "One two"), (2003, "one TWO"), (2004, data[0][1])]
    groups = similar_groups(data)
    want = {i for i, g in groups.items() if i == g}
    df = clash(spark.createDataFrame(data + [(None, data[0][1]), (5, "another text of a repeated id")], DOC))
    kept = simhash.keep_one(df)
    got = {r.doc_id for r in kept.collect()}
    assert kept.columns == df.columns and want <= got - {None, 5} | {5} & want and None in got
    assert len(got - want - {None, 5}) <= (len(data) - len(want)) // 30 and len(data) - len(want) > 100
    assert {2000, 2002} <= got and not {2001, 2003, 2004} & got and 5 in got and kept.filter("doc_id = 5").count() == 2
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_wide_links_of_hot_blocks(spark, tmp_path):
    """Blocks that are cut into parts give the groups of whole ones."""
    rng = random.Random(4)
    data = list(enumerate(t for _ in range(3) for t in near_copies(rng, 40, [f"w{k}" for k in range(300)], 4)))
    nodes = simhash.wide_prints(spark.createDataFrame(data, DOC)).drop("doc_id").dropDuplicates(["node"])
    groups = []
    for size in (4096, 7):
        folder = str(tmp_path / str(size))
        found = simhash.components(simhash.wide_links(nodes, folder, 36, size), folder).collect()
        groups.append({frozenset(bytes(r.node) for r in found if r.component == c) for c in {r.component for r in found}})
    assert groups[0] == groups[1] and len(groups[0]) == 3


@pytest.mark.parametrize("max_group", [40_000, 12])
def test_links_lose_no_pair(spark, tmp_path, max_group):
    """Also where every key is oversized and dealt out again by finer masks."""
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(40)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(fps)], "fp long, rep long")
    links = simhash.fingerprint_links(df, str(tmp_path), max_group=max_group)
    got = {r.node: r.component for r in simhash.components(links, str(tmp_path / "c")).collect()}
    signed = [r.fp for r in df.collect()]
    root = list(range(len(fps)))
    for _ in fps:
        for a in range(len(fps)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    groups = lambda label: {frozenset(k for k in range(len(fps)) if label[k] == x) for x in label}
    for _ in fps:
        root = [root[r] for r in root]
    assert groups([got.get(x, x) for x in signed]) == groups(root)


# 9 wrapper induction


def article(page):
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = (re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_wrapper(spark, sf):
    pages = {r["page_id"]: r for r in pq.read_table(f"{sf}/pages.parquet").to_pylist()}
    for r in queries.op9_wrapper(spark, sf).collect():
        assert r.text == article(pages[r.page_id]["html"]) and r.n_chars == len(r.text) and r.url == pages[r.page_id]["url"]


def test_wrapper_learns_template(spark):
    page = lambda i: f"<html><body><div>Welcome to the site</div><div><h2>Title {i}</h2><p>Text {i} &amp; more\n words</p></div><div class='comments'>nice {i}</div><div>All rights kept</div></body></html>"
    data = [(i, f"https://h.example.org/{i}", page(i)) for i in range(30)] + [(90, None, None), (91, "not a url", ""), (92, "https://lone.example.org/", "<p>one<p>two<script>x()</script>"), (3, "https://h.example.org/3", page(3))]
    df = clash(spark.createDataFrame(data, "page_id long, url string, html string"))
    for limit in (32_000_000, 0):  # wrappers broadcast, and shuffled
        out = wrapper.extract(df, most_bytes=limit).collect()
        assert len(out) == len(data)
        got = {r.page_id: r.text for r in out}
        assert all(got[i] == f"Title {i}\nText {i} & more words" for i in range(30)) and got[90] == got[91] == "" and got[92] == "one\ntwo"
    assert wrapper.extract(df.limit(0)).count() == 0


def test_wrapper_needs_no_names(spark):
    """Constants, menus and misleading names are told by the host's pages alone; every class is neutral or wrong."""
    menu = lambda i: "".join(f"<div class='b{k}'><a href='/{i}/{k}'>link {i} {k}</a></div>" for k in range(4))
    frame = "Long words of a frame that every page of the host repeats. " * 40
    page = lambda i: f"<body class='has-sidebar'><div class='x1'>{menu(i)}</div><div class='x2'>{frame}</div><div class='sidebar'><h2>Head {i}</h2><p>Own words {i} of this page, which differ.</p></div><div class='x3'>Terms</div></body>"
    data = [(i, f"https://h.example.org/{i}", page(i)) for i in range(12)] + [(50, "https://h.example.org/50", None)]
    out = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert out == {i: f"Head {i}\nOwn words {i} of this page, which differ." for i in range(12)} | {50: ""}
    names_alone = wrapper.main_text(wrapper.parse(page(3)), set())
    assert "link" in names_alone and "frame" in names_alone and "Own words" not in names_alone


@pytest.mark.parametrize("n_pages", [1, 2, 3, 7, 9])
def test_names_never_take_the_article(spark, n_pages):
    """Misleading classes and ids around or on the article, on hosts of any size; real frames beside it still go."""
    body = lambda i: f"Article {i} begins. " + " ".join(f"word{i}x{k}" for k in range(60))
    shapes = {
        "a": "<div class='page has-sidebar'><div class='post'><p>{}</p></div></div>",
        "b": "<div id='search'><h1>Binary search</h1><p>{}</p></div><div class='search-box'>find things</div>",
        "c": "<div class='social-history'><p>{}</p></div><div class='ad'>buy {n} now</div>",
        "d": "<div class='content-sidebar menu'><div class='header'><p>{}</p></div></div><div class='site-footer'>imprint {n}</div>",
        "e": "<div class='text'><p>{}</p></div><div id='comments'><p>" + "reader says so {n} " * 200 + "</p></div><div class='left side-menu'>x {n}</div>",
    }
    pages = [(100 * h + i, f"http://{name}.example.org/{i}", f"<html><body><nav>go {i}</nav>{shape.replace('{n}', str(i)).format(body(i))}</body></html>") for h, (name, shape) in enumerate(shapes.items()) for i in range(n_pages)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for h, name in enumerate(shapes):
        for i in range(n_pages):
            want = body(i) if name != "b" else f"Binary search\n{body(i)}"
            # On hosts with many pages a heading that is the same everywhere is template.
            assert got[100 * h + i] in (want, body(i)) if n_pages >= 8 else got[100 * h + i] == want, (name, i)


def test_names_spare_the_only_article():
    text = lambda html: wrapper.main_text(wrapper.parse(html), set())
    assert text("<body class='search-results'><form><article class='social'><p>one</p></article></form></body>") == "one"
    assert text("<div class='content-sidebar'><main><p>one</p></main><nav>n</nav></div>") == "one"
    assert text("<article><p>one</p><div id='comments'><article class='comment'>two</article></div></article>") == "one"


def test_wrapper_takes_deep_and_wide_pages(spark):
    deep = lambda word, n=5000: "<div>" * n + f"<p>{word}</p>" + "</div>" * n
    wide = lambda word: "".join(f"<p class='c{k % 7}'>{word} {k}</p>" if k % 3 else f"<ul><li>{word} {k}<li>x</ul>" for k in range(20_000))
    data = [(1, "https://d.example.org/1", deep("one")), (2, "https://d.example.org/2", deep("two <b>x</b>", 4900)), (3, "https://w.example.org/3", wide("a")), (4, "https://w.example.org/4", "<h1>t</h1>" + wide("b"))]
    began = time.monotonic()
    out = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(data, "page_id long, url string, html string").repartition(4)).collect()}
    assert out[1] == "one" and out[2] == "two x" and out[3].count("\n") == 26_666 and out[4].startswith("t\n") and time.monotonic() - began < 60


def test_tree_matching_is_maximal():
    matcher = wrapper.Matcher()
    a, b = wrapper.parse("<ul><li>1<li><b>2</b><li>3</ul><p>x"), wrapper.parse("<p>y</p><ul><li><b>2</b><li>3</ul><p>x")
    matcher.shape(a)
    matcher.shape(b)
    assert matcher.weight(a, b) == 1 + 6 + 2 and matcher.weight(a, a) == a.size
    rng = random.Random(3)

    def grown(depth):
        node = wrapper.Node(rng.choice("xy"))
        node.kids = [grown(depth - 1) for _ in range(rng.randint(0, 3))] if depth else []
        return node

    def plain(x, y):
        if x.tag != y.tag:
            return 0
        best = [[0] * (len(y.kids) + 1) for _ in range(len(x.kids) + 1)]
        for i, p in enumerate(x.kids):
            for j, q in enumerate(y.kids):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain(p, q))
        return 1 + best[-1][-1]

    for _ in range(200):
        x, y = grown(3), grown(3)
        matcher.shape(x)
        matcher.shape(y)
        assert matcher.weight(x, y) == plain(x, y)
        if x.tag == y.tag:
            assert sum(1 for _ in matcher.pairs(x, y)) == plain(x, y)


# 10 WARC


def test_warc_round_trip(spark, tmp_path):
    body = "<p>" + "same text " * 20
    data = [(5, "https://x.example.org/a b", body), (3, None, body), (9, "u", body), (9, "u", body), (1, "v", "tiny"), (2, "w", "tiny"), (4, "n", None), (6, "e", ""), (None, "z", body), (7, "long", "é" * 700_000)]
    df = clash(spark.createDataFrame(data, "page_id long, url string, html string"))
    out = warc.round_trip(df, with_payload=True).collect()
    assert len(out) == len(data)
    by = {r.page_id: r for r in out}
    assert by[3].record_type == "response" and by[3].refers_to is None and bytes(by[3].payload) == body.encode()
    assert {by[i].refers_to for i in (5, 9, None)} == {3} and by[5].payload_digest == hashlib.sha256(body.encode()).hexdigest() and bytes(by[5].payload) == b""
    assert by[1].record_type == by[2].record_type == by[4].record_type == "response" and by[4].payload_bytes == 0 and by[7].payload_bytes == 1_400_000
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_checks():
    payload = b"hello" * 40
    record = warc.build_record(1, "https://x.example.org/", payload, hashlib.sha256(payload).hexdigest(), None)
    assert warc.parse_record(record)["payload"] == payload
    for bad in (record.replace(b"WARC/1.1", b"WRAC/1.1"), record[:-1], record.replace(b"hello", b"jello", 1), record.replace(b"WARC-Date", b"WARC-Dat", 1)):
        with pytest.raises(warc.ArchiveError):
            warc.parse_record(bad)
    import zstandard

    samples = [b"<html><p>%d some words here %d</p>" % (i, i * i) for i in range(400)]
    words = zstandard.train_dictionary(2048, samples)
    packer = zstandard.ZstdCompressor(dict_data=words, write_checksum=True)
    for frame in (words.as_bytes(), zstandard.ZstdCompressor().compress(words.as_bytes())):
        archive = warc.open_archive(frame) + packer.compress(record) * 2
        assert [r["page_id"] for r in warc.read_archive(archive)] == [1, 1]
    with pytest.raises(warc.ArchiveError):
        list(warc.read_archive(archive[:-3]))
    with pytest.raises(warc.ArchiveError):
        list(warc.read_archive(packer.compress(record)))


def test_warc_standard_records():
    """Records as other writers make them, and every way to break one."""
    import zstandard

    def record(kind, block, **more):
        head = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:00000000-0000-0000-0000-000000000001>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Length": len(block)} | {k.replace("_", "-"): v for k, v in more.items()}
        return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>x</p>"
    records = [
        record("warcinfo", b"software: y\r\n", Content_Type="application/warc-fields"), record("request", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request"),
        record("response", http, Content_Type="application/http; msgtype=response", WARC_Payload_Digest="sha1:ABC", WARC_Target_URI="https://x.example.org/"),
        record("revisit", http[:-8], Content_Type="application/http; msgtype=response", WARC_Payload_Digest="sha1:ABC"), record("resource", b"raw"),
    ]
    got = [warc.parse_record(r) for r in records]
    assert [r["record_type"] for r in got] == ["warcinfo", "request", "response", "revisit", "resource"] and all(r["page_id"] is None for r in got)
    assert [r["payload"] for r in got] == [b"software: y\r\n", b"GET / HTTP/1.1\r\n\r\n", b"<p>x</p>", b"", b"raw"] and got[2]["url"] == "https://x.example.org/"
    packer = zstandard.ZstdCompressor(write_content_size=False)  # frames that do not state their size
    other = (0x184D2A50).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"abc"
    archive = warc.open_archive(b"") + other + b"".join(packer.compress(r) for r in records)
    assert len(list(warc.read_archive(archive))) == 5
    rng = random.Random(5)
    for n in range(300):  # cut or changed anywhere, an archive reads as before or raises ArchiveError
        at = rng.randrange(len(archive))
        broken = archive[:at] if n % 2 else archive[:at] + bytes([archive[at] ^ 1 << rng.randrange(8)]) + archive[at + 1 :]
        try:
            list(warc.read_archive(broken))
        except warc.ArchiveError:
            pass
    for bad in (records[2].replace(b"Content-Length: ", b"Content-Length: x"), records[0].replace(b"WARC-Type", b"\xff\xfe"), b"", records[0].replace(b"\r\n\r\n", b"\r\n", 1)):
        with pytest.raises(warc.ArchiveError):
            warc.parse_record(bad)


def test_warc_files(spark, tmp_path):
    data = [(i, f"https://x.example.org/{i}", "<p>" + f"text {i % 3} " * 30) for i in range(9)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    archives = warc.write_archives(warc.marked(df), str(tmp_path / "table"), b"", archive_bytes=300)
    (tmp_path / "files").mkdir()
    for _ in range(2):
        warc.save_files(archives, str(tmp_path / "files"))
    out = warc.read_files(spark, str(tmp_path / "files")).collect()
    assert sorted(r.page_id for r in out) == list(range(9)) and {r.page_id for r in out if r.record_type == "response"} == {0, 1, 2}
    assert all(r.refers_to == r.page_id % 3 for r in out if r.record_type == "revisit")


@pytest.mark.parametrize("size", [4096, 7])
def test_links_between_groups_are_all_candidates(spark, tmp_path, size):
    """Where nearest links end, every pair of fingerprints in different groups that shares a block within the radius is a candidate."""
    rnd = random.Random(17)
    centre = rnd.getrandbits(256)
    prints = []
    for n in range(40):
        bits = centre
        for at in rnd.sample(range(256), rnd.randint(4, 20)):
            bits ^= 1 << at
        prints.append((n, bits))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(n.to_bytes(2, "big"), *(signed(bits >> 64 * i & (1 << 64) - 1) for i in range(4)), (n % 3).to_bytes(1, "big")) for n, bits in prints]
    blocks = [(64 * i + 13 * k, (1 << 13) - 1) for i in range(4) for k in range(4)]
    want = {
        (a, b) for a, x in prints for b, y in prints
        if a < b and a % 3 != b % 3 and (x ^ y).bit_count() <= 30 and any(x >> at & mask == y >> at & mask for at, mask in blocks)
    }
    found = simhash.wide_links(spark.createDataFrame(rows, "node binary, w0 long, w1 long, w2 long, w3 long, grp binary"), str(tmp_path), 30, size)
    pairs = {tuple(sorted(int.from_bytes(x, "big") for x in r)) for r in found.collect()}
    assert pairs == want and len(want) > 200
    near = simhash.wide_links(spark.createDataFrame(rows, "node binary, w0 long, w1 long, w2 long, w3 long, grp binary").drop("grp"), str(tmp_path / "near"), 30, size)
    assert {x for r in near.collect() for x in r} >= {x for r in found.collect() for x in r}
