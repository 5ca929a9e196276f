"""The queries opN_<name> and their DuckDB SQL: thin, contract-shaped views of the operators."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm import bpe, decontamination, divergence, line_dedup, manifest, pii, quality_rules, sharding, simhash, suffixes, toxicity, warc, wrapper
from tallystone.llm.common import shared_dir, table


def default_vocabulary() -> str:
    """Path of the public vocabulary file that op2 is bound to."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.written_ledger(table(spark, sf_dir, "documents", "doc_id", "text"), f"{shared_dir(spark)}/ledger")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes("base")).alias("base_failed"), quality_rules.passes("v2").alias("kept"), "fail_bits",
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.ablations(quality_rules.written_ledger(table(spark, sf_dir, "documents", "doc_id", "text"), f"{shared_dir(spark)}/ledger"))


_LEDGER = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
pos AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win FROM pos),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM line
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(lines.dup, 0) AS n_dup_lines,
        coalesce(hit.n, 0) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines, len(regexp_extract_all(text, '[A-Z]')) AS n_upper,
        len(regexp_extract_all(text, '[A-Za-z]')) AS n_letters, len(regexp_extract_all(text, '[!?]{2,}')) AS n_marks
      FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
        + 8 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT + 16 * (2 * n_dup_lines > n_lines)::INT
        + 32 * (2 * n_upper > n_letters)::INT + 64 * (5 * n_marks > n_words)::INT AS fail_bits FROM m)
"""
OP1_SQL = _LEDGER + """
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (fail_bits & 3) != 0 AS base_failed, fail_bits = 0 AS kept, fail_bits::BIGINT AS fail_bits
FROM f
"""

#: Every policy and rule, each pattern of bits against the policy's mask with and without the rule.
ABLATION_SQL = _LEDGER + """
, p AS (SELECT * FROM (VALUES ('base', 3), ('v1', 31), ('v2', 127)) t(policy, all_mask)),
r AS (SELECT * FROM (VALUES ('few_words', 1), ('repeated_words', 2), ('many_symbols', 4), ('odd_word_length', 8), ('repeated_lines', 16), ('shouting', 32), ('exclaiming', 64)) t(rule, bit))
SELECT policy, rule, count(*) FILTER (WHERE fail_bits & all_mask <> 0) AS n_rejected, count(*) FILTER (WHERE fail_bits & (all_mask - bit) <> 0) AS n_rejected_without,
  coalesce(bit_or(fail_bits & all_mask), 0)::BIGINT AS rules_that_fired
FROM p JOIN r ON all_mask & bit <> 0 LEFT JOIN f ON true GROUP BY policy, rule
"""


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"), default_vocabulary())


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents", "doc_id", "text"), n_shards=16)


#: The checksum's table and steps are written out, since DuckDB has no CRC-32.
OP3_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY n) AS tab FROM (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS n))),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
crc AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(size - 1), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS text_crc32 FROM d, tab),
j AS (
  SELECT doc_id, doc_id::UHUGEINT AS k, 0::BIGINT AS j, -1::BIGINT AS b16, -1::BIGINT AS b17 FROM documents
  UNION ALL
  SELECT doc_id, k2, floor((j + 1) * (2147483648::DOUBLE / ((k2 // 8589934592)::DOUBLE + 1)))::BIGINT, CASE WHEN j < 16 THEN j ELSE b16 END, j
  FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616::UHUGEINT AS k2 FROM j) WHERE j < 17),
s AS (SELECT doc_id, max(b16) AS shard, max(b17) AS grown_shard FROM j GROUP BY doc_id),
r AS (SELECT *, ((doc_id % 2147483648) * 2654435761 + text_crc32) % 1024 AS bucket FROM crc JOIN s USING (doc_id))
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1 AS slot, grown_shard::INT AS grown_shard FROM r
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.rewrite(table(spark, sf_dir, "documents", "doc_id", "text"))
    found = rows.select("doc_id", "__line_dedup.*")
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


#: Rows that repeat an id are one document in the counts; rows without one count each.
OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT n, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
k AS (SELECT n, doc_id, i, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
c AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key
      HAVING count(DISTINCT doc_id) + count(DISTINCT CASE WHEN doc_id IS NULL THEN n END) >= 5),
j AS (SELECT k.*, c.key IS NOT NULL AND c.owner IS DISTINCT FROM k.doc_id AS dropped FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY n, doc_id
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the session's key in tallystone.pii.key; without one, under a new key that is kept for the session."""
    if not spark.conf.get("tallystone.pii.key", None):
        spark.conf.set("tallystone.pii.key", secrets.token_hex(32))
    return pii.replace_entities(table(spark, sf_dir, "documents", "doc_id", "text"), spark.conf.get("tallystone.pii.key"))


def op9_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100
"""


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audit(table(spark, sf_dir, "documents", *manifest.FIELDS))


#: The checksum is op3's; a level's nodes are one list, hashed in slices, and a proof's steps are folded in order.
OP11_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY n) AS tab FROM (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS n))),
e AS (SELECT doc_id, source, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS fields,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc FROM documents, tab),
l AS (SELECT doc_id, source, sha256(fields || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(fields || coalesce(strlen(text) || ':' || CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS bad FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM l),
t AS (SELECT source, 0 AS level, list(leaf ORDER BY idx) AS nodes FROM r GROUP BY source
  UNION ALL
  SELECT source, level + 1, list_transform(range((len(nodes) + 15) // 16), lambda i: sha256(array_to_string(nodes[16 * i + 1:16 * i + 16], ''))) FROM t WHERE len(nodes) > 1),
s AS (SELECT source, level AS h, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM t WHERE len(nodes) = 1),
u AS (SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM s
  UNION ALL
  SELECT level + 1, list_transform(range((len(nodes) + 15) // 16), lambda i: sha256(array_to_string(nodes[16 * i + 1:16 * i + 16], ''))) FROM u WHERE len(nodes) > 1),
step AS (
  SELECT r.source, r.idx, t.level, t.nodes, (r.idx // (16 ** t.level)::BIGINT)::BIGINT AS k FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source WHERE len(t.nodes) > 1
  UNION ALL
  SELECT r.source, r.idx, s.h + u.level, u.nodes, (s.place // (16 ** u.level)::BIGINT)::BIGINT FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source, u WHERE len(u.nodes) > 1),
side AS (SELECT source, idx, level, array_to_string(nodes[k // 16 * 16 + 1:k], '') AS a, array_to_string(nodes[k + 2:k // 16 * 16 + 16], '') AS b FROM step),
path AS (SELECT source, idx, list(a || '|' || b ORDER BY level) AS steps, sha256(string_agg(a || b, '' ORDER BY level)) AS proof FROM side GROUP BY source, idx),
f AS (SELECT r.doc_id, r.leaf, s.subroot, u.nodes[1] AS root, coalesce(proof, sha256('')) AS proof_sha256,
    list_reduce(list_prepend(r.bad, coalesce(steps, [])), lambda acc, x: sha256(split_part(x, '|', 1) || acc || split_part(x, '|', 2))) AS folded_root
  FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source JOIN u ON len(u.nodes) = 1 LEFT JOIN path ON r.source IS NOT DISTINCT FROM path.source AND r.idx = path.idx)
SELECT *, folded_root = root AS verified FROM f
"""


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_substrings(table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents", "text", "lang", "source"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT id, lang, source, term, count(*) AS n FROM (SELECT id, lang, source, unnest(terms) AS term FROM d) GROUP BY id, lang, source, term),
kept AS (SELECT lang, term, sum(n) AS n FROM t GROUP BY lang, term HAVING count(*) >= 30),
own AS (SELECT t.lang, t.source, t.term, sum(t.n) AS n FROM t JOIN kept ON t.lang = kept.lang AND t.term = kept.term GROUP BY t.lang, t.source, t.term),
g AS (SELECT DISTINCT lang, source FROM d),
size AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
total AS (SELECT lang, source, sum(n) AS n FROM own GROUP BY lang, source),
cell AS (SELECT g.lang, g.source, kept.term, coalesce(own.n, 0) AS own_n,
    1 + (1000000000::HUGEINT * (coalesce(own.n, 0) + 5)) // (coalesce(total.n, 0) + 5 * size.v) AS p,
    1 + (1000000000::HUGEINT * (kept.n + 5)) // (size.n + 5 * size.v) AS q
  FROM g JOIN kept ON g.lang = kept.lang JOIN size ON g.lang = size.lang LEFT JOIN total ON g.lang = total.lang AND g.source = total.source
  LEFT JOIN own ON g.lang = own.lang AND g.source = own.source AND kept.term = own.term),
gap AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(gap.value, 0)::BIGINT AS value
      FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN gap ON gap.lang = g.lang AND gap.source = g.source AND gap.item = h.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM cell WHERE own_n > 0 AND p > q),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= 50
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, quality_ablations, op2_bpe, op3_sharding, op4_toxicity, op5_line_dedup, op6_decontamination,
        op7_pii, op8_simhash, op9_wrapper, op10_warc, op11_manifest, op12_suffix_dedup, op13_divergence,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": OP1_SQL, "quality_ablations": ABLATION_SQL, "op3_sharding": OP3_SQL, "op5_line_dedup": OP5_SQL, "op10_warc": OP10_SQL, "op11_manifest": OP11_SQL, "op13_divergence": OP13_SQL}
