"""Queries of the training-data operators, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import attention_lm, chat_tree, decontaminate, licenses, pivotal_mix, quality, shard, simhash_pivot, token_table, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_tree.chat_rows(_table(spark, sf_dir, "conversations"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rows(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.lm_rows(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_rows(_table(spark, sf_dir, "documents"))


def op6_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotal_mix.mix_rows(_table(spark, sf_dir, "documents"))


def op7_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_rows(_table(spark, sf_dir, "documents"))


def op8_simhash_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pivot.simhash_rows(_table(spark, sf_dir, "documents"))


def op9_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table.token_rows(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_rows(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_chat_tree, op2_quality_rules, op3_decontaminate, op4_attention_lm, op5_license_scan, op6_pivotal_mix, op7_byte_shards, op8_simhash_pivot, op9_token_table, op10_toxicity)
    return {f.__name__: f for f in own}


CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\]+', '', 'g')) + len(regexp_extract_all(text, '</?s>|\[/?INST\]|<\|')) AS body,
         length(role) + length(regexp_replace(role, '[^\\\]]+', '', 'g')) AS head
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       sum(4 + head + 2 + body + 5)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""

LEAK_SQL = r"""
WITH iw AS (SELECT item_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
i AS (SELECT item_id, text, least(5, len(w)) AS n, unnest(list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda k: array_to_string(w[k:k + least(5, len(w)) - 1], ' ')))) AS s FROM iw WHERE len(w) > 0),
sizes AS (SELECT item_id, text, any_value(n) AS n, count(*) AS n_shingles FROM i GROUP BY item_id, text),
dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+') AS w FROM documents WHERE text IS NOT NULL),
lens AS (SELECT DISTINCT n FROM sizes),
d AS (SELECT r, doc_id, n, unnest(list_distinct(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' ')))) AS s FROM dw, lens WHERE len(w) >= n),
hit AS (SELECT r, doc_id, item_id, text, count(*) AS n_shared FROM d JOIN i USING (n, s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment
FROM hit JOIN sizes USING (item_id, text) WHERE n_shared >= 0.8 * n_shingles
"""


SHARD_SQL = r"""
WITH t AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce([n] || list_transform(range(8), lambda z: 0::BIGINT), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
d AS (SELECT doc_id, size, xor(list_reduce([4294967295] || bytes, lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, t),
s AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total FROM d),
p AS (SELECT *, least(23, (before * 2 + size) * 24 // (2 * total))::INT AS shard FROM s)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY before) - 1 AS slot, NULL::INT AS grown_shard FROM p
"""


def _simhash_sql(seed: int = 42, words: int = 3, radius: int = 3) -> str:
    """XXH64 of all shingles, step by step in 128-bit integers cut to 64 bits, then majorities of bits, links and components."""
    # The primes of XXH64.
    p1, p2, p3, p4, p5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
    cut, big = f"{2**64 - 1}::UHUGEINT", lambda x: f"{x % 2**64}::UHUGEINT"
    rot = lambda x, r: f"(((({x}) << {r}) & {cut}) | (({x}) >> {64 - r}))"
    mul = lambda x, p: f"((({x}) * {big(p)}) & {cut})"
    four = "(tail[1] | (tail[2] << 8) | (tail[3] << 16) | (tail[4] << 24))"
    spans = " || ' ' || ".join(f"w[k + {j}]" if j else "w[k]" for j in range(words))
    return f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= {words} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {words - 2}), lambda k: {spans}) END) AS s FROM w),
u AS MATERIALIZED (SELECT s, octet_length(encode(s)) AS n, list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda x: ('0x' || x)::UHUGEINT) AS b FROM (SELECT DISTINCT s FROM s)),
l AS (SELECT *, list_transform(range(n // 8), lambda k: list_reduce([0::UHUGEINT] || list_reverse(b[8 * k + 1:8 * k + 8]), lambda a, x: (a << 8) | x)) AS lane FROM u),
m AS (SELECT *, list_transform(lane, lambda x: {mul("x", p2)}) AS m, 4 * (n // 32) AS striped FROM l),
v AS (SELECT *, list_transform([{big(seed + p1 + p2)}, {big(seed + p2)}, {big(seed)}, {big(seed - p1)}], lambda start, j: list_reduce([start] || list_transform(range(striped // 4), lambda k: m[4 * k + j]), lambda a, x: {mul(rot(f"((a + x) & {cut})", 31), p1)})) AS v FROM m),
t AS (SELECT *, ({rot("v[1]", 1)} + {rot("v[2]", 7)} + {rot("v[3]", 12)} + {rot("v[4]", 18)}) & {cut} AS h0, list_transform(list_transform(v, lambda x: {mul("x", p2)}), lambda x: {mul(rot("x", 31), p1)}) AS merged,
  list_transform(m[striped + 1:], lambda x: {mul(rot("x", 31), p1)}) AS k, b[8 * (n // 8) + 1:] AS tail FROM v),
a AS (SELECT s, tail, list_reduce([((CASE WHEN n >= 32 THEN list_reduce([h0] || merged, lambda h, x: ({mul("xor(h, x)", p1)} + {big(p4)}) & {cut}) ELSE {big(seed + p5)} END) + n::UHUGEINT) & {cut}] || k, lambda h, x: ({mul(rot("xor(h, x)", 27), p1)} + {big(p4)}) & {cut}) AS h FROM t),
f AS (SELECT s, CASE WHEN len(tail) >= 4 THEN tail[5:] ELSE tail END AS tail, CASE WHEN len(tail) >= 4 THEN ({mul(rot(f"xor(h, {mul(four, p1)})", 23), p2)} + {big(p3)}) & {cut} ELSE h END AS h FROM a),
g AS (SELECT s, list_reduce([h] || list_transform(tail, lambda x: {mul("x", p5)}), lambda c, x: {mul(rot("xor(c, x)", 11), p1)}) AS h FROM f),
g1 AS (SELECT s, {mul("xor(h, h >> 33)", p2)} AS h FROM g), g2 AS (SELECT s, {mul("xor(h, h >> 29)", p3)} AS h FROM g1),
x AS MATERIALIZED (SELECT s, xor(h, h >> 32)::UBIGINT AS h FROM g2),
c AS (SELECT r, count(*) AS n, {", ".join(f"sum((h >> {i}) & 1) AS b{i}" for i in range(64))} FROM s JOIN x USING (s) GROUP BY r),
p AS MATERIALIZED (SELECT doc_id, coalesce({" | ".join(f"(CASE WHEN 2 * b{i} > n THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END)" for i in range(64))}, 0::UBIGINT) AS fp FROM w LEFT JOIN c USING (r)),
d AS MATERIALIZED (SELECT fp, min(doc_id) AS least FROM p GROUP BY fp),
e AS MATERIALIZED (SELECT a.fp AS a, b.fp AS b FROM d a JOIN d b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)::BIT) <= {radius}),
reach AS (SELECT fp, least FROM d UNION SELECT e.b, reach.least FROM reach JOIN e ON e.a = reach.fp JOIN d ON d.fp = e.b WHERE reach.least < d.least),
o AS (SELECT fp, min(least) AS component_id FROM reach GROUP BY fp)
SELECT doc_id, lpad(lower(to_hex(fp)), 16, '0') AS fingerprint, component_id FROM p JOIN o USING (fp)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_tree": CHAT_SQL, "op2_quality_rules": quality.ORACLE_SQL, "op3_decontaminate": LEAK_SQL, "op5_license_scan": licenses.oracle_sql(), "op7_byte_shards": SHARD_SQL, "op8_simhash_pivot": _simhash_sql()}
