"""The thin contract queries: one opN_<name> for each operator, over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from emberlog.llm import chat, decontam, exactsub, licenses, mixing, neardup, pii, quality, secrets, tokenfile


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents")).drop("rejected_by")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op3_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op5_rare_seed_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(table(spark, sf_dir, "conversations"))


def op8_prefix_doubling_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactsub.deduplicate(table(spark, sf_dir, "documents")).drop("kept")


def op10_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer file lies; a folder can be named in EMBERLOG_TOKENIZERS."""
    folder = os.environ.get("EMBERLOG_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classify(table(spark, sf_dir, "documents"))


def op7_pfor_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_index(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {f.__name__: f for f in (op1_hyperminhash_dedup, op2_license_scan, op3_entropy_mix, op4_crf_pii, op5_rare_seed_alignment, op6_snapshot_collapse, op7_pfor_tokens, op8_prefix_doubling_dedup, op9_quality_cascade, op10_randomness_secrets)}

#: Words of a text, as all queries here take them.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE = {
    "op6_snapshot_collapse": """
WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS seq,
             string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
                        ORDER BY turn NULLS FIRST, role, text) AS chat FROM d GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, count(*) AS n_same, n, seq, min(chat) AS chat FROM c GROUP BY n, seq)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, CAST(n_same AS BIGINT) AS n_same, chat FROM u
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.seq[1] = u.seq[1] AND c.n > u.n AND c.seq[1:u.n] = u.seq)""",
    "op3_entropy_mix": rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS s, count(*) AS n, CAST(sum(size) AS BIGINT) AS source_size,
             [1, 2, 3][CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM d GROUP BY source),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0))::DOUBLE
                / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
      FROM s WINDOW b AS (ORDER BY 3 * source_size / w::DOUBLE, w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min_by(level, 3 * source_size / w::DOUBLE) AS level FROM l WHERE 3 * source_size >= level * w),
t AS (SELECT s, source, n, source_size, least((3 * source_size)::DOUBLE, f.level * w) AS target FROM s, f),
c AS (SELECT t.s, length(bin(greatest(size, 1))) - 1 AS class, sum(size)::DOUBLE AS mass
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source GROUP BY ALL),
o AS (SELECT sum(mass) AS tokens, sum(mass * class) / sum(mass) AS middle FROM c),
x AS (SELECT c.s, c.class, c.mass, class - middle AS x, target, target >= 3 * source_size AS bound, target > 0 AS wanted, tokens
      FROM c JOIN t USING (s), o),
k AS (SELECT coalesce(sum(3 * mass * x) FILTER (bound), 0) AS fixed, any_value(1.0::DOUBLE * tokens) AS soft FROM x),
nw AS (
  SELECT 0 AS i, s, ln(target / source_size) AS own, 0.0::DOUBLE AS shared FROM t WHERE target > 0 AND target < 3 * source_size
  UNION ALL
  SELECT i + 1, s, own + greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (g - dd * move) / b)), shared + move
  FROM (SELECT *, greatest(-0.25::DOUBLE, least(0.25::DOUBLE,
                    (-(sum(p) OVER () + fixed) - soft * shared - sum(dd * g / b) OVER ())
                    / greatest(sum(e) OVER () + soft - sum(dd * dd / b) OVER (), soft))) AS move
        FROM (SELECT i, s, own, shared, fixed, soft, target - sum(mass * least(3.0::DOUBLE, exp(own + shared * x))) AS g,
                     greatest(coalesce(sum(mass * exp(own + shared * x)) FILTER (exp(own + shared * x) < 3), 0), target * 1e-6::DOUBLE) AS b,
                     coalesce(sum(mass * exp(own + shared * x) * x) FILTER (exp(own + shared * x) < 3), 0) AS dd,
                     coalesce(sum(mass * exp(own + shared * x) * x * x) FILTER (exp(own + shared * x) < 3), 0) AS e,
                     sum(mass * least(3.0::DOUBLE, exp(own + shared * x)) * x) AS p
              FROM nw JOIN x USING (s), k WHERE i < 40 GROUP BY i, s, own, shared, fixed, soft, target))),
a AS (SELECT x.s, x.class, CAST(round(1e6::DOUBLE * CASE WHEN bound AND wanted THEN 3.0::DOUBLE
               WHEN own IS NOT NULL THEN least(3.0::DOUBLE, exp(own + shared * x)) ELSE 0.0::DOUBLE END) AS BIGINT) AS rate
      FROM x LEFT JOIN (SELECT * FROM nw WHERE i = 40) AS z USING (s)),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.s, a.rate, md5(coalesce(CAST(d.doc_id AS VARCHAR), '')) AS digest, t.n
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN a ON a.s = t.s AND a.class = length(bin(greatest(d.size, 1))) - 1),
p AS (SELECT *, sum(rate) OVER (PARTITION BY s, CAST('0x' || substr(digest, 1, 6) AS BIGINT) % CAST(ceil(n / 4096.0) AS BIGINT)
                                ORDER BY size, digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS passed FROM r)
SELECT doc_id, size, source_size, target,
       CAST(size * ((passed + 500000) // 1000000 - (passed - rate + 500000) // 1000000) AS BIGINT) AS taken FROM p""",
    "op9_quality_cascade": rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS ws,
                  string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
g AS (SELECT r, i, array_to_string(ws[i:i+4], ' ') AS s
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM g) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range(0, 5) AS o(k) GROUP BY r),
m AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
               - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
             coalesce(cov.n, 0) AS n_repeat_words
      FROM w LEFT JOIN cov USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT 4 * n_symbols > n_words AND NOT 20 * n_dup_lines > n_words
         AND NOT word_chars < 2 * n_words AND NOT word_chars > 30 * n_words AS kept
FROM f""",
}
