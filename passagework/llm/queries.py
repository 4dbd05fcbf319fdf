"""The registered queries opN_<name>, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    exact_topk, html_text, jaccard_join, mixing, packing, prefix_trie, quality_classifier, quality_rules, secret_scan, sharding, simhash_dedup,
    token_files,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed"
    )


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_components(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(_table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(spark, _table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search_embeddings(_table(spark, sf_dir, "embeddings"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations")).drop("position", "subtree_end")


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per rule of the default policy: the documents that fail it, and those that only it rejects."""
    return quality_rules.ablations(quality_rules.ledger(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_quality_rules, op2_simhash_dedup, op3_best_fit_packing, op4_secret_scan, op5_token_files, op6_sharding,
            op7_mixing, op8_quality_classifier, op9_html_text, op10_exact_topk, op11_prefix_trie, op12_jaccard_join, quality_ablations,
        )
    }


LEDGER_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
t AS (SELECT r, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS t FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM t WHERE t IS NOT NULL),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM c, range(3) AS x(k) WHERE n > 1 GROUP BY r),
m AS (
  SELECT d.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_upper,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         coalesce(p.n, 0) AS n_repeat_words
  FROM d LEFT JOIN p USING (r)),
f AS (
  SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines FROM m),
b AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
         + 4 * (100 * n_symbols > 50 * n_words)::BIGINT + 8 * (10 * n_dup_lines > 5 * n_lines)::BIGINT
         + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT
         + 64 * (10 * n_upper > 5 * word_chars)::BIGINT AS failed FROM f)
"""
OP1_SQL = f"""{LEDGER_SQL}SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       failed & 3 <> 0 AS base_failed, failed & 127 = 0 AS kept, failed
FROM b
"""

_BITS = ", ".join(f"('{r.name}', {1 << k})" for k, r in enumerate(quality_rules.RULES))
ABLATIONS_SQL = f"""{LEDGER_SQL}
SELECT rule, count(*) FILTER (failed & bit <> 0) AS n_failed, count(*) FILTER (failed & 127 = bit) AS n_only_this
FROM b, (VALUES {_BITS}) AS r(rule, bit) GROUP BY rule
"""


def _op4_sql() -> str:
    """Spans from the lengths of matches and of the text between them, for every rule over every text."""
    parts = []
    for place, r in enumerate(secret_scan.RULES):
        regex = r.regex.replace("'", "''")
        parts.append(
            f"SELECT r, {place} AS place, '{r.kind}' AS kind, {r.least} AS least, "
            f"unnest(regexp_extract_all(text, '{regex}', 0)) AS hit, unnest(regexp_extract_all(text, '{regex}', {r.group})) AS judged, "
            f"unnest(string_split_regex(text, '{regex}')[:-2]) AS gap, "
            f"generate_subscripts(regexp_extract_all(text, '{regex}', 0), 1) AS i FROM d"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
h AS ({" UNION ALL ".join(parts)}),
e AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY r, place ORDER BY i) AS stop FROM h),
s AS (SELECT r, place, kind, (stop - length(hit))::BIGINT AS start, stop::BIGINT AS stop FROM e WHERE length(judged) >= least),
a AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (place < 3) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""


OP10_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON c.r <> q.r AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


# The checksum of a decimal number, bit by bit over its characters.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""
OP11_SQL = f"""
WITH x AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS said
  FROM conversations WHERE conv_id IS NOT NULL),
r AS (
  SELECT x.conv_id, 0 AS part, pos, said FROM x JOIN o ON o.conv_id = x.base AND pos <= h
  UNION ALL SELECT conv_id, 1, pos, said FROM x JOIN o USING (conv_id) WHERE pos > h),
p AS (SELECT x.conv_id, coalesce(list(said ORDER BY part, pos) FILTER (said IS NOT NULL), []) AS path FROM x LEFT JOIN r USING (conv_id) GROUP BY x.conv_id),
m AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM p),
n AS MATERIALIZED (
  SELECT path[1:depth] AS k, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = depth), '')) AS ends_sha256 FROM m GROUP BY ALL),
c AS MATERIALIZED (SELECT k[1:depth - 1] AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
u AS (SELECT k, depth, n_convs, unnest(range(0, depth + 1)) AS above FROM n),
s AS (
  SELECT u.k[1:above] AS k, count(*) FILTER (c.k IS NULL) AS n_leaves,
         sum(CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(u.k[depth].t) END)::BIGINT AS saved_tokens
  FROM u LEFT JOIN c ON c.k = u.k GROUP BY ALL)
SELECT n.conv_id, n.depth, b.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN s ON s.k = n.k LEFT JOIN c ON c.k = n.k LEFT JOIN n b ON n.depth > 0 AND b.k = n.k[1:n.depth - 1]
"""
OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT r, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM d),
c AS MATERIALIZED (SELECT min(r) AS r, any_value(len(s)) AS n, list_sort(s) AS s FROM s GROUP BY list_sort(s)),
t AS MATERIALIZED (SELECT r, n, unnest(s) AS t FROM c),
e AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM t a JOIN t b ON a.t = b.t AND a.r <> b.r AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
g(a, b) AS (SELECT r, r FROM c WHERE n > 0 UNION SELECT g.a, e.b FROM g JOIN e ON g.b = e.a),
l AS MATERIALIZED (SELECT a, min(b) AS label FROM g GROUP BY a),
m AS MATERIALIZED (
  SELECT d.r, d.doc_id, len(s.s) AS n, l.label FROM d JOIN s USING (r) JOIN c ON c.s = list_sort(s.s) LEFT JOIN l ON l.a = c.r)
SELECT doc_id, n AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY label) END AS component_id FROM m
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "quality_ablations": ABLATIONS_SQL, "op4_secret_scan": _op4_sql(), "op10_exact_topk": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_jaccard_join": OP12_SQL}
