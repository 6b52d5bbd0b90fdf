"""SQL counterparts of the queries that SQL can express, for DuckDB over the same tables.

The others are compared with brute force in ``tests/llm``: the randomness tests
(1), HTML trees (3), a fitted classifier (4), an approximate index (7) and
token ids (10, 12) are outside SQL.
"""

from __future__ import annotations

from rosterlens.llm.quality import STOP_WORDS
from rosterlens.llm.sharding import SHARD_BYTES

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_SYMBOLS = "(length({0}) - length(regexp_replace({0}, '[#*$%&|<>]', '', 'g')))"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT doc_id, text, {_WORDS.format('text')} AS words,
         [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split)),
often AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM often WHERE n >= 2) GROUP BY doc_id),
counted AS (
  SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST({_SYMBOLS.format('text')} AS BIGINT) AS n_symbols, len(lines) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len([w FOR w IN words IF lower(w) IN ({_STOP})]) AS n_stop,
         len([x FOR x IN lines IF regexp_matches(x, '^ *[-*•]')]) AS n_bullets,
         len([x FOR x IN lines IF regexp_matches(x, '(\.\.\.|…)$')]) AS n_ellipsis
  FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words BETWEEN 50 AND 1000000
       AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 15
       AND n_symbols / greatest(n_words, 1) <= 0.25 AND n_stop / greatest(n_words, 1) >= 0.02
       AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND n_bullets / greatest(n_lines, 1) <= 0.9
       AND n_ellipsis / greatest(n_lines, 1) <= 0.3 AND n_repeat_words / greatest(n_words, 1) <= 0.5 AS kept
FROM judged
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split WHERE len(words) >= 3)
    UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM split WHERE len(words) BETWEEN 1 AND 2)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT p.a, p.b FROM pairs p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b
  WHERE 100 * p.k >= 85 * (x.n + y.n - p.k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, e.b FROM reached r JOIN edges e ON r.other = e.a),
named AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN named c ON c.doc_id = d.doc_id
"""


def shards_sql(limit: int = SHARD_BYTES) -> str:
    """Smallest depth at which the rows that share a row's first bits fit the limit, for keys without repeats."""
    return f"""
    WITH h AS (
      SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes,
             CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS code FROM documents),
    levels AS (SELECT doc_id, bytes, code, unnest(range(0, 31)) AS depth FROM h),
    placed AS (
      SELECT doc_id, bytes, depth, code >> (60 - depth) AS prefix,
             sum(bytes) OVER (PARTITION BY depth, code >> (60 - depth)) AS shard_bytes,
             count(*) OVER (PARTITION BY depth, code >> (60 - depth)) AS shard_rows FROM levels)
    SELECT doc_id, bytes, CAST(depth AS INTEGER) AS depth, CAST(prefix AS BIGINT) AS prefix, CAST(shard_bytes AS BIGINT) AS shard_bytes,
           CAST(shard_rows AS BIGINT) AS shard_rows
    FROM placed WHERE shard_bytes <= {limit} OR shard_rows = 1
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
    """


_ESCAPED = "replace(replace(replace({}, chr(92), chr(92) || chr(92)), '#', chr(92) || 'h'), '<', chr(92) || 'l')"
CHAT = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'),
joined AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS spoken,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS trained,
         sum(14 + length(replace({_ESCAPED.format('role')}, ':', chr(92) || 'c')) + length({_ESCAPED.format('text')})) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(spoken) AS turns_sha256,
       CAST(length(trained) AS BIGINT) AS loss_chars, sha256(trained) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM joined
"""

MIXING = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len({_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size,
         {_SYMBOLS.format("coalesce(text, '')")} AS symbols,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS digest FROM documents),
keyed AS (
  SELECT doc_id, source, size,
         -ln((CAST(CAST('0x' || substr(digest, 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)
         / greatest(0.05, CASE WHEN size > 0 THEN size / (size + 4 * symbols) ELSE 0.0 END) AS key FROM sized),
sources AS (
  SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source),
shared AS (
  SELECT *, 3 * source_size AS cap,
         CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
           ORDER BY 3 * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / sum(weight) OVER (ORDER BY 3 * source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit
  FROM sources),
fixed AS (
  SELECT arg_min(unit, cap / weight) AS unit FROM (
    SELECT *, row_number() OVER (ORDER BY cap / weight, place) AS n FROM shared WHERE cap / weight >= unit) WHERE n = 1),
targets AS (SELECT s.source, s.source_size, least(CAST(s.cap AS DOUBLE), f.unit * s.weight) AS target FROM shared s, fixed f),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(round(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets),
ordered AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, CAST(round(p.target) AS BIGINT) - p.epochs * p.source_size AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           AS earlier
  FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(epochs * size + greatest(0, least(rest - earlier, size)) AS BIGINT) AS taken
FROM ordered
"""

_FINITE = "embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)"


def clusters_sql(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """Lloyd's rounds written out: every vector against every centroid, in integers."""
    def assigned(turn: int) -> str:
        gap = f"list_sum([CAST((v.q[i] - c.q[i]) * (v.q[i] - c.q[i]) AS BIGINT) FOR i IN range(1, {dim + 1})])"
        return f"""a{turn} AS MATERIALIZED (
          SELECT row_id, vec_id, q, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
            SELECT v.row_id, v.vec_id, v.q, c.cluster, CAST({gap} AS BIGINT) AS d FROM v, c{turn} c)
          GROUP BY row_id, vec_id, q)"""

    def moved(turn: int) -> str:
        return f"""s{turn} AS MATERIALIZED (
          SELECT cluster, i, CAST(sum(q[i]) AS BIGINT) AS s, count(*) AS n
          FROM (SELECT cluster, q, unnest(range(1, {dim + 1})) AS i FROM a{turn}) GROUP BY cluster, i),
        c{turn + 1} AS MATERIALIZED (
          SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{turn} c LEFT JOIN (
            SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM s{turn} GROUP BY cluster) m ON m.cluster = c.cluster)"""

    steps = ",\n".join(f"{assigned(t)},\n{moved(t)}" for t in range(rounds))
    return f"""
    WITH v AS MATERIALIZED (
      SELECT row_number() OVER () AS row_id, vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
      FROM embeddings WHERE {_FINITE} AND len(embedding) = {dim}),
    c0 AS MATERIALIZED (
      SELECT CAST(row_number() OVER (ORDER BY h, q) - 1 AS INTEGER) AS cluster, q FROM (
        SELECT q, sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h FROM v ORDER BY h, q LIMIT {k})),
    {steps},
    {assigned(rounds)}
    SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
           CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster
    """


NEGATIVES = f"""
WITH v AS MATERIALIZED (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_FINITE}),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_sum([a.q[i] * b.q[i] FOR i IN range(1, len(a.q) + 1)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 10
"""

ORACLE: dict[str, str] = {
    "op2_quality_rules": QUALITY,
    "op5_minhash_dedup": NEAR_DUPLICATES,
    "op6_extendible_sharding": shards_sql(),
    "op8_chat_format": CHAT,
    "op9_source_mixing": MIXING,
    "op11_shallot_clustering": clusters_sql(),
    "op13_hard_negatives": NEGATIVES,
}
