"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_WORDS = r"[^\x20\x09-\x0D]+"

#: In Pareto order each document that fits into what is left of its source's residual is taken: one step a document.
MIX = f"""WITH RECURSIVE sizes AS (SELECT *, length(bin(size))::DOUBLE AS w FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}'))::BIGINT AS size FROM documents)),
per AS (SELECT source, sum(size)::BIGINT AS total, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM sizes GROUP BY source),
weighed AS (SELECT *, ([5, 2, 1])[(k - 1) % 3 + 1]::DOUBLE AS w, total * 3.0::DOUBLE AS cap FROM per),
levels AS (SELECT *, (sum(total) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
goals AS (SELECT source, total, least(cap, coalesce(max(CASE WHEN level <= cap / w THEN level END) OVER () * w, cap)) AS target FROM levels),
classes AS (SELECT source, w, sum(size)::BIGINT AS size FROM sizes GROUP BY source, w),
tried AS (SELECT c.source, c.w, g.target < 3.0::DOUBLE * g.total AS open, (g.target - 3.0::DOUBLE * coalesce(sum(c.size) OVER (PARTITION BY c.source ORDER BY c.w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / nullif(sum(c.size * c.w) OVER (PARTITION BY c.source ORDER BY c.w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS scale FROM classes c JOIN goals g ON g.source IS NOT DISTINCT FROM c.source),
scales AS (SELECT source, arg_max(scale, w) FILTER (WHERE open AND scale * w <= 3) AS scale FROM tried GROUP BY source),
shares AS (SELECT s.*, g.total, g.target, coalesce(least(x.scale * s.w, 3.0::DOUBLE), 3.0::DOUBLE) AS e,
  (('0x' || substr(md5(concat('7:', coalesce(s.doc_id::VARCHAR, 'null'))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sizes s JOIN goals g ON g.source IS NOT DISTINCT FROM s.source JOIN scales x ON x.source IS NOT DISTINCT FROM s.source),
odds AS (SELECT *, floor(e)::BIGINT AS certain, CASE WHEN e - floor(e) > 0 AND size > 0 THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS q FROM shares),
ordered AS MATERIALIZED (SELECT *, least(q / (1 + q), 1 - 1 / 9007199254740992.0::DOUBLE) AS ord FROM odds),
left_over AS (SELECT source, max(target) - sum(certain * size)::DOUBLE AS residual FROM ordered GROUP BY source),
ranked AS MATERIALIZED (SELECT source, doc_id, size, ord, row_number() OVER (PARTITION BY source ORDER BY ord, doc_id, size) AS k FROM ordered WHERE q IS NOT NULL),
walk AS (SELECT source, 0::BIGINT AS k, residual AS gap, false AS took FROM left_over
  UNION ALL SELECT a.source, r.k, a.gap - CASE WHEN r.size <= a.gap THEN r.size ELSE 0 END, r.size <= a.gap FROM walk a JOIN ranked r ON r.source IS NOT DISTINCT FROM a.source AND r.k = a.k + 1),
picked AS (SELECT r.doc_id, r.ord, r.size FROM ranked r JOIN walk a ON a.source IS NOT DISTINCT FROM r.source AND a.k = r.k WHERE a.took)
SELECT o.doc_id::BIGINT AS doc_id, o.size, o.total AS source_size, o.target, ((o.certain + CASE WHEN p.ord IS NOT NULL THEN 1 ELSE 0 END) * o.size)::BIGINT AS taken
FROM ordered o LEFT JOIN picked p ON p.doc_id IS NOT DISTINCT FROM o.doc_id AND p.ord = o.ord AND p.size = o.size"""


_COMPONENTS = """both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(a, b) AS (SELECT {id}, {id} FROM {rows} UNION SELECT r.a, l.v FROM reach r JOIN both_ways l ON l.u = r.b),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)"""

NEAR_DUPLICATES = f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
{_COMPONENTS.format(id="doc_id", rows="sets")}
SELECT doc_id::BIGINT AS doc_id, len(s)::BIGINT AS n_shingles, c::BIGINT AS component_id, c = doc_id AS kept FROM sets JOIN comp ON a = doc_id"""

NEAR_VECTORS = f"""WITH RECURSIVE vectors AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
usable AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM vectors WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.v) = len(b.v) AND a.norm > 0 AND b.norm > 0
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
{_COMPONENTS.format(id="vec_id", rows="vectors")}, degrees AS (SELECT u, count(*) AS n FROM both_ways GROUP BY u)
SELECT vec_id::BIGINT AS vec_id, coalesce(n, 0)::BIGINT AS n_links, c::BIGINT AS component_id, c = vec_id AS kept FROM vectors JOIN comp ON a = vec_id LEFT JOIN degrees ON u = vec_id"""

TOP_K = """WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id::BIGINT AS query_id, rank::INT AS rank, vec_id::BIGINT AS vec_id, score FROM ranked WHERE rank <= 5"""

CHAT = r"""WITH added AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM added),
labels AS (SELECT *, CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System' WHEN 'tool' THEN 'Tool' ELSE '=' || role END AS label FROM turns)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(14 + length(label) + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')))::BIGINT AS formatted_chars FROM labels GROUP BY conv_id"""

WARC = """WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages), digests AS (SELECT page_id, strlen(body)::BIGINT AS n, sha256(body) AS d FROM bodies),
firsts AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS first FROM digests)
SELECT page_id::BIGINT AS page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END::BIGINT AS refers_to FROM firsts"""


def sql() -> dict[str, str]:
    return {
        "op1_pareto_mix": MIX,
        "op2_minmax_near_duplicates": NEAR_DUPLICATES,
        "op4_embedding_near_duplicates": NEAR_VECTORS,
        "op5_exact_top_k": TOP_K,
        "op6_reply_trees": CHAT,
        "op8_warc_salvage": WARC,
    }
