"""The corpus queries in DuckDB's SQL, from their definitions, where SQL can express them."""

from __future__ import annotations

from . import license_scan

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: From link(a, b): the smallest node that each node reaches.
_REACH = """sym AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
low AS (SELECT a AS node, min(b) AS low FROM reach GROUP BY a)"""

OP1 = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), unit AS (
    SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v WHERE list_dot_product(e, e) > 0
), link AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM unit x JOIN unit y ON x.vec_id < y.vec_id AND list_dot_product(x.u, y.u) >= 0.95
), {_REACH}, n AS (SELECT a, count(*) AS n FROM sym GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN low ON node = vec_id LEFT JOIN n ON n.a = vec_id
"""

OP3 = rf"""
WITH RECURSIVE doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
    SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, s, s + 4), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS s FROM doc WHERE len(w) > 0)
), size AS (
    SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM shingle x JOIN shingle y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), link AS (
    SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * i >= 80 * (p.n + q.n - i)
), {_REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN low ON node = d.doc_id
"""

OP4 = """
WITH doc AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), win AS (
    SELECT doc_id, s, md5(substr(h, (2 * s + 1)::BIGINT, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS s FROM doc)
), again AS (
    SELECT k FROM win GROUP BY k HAVING count(*) > 1
), start AS (
    SELECT doc_id, s, s > coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -1000) + 400 AS opens FROM win JOIN again USING (k)
), span AS (
    SELECT doc_id, min(s) AS a, max(s) + 400 AS b FROM (SELECT doc_id, s, sum(opens::INTEGER) OVER (PARTITION BY doc_id ORDER BY s) AS part FROM start) GROUP BY doc_id, part
), gap AS (
    SELECT doc_id, coalesce(lag(b) OVER o, 0) AS a, a AS b, b - a AS lost, lead(a) OVER o IS NULL AS final, b AS tail FROM span WINDOW o AS (PARTITION BY doc_id ORDER BY a)
), cut AS (
    SELECT g.doc_id, string_agg(substr(h, (2 * g.a + 1)::BIGINT, (2 * (g.b - g.a))::BIGINT), '' ORDER BY g.a) AS kept, sum(lost)::BIGINT AS n_removed, count(*) AS n_spans, max(tail) AS tail FROM gap g JOIN doc USING (doc_id) GROUP BY g.doc_id
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN tail IS NULL THEN h ELSE concat(kept, substr(h, (2 * tail + 1)::BIGINT)) END)) AS kept_sha256
FROM doc LEFT JOIN cut USING (doc_id)
"""

OP10 = f"""
WITH doc AS (
    SELECT doc_id, {_WORDS} AS w FROM documents
), win AS (
    SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 49), ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM doc)
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS at_ FROM win JOIN (SELECT k, min(doc_id) AS low FROM win GROUP BY k) USING (k) WHERE low < doc_id
), word AS (
    SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS at_ FROM doc
), kept AS (
    SELECT doc_id, string_agg(x, ' ' ORDER BY at_) AS t, count(*) AS n FROM word WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = word.doc_id AND gone.at_ = word.at_) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM doc LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": OP1, "op3_ngram_join": OP3, "op4_suffix_dedup": OP4, "op6_license_scan": license_scan.ORACLE_SQL, "op10_substring_dedup": OP10}
