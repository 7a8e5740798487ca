"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from arenalake.llm.secrets import ASSIGN_HEAD, PATTERNS, RANK, SCOPE


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _kind(kind: str, pattern: str) -> str:
    p = _text(pattern)
    ok = {"assign": f"length(regexp_replace(hit, {_text(ASSIGN_HEAD)}, '')) >= 12", "secret_part": "regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]')"}.get(kind, "true")
    return f"""SELECT doc_id, rk, {RANK[kind]} AS kind, '{kind}' AS name, s AS start, s + length(hit) AS stop FROM (
      SELECT doc_id, rk, hits[i] AS hit, CAST(list_sum(list_transform(pieces[1:i], lambda a: length(a))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda a: length(a))), 0) AS BIGINT) AS s
      FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, rk, regexp_extract_all(x, {p}) AS hits, string_split_regex(x, {p}) AS pieces FROM t WHERE regexp_matches(x, {p})))
    ) WHERE {ok}"""


def _near(weak: str, kinds: str) -> str:
    return f"EXISTS (SELECT 1 FROM spans p WHERE p.rk = {weak}.rk AND p.name IN ({kinds}) AND abs(p.start - {weak}.start) <= {SCOPE} AND (p.stop <= {weak}.start OR p.start >= {weak}.stop))"


SECRETS = f"""WITH t AS (SELECT doc_id, row_number() OVER () AS rk, coalesce(text, '') AS x FROM documents),
spans AS ({" UNION ALL ".join(_kind(k, p) for k, p in PATTERNS)}),
linked AS (SELECT * FROM spans s WHERE kind <= 2 OR (name = 'access_id' AND {_near("s", "'assign', 'secret_part'")})
  OR (name = 'secret_part' AND {_near("s", "'access', 'access_id', 'endpoint'")}) OR (name = 'endpoint' AND {_near("s", "'assign', 'secret_part'")} AND {_near("s", "'access', 'access_id'")})),
g AS (SELECT rk, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind <= 2) AS base, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans FROM linked GROUP BY rk)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (rk)"""

SUBSTRINGS = r"""WITH w AS (SELECT doc_id, row_number() OVER () AS rk, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda a: a <> '') AS ws FROM documents),
win AS (SELECT doc_id, rk, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT *, unnest(range(1, greatest(len(ws) - 48, 1))) AS i FROM w WHERE len(ws) >= 50)),
first AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT rk, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (h) WHERE m < doc_id),
word AS (SELECT rk, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT rk, string_agg(word, ' ' ORDER BY p) AS s, count(*) AS n FROM word ANTI JOIN gone USING (rk, p) GROUP BY rk)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (rk)"""

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id)::INT AS rank, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10"""
