"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from specforge.llm.secrets import BASE, RULES

WARC = """WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND least <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND least <> page_id THEN least END AS refers_to FROM f"""


def secrets() -> str:
    """Places from the pieces between matches, as long as the pieces and matches before them."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    total = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0)"
    parts = []
    for k, r in enumerate(RULES):
        p = quoted(r.pattern)
        parts.append(
            f"""SELECT doc_id, {k} AS rule, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'a': {total('o[1:i]')} + {total('m[1:i-1]')}, 'n': length(m[i]), 'c': length(g[i])}}), lambda s: s.c >= {r.least})) AS s
  FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {r.group}) AS g, regexp_split_to_array(t, {p}) AS o FROM d WHERE regexp_matches(t, {p}))"""
        )
    kinds = "[" + ", ".join(quoted(r.kind) for r in RULES) + "]"
    count = ", ".join(f"count(*) FILTER (rule = {k}) AS n_{r.kind}" for k, r in enumerate(BASE))
    line = f"{kinds}[rule + 1] || ':' || CAST(s.a AS BIGINT) || ':' || CAST(s.a + s.n AS BIGINT)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), x AS ({' UNION ALL '.join(parts)}),
g AS (SELECT doc_id, {count}, coalesce(string_agg({line}, ',' ORDER BY s.a, rule) FILTER (rule < {len(BASE)}), '') AS base, string_agg({line}, ',' ORDER BY s.a, rule) AS spans FROM x GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""


SECRETS = secrets()
