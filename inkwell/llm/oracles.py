"""DuckDB SQL of the queries that SQL can express."""

from inkwell.llm.lines import MIN_PAGES, RATIO

OP6 = rf"""
WITH pages AS (
  SELECT row_number() OVER () AS k, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents
), each AS (
  SELECT k, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM pages
), solid AS (
  SELECT * FROM each WHERE trim(regexp_replace(line, '[\t\x0b\f\r]', '', 'g')) <> ''
), totals AS (
  SELECT source, count(*) AS pages FROM documents GROUP BY source
), bad AS (
  SELECT s.source, s.line FROM (SELECT DISTINCT k, source, line FROM solid) s
  JOIN totals t ON s.source IS NOT DISTINCT FROM t.source
  GROUP BY s.source, s.line, t.pages HAVING count(*) >= {MIN_PAGES} AND count(*) > t.pages * {RATIO}::DOUBLE
), marked AS (
  SELECT e.k, e.i, e.line, s.line IS NOT NULL AS solid, b.line IS NOT NULL AS bad
  FROM each e LEFT JOIN solid s ON e.k = s.k AND e.i = s.i
  LEFT JOIN bad b ON e.source IS NOT DISTINCT FROM b.source AND e.line = b.line
), counted AS (
  SELECT k, count(*) FILTER (WHERE solid) AS n, count(*) FILTER (WHERE bad) AS n_bad,
    string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT bad) AS cut FROM marked GROUP BY k
)
SELECT p.doc_id, coalesce(c.n, 0)::BIGINT AS n_lines,
  CASE WHEN c.n_bad > 0 AND c.n_bad < c.n THEN c.n_bad ELSE 0 END::BIGINT AS n_dropped,
  CASE WHEN c.n_bad > 0 AND c.n_bad < c.n THEN c.cut ELSE p.text END AS text
FROM pages p LEFT JOIN counted c ON p.k = c.k
"""

_SOLID = r"CASE WHEN regexp_matches({0}, '[^\x20\x09-\x0D]') THEN {0} END AS {0}"

OP12 = rf"""
WITH r AS (
  SELECT coalesce(master_id, client_id) AS cluster_id, client_id, updated_at, nation_id, floor(100 * balance + 0.5)::BIGINT AS cents,
    CASE source WHEN 'store' THEN 0 WHEN 'crm' THEN 1 WHEN 'partner' THEN 2 WHEN 'web' THEN 3 ELSE 4 END AS trust,
    {", ".join(_SOLID.format(c) for c in ("name", "email", "city", "segment"))}
  FROM clients
), a AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY updated_at DESC NULLS LAST, trust, client_id) AS recent,
    updated_at IS NULL OR max(updated_at) OVER (PARTITION BY cluster_id) - updated_at > INTERVAL 240 HOURS AS stale FROM r
), b AS (
  SELECT *, first_value(segment) OVER (PARTITION BY cluster_id ORDER BY segment IS NULL, recent) AS chosen,
    row_number() OVER (PARTITION BY cluster_id ORDER BY stale, trust, recent) AS trusted FROM a
), c AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY name IS NULL, length(name) DESC, trusted) AS by_name,
    row_number() OVER (PARTITION BY cluster_id ORDER BY email IS NULL, trusted) AS by_email,
    row_number() OVER (PARTITION BY cluster_id ORDER BY segment IS NULL, recent) AS by_segment,
    row_number() OVER (PARTITION BY cluster_id ORDER BY cents IS NULL, coalesce(segment = chosen, false) DESC, recent) AS by_balance,
    row_number() OVER (PARTITION BY cluster_id ORDER BY (city IS NULL)::INT + (nation_id IS NULL)::INT, recent) AS by_address FROM b
)
SELECT cluster_id, count(*)::BIGINT AS n_records, (count(*) FILTER (WHERE stale))::BIGINT AS n_stale,
  max(CASE WHEN by_name = 1 THEN name END) AS name, max(CASE WHEN by_email = 1 THEN email END) AS email, max(chosen) AS segment,
  max(CASE WHEN by_address = 1 THEN city END) AS city, max(CASE WHEN by_address = 1 THEN nation_id END) AS nation_id,
  max(CASE WHEN by_balance = 1 THEN cents END) AS balance_cents,
  max(CASE WHEN by_name = 1 AND name IS NOT NULL THEN client_id END) AS name_from,
  max(CASE WHEN by_email = 1 AND email IS NOT NULL THEN client_id END) AS email_from,
  max(CASE WHEN by_segment = 1 AND segment IS NOT NULL THEN client_id END) AS segment_from,
  max(CASE WHEN by_balance = 1 AND cents IS NOT NULL THEN client_id END) AS balance_from,
  max(CASE WHEN by_address = 1 AND (city IS NOT NULL OR nation_id IS NOT NULL) THEN client_id END) AS address_from
FROM c GROUP BY cluster_id
"""

OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), asked AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM q GROUP BY ALL
), totals AS (
  SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0
), tf AS (
  SELECT k, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT k, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, totals GROUP BY term, n_docs
), impact AS (
  SELECT k, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS s FROM tf JOIN w USING (term), totals
), scored AS (
  SELECT item_id, doc_id, k, sum(s * times)::BIGINT AS score FROM asked JOIN impact USING (term) GROUP BY ALL HAVING sum(s * times) > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 20
"""

ORACLES = {"op6_line_dedup": OP6, "op12_golden_record": OP12, "op13_lexical_search": OP13}
