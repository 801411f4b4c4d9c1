"""SQL of the vector operators 12 and 13."""

from __future__ import annotations

_USABLE = "len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _assigned(k: int) -> str:
    return f"""
a{k} AS MATERIALIZED (
  SELECT r, p, arg_min(e, struct_pack(d := d, e := e)) AS e, min(d) AS d FROM (
    SELECT r, p, e, list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c) AS d FROM parts JOIN c{k} USING (p)) GROUP BY r, p)"""


def _means(k: int) -> str:
    return f"""
m{k} AS (
  SELECT p, e, j, floor(sum(x[j]) / count(*)) AS y FROM a{k - 1} JOIN parts USING (r, p), unnest(range(1, len(x) + 1)) AS u(j) GROUP BY p, e, j),
l{k} AS (SELECT p, e, list(y ORDER BY j) AS c FROM m{k} GROUP BY p, e),
c{k} AS MATERIALIZED (SELECT p, e, coalesce(l{k}.c, b.c) AS c FROM c{k - 1} b LEFT JOIN l{k} USING (p, e))"""


#: Whole numbers as doubles, which are exact at this size.
OP12 = (
    f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE {_USABLE}),
parts AS MATERIALIZED (SELECT r, vec_id, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM kept, range(4) AS t(p)),
c0 AS MATERIALIZED (SELECT p, e, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 256),"""
    + ",".join(_assigned(k) + "," + _means(k + 1) for k in range(4))
    + ","
    + _assigned(4)
    + """,
book AS (SELECT sha256(string_agg(CAST(CAST(c[j] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) AS h FROM c4, unnest(range(1, len(c) + 1)) AS u(j)),
coded AS (
  SELECT r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (r), book
"""
)

OP13 = f"""
WITH kept AS MATERIALIZED (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_USABLE}),
scores AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM kept a JOIN kept b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
pairs AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score FROM positives JOIN scores USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS INTEGER) AS rank,
  negative_id, positive_score, negative_score
FROM pairs QUALIFY rank <= 5
"""
