"""The operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bitplane import op2_bit_planes
from .hardneg import op13_hard_negatives
from .htmlmain import op7_html
from .linededup import op10_line_dedup
from .lloyd import op12_product_codes
from .media import op5_media
from .neardup import op6_near_duplicates
from .packing import op9_packing
from .quality import op3_quality
from .sentencepiece_trie import op8_sentencepiece
from .sharding import op4_sharding
from .toxicity import op11_toxicity
from .vector_sql import OP12, OP13
from .vptree import op1_vp_trees

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vp_trees": op1_vp_trees,
    "op2_bit_planes": op2_bit_planes,
    "op3_quality": op3_quality,
    "op4_sharding": op4_sharding,
    "op5_media": op5_media,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_html": op7_html,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_packing": op9_packing,
    "op10_line_dedup": op10_line_dedup,
    "op11_toxicity": op11_toxicity,
    "op12_product_codes": op12_product_codes,
    "op13_hard_negatives": op13_hard_negatives,
}

OP1 = """
WITH usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda x, y: x + y)) AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""

#: The checksum's table by its rule; a draw from 48 bits of md5; regions of four shards, racks of two.
OP4 = """
WITH crc AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(b))),
bytes AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents),
sums AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) AS text_crc32 FROM bytes, crc),
leaves AS (
  SELECT *, list_transform(range(9), lambda s: -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || s), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)) AS d FROM sums),
regions AS (
  SELECT *, list_position(list_transform(range(2), lambda r: list_min(d[4 * r + 1:4 * r + 4])), list_min(d[1:8])) - 1 AS r8,
    list_position(list_transform(range(3), lambda r: list_min(d[4 * r + 1:least(4 * r + 4, 9)])), list_min(d)) - 1 AS r9 FROM leaves),
racks AS (
  SELECT *, 2 * r8 + CASE WHEN list_min(d[4 * r8 + 1:4 * r8 + 2]) <= list_min(d[4 * r8 + 3:4 * r8 + 4]) THEN 0 ELSE 1 END AS k8,
    2 * r9 + CASE WHEN r9 = 2 OR list_min(d[4 * r9 + 1:4 * r9 + 2]) <= list_min(d[4 * r9 + 3:4 * r9 + 4]) THEN 0 ELSE 1 END AS k9 FROM regions),
placed AS (
  SELECT doc_id, size, text_crc32, 2 * k8 + CASE WHEN d[2 * k8 + 1] <= d[2 * k8 + 2] THEN 0 ELSE 1 END AS shard,
    2 * k9 + CASE WHEN k9 = 4 OR d[2 * k9 + 1] <= d[2 * k9 + 2] THEN 0 ELSE 1 END AS grown_shard FROM racks)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM placed
"""

OP6 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
sets AS (
  SELECT doc_id, list_distinct(list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS s FROM words WHERE len(w) > 0),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS both_
  FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE both_ >= 0.8 * (na + nb - both_)),
either AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN either e ON r.b = e.a)
SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a
"""

OP10 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS s0, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
clean AS (SELECT doc_id, line, trim(regexp_replace(s0, '\s+', ' ', 'g')) AS s FROM lines),
counted AS (SELECT *, least(length(s) - length(replace(s, ' ', '')) + 1, 50) AS w FROM clean WHERE s <> ''),
placed AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY line) AS hi, sum(w) OVER (PARTITION BY doc_id ORDER BY line) - w AS lo FROM counted),
windows AS (
  SELECT doc_id, min(line) OVER f AS low, max(line) OVER f AS high, sum(w) OVER f AS words, list(s) OVER f AS content FROM placed
  WINDOW f AS (PARTITION BY doc_id ORDER BY lo RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION
  SELECT doc_id, min(line) OVER f, max(line) OVER f, sum(w) OVER f, list(s) OVER f FROM placed
  WINDOW f AS (PARTITION BY doc_id ORDER BY hi RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
full_ AS (SELECT * FROM windows WHERE words >= 50),
firsts AS (SELECT content, min(struct_pack(d := doc_id, l := low, h := high)) AS f FROM full_ GROUP BY content HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(low, high + 1)) AS line FROM full_ JOIN firsts USING (content) WHERE doc_id <> f.d OR low > f.h)
SELECT lines.doc_id, coalesce(string_agg(s0, chr(10) ORDER BY lines.line) FILTER (WHERE gone.line IS NULL), '') AS text,
  CAST(count(*) AS INTEGER) AS n_lines, CAST(count(gone.line) AS INTEGER) AS n_removed
FROM lines LEFT JOIN gone ON gone.doc_id = lines.doc_id AND gone.line = lines.line GROUP BY lines.doc_id
"""

ORACLE_SQL = {"op1_vp_trees": OP1, "op4_sharding": OP4, "op6_near_duplicates": OP6, "op10_line_dedup": OP10, "op12_product_codes": OP12, "op13_hard_negatives": OP13}
