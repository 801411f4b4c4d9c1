"""All queries of the engine by name, each with the same query for a second engine where SQL can say it.

The platform's own tables have no data here, so each query runs over a table of the same shape.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brambling import functions as fn
from brambling.operators import merge, policy, retrieval
from brambling.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def plan(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def sql(name: str, tables: str, text: str, oracle: str | None = None) -> None:
    """A query whose SQL both engines take, or nearly so; tables stand in braces."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables.split()})

    run.__name__ = name
    QUERIES[name] = run
    oracle = oracle or text
    for t in tables.split():
        oracle = oracle.replace("{" + t + "}", t)
    ORACLE_SQL[name] = oracle


# Windows and paging over event logs

sql("conversation_snippets", "conversations", """
SELECT conv_id, turn, role, text, rn FROM (
  SELECT c.conv_id, c.turn, c.role, c.text, CAST(row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn DESC) AS BIGINT) AS rn
  FROM {conversations} c JOIN (SELECT DISTINCT conv_id AS active FROM {conversations}) a ON c.conv_id = a.active
  WHERE c.role IN ('user', 'assistant')) WHERE rn <= 2""")

sql("conversation_counts", "conversations", """
SELECT k.conv_id, (SELECT count(*) FROM {conversations} m WHERE m.conv_id = k.conv_id AND m.role = 'system') AS n_system
FROM (SELECT DISTINCT conv_id FROM {conversations}) k""")

sql("conversation_tail", "conversations", """
SELECT conv_id, turn, role, text FROM (SELECT * FROM {conversations} WHERE conv_id = 1 ORDER BY turn DESC LIMIT 20) WHERE role IN ('user', 'assistant') ORDER BY turn""")

sql("context_budget", "conversations", """
SELECT conv_id, turn, CAST(running AS BIGINT) AS running, running > 1000000 AS rejected FROM (
  SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM {conversations})""")

sql("sync_page", "events", "SELECT event_id, user_id, event_type, value FROM {events} WHERE event_id > 500 ORDER BY event_id LIMIT 100")

sql("sync_cursor", "events", "SELECT coalesce(max(event_id), 500) AS next_cursor, count(*) AS n FROM (SELECT event_id FROM {events} WHERE event_id > 500 ORDER BY event_id LIMIT 100)")

sql("due_jobs", "orders", "SELECT o_orderkey, o_orderdate FROM {orders} WHERE o_orderdate <= TIMESTAMP '1996-01-01 00:00:00' AND o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 20")

sql("otp_cooldown", "events", """
SELECT event_id, user_id, CAST(coalesce(gap, -1) AS BIGINT) AS gap_us, coalesce(gap < 3600000000, false) AS rejected FROM (
  SELECT event_id, user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS gap FROM (SELECT event_id, user_id, unix_micros(CAST(ts AS TIMESTAMP)) AS us FROM {events}))""", """
SELECT event_id, user_id, CAST(coalesce(gap, -1) AS BIGINT) AS gap_us, coalesce(gap < 3600000000, false) AS rejected FROM (
  SELECT event_id, user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS gap FROM (SELECT event_id, user_id, epoch_us(ts) AS us FROM events))""")


THROTTLE = """
SELECT event_id, user_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent
FROM (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'error')"""


@plan(f"SELECT event_id, user_id, recent, recent >= 5 AS blocked FROM ({THROTTLE})")
def login_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = table(spark, sf_dir, "events").filter("event_type = 'error'").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    recent = F.count("*").over(Window.partitionBy("user_id").orderBy("us").rangeBetween(-(86_400_000_000 - 1), 0))
    return failed.select("event_id", "user_id", recent.alias("recent")).withColumn("blocked", F.col("recent") >= 5)


@plan("SELECT event_type, event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "value")
    return merge.latest_per_key(events, ["event_type", "user_id"], F.col("event_id"))


sql("cross_conversation_digest", "conversations", """
WITH newest AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM {conversations} WHERE role IN ('user', 'assistant')),
top AS (SELECT conv_id FROM {conversations} WHERE conv_id <> 1 GROUP BY conv_id ORDER BY max(turn) DESC, conv_id LIMIT 3)
SELECT n.conv_id, array_join(transform(array_sort(collect_list(struct(n.turn, left(n.text, 500) AS t))), x -> x.t), ' / ') AS digest
FROM newest n JOIN top ON n.conv_id = top.conv_id WHERE n.rn <= 2 GROUP BY n.conv_id""", """
WITH newest AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role IN ('user', 'assistant')),
top AS (SELECT conv_id FROM conversations WHERE conv_id <> 1 GROUP BY conv_id ORDER BY max(turn) DESC, conv_id LIMIT 3)
SELECT n.conv_id, string_agg(left(n.text, 500), ' / ' ORDER BY n.turn) AS digest FROM newest n JOIN top ON n.conv_id = top.conv_id WHERE n.rn <= 2 GROUP BY n.conv_id""")


# Filters, joins and aggregates

TOKENS = "CAST(ceil((length(text) - length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))) / 4.0) + ceil(length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) / 2.0) AS BIGINT)"


@plan(f"SELECT doc_id, {TOKENS} AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fn.estimate_tokens(F.col("text")).alias("tokens"))


@plan(f"SELECT conv_id, CAST(2 + sum(4 + {TOKENS} + ceil(length(role) / 4.0)) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def request_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.lit(4) + fn.estimate_tokens(F.col("text")) + fn.estimate_tokens(F.col("role"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.lit(2) + F.sum(each)).cast("long").alias("tokens"))


sql("memory_search", "documents", "SELECT doc_id, source, n_chars FROM {documents} WHERE lang IN ('en', 'de') AND text ILIKE '%license%' ORDER BY n_chars DESC, doc_id LIMIT 50")

sql("memory_search_fallback", "documents", """
WITH hits AS (SELECT doc_id, source FROM {documents} WHERE text ILIKE '%no such words at all%' ORDER BY doc_id DESC LIMIT 5),
recent AS (SELECT doc_id, source FROM {documents} ORDER BY doc_id DESC LIMIT 5)
SELECT * FROM hits UNION ALL SELECT * FROM recent WHERE NOT EXISTS (SELECT 1 FROM hits)""")

sql("namespace_scope", "documents", """
SELECT doc_id, lang, source FROM {documents} WHERE startswith(source, 'src1') OR (lang = 'en' AND source IN ('src2', 'src3'))""", """
SELECT doc_id, lang, source FROM documents WHERE starts_with(source, 'src1') OR (lang = 'en' AND source IN ('src2', 'src3'))""")

sql("auth_star_join", "lineitem orders customer nation supplier", """
SELECT o.o_orderkey, l.l_linenumber, c.c_custkey, n.n_name, s.s_name
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey LEFT JOIN {supplier} s ON l.l_suppkey = s.s_suppkey AND s.s_acctbal > 0
WHERE o.o_orderstatus = 'F' AND (s.s_suppkey IS NULL OR s.s_nationkey = c.c_nationkey)""")

sql("exists_semi", "customer orders", "SELECT c_custkey, c_name FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")

sql("not_exists_anti", "customer orders", "SELECT c_custkey, c_name FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)")


@plan("SELECT c_custkey, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT') AS urgent FROM customer c")
def mark_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")).distinct()
    return table(spark, sf_dir, "customer").join(marked, F.col("c_custkey") == F.col("k"), "left").select("c_custkey", F.col("k").isNotNull().alias("urgent"))


sql("account_fanout", "orders customer nation", """
SELECT DISTINCT n.n_nationkey, o.o_orderpriority FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 200000""")

sql("count_active", "orders", "SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending FROM {orders}")

sql("collection_stats", "embeddings", "SELECT label, count(*) AS n FROM {embeddings} GROUP BY label")

sql("json_props", "events", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")

sql("code_lookup", "part", """
SELECT p_partkey, coalesce(element_at(map('SMALL', 1, 'LARGE', 2, 'ECONOMY', 3), split(p_type, ' ')[0]), 0) AS code FROM {part}""", """
SELECT p_partkey, CASE split_part(p_type, ' ', 1) WHEN 'SMALL' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'ECONOMY' THEN 3 ELSE 0 END AS code FROM part""")

sql("phase_lookup", "part", "SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'start' WHEN p_size <= 25 THEN 'middle' WHEN p_size <= 40 THEN 'late' ELSE 'done' END AS phase FROM {part}")

sql("progress_ratio", "lineitem", """
SELECT l_orderkey, l_linenumber, l_quantity, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(l_quantity) OVER (PARTITION BY l_orderkey) * 100, 6) AS progress FROM {lineitem}""")


@plan("""
SELECT event_type, round(v[least(n, CAST(floor(n * 0.5) AS BIGINT) + 1)], 3) AS p50, round(v[least(n, CAST(floor(n * 0.95) AS BIGINT) + 1)], 3) AS p95, n
FROM (SELECT event_type, list(value ORDER BY value) AS v, count(*) AS n FROM events GROUP BY event_type)""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at place floor(n * r), counted from 0, of each group in order: by rank, so that no group is held whole."""
    events = table(spark, sf_dir, "events").groupBy("event_type", "value").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("event_type").orderBy("value"))
    events = events.withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy("event_type")))
    at = lambda r: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * r), F.col("n") - 1), F.col("value")))
    return events.groupBy("event_type").agg(F.round(at(0.5), 3).alias("p50"), F.round(at(0.95), 3).alias("p95"), F.first("n").alias("n"))


@plan("""
WITH g AS (SELECT n_nationkey AS grant_id, n_nationkey % 5 AS account, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'AUTOMOBILE' END AS scope,
  CASE WHEN n_nationkey % 7 = 0 THEN 'revoked' ELSE 'active' END AS status, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 10 END AS expires_at FROM nation),
r AS (SELECT c_custkey, c_nationkey % 5 AS account, c_mktsegment AS scope FROM customer)
SELECT c_custkey, r.account, r.scope, max(grant_id) AS grant_id FROM r JOIN g ON r.account = g.account AND (g.scope = '' OR g.scope = r.scope)
WHERE status = 'active' AND (expires_at IS NULL OR expires_at > 60) GROUP BY c_custkey, r.account, r.scope""")
def grant_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    grants = table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS grant_id", "n_nationkey % 5 AS account", "CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'AUTOMOBILE' END AS scope",
        "CASE WHEN n_nationkey % 7 = 0 THEN 'revoked' ELSE 'active' END AS status", "CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 10 END AS expires_at", "n_nationkey AS created_at")
    requests = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_nationkey % 5 AS account", "c_mktsegment AS scope")
    return policy.match_grants(requests, grants, "account", "scope", F.lit(60))


KINDS = {"view": "read", "click": "read", "purchase": "gated", "signup": "write"}


@plan("""
SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'ALLOW' WHEN event_type = 'purchase' THEN 'REQUIRES_APPROVAL' WHEN event_type = 'signup' AND user_id IS NOT NULL AND user_id % 2 = 0 THEN 'ALLOW' ELSE 'DENY' END AS decision FROM events""")
def policy_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", policy.decide(F.col("event_type"), KINDS, F.col("user_id") % 2 == 0, F.col("user_id").isNotNull()).alias("decision"))


@plan("""
SELECT event_id, CASE WHEN event_type IN ('view', 'click') OR g.u IS NOT NULL THEN 'ALLOW' WHEN event_type = 'purchase' THEN 'REQUIRES_APPROVAL' WHEN event_type = 'signup' AND user_id % 2 = 0 THEN 'ALLOW' ELSE 'DENY' END AS decision
FROM events LEFT JOIN (SELECT DISTINCT c_custkey AS u FROM customer WHERE c_mktsegment = 'BUILDING') g ON user_id = g.u""")
def policy_with_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    granted = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("u")).distinct()
    events = table(spark, sf_dir, "events").join(granted, F.col("user_id") == F.col("u"), "left")
    decided = policy.decide(F.col("event_type"), KINDS, F.col("user_id") % 2 == 0, F.col("user_id").isNotNull())
    return events.select("event_id", F.when(F.col("u").isNotNull(), "ALLOW").otherwise(decided).alias("decision"))


# Merges and folds

URL_KEY = "regexp_replace(regexp_replace(lower(url), '^https?://(www\\.|m\\.)?', ''), '[?#].*$', '')"


@plan(f"""
SELECT key, arg_max(url, page_id) FILTER (WHERE url <> '') AS url, arg_max(title, page_id) FILTER (WHERE title <> '') AS title, min(page_id) AS first_seen, max(page_id) AS last_seen
FROM (SELECT page_id, url, {URL_KEY} AS key, CASE WHEN page_id % 3 = 0 THEN '' ELSE left(html, 40) END AS title FROM pages) GROUP BY key""")
def merge_nonempty_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.regexp_replace(F.regexp_replace(F.lower("url"), "^https?://(www\\.|m\\.)?", ""), "[?#].*$", "")
    rows = table(spark, sf_dir, "pages").select("page_id", "url", key.alias("key"), F.when(F.col("page_id") % 3 == 0, "").otherwise(F.left("html", F.lit(40))).alias("title"))
    return merge.merge_filled(rows, "key", F.col("page_id"), ["url", "title"], seen="page_id")


@plan(f"""
SELECT key, arg_max(url, page_id) FILTER (WHERE url <> '') AS url, arg_max(title, page_id) FILTER (WHERE title <> '') AS title, min(page_id) AS first_seen, max(page_id) AS last_seen
FROM (SELECT page_id, url, {URL_KEY} AS key, CASE WHEN page_id % 3 = 0 THEN '' ELSE html END AS title FROM pages) GROUP BY key""")
def merge_nonempty_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``merge_nonempty_upsert`` with the whole page as the value that is carried."""
    key = F.regexp_replace(F.regexp_replace(F.lower("url"), "^https?://(www\\.|m\\.)?", ""), "[?#].*$", "")
    rows = table(spark, sf_dir, "pages").select("page_id", "url", key.alias("key"), F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("html")).alias("title"))
    return merge.merge_filled(rows, "key", F.col("page_id"), ["url", "title"], seen="page_id")


@plan(f"SELECT page_id, {URL_KEY} AS key, regexp_extract({URL_KEY}, '([^/]*)$', 1) AS last FROM pages")
def clean_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.regexp_replace(F.regexp_replace(F.lower("url"), "^https?://(www\\.|m\\.)?", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", key.alias("key")).withColumn("last", fn.last_segment(F.col("key")))


@plan("SELECT source, count(*) FILTER (WHERE rn = 1) AS new_keys, count(*) AS received FROM (SELECT source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) GROUP BY source")
def new_keys_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text no earlier row has, per source; the first row of a text is found by a partial aggregate."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("key"))
    new = docs.groupBy("key").agg(F.min_by("source", "doc_id").alias("source")).groupBy("source").agg(F.count("*").alias("new_keys"))
    return docs.groupBy("source").agg(F.count("*").alias("received")).join(new, "source", "left").select("source", F.coalesce("new_keys", F.lit(0)).alias("new_keys"), "received")


@plan("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'doi:10.1/' || doc_id WHEN doc_id % 3 = 1 THEN 'arxiv:' || doc_id ELSE 'meta:' || sha256(text) END AS work_id FROM documents")
def canonical_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    doi = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("10.1/"), "doc_id"))
    arxiv = F.when(F.col("doc_id") % 3 == 1, F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", fn.canonical_id(doi, arxiv, F.lit(""), F.col("text")).alias("work_id"))


sql("checkpoint_incremental", "events", """
SELECT e.event_type, count(*) AS received, max(e.event_id) AS last_id FROM {events} e
JOIN (SELECT event_type, max(event_id) AS since FROM {events} WHERE event_id <= 500 GROUP BY event_type) c ON e.event_type = c.event_type WHERE e.event_id > c.since GROUP BY e.event_type""")

sql("retention_cleanup", "events", "SELECT event_id, CASE WHEN event_type = 'error' AND event_id < 500 THEN 'deleted' ELSE 'active' END AS status FROM {events} WHERE event_type <> 'logout'")

sql("state_transition", "orders lineitem", """
SELECT l.l_orderkey, l.l_linenumber, CASE WHEN o.k IS NOT NULL THEN 'revoked' ELSE l.l_linestatus END AS status
FROM {lineitem} l LEFT JOIN (SELECT o_orderkey AS k FROM {orders} WHERE o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1996-01-01 00:00:00') o ON l.l_orderkey = o.k""")

sql("event_derive", "events", """
SELECT event_id, user_id, concat(event_type, ':', get_json_object(props, '$.k')) AS content FROM (SELECT * FROM {events} WHERE user_id = 1 ORDER BY event_id DESC LIMIT 10) ORDER BY event_id""", """
SELECT event_id, user_id, concat(event_type, ':', json_extract_string(props, '$.k')) AS content FROM (SELECT * FROM events WHERE user_id = 1 ORDER BY event_id DESC LIMIT 10) ORDER BY event_id""")


@plan("""
WITH RECURSIVE d AS (SELECT user_id, event_id, value, event_id % 4 AS expected, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS revision, CAST(0 AS DOUBLE) AS value FROM events
  UNION ALL SELECT d.user_id, d.k, CASE WHEN d.expected = f.revision THEN f.revision + 1 ELSE f.revision END, CASE WHEN d.expected = f.revision THEN d.value ELSE f.value END FROM f JOIN d ON d.user_id = f.user_id AND d.k = f.k + 1)
SELECT user_id, arg_max(revision, k) AS revision, arg_max(value, k) AS value FROM f GROUP BY user_id""")
def revision_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    rows = events.select("user_id").distinct().withColumns({"revision": F.lit(0).cast("long"), "value": F.lit(0.0)})
    deltas = events.select("user_id", "event_id", (F.col("event_id") % 4).alias("expected"), F.lit(False).alias("deleted"), "value")
    return merge.fold_revisions(rows, deltas, "user_id", "event_id", ["value"]).select("user_id", "revision", "value")


# Vectors

D2 = "list_reduce(list_transform(list_zip(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda x, y: x + y)"
TOP = f"SELECT CAST(row_number() OVER (ORDER BY d2, vec_id) AS INTEGER) AS rank, vec_id, label, round(1 - least(d2, 1.0), 4) AS similarity FROM (SELECT e.vec_id, e.label, {D2} AS d2 FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q WHERE %s) ORDER BY d2, vec_id LIMIT 10"


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"])


@plan(TOP % "true")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_k(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10)


@plan(TOP % "e.label IN (1, 3, 5)")
def vector_topk_acl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search in the collections that a key's level may read."""
    return retrieval.top_k(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10, F.col("label").isin(1, 3, 5))


MERGED = f"""
WITH near AS (SELECT e.vec_id, e.label, {D2} AS d2 FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q WHERE e.label IN (1, 2)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d2, vec_id) AS r FROM near),
named AS (SELECT r.*, left(d.text, 80) AS print FROM ranked r JOIN documents d ON d.doc_id = r.vec_id WHERE r.r <= 5),
firsts AS (SELECT *, row_number() OVER (PARTITION BY print ORDER BY label, r) AS f FROM named)
SELECT vec_id, label, round(1 - least(d2, 1.0), 4) AS similarity FROM firsts WHERE f = 1 ORDER BY d2, label, r LIMIT 5"""


@plan(MERGED)
def vector_merge_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each collection's nearest, one of every fingerprint (the first collection wins), then the best of all."""
    q = F.array(*[F.lit(float(x)) for x in _query_vector(spark, sf_dir)])
    near = table(spark, sf_dir, "embeddings").filter("label in (1, 2)").select("vec_id", "label", fn.squared_distance(F.col("embedding").cast("array<double>"), q).alias("d2"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("d2", "vec_id"))).filter("r <= 5")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.left("text", F.lit(80)).alias("print"))
    first = Window.partitionBy("print").orderBy("label", "r")
    rows = near.join(docs, "vec_id").withColumn("f", F.row_number().over(first)).filter("f = 1").orderBy("d2", "label", "r").limit(5)
    return rows.select("vec_id", "label", fn.similarity(F.col("d2")).alias("similarity"))


# Text

@plan("SELECT doc_id, array_to_string(list_transform(string_split(left(text, 400), ' '), lambda x: x), ' ') AS text FROM documents")
def inverted_index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token positions, and the text from them again."""
    return _index_roundtrip(table(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(400)).alias("text")))


@plan("SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda x: x), ' ') AS text FROM documents")
def inverted_index_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``inverted_index_roundtrip`` over every word of every text."""
    return _index_roundtrip(table(spark, sf_dir, "documents"))


#: Bytes of text of which one task indexes the words.
INDEX_BYTES = 16 << 20


def _index_roundtrip(docs: DataFrame) -> DataFrame:
    """Whole texts are dealt by document; both groupings follow their partitions, so that no word is shuffled."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // INDEX_BYTES))
    words = docs.select("doc_id", "text").repartition(parts, "doc_id").select("doc_id", F.posexplode(F.split("text", " ")).alias("place", "token"))
    index = words.groupBy("doc_id", "token").agg(F.collect_list("place").alias("places"))
    back = index.select("doc_id", F.explode("places").alias("place"), "token").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("w"))
    return back.select("doc_id", F.array_join(F.transform("w", lambda x: x["token"]), " ").alias("text"))


sql("grep_lines", "documents", """
SELECT doc_id, line_no, left(trim(line), 120) AS line FROM (SELECT doc_id, pos + 1 AS line_no, line FROM {documents} LATERAL VIEW posexplode(split(text, '\\n')) p AS pos, line)
WHERE line RLIKE '(?i)licen[cs]e' ORDER BY doc_id, line_no LIMIT 200""", """
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, left(trim(line), 120) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
WHERE regexp_matches(line, '(?i)licen[cs]e') ORDER BY doc_id, line_no LIMIT 200""")

sql("read_window", "documents", """
SELECT doc_id, concat(lpad(CAST(pos + 1 AS STRING), 6, ' '), ' ', rtrim(line)) AS row_text FROM {documents} LATERAL VIEW posexplode(split(text, '\\n')) p AS pos, line WHERE pos + 1 BETWEEN 2 AND 4""", """
SELECT doc_id, concat(lpad(CAST(line_no AS VARCHAR), 6, ' '), ' ', rtrim(line, ' ')) AS row_text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) WHERE line_no BETWEEN 2 AND 4""")

sql("path_listing", "pages", """
SELECT page_id, url, url RLIKE '/$' AS is_dir FROM {pages} WHERE url RLIKE '^https://.*[.]com/' AND NOT (lower(url) LIKE '%.env%') ORDER BY NOT (url RLIKE '/$'), lower(url), page_id LIMIT 500""", """
SELECT page_id, url, regexp_matches(url, '/$') AS is_dir FROM pages WHERE regexp_matches(url, '^https://.*[.]com/') AND NOT (lower(url) LIKE '%.env%') ORDER BY NOT regexp_matches(url, '/$'), lower(url), page_id LIMIT 500""")

# Words that name an intent, in order of preference.
INTENTS = {"research": ["the", "that", "and"], "write": ["or", "of", "to"], "plan": ["in", "is", "for"]}
_HITS = {a: " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in ws) for a, ws in INTENTS.items()}


@plan(f"""
SELECT conv_id, turn, CASE WHEN greatest(a, b, c) >= 2 OR (greatest(a, b, c) = 1 AND length(text) > 10) THEN CASE greatest(a, b, c) WHEN a THEN 'research' WHEN b THEN 'write' ELSE 'plan' END END AS agent
FROM (SELECT *, {_HITS['research']} AS a, {_HITS['write']} AS b, {_HITS['plan']} AS c FROM conversations)""")
def intent_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lower("text")
    hits = {a: sum((text.contains(w).cast("int") for w in ws), F.lit(0)) for a, ws in INTENTS.items()}
    best = F.greatest(*hits.values())
    agent = F.coalesce(*[F.when(h == best, a) for a, h in hits.items()])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when((best >= 2) | ((best == 1) & (F.length("text") > 10)), agent).alias("agent"))


@plan(r"SELECT item_id, array_to_string(list_filter(string_split_regex(trim(replace(text, '?', '')), '\s+'), lambda w: length(w) >= 3)[1:6], ' ') AS terms FROM benchmark")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(fn.search_terms(F.col("text")), " ").alias("terms"))


@plan("SELECT p_partkey, left(trim(regexp_replace(lower(p_name), '[^a-z0-9]', '-', 'g'), '-'), 50) AS id FROM part")
def sanitize_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", fn.sanitize_id(F.col("p_name")).alias("id"))


@plan("""
WITH h AS (SELECT c_custkey, list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT)), lambda x, y: (x * 33 + y) % 4294967296) AS hash FROM customer),
s AS (SELECT c_custkey, hash, (hash % 233280 * 9301 + 49297) % 233280 AS state FROM h)
SELECT c_custkey, hash, CASE WHEN state / 233280.0 < 0.15 THEN 'great' WHEN state / 233280.0 < 0.5 THEN 'good' WHEN state / 233280.0 < 0.85 THEN 'fair' ELSE 'poor' END AS bucket FROM s""")
def djb2_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", fn.djb2(F.col("c_name")).alias("hash"))
    draw = fn.lcg(F.pmod("hash", F.lit(233280))) / 233280
    return rows.select("c_custkey", "hash", F.when(draw < 0.15, "great").when(draw < 0.5, "good").when(draw < 0.85, "fair").otherwise("poor").alias("bucket"))


sql("headings", "pages", "SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title FROM {pages} WHERE html LIKE '%<h1>%'")

sql("highlight", "documents", "SELECT doc_id, regexp_replace(text, '(?i)(license)', '<mark>$1</mark>') AS text FROM {documents} WHERE text ILIKE '%license%'", "SELECT doc_id, regexp_replace(text, '(?i)(license)', '<mark>\\1</mark>', 'g') AS text FROM documents WHERE text ILIKE '%license%'")


@plan()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.chunk(table(spark, sf_dir, "documents"))


# The published micro-benchmark's shapes, set-wise

sql("tail_10_of_each", "conversations", """
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM {conversations}) WHERE rn <= 10""")
