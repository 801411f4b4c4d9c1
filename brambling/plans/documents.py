"""Queries over documents, call logs and streams, beside those of the catalogue, which they join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brambling import streaming
from brambling.functions import text as tx
from brambling.operators import documents, merge
from brambling.plans.catalog import plan, sql
from brambling.sources import harvest, table

MESSAGE = "CASE turn % 4 WHEN 0 THEN concat('@PWA ', text) WHEN 1 THEN concat('ask @Agent_Producer: ', text) WHEN 2 THEN concat(text, ' @agent-producer') ELSE text END"


@plan(f"""
SELECT conv_id, turn, CASE WHEN m LIKE 'agent%' THEN 'agent_producer' WHEN m = '' THEN NULL ELSE m END AS agent
FROM (SELECT conv_id, turn, lower(regexp_extract({MESSAGE}, '(?i)@(pwa|researcher|agent[_-]?producer)', 1)) AS m FROM conversations)""")
def explicit_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.mention(F.expr(MESSAGE)).alias("agent"))


def _hits(words: list[str]) -> str:
    return " + ".join(f"CAST(contains(lower(text), '{w.lower()}') AS INTEGER)" for w in words)


_A, _B, _C = (_hits(w) for w in tx.INTENT_KEYWORDS.values())


@plan(f"""
SELECT doc_id, CASE WHEN n >= 2 OR (n = 1 AND length(text) > 10) THEN CASE n WHEN a THEN 'pwa' WHEN b THEN 'researcher' ELSE 'agent_producer' END END AS agent
FROM (SELECT *, greatest(a, b, c) AS n FROM (SELECT doc_id, text, {_A} AS a, {_B} AS b, {_C} AS c FROM documents))""")
def keyword_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.intent(F.col("text")).alias("agent"))


@plan("""
SELECT doc_id, CASE WHEN strpos(text, 'license') > 0 THEN replace(substr(text, strpos(text, 'license'), 100), chr(10), ' ')
  WHEN strpos(text, 'a') > 0 THEN replace(substr(text, strpos(text, 'a'), 100), chr(10), ' ') END AS excerpt FROM documents""")
def keyword_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.excerpt(F.col("text"), ["license", "a"], 100).alias("excerpt"))


@plan("""
SELECT doc_id, CASE WHEN n = 1 THEN replace(text, '. ', '; ') END AS text FROM (SELECT *, (length(text) - length(replace(text, '. ', ''))) / 2 AS n FROM documents)""")
def unique_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.replace_unique(F.col("text"), ". ", "; ").alias("text"))


VERSION = "concat(p_size, '.', p_partkey % 10, '.0', CASE p_partkey % 3 WHEN 0 THEN concat('-alpha.', p_partkey % 12) WHEN 1 THEN '-beta' ELSE '' END)"


@plan(f"""
SELECT p_brand, version FROM (SELECT p_brand, {VERSION} AS version, row_number() OVER (PARTITION BY p_brand
  ORDER BY p_size DESC, p_partkey % 10 DESC, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END DESC, p_partkey % 12 DESC) AS rn FROM part) WHERE rn = 1""")
def semver_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_brand", F.expr(VERSION).alias("version"))
    return parts.groupBy("p_brand").agg(F.max_by("version", tx.semver_key(F.col("version"))).alias("version"))


EMAIL = "CASE c_custkey % 4 WHEN 0 THEN concat(' ', c_name, '@Mail.example ') WHEN 1 THEN concat(c_name, '@mail') WHEN 2 THEN concat(c_name, '@a@b.example') ELSE concat(c_name, '@b.example') END"


@plan(f"SELECT c_custkey, CASE WHEN length(e) <= 254 AND regexp_matches(e, '^[^@]+@[^@]*\\.[^@]*$') THEN e END AS email FROM (SELECT c_custkey, lower(trim({EMAIL})) AS e FROM customer)")
def email_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", tx.normalize_email(F.expr(EMAIL)).alias("email"))


OUTPUT = "CASE event_id % 5 WHEN 0 THEN '[1, 2]' WHEN 1 THEN '3' WHEN 2 THEN 'no json' WHEN 3 THEN 'true' ELSE props END"


@plan("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'expected object, got list' WHEN 1 THEN 'expected object, got int' WHEN 2 THEN 'expected object, got non-JSON' WHEN 3 THEN 'expected object, got bool' END AS fault FROM events")
def output_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tx.output_contract(F.expr(OUTPUT), "object").alias("fault"))


@plan("""
WITH l AS (SELECT doc_id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) - 1 AS line_no
  FROM (SELECT doc_id, concat('# Top', chr(10), '```', chr(10), '# code', chr(10), '```', chr(10), '## ', text) AS md FROM documents)),
f AS (SELECT *, sum(CAST(starts_with(line, '```') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no) AS fences FROM l)
SELECT doc_id, line_no, length(regexp_extract(line, '^(#{1,6})\\s+(.+)$', 1)) AS level, regexp_extract(line, '^(#{1,6})\\s+(.+)$', 2) AS title
FROM f WHERE fences % 2 = 0 AND regexp_matches(line, '^(#{1,6})\\s+(.+)$')""")
def markdown_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = F.concat(F.lit("# Top\n```\n# code\n```\n## "), "text")
    return documents.headings(table(spark, sf_dir, "documents").select("doc_id", md.alias("text")))


@plan()
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.blocks(table(spark, sf_dir, "documents").select("doc_id", "text"))


@plan()
def edit_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", tx.replace_unique(F.col("text"), ". ", "; ").alias("new"))
    return docs.filter("new is not null").select("doc_id", documents.unified_diff("text", "new").alias("diff"))


@plan("""
WITH p AS (SELECT list_filter(string_split(regexp_replace(url, '^https?://', ''), '/'), lambda x: x <> '') AS parts FROM pages WHERE url IS NOT NULL),
d AS (SELECT parts, unnest(range(1, len(parts) + 1)) AS depth FROM p)
SELECT DISTINCT array_to_string(parts[1:depth], '/') AS path, parts[depth] AS name, CAST(depth AS INTEGER) AS depth, depth < len(parts) AS is_dir FROM d
WHERE depth < len(parts) OR regexp_matches(lower(array_to_string(parts, '/')), '(html|[0-9])$')""")
def file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "pages").filter("url is not null").select(F.regexp_replace("url", "^https?://", "").alias("path"))
    return harvest.file_tree(paths, ("html", *"0123456789"))


@plan("""
SELECT user_id, left(string_agg(event_type, ', ' ORDER BY seq), 200) AS summary FROM (SELECT user_id, event_type, min(event_id) AS seq FROM events GROUP BY user_id, event_type) GROUP BY user_id""")
def tool_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.activity(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@plan("SELECT user_id, arg_min(CAST(event_id AS VARCHAR), event_id) AS id, arg_max(event_type, event_id) AS name, string_agg(props, '' ORDER BY event_id) AS arguments FROM events GROUP BY user_id")
def assembled_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("name"), F.col("props").alias("arguments"))
    return documents.assemble_calls(events, ["user_id"], "event_id")


@plan("""
WITH c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN 'o1' END AS owner FROM customer)
SELECT c_custkey, 'personal' AS scope, concat('user/', c_custkey) AS namespace FROM c UNION ALL SELECT c_custkey, 'shared', concat('shared/', c_nationkey) FROM c
UNION ALL SELECT c_custkey, 'project', concat('project/', c_nationkey) FROM c UNION ALL SELECT c_custkey, s, concat(s, '/', owner) FROM c, (VALUES ('owner'), ('daily'), ('system')) v(s) WHERE owner IS NOT NULL""")
def memory_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 5 == 0, "o1").alias("owner"))
    return documents.namespaces(rows, "c_custkey", "c_nationkey", "owner").select("c_custkey", "scope", "namespace")


@plan("SELECT p_brand, p_partkey, place FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY lower(p_name), p_partkey) AS place FROM part) WHERE place <= 250")
def folder_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.children(table(spark, sf_dir, "part"), "p_brand", "p_name", "p_partkey").select("p_brand", "p_partkey", "place")


@plan("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey < 10 UNION ALL SELECT c_nationkey, 'new' FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey >= 10)")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "nation").filter("n_nationkey < 10").selectExpr("n_nationkey AS k", "n_name AS name")
    return merge.insert_missing(base, table(spark, sf_dir, "customer").selectExpr("c_nationkey AS k", "'new' AS name"), ["k"])


sql("job_reschedule", "orders", """
SELECT o_orderkey, o_orderdate + INTERVAL 1 DAY AS next_run_at, CASE WHEN o_orderdate <= TIMESTAMP '1996-01-01 00:00:00' THEN 'ran' ELSE 'waiting' END AS last_status, left(o_orderpriority, 2000) AS last_output
FROM {orders} WHERE o_orderstatus = 'O'""")


@plan("SELECT event_type, event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of every key, merged micro-batch by micro-batch."""
    keep = lambda rows: merge.latest_per_key(rows, ["event_type", "user_id"], F.col("event_id"))
    events = streaming.table_stream(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "value")
    return streaming.merged(events, keep, ["event_type", "user_id"])


@plan("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role IN ('user', 'assistant')) WHERE rn <= 2")
def stream_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest two messages of every conversation; what a batch brings is ranked with what is held."""
    rows = streaming.table_stream(spark, sf_dir, "conversations").filter("role in ('user', 'assistant')")
    return streaming.merged(rows, lambda held: merge.newest_n(held, ["conv_id"], "turn", 2), ["conv_id"])
