"""Queries over approvals, event logs, collections, harvest state and small predicates; they join the catalogue's.

The platform's own tables have no data here, so each query makes its rows from a table of the same shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brambling import streaming
from brambling.functions import checks, estimate_tokens, squared_distance, similarity
from brambling.operators import approvals, collections, journal
from brambling.plans.catalog import TOKENS, plan
from brambling.sources import state, table

# Small predicates and values

PATH = "concat('/data', CASE WHEN event_id % 4 = 0 THEN '2' ELSE '' END, '/', event_type, CASE event_id % 5 WHEN 0 THEN '/.env.local' WHEN 1 THEN '/key.pem' WHEN 2 THEN '/.git/config' ELSE '/notes.md' END)"


@plan(f"""
SELECT event_id, path, path = '/data' OR starts_with(path, '/data/') AS within,
  regexp_matches(path, '/(\\.git)(/|$)') OR regexp_matches(path, '/\\.env\\.[^/]*$') OR ends_with(path, '.pem') AS sensitive,
  regexp_matches(path, '/\\.[^/]') AS hidden, regexp_matches(regexp_extract(path, '[^/]*$'), '^n.tes\\..*$') AS globbed
FROM (SELECT event_id, {PATH} AS path FROM events)""")
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(PATH).alias("path"))
    path = F.col("path")
    return rows.select("event_id", "path", checks.is_within(path, F.lit("/data")).alias("within"), checks.is_sensitive(path).alias("sensitive"), checks.is_hidden(path).alias("hidden"), checks.matches_glob(F.element_at(F.split(path, "/"), -1), "n?tes.*").alias("globbed"))


@plan("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT'")
def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.filter(checks.optional(F.col("o_orderstatus"), None) & checks.optional(F.col("o_orderpriority"), "1-URGENT")).select("o_orderkey", "o_orderstatus")


@plan("SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_type)), 'widget')")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(checks.named_like("WIDGET", F.col("p_name"), F.col("p_type"))).select("p_partkey", "p_name")


COMMAND = "CASE event_id % 6 WHEN 0 THEN concat('rm -', CASE WHEN user_id % 2 = 0 THEN 'rf' ELSE 'v' END, ' x') WHEN 1 THEN 'git Push origin' WHEN 2 THEN 'git status' WHEN 3 THEN 'chmod 777 f' WHEN 4 THEN 'echo reformat' ELSE 'SUDO reboot' END"


@plan(f"SELECT event_id, command, regexp_matches(command, '\\brm\\s+-[a-z]*[rf]|\\bgit\\s+(push|commit)\\b|\\b(shutdown|reboot|format)\\b|\\b(chmod|chown)\\s+-?[a-z]*\\s*[47]?[0-7]{{3}}', 'i') AS dangerous FROM (SELECT event_id, {COMMAND} AS command FROM events)")
def dangerous_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(COMMAND).alias("command")).withColumn("dangerous", checks.is_dangerous(F.col("command")))


ESCAPED = "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@plan(f"SELECT page_id, length({ESCAPED}) AS n, md5({ESCAPED}) AS digest FROM pages")
def escaped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = checks.escape_html(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(html).cast("long").alias("n"), F.md5(html).alias("digest"))


@plan(f"""
SELECT conv_id, CAST(greatest(least(4096, 2048, 8192 - used), 0) AS BIGINT) AS budget
FROM (SELECT conv_id, CAST(2 + sum(4 + {TOKENS} + ceil(length(role) / 4.0)) AS BIGINT) AS used FROM conversations GROUP BY conv_id)""")
def output_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.lit(2) + F.sum(F.lit(4) + estimate_tokens(F.col("text")) + estimate_tokens(F.col("role")))).cast("long").alias("used"))
    return used.select("conv_id", checks.output_budget(F.lit(4096), F.lit(2048), F.lit(8192), F.col("used")).cast("long").alias("budget"))


@plan("""
SELECT event_id, event_id % 4 <> 3 AND event_type IN ('view', 'click') AS may_read, event_type IN ('view', 'click', 'purchase') AND event_id % 3 <> 0 AS valid,
  CAST(floor(value + 0.5) AS BIGINT) AS rounded, strftime(CAST(ts AS DATE) - INTERVAL 30 DAY, '%Y-%m-%d') AS since, strftime(ts, '%Y-%m-%d') AS day FROM events""")
def permissions_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    listed = F.when(F.col("event_id") % 4 == 3, F.lit("not json")).otherwise(F.concat(F.lit('["'), "event_type", F.lit('"]')))
    given = F.when(F.col("event_id") % 3 == 0, F.array("event_type", "event_type")).otherwise(F.array("event_type"))
    day = F.col("ts").cast("date")
    may = checks.json_has(listed, "view") | checks.json_has(listed, "click")
    return rows.select("event_id", may.alias("may_read"), checks.valid_permissions(given, ["view", "click", "purchase"]).alias("valid"), checks.round_half_up(F.col("value")).cast("long").alias("rounded"), checks.days_before(day, 30).alias("since"), checks.day_text(F.col("ts")).alias("day"))


# Approvals

CALLS = "SELECT event_id AS request_id, user_id AS account, user_id % 50 AS conversation, event_type AS tool, props, CASE event_type WHEN 'purchase' THEN 'REQUIRES_APPROVAL' WHEN 'error' THEN 'DENY' WHEN 'signup' THEN 'REQUIRES_APPROVAL' ELSE 'ALLOW' END AS decision"
PRINT = "sha256('{\"args\": ' || props || ', \"tool\": \"' || tool || '\"}')"


@plan(f"SELECT request_id, {PRINT} AS fingerprint FROM ({CALLS} FROM events)")
def call_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = F.map_from_arrays(F.array(F.lit("k")), F.array(F.get_json_object("props", "$.k")))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), approvals.fingerprint(F.col("event_type"), args).alias("fingerprint"))


@plan(f"""
WITH calls AS (SELECT *, {PRINT} AS fingerprint, request_id % 2 AS space, request_id % 3 AS principal FROM ({CALLS} FROM events)),
live AS (SELECT account, space, principal, tool, fingerprint, request_id AS approval_id, CASE request_id % 4 WHEN 0 THEN 'approved' ELSE 'pending' END AS status, request_id % 1000 AS requested_at
  FROM calls WHERE request_id % 5 <> 0 AND request_id + 4000 > 5000 AND request_id % 4 <> 3),
best AS (SELECT account, space, principal, tool, fingerprint, approval_id, status FROM live
  QUALIFY row_number() OVER (PARTITION BY account, space, principal, tool, fingerprint ORDER BY requested_at DESC, approval_id DESC) = 1),
joined AS (SELECT c.request_id, c.decision, c.request_id % 7 = 0 AS granted, c.conversation % 10 = 0 AS never, b.status, b.approval_id
  FROM calls c LEFT JOIN best b USING (account, space, principal, tool, fingerprint)),
named AS (SELECT *, CASE WHEN decision = 'ALLOW' THEN 'policy' WHEN granted THEN 'grant_allowed' WHEN decision = 'DENY' THEN 'denied' WHEN coalesce(never, false) THEN 'approval_policy_never'
  WHEN status = 'approved' THEN 'approval_granted' WHEN status IS NOT NULL THEN 'approval_pending' ELSE 'approval_due' END AS reason FROM joined)
SELECT request_id, CASE WHEN reason IN ('policy', 'grant_allowed', 'approval_granted') THEN 'ALLOW' WHEN reason = 'denied' THEN 'DENY' ELSE 'REQUIRES_APPROVAL' END AS outcome, reason,
  CASE WHEN reason IN ('approval_granted', 'approval_pending') THEN approval_id ELSE -1 END AS approval_id FROM named""")
def approval_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy, grant, the conversation's own policy, and the newest approval of the call's scope that isn't denied."""
    calls = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("account"), (F.col("event_id") % 2).alias("space"), (F.col("event_id") % 3).alias("principal"), F.col("event_type").alias("tool"), (F.col("user_id") % 50).alias("conversation"),
        F.when(F.col("event_type").isin("purchase", "signup"), "REQUIRES_APPROVAL").when(F.col("event_type") == "error", "DENY").otherwise("ALLOW").alias("decision"),
        approvals.fingerprint(F.col("event_type"), F.map_from_arrays(F.array(F.lit("k")), F.array(F.get_json_object("props", "$.k")))).alias("fingerprint"))
    status = F.element_at(F.array(F.lit("approved"), F.lit("pending"), F.lit("pending"), F.lit("denied")), (F.col("request_id") % 4).cast("int") + 1)
    asked = calls.filter("request_id % 5 <> 0").select(*approvals.SCOPE, F.col("request_id").alias("approval_id"), status.alias("status"), (F.col("request_id") % 1000).alias("requested_at"), (F.col("request_id") + 4000).alias("expires_at"))
    policies = calls.select("conversation").distinct().select("conversation", F.when(F.col("conversation") % 10 == 0, "never").otherwise("ask").alias("approval_policy"))
    done = approvals.resolve(calls, calls.filter("request_id % 7 = 0").select("request_id"), asked, policies, F.lit(5000))
    return done.select("request_id", "outcome", "reason", F.coalesce("approval_id", F.lit(-1).cast("long")).alias("approval_id"))


@plan("""
SELECT event_id, CASE WHEN value > 90 THEN 'too_large' WHEN user_id % 11 = 0 THEN 'blocked_user' WHEN NULLIF(event_id % 13, 0) IS NULL THEN 'guard_internal_error' END AS reason FROM events""")
def guard_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    guards = approvals.Guards()
    guards.add("too_large", F.col("value") > 90)
    gone = guards.add("all", F.lit(True))
    guards.add("blocked_user", F.col("user_id") % 11 == 0)
    guards.add("odd", F.nullif(F.col("event_id") % 13, F.lit(0)) < 0)
    gone()
    return table(spark, sf_dir, "events").select("event_id", guards.reason().alias("reason"))


@plan("""
SELECT event_id, tool, CASE WHEN tool IN ('read_file', 'list_dir') THEN 'file.read' WHEN tool = 'run_command' THEN 'command' END AS capability
FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'read_file' WHEN 'click' THEN 'list_dir' WHEN 'purchase' THEN 'run_command' ELSE 'other' END AS tool,
  CASE event_type WHEN 'error' THEN 'DENY' WHEN 'purchase' THEN 'REQUIRES_APPROVAL' ELSE 'ALLOW' END AS decision FROM events) WHERE decision <> 'DENY'""")
def visible_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    tool = F.when(kind == "view", "read_file").when(kind == "click", "list_dir").when(kind == "purchase", "run_command").otherwise("other")
    decision = F.when(kind == "error", "DENY").when(kind == "purchase", "REQUIRES_APPROVAL").otherwise("ALLOW")
    rows = table(spark, sf_dir, "events").select("event_id", tool.alias("tool"), decision.alias("decision"))
    return approvals.visible(rows, F.col("decision")).select("event_id", "tool", approvals.capability_of(F.col("tool")).alias("capability"))


@plan("""
WITH rows AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'denied' END AS status, o_orderkey % 100 AS expires_at FROM orders),
firsts AS (SELECT l_orderkey AS id, arg_min(l_linenumber % 2, l_linenumber) AS d, min(l_linenumber) AS n FROM lineitem WHERE l_linenumber > 1 GROUP BY l_orderkey)
SELECT rows.id, CASE WHEN status <> 'pending' OR n IS NULL THEN status WHEN expires_at <= n * 20 THEN 'expired' WHEN d = 0 THEN 'approved' ELSE 'denied' END AS status,
  CAST(coalesce(CASE WHEN status = 'pending' THEN n * 20 END, -1) AS BIGINT) AS decided_at FROM rows LEFT JOIN firsts ON rows.id = firsts.id""")
def guarded_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "approved").otherwise("denied")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), (F.col("o_orderkey") % 100).alias("expires_at"))
    made = table(spark, sf_dir, "lineitem").filter("l_linenumber > 1")
    made = made.select(F.col("l_orderkey").alias("id"), F.when(F.col("l_linenumber") % 2 == 0, "approved").otherwise("denied").alias("decision"), F.lit("owner").alias("decided_by"), (F.col("l_linenumber") * 20).cast("long").alias("decided_at"))
    return approvals.decide(rows, made, "id", F.lit(0)).select("id", "status", F.coalesce(F.col("decided_at").cast("long"), F.lit(-1).cast("long")).alias("decided_at"))


@plan("""
SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN 'owner' WHEN c_mktsegment <> 'BUILDING' THEN 'assistant' WHEN n > 0 THEN 'owner' ELSE 'assistant' END AS route
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' GROUP BY o_custkey) ON c_custkey = o_custkey""")
def principal_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    people = table(spark, sf_dir, "customer").select("c_custkey", key.alias("account_id"), F.when(key % 17 == 0, "c").alias("credential"), F.lit("p").alias("principal_id"), F.lit("t").alias("token_id"), F.when(F.col("c_mktsegment") == "BUILDING", "approved").alias("device_status"))
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account_id"), F.when(F.col("o_orderstatus") == "F", "active").otherwise("ended").alias("link_status"), F.when(F.col("o_orderpriority") == "1-URGENT", "active").otherwise("ended").alias("owner_status"))
    return approvals.route(people, links).select("c_custkey", "route")


# Event logs


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = journal.payload(F.concat_ws("-", "conv_id", "turn"), F.col("role"), F.col("text"), F.create_map(F.lit("source"), F.concat(F.lit("c"), (F.col("conv_id") % 3).cast("string"))))
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"), F.col("conv_id").alias("conversation_id"), F.concat("role", F.lit("/message")).alias("event_type"), body.alias("payload_json"), F.col("turn").cast("double").alias("created_at"))


@plan("""
SELECT conv_id AS conversation_id, event_id, conv_id || '-' || turn AS id, role, text AS content, 'c' || conv_id % 3 AS source FROM (
  SELECT *, conv_id * 1000 + turn AS event_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role IN ('user', 'assistant')) WHERE rn <= 10""")
def derived_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages from event payloads, with a metadata field beside them."""
    return journal.messages(_log(spark, sf_dir), ["source"], 10).drop("timestamp")


@plan("SELECT conv_id AS conversation_id, role || '/message' AS event_type, conv_id || '-' || turn AS message_id, text AS content, 'old' AS source FROM conversations WHERE turn % 2 = 1")
def legacy_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy messages that no event holds yet; those that are migrated twice would be missing from the result."""
    log, rows = _log(spark, sf_dir).filter("created_at % 2 = 0"), table(spark, sf_dir, "conversations")
    legacy = rows.select(F.concat_ws("-", "conv_id", "turn").alias("message_id"), F.col("conv_id").alias("conversation_id"), "role", F.col("text").alias("content"), F.lit('{"source": "old"}').alias("metadata_json"), F.col("turn").cast("double").alias("created_at"))
    new = journal.migrated(log, legacy)
    again = journal.migrated(log.unionByName(new, allowMissingColumns=True), legacy)
    p = F.from_json("payload_json", journal.PAYLOAD)
    return new.unionByName(again).select("conversation_id", "event_type", p["message_id"].alias("message_id"), p["content"].alias("content"), p["metadata"]["source"].alias("source"))


@plan("SELECT conv_id AS conversation_id, count(*) AS n_session, count(*) AS n_sync, max(conv_id * 1000 + turn) AS last FROM conversations GROUP BY conv_id")
def two_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to both logs, one part of them twice, as after a failure."""
    log, home = _log(spark, sf_dir), streaming.scratch(spark, "logs")
    for part in (log.filter("event_id % 2 = 0"), log.filter("event_id % 2 = 1"), log.filter("event_id % 2 = 1")):
        journal.append_both(part, f"{home}/session", f"{home}/sync")
    session = journal.once(spark.read.parquet(f"{home}/session")).groupBy("conversation_id").agg(F.count("*").alias("n_session"), F.max("event_id").alias("last"))
    sync = journal.once(spark.read.parquet(f"{home}/sync")).groupBy(F.col("aggregate_id").alias("conversation_id")).agg(F.count("*").alias("n_sync"))
    return session.join(sync, "conversation_id").select("conversation_id", "n_session", "n_sync", "last")


@plan("""
SELECT o_orderkey AS id, CASE WHEN hit THEN 'deleted' ELSE status END AS status, CAST(CASE WHEN hit THEN rev + 1 ELSE rev END AS BIGINT) AS revision,
  CASE WHEN hit THEN 'deleted' WHEN status = 'active' AND asked THEN 'conflict' WHEN asked THEN 'gone' END AS outcome
FROM (SELECT *, asked AND status = 'active' AND o_orderkey % 3 = rev AS hit FROM (
  SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'deleted' ELSE 'active' END AS status, o_orderkey % 4 AS rev, o_orderkey % 2 = 0 AS asked FROM orders))""")
def soft_delete_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "deleted").otherwise("active").alias("status"), (F.col("o_orderkey") % 4).alias("revision"), F.lit(None).cast("double").alias("deleted_at"))
    asked = orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).alias("expected"))
    return journal.soft_delete(rows, asked, "id", F.lit(1.0)).select("id", "status", "revision", "outcome")


@plan("""
SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_orderpriority LIKE '%LOW') AS affected FROM orders GROUP BY o_orderstatus""")
def retention_by_tag_and_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_orderdate", F.when(F.col("o_orderstatus") == "O", "active").otherwise("deleted").alias("status"), F.lit(1).alias("revision"), F.lit(None).cast("double").alias("deleted_at"))
    done = journal.retention(rows, F.col("o_orderpriority").endswith("LOW") & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")), F.lit(1.0))
    return done.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_if("affected").alias("affected"))


@plan("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'shared/' || source ELSE 'space/other' END AS namespace FROM documents")
def namespace_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("space/"), "source")).otherwise("space/other")
    return table(spark, sf_dir, "documents").select("doc_id", journal.renamed_namespace(space, F.col("source")).alias("namespace"))


@plan("SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type <> '' GROUP BY user_id, event_type HAVING count(*) > 1")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.duplicates(table(spark, sf_dir, "events"), "user_id", "event_type")


@plan(f"""
WITH kept AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations)
SELECT conv_id, string_agg('File: ' || role || chr(10) || 'Path: ' || role || chr(10) || 'Content:' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text,
  CAST(sum({TOKENS}) AS BIGINT) AS tokens, sum({TOKENS}) > 400 AS rejected FROM kept WHERE n = 1 GROUP BY conv_id""")
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("path"), F.col("role").alias("name"), F.col("text").alias("content"), F.col("turn").alias("place"))
    return journal.context_blocks(rows, ["conv_id"], estimate_tokens(F.col("content")), 400)


@plan("SELECT source AS path, max(lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.bak') AS backup, arg_max(n_chars, doc_id) AS content FROM documents GROUP BY source")
def newest_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".bak")).alias("backup"), F.col("n_chars").alias("content"))
    return journal.restored(rows)


@plan("""
(SELECT 'pending' AS list, o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50)
UNION ALL (SELECT 'recent', o_orderkey FROM orders WHERE o_orderstatus <> 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20)""")
def review_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"), F.col("o_orderdate").alias("requested_at"))
    return journal.two_lists(rows).select("list", "id")


# Collections

D2 = "list_reduce(list_transform(list_zip(e.embedding, q.embedding), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2])), lambda x, y: x + y)"


def _near(rows: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """rank, collection, vec_id, similarity of the k nearest rows to the vector of id 0, of every collection."""
    q = vectors.filter("vec_id = 0").select(F.col("embedding").cast("array<double>").alias("q"))  # one row
    d2 = squared_distance(F.col("embedding").cast("array<double>"), F.col("q"))
    rank = F.row_number().over(Window.partitionBy("collection").orderBy("d2", "vec_id"))
    near = rows.join(F.broadcast(q)).select("collection", "vec_id", d2.alias("d2")).withColumn("rank", rank).filter(F.col("rank") <= k)
    return near.select("collection", "rank", "vec_id", similarity(F.col("d2")).alias("similarity"))


@plan(f"""
WITH named AS (SELECT vec_id, embedding, CASE label % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'novel' ELSE 'data' END AS collection FROM embeddings),
access AS (SELECT * FROM (VALUES ('admin', 'public'), ('admin', 'novel'), ('admin', 'data'), ('research', 'public'), ('research', 'data'), ('langbot', 'public'), ('langbot', 'novel'), ('public', 'public')) t(level, collection)),
near AS (SELECT collection, e.vec_id, {D2} AS d2 FROM named e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
top AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY d2, vec_id) AS rank FROM near)
SELECT level, collection, CAST(rank AS INTEGER) AS rank, vec_id, round(1 - least(d2, 1.0), 4) AS similarity FROM access JOIN top USING (collection)
WHERE rank <= 5 AND level IN ('admin', 'research', 'langbot')""")
def search_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search in what each key's level may read, by the table of access; levels below the required one see nothing."""
    vectors = table(spark, sf_dir, "embeddings")
    name = F.element_at(F.array(F.lit("public"), F.lit("novel"), F.lit("data")), (F.col("label") % 3).cast("int") + 1)
    near = _near(vectors.withColumn("collection", name), vectors, 5)
    levels = spark.createDataFrame([(x,) for x in collections.LEVELS], "level string").filter(collections.reaches(F.col("level"), "langbot"))
    return collections.allowed_rows(levels, near, collections.access_table(spark)).select("level", "collection", "rank", "vec_id", "similarity")


@plan(f"""
WITH rows AS (
  SELECT 'public' AS collection, vec_id, embedding FROM embeddings WHERE label = 1 AND vec_id % 2 = 0
  UNION ALL SELECT 'data', vec_id, embedding FROM embeddings WHERE label = 2
  UNION ALL SELECT 'private/u1', vec_id, embedding FROM embeddings WHERE label = 3),
near AS (SELECT collection, vec_id, {D2} AS d2 FROM rows e, (SELECT embedding AS embedding FROM embeddings WHERE vec_id = 0) q),
top AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY d2, vec_id) AS rank FROM near)
SELECT collection, CAST(rank AS INTEGER) AS rank, vec_id, round(1 - least(d2, 1.0), 4) AS similarity FROM top WHERE rank <= 5""")
def collection_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds, a rebuild that swaps, one without rows that keeps a shared collection, and one that removes a user's."""
    vectors = table(spark, sf_dir, "embeddings")
    store = collections.Store(spark, streaming.scratch(spark, "store"))
    label = lambda k: vectors.filter(F.col("label") == k).select("vec_id", "embedding")
    store.rebuild("public", label(1))
    store.rebuild("public", label(1).filter("vec_id % 2 = 0"))
    store.rebuild("data", label(2))
    store.rebuild("data", label(2).limit(0))
    store.rebuild("private", label(3), "u1")
    store.rebuild("private", label(4), "u2")
    store.rebuild("private", label(4).limit(0), "u2")
    found = [(store.read("public"), "public"), (store.read("data"), "data"), (store.read("private", "u1"), "private/u1"), (store.read("private", "u2"), "private/u2"), (store.read("private", "u3"), "private/u3")]
    rows = [d.withColumn("collection", F.lit(name)) for d, name in found if d is not None]
    all_ = rows[0]
    for more in rows[1:]:
        all_ = all_.unionByName(more)
    return _near(all_, vectors, 5)


@plan("""
SELECT conv_id, string_agg('--- ' || turn || ' (' || (turn * 7 % 101) || '%) ---' || chr(10) || role || chr(10) || text || chr(10), chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""")
def rendered_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("rank"), ((F.col("turn") * 7 % 101) / 100).alias("similarity"), F.col("role").alias("source"), F.col("text").alias("content"))
    return collections.rendered(rows, ["conv_id"])


@plan("""
WITH msg AS (SELECT conv_id * 1000 + turn AS id, CASE turn % 3 WHEN 0 THEN '/cmd ' || text WHEN 1 THEN ' ' || text || ' ' ELSE text END AS text FROM conversations),
res AS (SELECT conv_id * 1000 + turn AS id, '[50%] ' || role || chr(10) || left(text, 300) AS t FROM conversations WHERE conv_id % 2 = 0)
SELECT id, CASE WHEN t IS NULL OR trim(text) = '' OR starts_with(trim(text), '/') THEN text ELSE trim(text) || chr(10) || chr(10) || 'Found documents:' || chr(10) || t END AS text,
  NOT (t IS NULL OR trim(text) = '' OR starts_with(trim(text), '/')) AS enhanced FROM msg LEFT JOIN res USING (id)""")
def injected_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, id_ = table(spark, sf_dir, "conversations"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id")
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("/cmd "), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit(" "), "text", F.lit(" "))).otherwise(F.col("text"))
    found = rows.filter("conv_id % 2 = 0").select(id_, F.lit(1).alias("rank"), F.lit(0.5).alias("similarity"), F.col("role").alias("source"), F.col("text").alias("content"))
    return collections.with_context(rows.select(id_, text.alias("text")), found, "id")


# Harvest state

WORKS = "SELECT doc_id, source, source || '-' || doc_id % 200 AS source_id, 'w' || doc_id % 100 AS work_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 't' || doc_id END AS title, CASE WHEN doc_id % 4 = 0 THEN n_chars END AS cites, doc_id % 5 = 0 AS bare FROM documents"


@plan(f"""
WITH rows AS ({WORKS})
SELECT work_id, arg_max(title, doc_id) FILTER (WHERE title <> '') AS title, arg_max('a' || doc_id, doc_id) FILTER (WHERE NOT bare) AS first_author,
  coalesce(arg_max(cites, doc_id) FILTER (WHERE cites IS NOT NULL), -1) AS citation_count, CASE WHEN max(doc_id) % 2 = 0 THEN 'open' ELSE 'unknown' END AS oa_status, min(doc_id) AS first_seen, max(doc_id) AS last_seen FROM rows GROUP BY work_id""")
def works_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works merged from all their records: empty text and empty author lists never win, the status always does."""
    done = state.merge_works(_records(spark, sf_dir), F.col("doc_id"))
    return done.select("work_id", "title", F.get("authors", F.lit(0)).alias("first_author"), F.coalesce("citation_count", F.lit(-1).cast("long")).alias("citation_count"), "oa_status", F.col("first_seen_at").alias("first_seen"), F.col("last_seen_at").alias("last_seen"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.concat_ws("-", "source", (d % 200).cast("string")).alias("source_id"), F.concat(F.lit("w"), (d % 100).cast("string")).alias("work_id"),
        F.when(d % 3 == 0, "").otherwise(F.concat(F.lit("t"), d.cast("string"))).alias("title"), F.when(d % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("a"), d.cast("string")))).alias("authors"),
        F.when(d % 4 == 0, F.col("n_chars")).alias("citation_count"), F.when(d % 2 == 0, "open").otherwise("unknown").alias("oa_status"), d.alias("harvested_at"))


@plan(f"SELECT source, source_id, arg_max(work_id, doc_id) AS work_id, max(doc_id) AS harvested_at FROM ({WORKS}) GROUP BY source, source_id")
def source_records_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.merge_source_records(_records(spark, sf_dir)).select("source", "source_id", "work_id", "harvested_at")


@plan("""
WITH runs AS (SELECT event_id, 's' || user_id % 7 AS source, event_type <> 'error' AS ok, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE user_id % 7 < 5),
points AS (SELECT source, arg_max(day, event_id) AS last_since FROM runs WHERE ok GROUP BY source)
SELECT s.source, CASE WHEN s.source = 's1' THEN '1800-01-01' ELSE coalesce(last_since, '2020-01-02') END AS since FROM (SELECT DISTINCT 's' || user_id % 7 AS source FROM events) s LEFT JOIN points USING (source)""")
def checkpoint_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every source's next run begins: a full one at the start, others at their last success or some days back."""
    events = table(spark, sf_dir, "events").withColumn("source", F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")))
    runs = events.filter("user_id % 7 < 5").select("source", F.when(F.col("event_type") != "error", "ok").otherwise("error").alias("status"), F.col("event_id").alias("seq"), checks.day_text(F.col("ts")).alias("day"))
    points = state.checkpoints(runs)
    return state.since(events.select("source").distinct(), points, F.lit("2020-02-01").cast("date"), 30, full=["s1"])


@plan(f"""
WITH rows AS (SELECT *, doc_id > 100 AS later FROM ({WORKS})),
prior AS (SELECT DISTINCT work_id FROM rows WHERE NOT later),
firsts AS (SELECT work_id, arg_min(source, doc_id) AS source FROM rows WHERE later GROUP BY work_id)
SELECT r.source, 'ok' AS status, count(*) AS received, coalesce(any_value(n.n), 0) AS new_works FROM rows r
LEFT JOIN (SELECT source, count(*) AS n FROM firsts WHERE work_id NOT IN (SELECT work_id FROM prior) GROUP BY source) n ON n.source = r.source WHERE later GROUP BY r.source""")
def harvest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run received of every source, and how many works were new."""
    rows = _records(spark, sf_dir)
    return state.report(rows.filter("doc_id > 100"), rows.filter("doc_id <= 100").select("work_id"), F.col("doc_id"))


# Streams


@plan("SELECT event_type, count(*) AS n, max(event_id) AS last, CAST(sum(event_id) AS BIGINT) AS total FROM events WHERE event_id > 100 GROUP BY event_type")
def cursor_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log read as a stream by its cursor, in pages, each merged into the table in its own micro-batch."""
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    size = table(spark, sf_dir, "events").count() // 3 + 1
    stream = streaming.cursor_stream(spark, path, cursor="event_id", after=100, size=size, columns={"event_type": "string"})
    rows = streaming.merged(stream, lambda d: d.groupBy("event_id").agg(F.first("event_type").alias("event_type")), ["event_id"], every="0 seconds")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"), F.sum("event_id").cast("long").alias("total"))
