"""Event logs: appends, messages derived from them, migrations, soft deletes, assertions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MESSAGE_TYPES = ("user/message", "assistant/message")
PAYLOAD = "struct<message_id:string,role:string,content:string,metadata:map<string,string>>"


def payload(message_id: Column, role: Column, content: Column, metadata: Column) -> Column:
    return F.to_json(F.struct(message_id.alias("message_id"), role.alias("role"), content.alias("content"), metadata.alias("metadata")))


def append_both(events: DataFrame, session_log: str, sync_log: str) -> None:
    """Append events to the conversation's log and, as changes of the conversation, to the sync log.

    The batch is written beside the session log first and both logs are appended from there, so that they get the same rows
    and neither is read; an event carries its own id, so readers drop what a repeated append has
    written twice (``once``).
    """
    staged = f"{session_log.rstrip('/')}-staged/{uuid.uuid4().hex}"
    events.select("event_id", "conversation_id", "event_type", "payload_json", "created_at").write.parquet(staged)
    stored = events.sparkSession.read.parquet(staged)
    stored.write.mode("append").parquet(session_log)
    stored.select("event_id", F.lit("conversation").alias("aggregate_type"), F.col("conversation_id").alias("aggregate_id"), "event_type", "payload_json", "created_at").write.mode("append").parquet(sync_log)


def once(log: DataFrame) -> DataFrame:
    return log.dropDuplicates(["event_id"])


def messages(log: DataFrame, fields: list[str] = (), limit: int | None = None) -> DataFrame:
    """The messages of every conversation, read from its events: id, role, content, timestamp, and chosen metadata
    fields beside them, which win over a column of the same name; the newest ``limit`` of each."""
    rows = log.filter(F.col("event_type").isin(*MESSAGE_TYPES)).withColumn("p", F.from_json("payload_json", PAYLOAD))
    if limit:
        place = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("event_id")))
        rows = rows.withColumn("_place", place).filter(F.col("_place") <= limit)
    base = {"id": F.col("p.message_id"), "role": F.col("p.role"), "content": F.col("p.content"), "timestamp": F.col("created_at")}
    spread = {f: F.coalesce(F.col("p.metadata")[f], base[f].cast("string")) if f in base else F.col("p.metadata")[f] for f in fields}
    return rows.select("conversation_id", "event_id", *[c.alias(n) for n, c in (base | spread).items()])


def migrated(log: DataFrame, legacy: DataFrame) -> DataFrame:
    """Events for the legacy messages that no event holds yet, by time and id; running it again gives none.

    Their ids follow the log's last and rise in that order, but need not be next to each other. Write them before use: a plan that
    runs again may number them otherwise.
    """
    there = log.select(F.get_json_object("payload_json", "$.message_id").alias("message_id")).filter("message_id is not null").distinct()
    rows = legacy.dropDuplicates(["message_id"]).join(there, "message_id", "left_anti")
    body = payload(F.col("message_id"), F.col("role"), F.col("content"), F.from_json("metadata_json", "map<string,string>"))
    last = log.agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("n")).first()["n"]
    rows = rows.orderBy("created_at", "message_id")  # by ranges over the tasks, whose numbers rise with them
    number = F.monotonically_increasing_id() + F.lit(last + 1)
    return rows.select(number.alias("event_id"), "conversation_id", F.concat("role", F.lit("/message")).alias("event_type"), body.alias("payload_json"), "created_at")


def soft_delete(rows: DataFrame, requests: DataFrame, key: str, now: Column) -> DataFrame:
    """Active rows become deleted where any request names their current revision, which rises by one; ``outcome`` says
    what a row's requests met: deleted, none named the current revision, or the row wasn't active. Null where nothing asked."""
    current = requests.select(key, "expected").join(rows.select(key, "revision"), key)
    asked = current.groupBy(key).agg(F.coalesce(F.bool_or(F.col("expected") == F.col("revision")), F.lit(False)).alias("_hit"))
    joined = rows.join(asked, key, "left")
    active = (F.col("status") == "active") & F.col("_hit").isNotNull()
    hit = active & F.col("_hit")
    changed = {"status": F.when(hit, "deleted").otherwise(F.col("status")), "deleted_at": F.when(hit, now).otherwise(F.col("deleted_at")), "revision": F.when(hit, F.col("revision") + 1).otherwise(F.col("revision"))}
    outcome = F.when(hit, "deleted").when(active, "conflict").when(F.col("_hit").isNotNull(), "gone")
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in rows.columns], outcome.alias("outcome"))


def delete_outcomes(rows: DataFrame, requests: DataFrame, key: str, seq: str) -> DataFrame:
    """What each request met, one by one in order: the first that names the current revision of an active row deletes it
    (and answers with the revision after), those before conflict, those after and those for other rows find nothing."""
    met = requests.join(rows.select(key, "revision", F.col("status").alias("_status")), key, "left")
    right = F.coalesce((F.col("_status") == "active") & (F.col("expected") == F.col("revision")), F.lit(False))
    order = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.bool_or(right).over(order), F.lit(False))
    met = met.withColumns({"_right": right, "_before": before})
    open_ = F.coalesce(F.col("_status") == "active", F.lit(False)) & ~F.col("_before")
    outcome = F.when(~open_, "gone").when(F.col("_right"), "deleted").otherwise("conflict")
    return met.select(*requests.columns, outcome.alias("outcome"), F.when(open_, F.col("revision") + F.col("_right").cast("int")).alias("revision"))


def retention(rows: DataFrame, due: Column, now: Column) -> DataFrame:
    """Soft delete of the active rows that are due; ``affected`` marks them, so their count is a filter."""
    hit = (F.col("status") == "active") & F.coalesce(due, F.lit(False))
    changed = {"status": F.when(hit, "deleted").otherwise(F.col("status")), "deleted_at": F.when(hit, now).otherwise(F.col("deleted_at")), "revision": F.when(hit, F.col("revision") + 1).otherwise(F.col("revision"))}
    return rows.select(*[changed.get(c, F.col(c)).alias(c) for c in rows.columns], hit.alias("affected"))


def renamed_namespace(namespace: Column, space: Column, old: str = "space/", new: str = "shared/") -> Column:
    """The namespace with its prefix changed where the rest is the row's own space."""
    return F.when(namespace == F.concat(F.lit(old), space), F.concat(F.lit(new), space)).otherwise(namespace)


def duplicates(rows: DataFrame, *columns: str) -> DataFrame:
    """Values of the columns, other than null and empty, that stand in several rows: none, if they are unique."""
    filled = rows.filter(" and ".join(f"coalesce(cast(`{c}` as string), '') <> ''" for c in columns))
    return filled.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def context_blocks(blocks: DataFrame, keys: list[str], tokens: Column, most: int) -> DataFrame:
    """The blocks of every key in order, the first of each path, as one text; ``rejected`` where they hold more tokens than allowed."""
    first = F.row_number().over(Window.partitionBy(*keys, "path").orderBy("place"))
    kept = blocks.withColumn("_n", first).filter("_n = 1").withColumn("_t", tokens)
    text = F.concat(F.lit("File: "), "name", F.lit("\nPath: "), "path", F.lit("\nContent:\n"), "content")
    out = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", text.alias("t")))).alias("b"), F.sum("_t").alias("tokens"))
    return out.select(*keys, F.array_join(F.transform("b", lambda x: x["t"]), "\n\n").alias("text"), "tokens", (F.col("tokens") > most).alias("rejected"))


def restored(versions: DataFrame) -> DataFrame:
    """Of every path the newest backup by its name, in which a padded timestamp stands."""
    return versions.groupBy("path").agg(F.max_by(F.struct("backup", "content"), "backup").alias("v")).select("path", "v.backup", "v.content")


def two_lists(rows: DataFrame, pending: int = 50, recent: int = 20) -> DataFrame:
    """What a reviewer sees: the newest pending rows and the newest others, each list with its own limit."""
    newest = lambda d, n, name: d.orderBy(F.desc("requested_at"), F.desc("id")).limit(n).withColumn("list", F.lit(name))
    return newest(rows.filter("status = 'pending'"), pending, "pending").union(newest(rows.filter("status <> 'pending'"), recent, "recent"))
