"""State by key with time to live: approvals that expire unasked, and rows that change by revision.

Both read an event-time stream with a watermark. A key's state is one small row, held with those of its bucket; a bucket's timer in event time
expires keys and, ``keep`` seconds later, removes them, so that the store holds live keys only. Rows of a key are
taken in order of time and sequence within a micro-batch, and batch after batch; a row at or before second 0 is late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "approval_id long, status string, changed_at double, decided_by string"
OUTCOMES = "key long, seq long, outcome string, revision long"


#: Keys are held by buckets, so that a bucket's keys of a micro-batch cost one read and one write of state. A bucket has one
#: key in so many of all that live, and must fit a task.
BUCKETS = 4096


def _ordered(frames: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    """Values of the columns, row by row in order of time and sequence."""
    rows = pd.concat(list(frames)).sort_values(["at", "seq"], kind="stable")
    return zip(*[rows[c].tolist() for c in columns])


class _Bucket:
    """The state of a bucket's keys, the first column of the schema being the key, and its one timer: that of the key due first."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, schema: str) -> None:
        self.handle, self.rows, self.timer = handle, handle.getListState(name, schema), handle.getValueState(f"{name}_timer", "at long")

    def held(self) -> dict[int, tuple]:
        return {r[0]: tuple(r[1:]) for r in self.rows.get()} if self.rows.exists() else {}

    def hold(self, held: dict[int, tuple]) -> None:
        if held:
            self.rows.put([(k, *s) for k, s in held.items()])
        else:
            self.rows.clear()

    def wake(self, due: Iterator[int]) -> None:
        """Moves the timer to the first of the times that are due (milliseconds), if there is any."""
        first, have = min(due, default=None), self.timer.get()[0] if self.timer.exists() else None
        if first == have:
            return
        if have is not None:
            self.handle.deleteTimer(have)
            self.timer.clear()
        if first is not None:
            self.handle.registerTimer(first)
            self.timer.update((first,))

    def woken(self, timers: TimerValues, fired: ExpiredTimerInfo) -> int:
        """The time up to which keys are due; the timer that fired is gone."""
        self.timer.clear()
        return max(timers.getCurrentWatermarkInMs(), fired.getExpiryTimeInMs())


class ApprovalProcessor(StatefulProcessor):
    """Rows: kind (request or decision), at (seconds), seq, ttl, decision, decided_by. One row for each change of status.

    The first request opens an approval; further ones of its key change nothing. The first decision that meets
    it open counts, if it comes before the time is over; one that comes later finds it expired.
    """

    def __init__(self, keep: float) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = _Bucket(handle, "approvals", "approval_id long, status string, expires_at double")

    def _due(self, state: tuple) -> int:
        """When something happens to an approval: it expires if it is pending, else it is forgotten."""
        return int(state[1] * 1000) if state[0] == "pending" else int((state[1] + self.keep) * 1000) + 1

    def _changes(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=["approval_id", "status", "changed_at", "decided_by"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, out = self.bucket.held(), []
        before = dict(held)
        for k, kind, at, ttl, decision, decided_by in _ordered(rows, "approval_id", "kind", "at", "ttl", "decision", "decided_by"):
            state = held.get(k)
            if state and at > state[1] + self.keep:  # as if its timers had run
                out += [(k, "expired", state[1], None)] if state[0] == "pending" else []
                state = held.pop(k) and None
            if kind == "request" and state is None:
                held[k] = ("pending", float(at + ttl))
                out.append((k, "pending", float(at), None))
            elif kind == "decision" and state and state[0] == "pending":
                late = at >= state[1]
                held[k] = ("expired" if late else decision, state[1])
                out.append((k, held[k][0], state[1] if late else float(at), None if late else decided_by))
        if held != before:
            self.bucket.hold(held)
            self.bucket.wake(map(self._due, held.values()))
        yield from self._changes(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, held, out = self.bucket.woken(timerValues, expiredTimerInfo), self.bucket.held(), []
        before = dict(held)
        for k, state in before.items():
            if state[0] == "pending" and self._due(state) <= now:
                state = held[k] = ("expired", state[1])
                out.append((k, "expired", float(state[1]), None))
            if self._due(state) <= now:  # nobody asks any more
                del held[k]
        if held != before:
            self.bucket.hold(held)
        self.bucket.wake(map(self._due, held.values()))
        yield from self._changes(out)

    def close(self) -> None:
        pass


class RevisionProcessor(StatefulProcessor):
    """Rows: op (create, update, delete), at, seq, expected, content. One row for what each of them met.

    A create makes revision 1 where nothing is; update and delete take effect where ``expected`` is the
    current revision, and raise it. A deleted key answers ``gone``; its state goes ``keep`` seconds later.
    """

    def __init__(self, keep: float) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = _Bucket(handle, "rows", "key long, revision long, content string, deleted boolean, gone_at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, out = self.bucket.held(), []
        before = dict(held)
        for k, op, at, seq, expected, content in _ordered(rows, "key", "op", "at", "seq", "expected", "content"):
            state = held.get(k)
            if state is None:
                made = op == "create"
                if made:
                    held[k] = (1, content, False, None)
                out.append((k, seq, "created" if made else "missing", 1 if made else 0))
            elif state[2] or op == "create":
                out.append((k, seq, "gone" if state[2] else "exists", state[0]))
            elif expected != state[0]:
                out.append((k, seq, "conflict", state[0]))
            else:
                gone = op == "delete"
                held[k] = (state[0] + 1, state[1] if gone else content, gone, float(at + self.keep) if gone else None)
                out.append((k, seq, "deleted" if gone else "updated", state[0] + 1))
        if held != before:
            self.bucket.hold(held)
            self.bucket.wake((int(s[3] * 1000) for s in held.values() if s[2]))
        yield pd.DataFrame(out, columns=["key", "seq", "outcome", "revision"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self.bucket.woken(timerValues, expiredTimerInfo)
        held = self.bucket.held()
        left = {k: s for k, s in held.items() if not s[2] or int(s[3] * 1000) > now}
        if len(left) < len(held):
            self.bucket.hold(left)
        self.bucket.wake((int(s[3] * 1000) for s in left.values() if s[2]))
        return iter(())

    def close(self) -> None:
        pass


def _keyed(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, late: str) -> DataFrame:
    """``stream`` has ``at`` in seconds; what is later than the watermark by ``late`` is dropped."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)  # read when the query starts; it stays set
    timed = stream.withColumn("_time", F.timestamp_seconds("at")).withWatermark("_time", late)
    return timed.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS))).groupBy("_bucket").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def approval_changes(stream: DataFrame, keep: float = 86_400, late: str = "0 seconds") -> DataFrame:
    """Changes of status of approvals from requests and decisions (approval_id, kind, at, seq, ttl, decision, decided_by)."""
    return _keyed(stream, "approval_id", ApprovalProcessor(keep), CHANGES, late)


def revision_outcomes(stream: DataFrame, keep: float = 86_400, late: str = "0 seconds") -> DataFrame:
    """What every change (key, op, at, seq, expected, content) met."""
    return _keyed(stream, "key", RevisionProcessor(keep), OUTCOMES, late)


def status_at(changes: DataFrame, ttls: DataFrame, now: Column) -> DataFrame:
    """approval_id, status, decided_by as a reader finds them: what is pending past its time is expired, whether or not a timer said so.
    ``ttls``: approval_id, ttl of the requests."""
    last = changes.groupBy("approval_id").agg(F.min_by("changed_at", F.when(F.col("status") == "pending", F.col("changed_at"))).alias("_asked"), F.max_by(F.struct("status", "decided_by"), F.struct((F.col("status") != "pending").cast("int").alias("f"), "changed_at")).alias("_s"))
    over = (F.col("_s.status") == "pending") & (F.col("_asked") + F.col("ttl") <= now)
    return last.join(ttls.select("approval_id", "ttl"), "approval_id").select("approval_id", F.when(over, "expired").otherwise(F.col("_s.status")).alias("status"), F.col("_s.decided_by").alias("decided_by"))


def sunk(rows: DataFrame, home: str) -> DataFrame:
    """All that a stream gives of what is there now, appended to a table under ``home``; run again, it goes on where it ended."""
    query = rows.writeStream.format("parquet").outputMode("append").option("path", f"{home}/out").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{home}/out")
