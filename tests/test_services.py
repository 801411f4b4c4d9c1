"""Services against a second engine: keyed state, table functions, readers and writers, harvest runs, collections."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brambling.plans import catalog, services
from brambling.streaming import keyed

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n, f in catalog.QUERIES.items() if f.__module__ == services.__name__]


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("null" if v is None or v is pd.NA or v != v else str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = rows(catalog.QUERIES[name](spark, SF).toPandas()), rows(con.sql(catalog.ORACLE_SQL[name]).df())
    norm = lambda x: [tuple(v[:-2] if v.endswith(".0") else v for v in r) for r in x]
    assert norm(got) == norm(want) and got


REQUEST = "approval_id long, kind string, at double, seq long, ttl double, decision string, decided_by string"


def _files(spark, rows, folder, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_approvals_expire_unasked_and_outlive_a_restart(spark, tmp_path):
    ask, decide = (lambda k, at, ttl=10.0: (k, "request", float(at), at, ttl, None, None)), (lambda k, at, d="approved": (k, "decision", float(at), at, None, d, "owner"))
    folder, home = str(tmp_path / "in"), str(tmp_path / "home")
    run = lambda: keyed.sunk(keyed.approval_changes(spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(folder), keep=50), home)
    _files(spark, [(1, "request", 0.5, 0, 10.0, None, None), ask(2, 1), ask(3, 2, 100.0), decide(9, 3)], folder, REQUEST)
    first = run()
    assert sorted((r.approval_id, r.status) for r in first.collect()) == [(1, "pending"), (2, "pending"), (3, "pending")]
    _files(spark, [decide(1, 5), decide(1, 6, "denied"), decide(2, 30), ask(3, 40)], folder, REQUEST)  # 2 comes too late; 3 is asked again
    _files(spark, [ask(4, 120), decide(2, 121)], folder, REQUEST)  # time goes on: 3 expires without a decision
    _files(spark, [ask(5, 400), ask(2, 401)], folder, REQUEST)  # the state of 2 is gone: a new request opens it anew
    got = sorted((r.approval_id, r.status, r.changed_at) for r in run().collect())
    assert [x for x in got if x[0] == 1] == [(1, "approved", 5.0), (1, "pending", 0.5)]
    assert [x for x in got if x[0] == 2] == [(2, "expired", 11.0), (2, "pending", 1.0), (2, "pending", 401.0)]
    assert (3, "expired", 102.0) in got and (4, "pending", 120.0) in got and not any(x[0] == 9 for x in got)


def test_reader_sees_what_no_timer_said(spark):
    changes = spark.createDataFrame([(1, "pending", 0.0, None), (2, "pending", 0.0, None), (2, "denied", 3.0, "o")], keyed.CHANGES)
    ttls = spark.createDataFrame([(1, 10.0), (2, 10.0)], "approval_id long, ttl double")
    at = lambda now: {r.approval_id: r.status for r in keyed.status_at(changes, ttls, F.lit(now)).collect()}
    assert at(9.9) == {1: "pending", 2: "denied"} and at(10.0) == {1: "expired", 2: "denied"}


def test_table_functions_follow_their_arguments(spark):
    from brambling.functions import tables

    registry = tables.registered(spark)
    spark.createDataFrame([(1, "a", None), (2, "b", ""), (3, "c", "x" * 10), (4, "a", "| A | b |\r\n|---|---|\r\n| 1 | 2 |\n| 3 |\n\n```\n| a | b |\n|---|---|\n| no | no |\n```\n| other |\n| --- | --- |\n| 9 |")], "chunk_no int, k string, t string").createOrReplaceTempView("t")
    got = spark.sql("SELECT * FROM chunks(TABLE(t), 't', 4, 0, true)")
    assert got.columns == ["k", "chunk_no", "chunk"]  # the text goes, and a found column wins over one of its name
    assert [tuple(r) for r in got.filter("k = 'c'").collect()] == [("c", 0, "xxxx"), ("c", 1, "xxxx"), ("c", 2, "xx")]
    got = spark.sql("SELECT * FROM markdown_tables(TABLE(SELECT k, t FROM t), 't', 'b, a, z')")
    assert got.columns == ["k", "table_no", "row_no", "b", "a", "z"] and [tuple(r) for r in got.collect()] == [("a", 0, 0, "2", "1", None), ("a", 0, 1, None, "3", None)]
    spark.createDataFrame([(3, "a", "x X"), (1, "a", "x"), (2, "a", "xx"), (9, "b", "x"), (8, "b", None)], "id int, g string, t string").createOrReplaceTempView("m")
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM matches(TABLE(m) PARTITION BY (g), 't', 'x', 2)").collect()) == [(2, "a", 2, 1), (3, "a", 2, 2), (9, "b", 1, 1)]
    for bad in ("chunks(TABLE(t), 'nowhere', 4, 0)", "chunks(TABLE(t), 't', 4, 4)", "markdown_tables(TABLE(t), 't', 'a,A')", "matches(TABLE(t), 't', '', 2)"):
        with pytest.raises(Exception, match="must"):
            spark.sql(f"SELECT * FROM {bad}").collect()
    assert registry.names() == ["chunks", "markdown_tables", "matches"]
    registry.scalar("twice", lambda x: x * 2, "bigint", "two times")
    registry.scalar("twice", lambda x: x * 3, "bigint", "three times")
    assert spark.sql("SELECT twice(7)").first()[0] == 21 and registry.schema("twice")["description"] == "three times"
    with pytest.raises(KeyError):
        registry.schema("never")


FILES = "collection string, name string, content string"


def test_uploads_come_whole_or_not_at_all(spark, tmp_path):
    import os

    from brambling.sources import uploads

    home = str(tmp_path / "up")
    assert uploads.manifest(spark, home).count() == 0 and uploads.uploaded(spark, home).count() == 0
    good = [("public", f"f{k}.md", f"text {k}") for k in range(20)] + [("data", "same.txt", "x"), ("data", "same.txt", "x"), ("data", "a/b/../c.PDF", None)]
    uploads.upload(spark.createDataFrame(good, FILES).repartition(4), home, "me")
    got = uploads.uploaded(spark, home).collect()
    assert sorted((r["collection"], r["name"], bytes(r["content"]).decode()) for r in got) == sorted((c, n.rsplit("/", 1)[-1], t or "") for c, n, t in good)
    assert len({r["stored"] for r in got}) == len(good) and {r["uploaded_by"] for r in got} == {"me"}
    for bad in (("public", "x.exe", "t"), ("public", "..", "t"), ("secret", "x.md", "t"), ("public", None, "t")):
        with pytest.raises(Exception, match="not an allowed|unknown collection"):
            uploads.upload(spark.createDataFrame([*good, bad], FILES).repartition(4), home)
    assert uploads.manifest(spark, home).count() == len(good) and uploads.sweep(home) == []
    uploads.sweep(home, older=0)
    assert len(os.listdir(f"{home}/batches")) == 1  # failed jobs left nothing
    with pytest.raises(Exception, match="appended only"):
        spark.createDataFrame(good, FILES).write.format("uploads").mode("overwrite").option("path", home).save()


def test_filters_and_limits_reach_the_reader(spark, tmp_path):
    import shutil

    from brambling.sources import adapters

    home = str(tmp_path)
    items = spark.createDataFrame([(str(k), f"2024-01-{k + 1:02d}", k // 5) for k in range(30)], "id string, updated string, page int")
    adapters.record(items, home, "documents")
    late = adapters.items_of(spark, home, "documents").filter(F.col("updated") >= "2024-01-18")
    plan = late._jdf.queryExecution().toString()
    assert "2024-01-18" in plan[plan.index("== Physical Plan ==") :]
    for page in (0, 1, 2):
        shutil.rmtree(f"{home}/documents/pages/page={page}")  # pages that end before: they aren't read
    assert sorted(int(r.id) for r in late.collect()) == list(range(17, 30)) and {r["_pages"] for r in late.collect()} == {3}
    shutil.rmtree(f"{home}/documents/pages/page=5")
    first = adapters.collect(spark, home, "documents", "2024-01-18", limit=6)
    assert sorted(int(r.source_id) for r in first.collect()) == list(range(17, 23))  # page 5 lies beyond the limit
    assert adapters.items_of(spark, home, "documents").filter("updated >= '2030-01-01'").count() == 0
    with pytest.raises(adapters.UnknownAdapter):
        adapters.adapter("nobody")


def _source(spark, *ids, doi="", title="t", **more):
    from brambling.sources import RECORD, runs

    row = {"doi": doi, "title": title, "oa_status": "open", "authors": ["x"], "citation_count": None} | more
    schema = ", ".join(f"{c} {runs.TYPES[c]}" for c in RECORD)
    return lambda since: spark.createDataFrame([tuple(({"source_id": k} | row).get(c, "") for c in RECORD) for k in ids], schema)


@pytest.mark.parametrize("step", ["works", "records", "checkpoints", "report", "manifest"])
def test_a_killed_run_changes_nothing(spark, tmp_path, step):
    from brambling.sources import runs

    store = runs.HarvestStore(spark, str(tmp_path / "h"))
    assert store.run({"a": _source(spark, "1", "2")}, "2024-01-01") == 1
    state = lambda: [sorted(map(str, d.collect())) for d in (store.works(), store.records(), store.checkpoints(), store.report())]
    before = state()

    def kill(at: str) -> None:
        if at == step:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        store.run({"a": _source(spark, "3", title="new")}, "2024-02-01", between=kill)
    assert store.version() == 1 and state() == before
    assert store.run({"a": _source(spark, "3")}, "2024-02-01") == 2 and store.works().count() == 3


def test_harvest_runs(spark, tmp_path, monkeypatch):
    from brambling.sources import runs

    monkeypatch.setattr(runs, "COMPACT", 3)
    store, seen = runs.HarvestStore(spark, str(tmp_path / "h")), []

    def asks(source, fail=False):
        def ask(since):
            seen.append(since)
            if fail:
                raise ConnectionError("gone\nfor good")
            return source(since)

        return ask

    store.run({"a": asks(_source(spark, "1", None, doi="10/x", citation_count=5)), "b": asks(None, fail=True)}, "2024-03-01", 30)
    report = {r.source: r for r in store.report().collect()}
    assert (report["a"].received, report["a"].new_works, report["b"].status, report["b"].reason) == (2, 1, "error", "gone")
    store.run({"a": asks(_source(spark, doi="")), "b": asks(_source(spark, "9", doi="10/x", title="", authors=[], oa_status="closed"))}, "2024-03-05", 30)
    assert seen == ["2024-01-31", "2024-01-31", "2024-03-01", "2024-02-04"]  # b is asked for the same again, from its own lookback
    (work,) = store.works().collect()
    assert (work.work_id, work.title, work.authors, work.citation_count, work.oa_status, work.first_seen_at, work.last_seen_at) == ("doi:10/x", "[untitled]", ["x"], 5, "closed", "2024-03-01", "2024-03-05")
    assert {r.source: (r.received, r.new_works) for r in store.report().collect()} == {"a": (0, 0), "b": (1, 0)}
    store.run({"a": asks(_source(spark, "2", doi="10/y"))}, "2024-03-06")  # the third: deltas become one
    assert len(store.manifest(3)["works"]) == 1 and store.works().count() == 2 and store.records().count() == 3
    assert store.works(1).first().citation_count == 5 and store.works(1).count() == 1  # older runs can still be read

    def overtaken(at: str) -> None:
        if at == "manifest":
            runs.HarvestStore(spark, store.home).run({"a": asks(_source(spark, "7"))}, "2024-03-08")

    with pytest.raises(runs.ConcurrentRun):
        store.run({"a": asks(_source(spark, "8"))}, "2024-03-07", between=overtaken)
    assert store.version() == 4 and store.records().filter("source_id = '8'").count() == 0


def test_one_rebuild_at_a_time(spark, tmp_path):
    from brambling.operators import collections, texts

    store = collections.Store(spark, str(tmp_path / "s"))
    docs = spark.createDataFrame([(1, "s", "one line\n\ntwo lines"), (2, "s", None), (3, "s", "")], "doc_id long, source string, text string")
    with texts.locked(spark, store.home, "private", "u1"):
        with pytest.raises(texts.RebuildRunning):
            texts.rebuild(store, "private", docs, "u1", chunker=texts.by_lines)
        assert texts.rebuild(store, "private", docs, "u2", chunker=texts.by_lines) == {"documents": 1, "chunks": 2}  # another user's isn't held up
    with texts.locked(spark, store.home, "public", stale=0.0):
        assert texts.rebuild_all(store, docs.withColumn("collection", F.lit("public")), ["public", "data"])["public"] == {"documents": -1, "chunks": -1}
    assert texts.rebuild(store, "private", docs.limit(0), "u2") == {"documents": 0, "chunks": 0} and store.read("private", "u2") is None


def test_embedders_are_pluggable(spark):
    from brambling.functions import embed
    from brambling.operators import texts

    v = embed.hashed_vector("A b\na B", 16, 1)
    assert abs(sum(x * x for x in v) - 1) < 1e-12 and embed.hashed_vector("", 4) == [0.0] * 4
    assert embed.hashed_vector("b a", 16, 1) == embed.hashed_vector("a b", 16, 1) and embed.hashed_vector("b a") != embed.hashed_vector("a b")
    own = embed.register(embed.Embedder("length", 1, lambda c: F.array(F.length(c).cast("double"))))
    docs = spark.createDataFrame([(1, "s", "abc")], "doc_id long, source string, text string")
    assert texts.chunks(docs, embed.EMBEDDERS["length"]).first()["embedding"] == [3.0] and own.dimensions == 1


def test_many_queries_in_several_passes(spark, monkeypatch):
    import random

    from brambling.operators import texts

    rng = random.Random(2)
    rows = [(k, [rng.choice((0.0, 0.5, 1.0)) for _ in range(3)]) for k in range(200)]  # many ties
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    asked = vectors.limit(40).selectExpr("vec_id AS query_id", "embedding")
    of = dict(rows)
    want = lambda q: sorted((sum((a - b) ** 2 for a, b in zip(of[q], v)), k) for k, v in rows)[:7]
    for numbers in (texts.PASS_NUMBERS, 30):
        monkeypatch.setattr(texts, "PASS_NUMBERS", numbers)
        got = texts.top_k_many(vectors, asked, 7).orderBy("query_id", "rank").collect()
        assert len(got) == 280
        for q in {r.query_id for r in got}:
            assert [(r.d2, r.vec_id) for r in got if r.query_id == q] == want(q)
    assert texts.top_k_many(vectors, asked.limit(0), 7).count() == 0


def test_fingerprints_are_those_of_sorted_json(spark):
    import hashlib
    import json

    from brambling.operators import approvals

    texts = ["\x1f\x0b", "\\u001F", "\\\x1a", "\\\\\x0f", '"\n\t\r\b\f', "漢😀\x7f", "\x00\x0e\x1c\x1d"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(approvals.fingerprint(F.col("t"), F.create_map(F.lit("a"), approvals.quoted(F.col("t"))))).collect()
    assert [r[0] for r in got] == [hashlib.sha256(json.dumps({"tool": t, "args": {"a": t}}, sort_keys=True, ensure_ascii=False).encode()).hexdigest() for t in texts]


def test_approvals_keep_to_their_scope(spark):
    from brambling.operators import approvals

    asks = "request_id long, account string, space string, principal string, tool string, conversation long, fingerprint string, decision string"
    requests = spark.createDataFrame([(k, "a", "s", p, "t", 1, "f", "REQUIRES_APPROVAL") for k, p in enumerate(["p", "q", "r", "z"])], asks)
    have = "approval_id string, account string, space string, principal string, tool string, fingerprint string, status string, requested_at double, expires_at double"
    old = [("1", "p", "approved", 1.0, 99.0), ("2", "p", "pending", 2.0, 99.0), ("3", "q", "approved", 1.0, 99.0), ("4", "q", "denied", 2.0, 99.0), ("5", "r", "approved", 3.0, 5.0)]
    approvals_ = spark.createDataFrame([(i, "a", "s", p, "t", "f", st, r, e) for i, p, st, r, e in old] + [("6", "a", "other", "z", "t", "f", "approved", 9.0, 99.0)], have)
    policies = spark.createDataFrame([(1, "ask")], "conversation long, approval_policy string")
    done = approvals.resolve(requests, requests.select("request_id").limit(0), approvals_, policies, F.lit(10.0))
    assert {r.principal: (r.outcome, r.approval_id) for r in done.collect()} == {
        "p": ("REQUIRES_APPROVAL", "2"), "q": ("ALLOW", "3"), "r": ("REQUIRES_APPROVAL", None), "z": ("REQUIRES_APPROVAL", None)}


def test_requests_for_one_row(spark):
    from brambling.operators import journal

    have = spark.createDataFrame([(1, "active", 2, None), (2, "active", 1, None), (3, "deleted", 1, None), (4, "active", 1, None)], "id long, status string, revision long, deleted_at double")
    asked = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 5), (3, 1, 1), (9, 1, 1)], "id long, seq long, expected long")
    assert {r.id: (r.status, r.revision, r.outcome) for r in journal.soft_delete(have, asked, "id", F.lit(1.0)).collect()} == {1: ("deleted", 3, "deleted"), 2: ("active", 1, "conflict"), 3: ("deleted", 1, "gone"), 4: ("active", 1, None)}
    got = {(r.id, r.seq): (r.outcome, r.revision) for r in journal.delete_outcomes(have, asked, "id", "seq").collect()}
    assert got == {(1, 1): ("conflict", 2), (1, 2): ("deleted", 3), (1, 3): ("gone", None), (2, 1): ("conflict", 1), (3, 1): ("gone", None), (9, 1): ("gone", None)}


def test_appends_read_no_log(spark, tmp_path):
    from brambling.operators import journal

    schema = "event_id long, conversation_id string, event_type string, payload_json string, created_at double"
    log, sync = str(tmp_path / "session"), str(tmp_path / "sync")
    for k in range(3):
        journal.append_both(spark.createDataFrame([(k, "c", "user/message", "{}", 1.0)], schema), log, sync)
    assert spark.read.parquet(log).count() == 3 and spark.read.parquet(sync).count() == 3  # nothing is copied again


def test_logs_without_statistics_are_an_error(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from brambling import streaming

    (tmp_path / "log").mkdir()
    pq.write_table(pa.table({"n": list(range(100))}), tmp_path / "log" / "a.parquet", write_statistics=False)
    stream = streaming.cursor_stream(spark, str(tmp_path / "log"), cursor="n")
    with pytest.raises(Exception, match="no statistics of n"):
        streaming.merged(stream, lambda d: d, ["n"], every="0 seconds")


def test_cursor_reads_by_uri(spark, tmp_path):
    from brambling import streaming

    spark.range(10).select(F.col("id").alias("n")).write.parquet(str(tmp_path / "log"))
    stream = streaming.cursor_stream(spark, (tmp_path / "log").as_uri(), cursor="n", after=-1, size=4)
    assert streaming.merged(stream, lambda d: d, ["n"], every="0 seconds").count() == 10


def test_restore_writes_new_versions(spark, tmp_path):
    from brambling.operators import versions

    log = versions.VersionLog(spark, str(tmp_path), "path string, stamp bigint, deleted boolean, content string")
    assert log.log().count() == 0
    put = lambda *rows: log.write(spark.createDataFrame(rows, log.schema))
    put(("a", 1, False, "a1"), ("b", 1, False, "b1"), ("c", 1, False, "c1"))
    put(("a", 2, False, "a2"), ("b", 3, True, None), ("d", 3, False, "d3"), ("a", 1, False, "never"))
    files = lambda at: {r.path: r.content for r in log.as_of(at).collect()}
    assert files(0) == {} and files(1) == {"a": "a1", "b": "b1", "c": "c1"} and files(3) == {"a": "a2", "c": "c1", "d": "d3"}
    log.restore(1, 5)
    assert files(9) == files(1) and files(4) == {"a": "a2", "c": "c1", "d": "d3"}
    assert log.log().filter("path = 'c'").count() == 1  # what hadn't changed isn't written again
    spans = {(r.path, r.stamp): r.until for r in versions.intervals(log.log()).collect()}
    assert spans["a", 1] == 2 and spans["a", 2] == 6 and spans["c", 1] is None


def test_schemas_only_grow(spark, tmp_path):
    from brambling.operators import versions

    store = versions.EvolvingTable(spark, str(tmp_path))
    store.evolve("k bigint, n int")
    store.append(spark.createDataFrame([(1, 2)], "k bigint, n int"))
    for bad in ("k bigint", "k bigint, n string", "k int, n int"):
        with pytest.raises(ValueError, match="can't be dropped"):
            store.evolve(bad)
    store.evolve("k bigint, n bigint, t string", {"t": "x"})
    store.append(spark.createDataFrame([(3,)], "k bigint"))
    with pytest.raises(ValueError, match="unknown columns"):
        store.append(spark.createDataFrame([(3,)], "z bigint"))
    assert sorted(map(tuple, store.read().collect())) == [(1, 2, "x"), (3, None, "x")] and dict(store.read().dtypes)["n"] == "bigint"


def test_pages_read_the_files_they_need(spark, tmp_path):
    from brambling.operators import eventlog

    log = eventlog.ClusteredLog(spark, str(tmp_path), "scope bigint, event_id bigint, v string", file_rows=100)
    assert log.page(1, 0).count() == 0
    data = spark.range(3000).select((F.col("id") % 3).alias("scope"), F.col("id").alias("event_id"), F.concat(F.lit("v"), "id").alias("v"))
    log.append(data.filter("event_id < 1500"))
    log.append(data.filter("event_id >= 1500"))
    for scope, after, limit in ((0, -1, 50), (1, 700, 120), (2, 1400, 200), (2, 2990, 100), (1, 5000, 10), (9, 0, 10)):
        want = [k for k in range(3000) if k % 3 == scope and k > after][:limit]
        assert [r.event_id for r in log.page(scope, after, limit).collect()] == want
        assert len(log.files_after(scope, after, limit)) <= 2 + 2 * (limit // 100 + 1) < len(log.zones()) / 2
    for k in range(6):
        log.append(spark.createDataFrame([(0, 3000 + k, "w")], "scope bigint, event_id bigint, v string"))
    assert log.version() == 8 and log.read().count() == 3006 and len(log.zones()) <= 32  # the eighth batch merged all
    assert [r.event_id for r in log.page(0, 2990).collect()] == [2991, 2994, 2997, 3000, 3001, 3002, 3003, 3004, 3005]


def test_content_search_filters(spark):
    from brambling.operators import documents

    files = spark.createDataFrame([("/w/a.md", "x\n  Hit \r\nhit"), ("/w/b.MD", "hit"), ("/w/.git/c.md", "hit"), ("/w2/d.md", "hit"), ("/w/big.md", "hit" * 10), ("/w/.md", "hit"), ("/w/k.pem", "hit")], "path string, content string")
    got = lambda **how: [(r.path, r.line_no, r.line) for r in documents.search_content(files, "hit", "/w", **how).collect()]
    assert got(file_types=".md", largest=20) == [("/w/a.md", 2, "Hit"), ("/w/a.md", 3, "hit")]
    assert got(file_types=".md", largest=20, case_sensitive=True) == [("/w/a.md", 3, "hit")]
    assert [x[0] for x in got()] == ["/w/.md", "/w/a.md", "/w/a.md", "/w/b.MD", "/w/big.md"] and len(got(most=2)) == 2
