"""Growth: state by buckets, tiles of bounded size, words that aren't shuffled, manifests by parts."""

from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from brambling.streaming import keyed


class _Held:
    """A state and its timers as a processor sees them, with the times it was read or written."""

    def __init__(self):
        self.values, self.timers, self.calls = {}, set(), 0

    def _state(self, name, schema):
        return SimpleNamespace(exists=lambda: name in self.values, get=lambda: self.seen(self.values[name]), put=lambda v: self.set(name, v), update=lambda v: self.set(name, v), clear=lambda: self.values.pop(name, None))

    getListState = getValueState = _state

    def seen(self, value):
        self.calls += 1
        return value

    def set(self, name, value):
        self.calls += 1
        self.values[name] = value

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def fire(self, processor, now):
        """Rows of all timers due, as a micro-batch with this watermark has them."""
        out = []
        for at in sorted(t for t in self.timers if t <= now):
            self.timers.discard(at)
            out += [tuple(r) for d in processor.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: now), SimpleNamespace(getExpiryTimeInMs=lambda at=at: at)) for r in d.itertuples(index=False)]
        return out


def _rows(processor, frame):
    return [tuple(r) for d in processor.handleInputRows((0,), iter([frame]), None) for r in d.itertuples(index=False)]


def test_a_bucket_of_revisions_is_read_and_written_once():
    held, processor = _Held(), keyed.RevisionProcessor(keep=10.0)
    processor.init(held)
    n = 500
    made = pd.DataFrame({"key": range(n), "op": "create", "at": [float(k + 1) for k in range(n)], "seq": range(n), "expected": 1, "content": "c"})
    assert len(_rows(processor, made)) == n and held.calls <= 2
    gone = made.assign(op=["delete" if k < 2 else "update" for k in range(n)], at=made["at"] + 1000, seq=made["seq"] + n)
    assert {r[2] for r in _rows(processor, gone)} == {"deleted", "updated"} and len(held.timers) == 1
    held.fire(processor, 1_011_000)  # the first that was deleted is forgotten, the second isn't due
    assert len(held.values["rows"]) == n - 1 and held.timers == {1_012_000}
    assert [r[2] for r in _rows(processor, made.head(2).assign(seq=[2 * n, 2 * n + 1]))] == ["created", "gone"]


def test_a_bucket_of_approvals_has_one_timer():
    held, processor = _Held(), keyed.ApprovalProcessor(keep=10.0)
    processor.init(held)
    n = 300
    asked = pd.DataFrame({"approval_id": range(n), "kind": "request", "at": [float(k + 1) for k in range(n)], "seq": range(n), "ttl": 1000.0, "decision": None, "decided_by": None})
    assert len(_rows(processor, asked)) == n and held.calls <= 2 and held.timers == {1_001_000}
    decided = asked.head(1).assign(kind="decision", at=500.0, seq=n, decision="approved", decided_by="o")
    assert _rows(processor, decided) == [(0, "approved", 500.0, "o")]
    assert held.fire(processor, 1_002_500) == [(1, "expired", 1002.0, None)] and held.timers == {1_003_000}
    held.fire(processor, 1_011_001)  # the first is forgotten ten seconds later, the others up to now expire
    assert 0 not in {r[0] for r in held.values["approvals"]} and {r[1] for r in held.values["approvals"] if r[0] < 11} == {"expired"}
    assert held.fire(processor, 2_000_000)[-1] == (n - 1, "expired", 1300.0, None) and not held.values.get("approvals") and not held.timers


def test_a_block_pair_holds_no_more_than_a_tile(monkeypatch):
    """A task's memory doesn't grow with queries times rows of a batch."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from brambling.operators import texts

    rng = np.random.default_rng(3)
    n, pack = texts.BLOCK_ROWS, lambda i, v: (i.astype(np.int64).tobytes(), v.tobytes())
    blocks = [(k, *pack(np.arange(k * n, (k + 1) * n), rng.random((n, 8)))) for k in range(6)]
    pairs = (pa.RecordBatch.from_pydict({"x_ids": [x[1]], "x_v": [x[2]], "block": [q[0]], "q_ids": [q[1]], "q_v": [q[2]]}, pa.schema([("x_ids", pa.binary()), ("x_v", pa.binary()), ("block", pa.int64()), ("q_ids", pa.binary()), ("q_v", pa.binary())])) for x in blocks for q in blocks)
    tracemalloc.start()
    got = pa.Table.from_batches(list(texts._nearest(3)(pairs))).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * n * n < (6 * n) ** 2 * 8  # all queries against a batch were 8 bytes a cell
    assert len(got) == 18 * n and (got.groupby("query_id").d2.min() == 0).all()


def test_queries_do_not_pass_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from brambling.operators import texts

    vectors = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(3000)], "vec_id long, embedding array<float>")
    whole = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: pytest.fail("collected") if {"query_id", "v"} & set(self.columns) else whole(self))
    assert texts.top_k_many(vectors, vectors.selectExpr("vec_id AS query_id", "embedding"), 2).count() == 6000


def test_a_text_is_lowered_once_for_all_keywords(spark):
    from brambling.functions import text as tx

    rows = spark.createDataFrame([(1, "PLAN a Wbs"), (2, None), (3, "Agent"), (4, "our research paper, the PLAN")], "k int, t string")
    got = rows.select("k", tx.intent(F.col("t")).alias("a"), tx.keyword_hits(F.col("t"), ["Plan", "WBS", "no"]).alias("h"))
    assert [(r.a, r.h) for r in got.orderBy("k").collect()] == [("pwa", ["Plan", "WBS"]), (None, []), (None, []), ("researcher", ["Plan"])]
    plan = rows.select(tx.intent(F.col("t")).alias("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(t") == 1


def test_a_gram_is_digested_once_for_a_group_of_texts(monkeypatch):
    from brambling.functions import embed

    seen = []
    monkeypatch.setattr(embed, "md5", lambda b, real=embed.md5: seen.append(b) or real(b))
    got = embed.hashed_vectors(["a b a b", None, "B a", "", "a  b\na"], 8)
    assert sorted(seen) == [b"a", b"a b", b"b", b"b a"] and got.shape == (5, 8) and not got[1].any()
    assert [list(v) for v in got] == [embed.hashed_vector(t, 8) for t in ("a b a b", None, "B a", "", "a  b\na")]
    monkeypatch.setattr(embed, "GROUP_WORDS", 2)
    assert (embed.hashed_vectors(["a b a b", None, "B a", "", "a  b\na"], 8) == got).all()


def test_words_of_an_index_are_not_shuffled(spark):
    from brambling.plans import catalog

    docs = spark.createDataFrame([(k, f"a b a {k} b") for k in range(50)] + [(99, None)], "doc_id long, text string")
    got = catalog._index_roundtrip(docs)
    assert {r.doc_id: r.text for r in got.collect()} == {k: f"a b a {k} b" for k in range(50)}
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_an_upload_names_its_parts_only(spark, tmp_path):
    import os

    from brambling.sources import uploads

    home = str(tmp_path / "up")
    uploads.upload(spark.range(400).selectExpr("'data' AS collection", "concat('f', id, '.md') AS name", "concat('text ', id) AS content").repartition(4), home)
    (name,) = [f for f in os.listdir(f"{home}/manifests") if f.endswith(".json")]
    assert len(open(f"{home}/manifests/{name}").readlines()) == 4 and uploads.manifest(spark, home).count() == 400
    got = uploads.uploaded(spark, home)
    assert "binaryFile" not in got._jdf.queryExecution().executedPlan().toString()  # that reader lists every file in the driver
    gone = got.first()["stored"]
    os.remove(f"{home}/{gone}")
    again = {r["stored"]: r["content"] for r in got.collect()}
    assert len(again) == 400 and [k for k, v in again.items() if v is None] == [gone]


def test_requests_are_shuffled_once(spark):
    from brambling.plans import services

    plan = services.delete_requests(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "hashpartitioning(id" in plan  # requests, and rows if they aren't broadcast


def test_documents_of_one_file_are_embedded_by_many_tasks(spark, tmp_path):
    from brambling.operators import texts

    spark.range(200).selectExpr("id AS doc_id", "'s' AS source", "concat('a ', id) AS text").coalesce(1).write.parquet(str(tmp_path / "d"))
    got = texts.chunks(spark.read.parquet(str(tmp_path / "d")), chunker=texts.by_lines)
    assert got.select(F.spark_partition_id()).distinct().count() > 1 and got.count() == 200


def _against_sql(spark, name, folder, docs):
    """A query's rows and those of its SQL over documents of a few rows."""
    import duckdb

    from brambling.plans import catalog, services  # noqa: F401  it adds its queries

    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    got = catalog.QUERIES[name](spark, str(folder))
    return sorted(map(str, map(tuple, got.collect()))), sorted(map(str, con.sql(f"select {', '.join(got.columns)} from ({catalog.ORACLE_SQL[name]})").fetchall()))


def test_collections_hold_every_document(spark, tmp_path):
    odd = [(0, "a\n\nb c", "s"), (0, "a", None), (4, " \n", "s"), (4, "", "s"), (1, "\u00a0\u3000\nx\n\t", "s"), (2, "", "s"), (2, None, "s"), (-1, "y", "s"), (None, "z\nz", "s"), (None, "z", "t")]
    got, want = _against_sql(spark, "rebuilt_collections", tmp_path, odd)
    assert got == want and len(got) == 5  # no document of a third user, one user's are blank, others have an id below nought or none


def test_the_third_upload_fails_and_leaves_nothing(spark, monkeypatch):
    import os

    from brambling.plans import services
    from brambling.sources import uploads

    asked, real = [], uploads.upload
    monkeypatch.setattr(uploads, "upload", lambda files, home, by="": asked.append((by, files.count(), home)) or real(files, home, by))
    got = services.upload_round_trip(spark, "/root/testdata/sf0.001")
    assert [(by, n) for by, n, _ in asked] == [("u0", 100), ("u1", 100), ("u2", 201)]
    assert {(r.uploaded_by, r["count"]) for r in got.groupBy("uploaded_by").count().collect()} == {("u0", 100), ("u1", 100)}
    home = asked[2][2].removeprefix("file://")
    assert [len(os.listdir(f"{home}/{folder}")) for folder in ("batches", "parts", "manifests")] == [2, 2, 2]
    with pytest.raises(RuntimeError, match="was uploaded"):
        services._refused(spark.createDataFrame([("data", "f.md", "x")], "collection string, name string, content string"), asked[2][2], "u2")


def test_grams_are_digested_by_arrays(monkeypatch):
    import random

    from brambling.functions import embed

    rng, parts = random.Random(3), ["a", "B", "é", "Σ", "漢字", "😀", "\t", "y" * 54, "z" * 55, "q" * 56, "w\r", " ", "  ", "\n", " \n"]
    odd = [None, "", " ", "\n\n", "one " * 9, *["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(400)]]
    alone = [embed.hashed_vector(t, 16) for t in odd]
    monkeypatch.setattr(embed, "MANY_WORDS", 0)
    seen = []
    monkeypatch.setattr(embed, "md5", lambda b, real=embed.md5: seen.append(b) or real(b))
    assert embed.hashed_vectors(odd, 16).tolist() == alone
    assert seen and all(len(b) > 55 for b in seen)  # the others are digested many at a time


def test_equal_lines_are_embedded_and_searched_once(spark, monkeypatch):
    import random

    import numpy as np

    from brambling.operators import texts

    docs = spark.range(300).selectExpr("id AS doc_id", "'s' AS source", "concat('line ', id % 30, '\nother ', id % 3) AS text")
    built = texts.chunks(docs, chunker=texts.by_lines)
    assert built.select("text", F.spark_partition_id()).distinct().count() == 33  # a line is in one task
    rows = built.select((F.col("doc_id") * 10 + F.col("chunk_no")).alias("_id"), F.col("embedding").alias("_v"))
    held = texts._blocks(rows, "ids", "v", 5).collect()
    ids = np.concatenate([texts._table(np.frombuffer(r["ids"], np.int64), len(r["v"]) // 512, 5) for r in held])
    assert len(ids) == 33 and sorted(ids[:, 0]) == [5] * 33 and sum(len(r["v"]) for r in held) == 33 * 64 * 8
    assert {tuple(r[1:]) for r in ids} == {tuple((30 * j + k) * 10 for j in range(5)) for k in range(30)} | {tuple((3 * j + k) * 10 + 1 for j in range(5)) for k in range(3)}
    rng = random.Random(4)
    of = {k: [rng.choice((0.0, 1e-3, 1.0)) * scale for _ in range(3)] for scale in (1.0, 1e25, 1e-25) for k in range(int(scale > 1) * 100 + int(scale < 1) * 200, int(scale > 1) * 100 + int(scale < 1) * 200 + 100)}
    vectors = spark.createDataFrame(list(of.items()), "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(texts, "TILE_NUMBERS", 64)
    monkeypatch.setattr(texts, "PAIRS", 50)
    got = texts.top_k_many(vectors, vectors.selectExpr("vec_id AS query_id", "embedding"), 4).orderBy("query_id", "rank").collect()
    want = {q: sorted((sum((a - b) ** 2 for a, b in zip(v, of[q])), k) for k, v in of.items())[:4] for q in of}
    assert {q: [(r.d2, r.vec_id) for r in got if r.query_id == q] for q in of} == want
