"""Queries over platform tables against a second engine, and the behaviour behind them."""

import hashlib
import json

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brambling import functions as fn
from brambling import streaming
from brambling.functions import checks
from brambling.operators import approvals, collections, journal, merge
from brambling.plans import catalog, platform
from brambling.sources import normalise_crossref, normalise_openalex, state

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n, f in catalog.QUERIES.items() if f.__module__ == platform.__name__]


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("null" if pd.isna(v) else str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = rows(catalog.QUERIES[name](spark, SF).toPandas()), rows(con.sql(catalog.ORACLE_SQL[name]).df())
    norm = lambda x: [tuple(v[:-2] if v.endswith(".0") else v for v in r) for r in x]
    assert norm(got) == norm(want) and got


def test_fingerprint_equals_sorted_json(spark):
    args = {"b": 'x "y"\n漢', "a": "1"}
    frame = spark.createDataFrame([("run", {k: json.dumps(v, ensure_ascii=False) for k, v in args.items()})], "tool string, args map<string,string>")
    want = hashlib.sha256(json.dumps({"tool": "run", "args": args}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    assert frame.select(approvals.fingerprint(F.col("tool"), F.col("args"))).first()[0] == want


def test_paths(spark):
    paths = ["/data", "/data/x", "/data2/x", "/data/.env", "/data/.ENV.local", "/a/Secrets/b", "/a/key.PEM", "/a/b.md"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", checks.is_within(F.col("p"), F.lit("/data/")), checks.is_sensitive(F.col("p"))).collect()
    assert [tuple(r)[1:] for r in got] == [(True, False), (True, False), (False, False), (True, True), (True, True), (False, True), (False, True), (False, False)]
    import fnmatch

    names = ["a.md", "ab.md", "a[.md", "b.txt", ".md", "a\n.md"]
    for glob in ("*.md", "?.md", "[ab].*", "[!a]*", "a[[].md", "*"):
        got = spark.createDataFrame([(n,) for n in names], "n string").filter(checks.matches_glob(F.col("n"), glob)).collect()
        assert sorted(r.n for r in got) == sorted(n for n in names if fnmatch.fnmatchcase(n, glob)), glob


def test_lines_and_markup(spark):
    one = spark.range(1)
    assert one.select(checks.read_lines(F.lit("a  \nb\nc\n"), 2, 1)).first()[0] == "     2\tb"
    assert one.select(checks.read_lines(F.lit("a  \nb"), 0, 9999)).first()[0] == "     1\ta\n     2\tb"
    assert one.select(checks.inline_markdown(F.lit("<a> `x` **b** [t](u) ![i](s)"))).first()[0] == '&lt;a&gt; <code>x</code> <strong>b</strong> <a href="u" target="_blank" rel="noopener">t</a> <img alt="i" src="s">'
    assert [checks.clamp(n, "events") for n in (-1, 0, 7, 10_000)] == [1, 1, 7, 500]


def test_scalars_beyond_the_first_plane(spark):
    r = spark.range(1).select(fn.djb2(F.lit("a😀")), fn.djb2(F.lit("abc")), fn.search_terms(F.lit("what is the？ a b")), fn.search_terms(F.lit("a ?？"))).first()
    assert tuple(r) == (195366243, 193485963, ["what", "the"], ["待生成具体检索词"])


def test_decisions_and_revoked_grants(spark):
    have = spark.createDataFrame([("a", "pending", 10), ("b", "pending", 10), ("c", "denied", 10), ("d", "pending", 10)], "id string, status string, expires_at int")
    made = spark.createDataFrame([("a", "approved", "x", 5), ("a", "denied", "y", 6), ("b", "approved", "x", 10), ("c", "approved", "x", 5), ("z", "approved", "x", 5)], "id string, decision string, decided_by string, decided_at int")
    got = {r.id: (r.status, r.decided_by) for r in approvals.decide(have, made, "id", F.lit(0)).collect()}
    assert got == {"a": ("approved", "x"), "b": ("expired", "x"), "c": ("denied", None), "d": ("pending", None)}


def test_migration_is_idempotent_and_metadata_spreads(spark):
    log = spark.createDataFrame([(1, "c", "user/message", '{"message_id": "m1", "role": "user", "content": "hi", "metadata": {"role": "boss", "k": "v"}}', 1.0), (2, "c", "conversation.created", "{}", 1.0)], "event_id long, conversation_id string, event_type string, payload_json string, created_at double")
    legacy = spark.createDataFrame([("m1", "c", "user", "hi", "{}", 1.0), ("m2", "c", "assistant", "yo", '{"k": "w"}', 2.0), ("m2", "c", "assistant", "yo", '{"k": "w"}', 2.0)], "message_id string, conversation_id string, role string, content string, metadata_json string, created_at double")
    new = journal.migrated(log, legacy)
    assert [r.event_type for r in new.collect()] == ["assistant/message"]
    assert journal.migrated(log.unionByName(new, allowMissingColumns=True), legacy).count() == 0
    got = journal.messages(log, ["role", "k"]).collect()
    assert [(r.id, r.role, r.content, r.k) for r in got] == [("m1", "boss", "hi", "v")]


def test_store(spark, tmp_path):
    store, data = collections.Store(spark, str(tmp_path)), spark.range(3)
    with pytest.raises(collections.CollectionNotBuilt):
        store.read("public")
    assert store.read("private", "u") is None
    assert store.rebuild("public", data) and not store.rebuild("public", data.limit(0)) and store.read("public").count() == 3
    before = store.read("public")
    assert store.rebuild("public", data.limit(1)) and store.read("public").count() == 1 and before.count() == 3
    assert store.rebuild("private", data, "u") and not store.rebuild("private", data.limit(0), "u") and store.read("private", "u") is None
    scope = spark.createDataFrame([(["data:search"], "data"), (["novel:search"], "novel"), ([], "public")], "scope array<string>, collection string")
    assert [r[0] for r in scope.select(collections.in_scope(F.col("scope"), F.col("collection"))).collect()] == [True, False, False]


def test_empty_lists_never_win(spark):
    new = spark.createDataFrame([("k", 1, ["a"], 5, "open"), ("k", 2, [], None, "unknown")], "key string, seq int, authors array<string>, cites long, oa string")
    assert tuple(merge.merge_filled(new, "key", F.col("seq"), ["authors", "cites"], ["oa"]).first()) == ("k", ["a"], 5, "unknown")


def test_response_shapes(spark):
    items = spark.read.json(spark.sparkContext.parallelize([json.dumps({"DOI": "https://doi.org/10.1/X", "title": ["T"], "abstract": None, "author": [{"given": "A", "family": "B"}, {"given": "", "family": "C"}, {"given": "", "family": ""}], "published": {"date-parts": [[2024, 3]]}, "URL": "", "type": "t", "indexed": {"date-time": "d"}, "is-referenced-by-count": 4})]))
    r = normalise_crossref(items).first()
    assert (r.source_id, r.doi, r.title, r.abstract, r.authors, r.published, r.landing_url, r.updated, r.citation_count) == ("10.1/x", "10.1/x", "T", "", ["A B", "C"], "2024-3", "https://doi.org/10.1/x", "d", 4)
    schema = "id string, doi string, ids struct<arxiv:string>, title string, abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<display_name:string>>>, publication_date string, primary_location struct<landing_page_url:string>, open_access struct<is_oa:boolean,oa_url:string>, type string, updated_date string, cited_by_count long"
    works = spark.createDataFrame([("https://x/W1", None, ("https://arxiv.org/abs/2401.1",), None, {"b": [1], "a": [0, 2]}, [(("N",),), (("",),)], None, None, (True, None), None, None, 3), ("https://x/W2", "https://doi.org/10.2/y", None, "t", None, None, "2024", ("u",), None, "a", "b", None)], schema)
    a, b = normalise_openalex(works).orderBy("source_id").collect()
    assert (a.source_id, a.arxiv_id, a.abstract, a.authors, a.landing_url, a.oa_status, a.citation_count) == ("W1", "2401.1", "a b a", ["N"], "https://x/W1", "open", 3)
    assert (b.doi, b.arxiv_id, b.abstract, b.authors, b.landing_url, b.oa_status) == ("10.2/y", "", "", [], "u", "closed_or_unknown")


def test_harvest_moves_on_after_success_only(spark, tmp_path):
    runs = spark.createDataFrame([("a", "ok", 1, "2024-01-01"), ("a", "error", 2, "2024-02-01"), ("b", "error", 1, "2024-01-01")], "source string, status string, seq int, day string")
    points = state.checkpoints(runs)
    later = state.checkpoints(spark.createDataFrame([("a", "ok", 3, "2024-03-01")], runs.schema), points)
    assert [tuple(r) for r in points.collect()] == [("a", "2024-01-01")] and [tuple(r) for r in later.collect()] == [("a", "2024-03-01")]
    state.write_report(spark.createDataFrame([("a", "ok", 3, 1)], "source string, status string, received int, new_works int"), str(tmp_path / "r"))
    assert state.read_report(spark, str(tmp_path / "r")).first().received == 3


def test_stream_merges_over_batches(spark, tmp_path):
    data = spark.range(400).select((F.col("id") % 20).alias("k"), F.col("id").alias("seq"))
    for n in range(5):
        data.filter(f"seq div 80 = {n}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    keep = lambda d: merge.newest_n(d, ["k"], "seq", 2)
    query = streaming.merge_stream(stream, str(tmp_path / "t"), str(tmp_path / "c"), keep, ["k"])
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 5
    held = streaming._held(spark, str(tmp_path / "t"), 5, None, data.schema)
    assert sorted(map(tuple, held.collect())) == sorted((k, s) for k in range(20) for s in (360 + k, 380 + k))


def test_cursor_pages(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("n"), F.concat(F.lit("v"), "id").alias("v")).repartition(3).write.parquet(str(tmp_path / "log"))
    stream = streaming.cursor_stream(spark, str(tmp_path / "log"), cursor="n", after=99, size=250, columns={"v": "string"})
    got = streaming.merged(stream, lambda d: d.dropDuplicates(["n"]), ["n"], every="0 seconds")
    assert got.count() == 900 and got.agg(F.min("n"), F.max("n")).first()[:] == (100, 999) and got.filter("v <> concat('v', n)").count() == 0
