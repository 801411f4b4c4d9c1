"""Queries against a second engine, and the behaviour that the surveyed tests state."""

import duckdb
import pytest
from pyspark.sql import functions as F

from brambling import functions as fn
from brambling.operators import merge, policy, retrieval
from brambling.plans import catalog
from brambling.sources import abstract_from_index

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", ["conversation_snippets", "login_throttle", "grant_match", "merge_nonempty_upsert", "revision_fold", "vector_topk", "grep_lines", "djb2_bucket", "latency_percentiles", "auth_star_join"])
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(catalog.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["inverted_index_whole", "merge_nonempty_whole"])
def test_whole_values_equal_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, column = catalog.QUERIES[name](spark, SF).toPandas(), {"inverted_index_whole": "text", "merge_nonempty_whole": "title"}[name]
    assert rows(got) == rows(con.sql(catalog.ORACLE_SQL[name]).df())
    assert got[column].str.len().max() > 10_000


def test_revision_guard(spark):
    base = spark.createDataFrame([("m", 1, "old")], "k string, revision long, text string")
    deltas = spark.createDataFrame([("m", 1, 2, False, "no"), ("m", 2, 1, False, "yes"), ("m", 3, 2, True, None), ("m", 4, 3, False, "late")], "k string, seq int, expected long, deleted boolean, text string")
    assert [tuple(r) for r in merge.fold_revisions(base, deltas, "k", "seq", ["text"]).collect()] == [("m", "yes", 3, True)]


def test_merge_keeps_what_is_filled(spark):
    new = spark.createDataFrame([("k", 1, "a", 5), ("k", 2, "", None), ("k", 3, None, 7)], "key string, seq int, title string, cites long")
    assert tuple(merge.merge_filled(new, "key", F.col("seq"), ["title", "cites"]).first()) == ("k", "a", 7)


def test_grants(spark):
    grants = spark.createDataFrame([(1, "a", "w1", "active", None, 1), (2, "a", "", "active", None, 2), (3, "a", "w2", "active", 10, 3), (4, "a", "w2", "revoked", None, 4)], "grant_id int, account string, scope string, status string, expires_at int, created_at int")
    asked = spark.createDataFrame([("a", "w1"), ("a", "w2"), ("b", "w1")], "account string, scope string")
    assert {tuple(r) for r in policy.match_grants(asked, grants, "account", "scope", F.lit(50)).collect()} == {("a", "w1", 2), ("a", "w2", 2)}


def test_scalars(spark):
    r = spark.range(1).select(fn.djb2(F.lit("abc")), fn.estimate_tokens(F.lit("abcde漢字x")), fn.clean_doi(F.lit("https://doi.org/DOI:10.1/X ")), abstract_from_index(F.create_map(F.lit("a"), F.array(F.lit(0), F.lit(2)), F.lit("b"), F.array(F.lit(1))))).first()
    assert tuple(r) == (193485963, 3, "10.1/x", "a b a")


@pytest.mark.parametrize("text", ["", "word " * 500, "x" * 3000, "a.b;c\n\n" * 300])
def test_chunks_fit(text):
    got = retrieval.split_text(text, 200, 40)
    assert all(len(c) <= 200 for c in got)
    assert not text.strip() or set("".join(got).split()) and "".join(text.split())[:50] == "".join("".join(got[:1]).split())[:50]
