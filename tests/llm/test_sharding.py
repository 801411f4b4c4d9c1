"""Operator 4: the law for many numbers of shards, weights, hot rows, and SQL."""

import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from brambling.llm import sharding
from brambling.llm.queries import ORACLE_SQL


def test_one_more_shard_takes_rows_only_into_itself(spark):
    keys = spark.range(3000).withColumn("d", sharding.draws(F.col("id"), 13))
    at = keys.select(*[sharding.descend(F.slice("d", 1, n)).alias(f"n{n}") for n in range(1, 14)]).toPandas()
    for n in range(1, 13):
        before, after = at[f"n{n}"], at[f"n{n + 1}"]
        assert set(after[before != after]) == {n} and before.between(0, n - 1).all()
        assert after.value_counts().between(3000 / (n + 1) * 0.7 - 15, 3000 / (n + 1) * 1.3 + 15).all()


def test_weights_move_rows_of_their_own_subtree_only(spark):
    keys = spark.range(4000).withColumn("key", F.col("id"))
    for weights in ({5: 3.0}, {5: 0.0}):
        rows = sharding.assign(sharding.assign(keys, F.col("key"), 8, "a"), F.col("key"), 8, "b", weights).toPandas()
        moved = rows[rows.a != rows.b]
        assert len(moved) and ((moved.a == 5) | (moved.b == 5)).all()
        assert abs((rows.b == 5).mean() - weights[5] / (7 + weights[5])) < 0.03


def test_repeated_rows_each_get_a_slot(spark, monkeypatch):
    monkeypatch.setattr(sharding, "REPEATS", 64)
    rows = [(None, "é")] * 500 + [(7, None)] * 3 + [(k, "é" * (k % 3)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("shard", "slot", "size", "_sh_n")})
    got = sharding.shard_documents(docs).toPandas()
    assert len(got) == len(rows) and all(sorted(s.slot) == list(range(len(s))) for _, s in got.groupby("shard"))
    got["doc_id"] = got.doc_id.fillna(-1)
    want = sorted((-1 if d is None else d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted(got[["doc_id", "size", "text_crc32"]].itertuples(index=False, name=None)) == want


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_equal_to_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '/root/testdata/{sf}/documents.parquet'")
    columns = "doc_id, size, text_crc32, law, shard, slot, grown_shard"
    want = con.sql(f"select {columns} from ({ORACLE_SQL['op4_sharding']})").fetchall()
    got = sharding.op4_sharding(spark, f"/root/testdata/{sf}").select(*columns.split(", ")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
