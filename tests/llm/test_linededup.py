"""Operator 10 against a plain search for repeated runs."""

import random

import pytest
from pyspark.sql import functions as F

from brambling.llm import common, linededup


def plain(rows, least):
    """Lines gone: those in a run of ``least`` words or more that also stands at an earlier place, apart from it."""
    docs = {}
    for doc, text in rows:
        lines = [(k, " ".join(x.split())) for k, x in enumerate(text.split("\n"))] if text else []
        docs[doc, text] = [(k, s, min(len(s.split()), least)) for k, s in lines if s]
    order = sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, linededup_hash[x[1]]))
    gone = {d: set() for d in docs}
    for j, b in enumerate(order):
        for a in order[: j + 1]:
            x, y = docs[a], docs[b]
            for p in range(len(x)):
                for q in range(len(y)):
                    if a == b and p >= q or p and q and x[p - 1][1] == y[q - 1][1]:
                        continue
                    n = 0
                    while p + n < len(x) and q + n < len(y) and x[p + n][1] == y[q + n][1]:
                        n += 1
                    # every shortest run of enough words inside the match, if it is apart from its earlier place
                    for s in range(n):
                        words, e = 0, s
                        while e < n and words < least:
                            words, e = words + y[q + e][2], e + 1
                        for low, high in ((s, e - 1),):
                            if words >= least and (a != b or y[q + low][0] > x[p + high][0]):
                                gone[b] |= set(range(y[q + low][0], y[q + high][0] + 1))
                        words, e = 0, n - 1 - s
                        while e >= 0 and words < least:
                            words, e = words + y[q + e][2], e - 1
                        if words >= least and (a != b or y[q + e + 1][0] > x[p + n - 1 - s][0]):
                            gone[b] |= set(range(y[q + e + 1][0], y[q + n - 1 - s][0] + 1))
    return {d: "\n".join(x for k, x in enumerate(d[1].split("\n")) if k not in gone[d]) if d[1] is not None else None for d in docs}


linededup_hash = {}


@pytest.mark.parametrize("seed,hot", [(1, 100_000), (2, 3)])
def test_against_plain_search(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 3, 7]))) + rng.choice(["", "", " ", "\t"])
    shared = [[line() for _ in range(rng.randint(3, 9))] for _ in range(5)]
    rows = []
    for k in range(24):
        parts = []
        for _ in range(rng.randint(0, 4)):
            run = rng.choice(shared)
            parts += run[rng.randint(0, 2) : rng.randint(3, 9)] if rng.random() < 0.7 else [line() for _ in range(4)]
            parts += [f"own {k} {rng.random()}"] * rng.randint(0, 1)
        rows.append((k // 2 if k % 9 else None, "\n".join(parts)))
    rows = list(dict.fromkeys(rows))
    docs = spark.createDataFrame([*rows, rows[0], (99, None)], "doc_id long, text string").withColumns({"n_removed": F.lit("clash"), "n_lines": F.lit("clash")}).repartition(3)
    linededup_hash.update({r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()})
    got = linededup.dedup_lines(docs, 6).collect()
    want = plain(rows, 6)
    keyed = linededup.cut_lines(docs.withColumn("before", F.col("text")), 6).collect()
    assert len(got) == len(keyed) == len(rows) + 2
    for r in keyed:
        if r.before is not None:
            assert r.text == want[r.doc_id, r.before], (r.doc_id, r.before)
            assert r.n_removed == "clash" and r._ld_removed == r._ld_lines - (len(r.text.split("\n")) if r._ld_removed < r._ld_lines else 0)
    assert any(r.n_removed for r in got) and {r.n_lines for r in got if r.doc_id == 99} == {0}


def test_rows_leave_where_the_minimum_changes(spark):
    text = "\n".join(f"word{k} word word" for k in range(1000))
    lines = linededup._lines(spark.createDataFrame([(1, text)], "doc_id long, text string"), 50, "doc_id", "text")
    assert linededup.fingerprints(lines, 50).count() < 500  # 2,000 windows of 17 lines


def test_equal_to_sql(spark):
    import duckdb

    from brambling.llm.queries import ORACLE_SQL

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(f"select doc_id, text, n_lines, n_removed from ({ORACLE_SQL['op10_line_dedup']})").fetchall()}
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in linededup.op10_line_dedup(spark, sf).collect()}
    assert all(got[k] == v for k, v in want.items()) and all(v[0] in (None, "") for k, v in got.items() if k not in want)
