"""Operator 9: the program against its bound and best fit, pieces against the library, many stretches of ranks."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from brambling.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def held(plan):
    out = Counter()
    for items, copies in plan.items():
        assert sum(items) <= 1024 and copies > 0
        out.update({x: c * copies for x, c in Counter(items).items()})
    return out


def test_program_is_near_its_bound_and_no_worse_than_best_fit():
    rng = np.random.default_rng(7)
    for gap, draws in ((packing.GAP, np.clip(rng.lognormal(5, 1, 3000).astype(int), 1, 1023)), (packing.GAP, rng.choice([210, 330, 340, 350, 520], 2000))):
        need = Counter(draws.tolist())
        amounts, lower = packing.fractional_configurations(need, 1024)
        assert lower <= sum(amounts.values()) <= lower * (1 + gap) * (1 + 1e-9)
        covered = Counter()
        for items, amount in amounts.items():
            for x in items:
                covered[x] += amount
        assert all(covered[x] >= n * (1 - 1e-6) for x, n in need.items())
        got = packing.plan(need)
        assert held(got) == need and lower <= sum(got.values()) + 1e-6 and sum(got.values()) <= sum(packing._best_fit(need, 1024).values())
        by_program, left = packing._rounded(need, amounts, 1024)
        assert held(by_program) + left == need and sum(by_program.values()) > 0.5 * sum(got.values())


@pytest.mark.parametrize("need,most", [({k: 10 for k in range(1, 1024)}, 5115), ({600: 1, 300: 1}, 1), ({1000: 1, 20: 1}, 1), ({700: 1, 500: 1, 400: 1}, 2), ({k: 1 for k in range(1, 1024)}, 512)])
def test_the_bound_is_met(need, most):
    got = packing.plan(need)
    assert held(got) == Counter(need) and sum(got.values()) == most
    taken, _ = packing._rounded(Counter(need), packing.fractional_configurations(need, 1024)[0], 1024)
    assert taken  # the program gives sequences however few pieces there are


def test_never_more_than_best_fit():
    for seed in range(12):
        rng = np.random.default_rng(seed)
        lengths = [rng.integers(1, 1024, 400), rng.integers(200, 700, 700), np.clip(rng.lognormal(5 + seed / 8, 1, 2500).astype(int), 1, 1023), rng.choice(rng.integers(1, 1024, 6), 500)][seed % 4]
        need = Counter(lengths.tolist())
        got = packing.plan(need)
        assert held(got) == need and sum(got.values()) <= sum(packing._best_fit(need, 1024).values())


def test_program_beats_best_fit_where_that_is_poor():
    need = Counter({520: 600, 272: 600, 264: 600, 240: 1200})  # 900 sequences are enough, best fit takes 1100
    assert sum(packing._best_fit(need, 1024).values()) == 1100
    assert sum(packing.plan(need).values()) <= 930


@pytest.mark.parametrize("need", [{}, {1: 1}, {1023: 3}, {512: 5}, {1024: 4}, {1: 5000}])
def test_small_histograms(need):
    assert held(packing.plan(need)) == Counter({k: v for k, v in need.items() if k < 1024})


def test_pieces_equal_the_library(spark, monkeypatch):
    from tokenizers import Tokenizer

    rng, fresh = random.Random(1), Tokenizer.from_file(PATH)
    texts = [None, "", "x"] + [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 5, 40, 400, 2500]))) for _ in range(60)] + [""] * 300
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts)]
    monkeypatch.setattr(packing, "RANK_ROWS", 40)  # empty texts fill many stretches
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("length", "piece", "_pk_row", "sequence_id")}).repartition(3)
    got = packing.pack_documents(docs, PATH).toPandas()
    want = []
    for doc, text in rows:
        ids = fresh.encode(text or "", add_special_tokens=False).ids + [2]
        size, at, piece = len(ids) % 1024 or 1024, 0, 0
        while at < len(ids):
            want.append((-1 if doc is None else doc, piece, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())))
            at, size, piece = at + size, 1024, piece + 1
    got["doc_id"] = got["doc_id"].fillna(-1).astype(int)
    assert sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 1024
    assert got.sequence_id.nunique() <= 1 + sum(packing._best_fit(Counter(x[3] for x in want), 1024).values())


def test_documents_need_no_more_sequences_than_by_best_fit(spark):
    pieces = packing.cut_pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), PATH)
    need = Counter({r["length"]: r["count"] for r in pieces.groupBy("length").count().filter("length < 1024").collect()})
    assert sum(packing.plan(need).values()) <= sum(packing._best_fit(need, 1024).values())
