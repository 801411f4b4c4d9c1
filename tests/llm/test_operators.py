"""Operators against brute force, exact round trips and held-out labels; edge rows for each."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from brambling.llm import bitplane, linededup, media, neardup, packing, quality, sentencepiece_trie, sharding, tokens, vptree
from brambling.llm import htmlmain as hm

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{k % 977}" for k in range(20_000))
EDGE = [(1, None), (2, ""), (3, "one"), (4, LONG), (5, "same text here and there again"), (6, "same text here and there again"), (6, "same text here and there again"), (None, "no id  at all \n é漢😀")]


@pytest.fixture(scope="module")
def edge(spark):
    docs = spark.createDataFrame(EDGE, "doc_id long, text string")
    return docs.withColumns({"shard": F.lit("clash"), "length": F.lit(1), "label": F.lit(2), "lang": F.lit(None).cast("string"), "source": F.lit("s")})


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


@pytest.mark.parametrize("kind,file", [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")])
def test_units_equal_the_library(kind, file):
    import pyarrow as pa

    rng = random.Random(3)
    alpha = list("ab AB  \n\t.,!'s$#1éΣςİ漢😀\xa0 \x1c") + ["don't ", "it's", "<|endoftext|>"]
    texts = ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["", "x" * 3000]
    enc = tokens.UnitEncoder(public_tokenizers.path(file), kind)
    want = [x.ids for x in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in enc.encode(pa.array(texts))] == want


@pytest.mark.parametrize("kind,file", [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")])
def test_added_tokens_equal_a_fresh_library(kind, file):
    import pyarrow as pa
    from tokenizers import Tokenizer

    fresh, rng = Tokenizer.from_file(public_tokenizers.path(file)), random.Random(4)
    alpha = list("ab A .,!|<>é漢\n") + ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|STARTOFTEXT|>", "<|endoftext", "|>", "don't "]
    texts = ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["a <|endoftext|> b", "<|ENDOFTEXT|>"]
    want = [x.ids for x in fresh.encode_batch(texts, add_special_tokens=False)]
    assert fresh.token_to_id("<|endoftext|>") in want[-2] and fresh.token_to_id("<|endoftext|>") not in want[-1]
    assert [x.tolist() for x in tokens.UnitEncoder(public_tokenizers.path(file), kind).encode(pa.array(texts))] == want


def test_blocks_round_trip():
    for mode in ("bit", "byte"):
        for ids in (np.zeros(0, "<u4"), np.zeros(5, "<u4"), np.arange(70_001, dtype="<u4") * 61):
            assert (bitplane.unpack_block(bitplane.pack_block(ids, mode)) == ids).all()


def test_token_planes(spark, edge, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    bitplane.write_token_planes(edge, str(tmp_path / "a"), path, block=1000, files=2)
    got = bitplane.read_token_planes(spark, str(tmp_path / "a")).orderBy("start").collect()
    enc = tokens.UnitEncoder(path, "word")
    at = 0
    for (doc, text), r in zip(sorted(EDGE, key=lambda x: -1 if x[0] is None else x[0]), got):
        ids = enc.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens) == (doc, at, len(ids)) and np.frombuffer(r.ids, "<u4").tolist() == ids
        at += len(ids)
    bitplane.write_token_planes(empty, str(tmp_path / "b"), path, files=2)
    assert bitplane.read_token_planes(spark, str(tmp_path / "b")).count() == 0


def test_packing(spark, edge, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    p = packing.pack_documents(edge, path).toPandas()
    assert len(p) == len(p.drop_duplicates(["sequence_id", "offset"])) and p.groupby("sequence_id").length.sum().max() <= 1024
    assert sorted(p[p.doc_id == 4].length)[1:] == [1024] * (len(p[p.doc_id == 4]) - 1)
    assert packing.pack_documents(empty, path).count() == 0
    rng = np.random.default_rng(0)
    need = dict(zip(*(x.tolist() for x in np.unique(rng.integers(1, 1024, 5000), return_counts=True))))
    got = packing.plan(need)
    assert sum(v for c, v in got.items() for _ in c) == 5000 and all(sum(c) <= 1024 for c in got)
    assert sum(k * v for k, v in need.items()) / 1024 <= sum(got.values()) <= sum(packing._best_fit(packing.Counter(need), 1024).values())


def test_sharding(edge, empty, spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("é").alias("text"))
    p = sharding.shard_documents(docs).toPandas()
    assert (p.groupby("shard").slot.max() + 1 == p.groupby("shard").size()).all() and p.groupby("shard").size().between(500, 750).all()
    assert set(p[p["shard"] != p.grown_shard].grown_shard) == {8} and set(p["size"]) == {3} and set(p.text_crc32) == {zlib.crc32("é".encode())}
    assert sharding.shard_documents(edge).count() == len(EDGE) and sharding.shard_documents(empty).count() == 0


def test_media(edge, empty):
    got = {r.doc_id: r for r in media.store_documents(edge).mapInArrow(media._features, media.FEATURES).collect()}
    assert got[1].payload_bytes == 192 and got[1].payload_sha256 == hashlib.sha256(b" " * 192).hexdigest() and got[3].media_type == "audio/wav"
    assert media.store_documents(empty).count() == 0
    wav = media.as_wav(b"RIFFGIF89aBM" + b"x" * 180)
    outer = media.as_wav(b"ab" + wav + b"%PDF-x")
    assert media.sniff(outer) == ("audio/wav", [("audio/wav", 46, len(wav))]) and media.sniff(None) == (None, []) and media.sniff(outer[:-1])[0] != "audio/wav"


def _pdf_file(note: bytes, updates: int = 0) -> bytes:
    b = b"%PDF-1.4\n1 0 obj\n" + note + b"\nendobj\n"
    for _ in range(updates + 1):
        b += b"xref\n0 1\ntrailer\n<<>>\nstartxref\n" + str(len(b)).encode() + b"\n%%EOF"
    return b


def test_media_carves_neighbours():
    import io
    import struct
    import zipfile

    def archive(text):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("a.bin", text)
            z.writestr("b.txt", "more")
        return out.getvalue()

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    inner = _pdf_file(b"in")
    cases = {
        "application/zip": [archive("one"), archive("two"), archive(archive("nested")), archive("two")],
        "application/pdf": [_pdf_file(b"one"), _pdf_file(b"one"), _pdf_file(b"two", 2), _pdf_file(b"x" + inner + b"y", 1), b"%PDF-1.4\nstartxref\n0\n%%EOF", _pdf_file(b"one")],
    }
    for kind, objects in cases.items():
        payload, want = b"head", []
        for x in objects:
            for found, part in ((kind, x), ("image/png", png)):
                want.append((found, len(payload), len(part)))
                payload += part + b"--"
        assert media.sniff(payload) == (media.UNKNOWN, want)
        assert all(media.sniff(x)[0] == kind for x in objects) and media.sniff(objects[0] + png + objects[1])[0] == kind
    lost = b"%PDF-1.4\nno end " + _pdf_file(b"two", 1)
    assert media.sniff(b"head" + lost)[1] == [("application/pdf", 20, len(lost) - 16)]


def test_near_duplicates(spark, edge, empty):
    rng = random.Random(5)
    base = [[f"t{rng.randrange(4000)}" for _ in range(300)] for _ in range(6)]
    texts = []
    for b in base:
        for n in range(12):
            t = list(b)
            for _ in range(n % 5):
                t[rng.randrange(300)] = "edit"
            texts.append(" ".join(t))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(296)} for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert dict(neardup.near_duplicate_classes(docs).collect()) == dict(enumerate(label))
    got = neardup.near_duplicate_classes(edge).collect()
    assert len(got) == len(EDGE) and {r.class_id for r in got if r.doc_id in (5, 6)} == {5} and {r.class_id for r in got if r.doc_id in (1, 2)} == {1, 2}
    kept = neardup.drop_near_duplicates(edge).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept) == [-1, 1, 2, 3, 4, 5]
    assert neardup.near_duplicate_classes(empty).count() == 0


def test_equal_texts_leave_one(spark):
    few = "same words here"
    rows = [(1, ""), (2, ""), (3, " "), (4, None), (5, None), (6, few), (None, few), (None, ""), (None, "\t"), (None, "\t"), (None, "only  here"), (None, "only here"), (None, None), (7, "\n"), (8, "\n"), (9, "")]
    docs = spark.createDataFrame([(*r, {"a": "b"}) for r in rows], "doc_id long, text string, more map<string,string>").repartition(3)
    kept = [(r.doc_id, " ".join(r.text.split()) if r.text and r.text.strip() else r.text) for r in neardup.drop_near_duplicates(docs).collect()]
    want = [(1, ""), (3, " "), (4, None), (5, None), (6, few), (7, "\n"), (None, "\t"), (None, "only here"), (None, None)]
    assert sorted(kept, key=str) == sorted(want, key=str)
    classes = neardup.near_duplicate_classes(docs.filter("doc_id is not null")).collect()
    assert all(r.doc_id == r.class_id for r in classes) and len(classes) == 9


def test_likely_misses_less_than_the_bands():
    from math import ceil, comb

    p, t = neardup.SIMILARITY + (1 - neardup.SIMILARITY) / 256, neardup.T
    missed = sum(comb(t, k) * p**k * (1 - p) ** (t - k) for k in range(ceil(neardup.LIKELY * t)))
    assert missed < (1 - neardup.SIMILARITY**neardup.ROWS) ** neardup.BANDS


def test_dart_sketch_estimates_weighted_similarity():
    w1, w2 = np.r_[np.ones(300), np.full(50, 3.0)], np.r_[np.ones(300), np.full(50, 1.0)]
    e = np.arange(350, dtype=np.uint64) * np.uint64(7919)
    s, _ = neardup.dart_sketch(np.repeat([0, 1], 350), np.r_[e, e], np.r_[w1, w2], 2, 1024)
    assert abs((s[0] == s[1]).mean() - 350 / 450) < 0.06


def test_line_dedup(spark, edge, empty):
    run = "\n".join(" ".join(f"r{k}x{j}" for j in range(20)) for k in range(4))
    docs = spark.createDataFrame([(1, "first\n" + run + "\nlast"), (2, "own words\n" + run + "\nown end"), (3, "short\nlines"), (4, "short\nlines"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup_lines(docs).collect()}
    assert got == {1: ("first\n" + run + "\nlast", 0), 2: ("own words\nown end", 4), 3: ("short\nlines", 0), 4: ("short\nlines", 0), 5: (None, 0)}
    out = linededup.dedup_lines(edge)
    assert out.count() == len(EDGE) and "lang" in out.columns and linededup.dedup_lines(empty).count() == 0


def test_quality(spark, edge, empty):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.filter("doc_id % 3 = 0")
    scored = quality.score_table(docs, labels.filter("doc_id % 3 <> 0")).join(held, "doc_id")
    right, n = scored.agg(F.count_if(F.col("keep") == (F.col("quality") == 1)), F.count("*")).first()
    assert right > 0.97 * n
    assert quality.score_table(edge, labels).count() == len(EDGE) and quality.score_table(empty, labels.limit(0)).count() == 0


def test_vantage_points(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    x[10:20] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (None, x[3].tolist())]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = vptree.nearest(v, v.filter("vec_id % 100 = 0 or vec_id = 12")).toPandas()
    for q in (0, 12, 100, 500):
        d = vptree.distances(x, x[q])
        want = [k for _, k in sorted((d[k], k) for k in range(600) if k != q)][:10]
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == want
    tree = vptree.VPTree(x, leaf=8)
    looked = [tree.search(x[5], 10, factor=f)[2] for f in (1, 3)]
    assert looked[1] < looked[0] <= 600
    assert vptree.nearest(v.limit(0), v.limit(0)).count() == 0


def test_pieces_equal_the_library(edge, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, enc = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_trie.TrieEncoder(path)
    rng = random.Random(2)
    texts = [t or "" for _, t in EDGE] + ["".join(rng.choice("abcdehinorst e,.' \né漢") for _ in range(200)) for _ in range(500)]
    got = enc.encode(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [lib.encode(t) for t in texts]
    assert [enc.decode(b) for b in got] == texts
    assert sentencepiece_trie.encode_pieces(edge, path).filter("decodes").count() == len(EDGE) and sentencepiece_trie.encode_pieces(empty, path).count() == 0


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = hm.fit_pages(pages, sample=40)
    html = "<html><head><title>no</title></head><body><nav><ul><li><a href='/x'>menu</a></li></ul></nav><div class=\"ad\">buy</div><article><h1>A &amp; B</h1><p><b>one.<br><p>two  three</p><script>var x='<p>no</p>'</script></article><footer>foot</footer>"
    assert hm.extract(html, model) == "A & B one. two three" and hm.extract(None, model) == "" == hm.extract("", model)
    assert hm.extract_pages(pages, model).count() == pages.count() and hm.extract_pages(pages.limit(0), model).count() == 0
    assert hm.decode([-1, 0, 1, 0], np.array([0.0, -9.0, 1.0, 5.0])).tolist() == [True, False, False, True]


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if k < 3:
            docs = spark.createDataFrame(docs.toPandas(), docs.schema)
            assert docs.columns == columns
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0 and docs.count() > 0


def test_near_duplicates_without_a_centre(spark, monkeypatch):
    """Copies of texts that aren't in the table link among themselves only, whatever the size of a block."""
    rng = np.random.default_rng(5)
    rows = []
    for g in range(4):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
        for _ in range(25):
            t = list(base)
            for x in rng.integers(0, 120, rng.integers(1, 4)):
                t[x] = f"v{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(t)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    label = list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    for block in (1000, 12):
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = neardup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        assert dict(got) == dict(enumerate(label))
