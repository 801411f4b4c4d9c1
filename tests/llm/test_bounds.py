"""No crash, no hang: hostile payloads, runs of blanks, broken markup, and damaged token files, each within a time."""

import random
import struct
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from brambling.llm import bitplane, media, sentencepiece_trie
from brambling.llm import htmlmain as hm

BOX = lambda kind, data=b"": struct.pack(">I4s", 8 + len(data), kind) + data


def test_cut_headers_confirm_nothing():
    riff = lambda body: struct.pack("<4sI4s", b"RIFF", 4 + len(body), b"WAVE") + body
    short = riff(struct.pack("<4sI", b"fmt ", 0) + struct.pack("<4sI", b"data", 0))
    assert media.sniff(short)[0] == media.UNKNOWN
    for n in range(len(short)):
        media.sniff(b"x" * (192 - n) + short[:n])
    whole = [media.as_wav(b"abc"), BOX(b"ftyp", b"isom") + BOX(b"moov", b"abc"), b"OggS\0" + b"\0" * 21 + b"\1\5hello", b"\x1f\x8b\x08" + b"\0" * 20, b"BM" + b"\0" * 40, b"GIF89a" + b"\xff" * 20, b"\xff\xd8\xff\xe0" + b"\0" * 9]
    for x in whole:
        for n in range(len(x) + 1):
            media.sniff(x[:n])
            media.sniff(b"head" + x[:n])
    assert [media.sniff(x)[0] for x in whole[:3]] == ["audio/wav", "video/mp4", "audio/ogg"]


def test_chains_are_walked_once():
    start = time.time()
    assert media.sniff(BOX(b"ftyp") * 30_000)[0] == media.UNKNOWN
    assert media.sniff(BOX(b"ftyp") * 30_000 + BOX(b"moov"))[0] == "video/mp4"
    page = b"OggS\0" + b"\0" * 21 + b"\0"
    assert media.sniff(b"x" + page * 20_000 + b"OggS\0")[1] == [("audio/ogg", 1, len(page) * 20_000)]
    assert time.time() - start < 10


def test_runs_of_blanks():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, enc = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_trie.TrieEncoder(path)
    rng, start = random.Random(3), time.time()
    texts = [" " * n for n in (1, 2, 3, 17, 2_000, 100_000)] + ["a" + " " * 5_000 + "b  c", "".join(rng.choice([" ", "  ", "   ", "a", "th", "\n"]) for _ in range(3_000))]
    got = [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)]
    assert time.time() - start < 20
    assert got == [lib.encode(t) for t in texts]


def test_unigram_models_are_refused(monkeypatch):
    import sentencepiece

    real = sentencepiece.SentencePieceProcessor

    class Other(real):
        def get_score(self, k):
            return -1.5 * real.get_score(self, k) ** 2 - 0.25

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Other)
    with pytest.raises(ValueError, match="BPE"):
        sentencepiece_trie.TrieEncoder(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.mark.parametrize("page", ["<a b='\"" * 8_000, "<a b='\">" * 8_000, "<a " * 20_000, "<!" * 20_000, "<head>" * 5_000, "<script>" * 5_000, "<div>" * 5_000 + "</p>" * 5_000, "<div>" * 3_000 + "<td></td>" * 3_000, "&" * 50_000, "<" * 50_000])
def test_broken_markup_is_read_in_time(page):
    start = time.time()
    hm.node_features(hm.Page(page))
    assert time.time() - start < 6


def test_markup_in_attributes():
    text = lambda x: hm.Page(x).text(np.ones(9, bool))
    assert text("<p title=\"a > b\">one</p>") == "one" and text("<p title='x\">two</p> 3 < 4 <b>its</b>") == "two 3 < 4 its"
    assert text("a<!-- > no -->b<!doctype x>c") == "abc" and text("<p>end <b") == "end <b"


def test_damaged_token_files_are_noticed(spark, tmp_path):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.lit("word here")] * 30).alias("text"))
    path = public_tokenizers.path("word_bpe_49k.json")
    bitplane.write_token_planes(docs, str(tmp_path / "a"), path, block=500, files=2)
    index = spark.read.parquet(str(tmp_path / "a" / "index"))
    assert index.agg(F.sum("n_ids")).first()[0] == bitplane.read_token_planes(spark, str(tmp_path / "a")).agg(F.sum("n_tokens")).first()[0]
    chunks = spark.read.parquet(str(tmp_path / "a" / "chunks"))
    last = index.filter("file = 0").agg(F.max("chunk")).first()[0]
    damage = {
        "gap": chunks.filter("not (file = 0 and chunk = 1)"),
        "end": chunks.filter(f"not (file = 0 and chunk = {last})"),
        "bytes": chunks.withColumn("blob", F.when((F.col("file") == 1) & (F.col("chunk") == 0), F.concat(F.expr("substring(blob, 1, length(blob) - 1)"), F.lit(b"\xaa"))).otherwise(F.col("blob"))),
    }
    for name, rows in damage.items():
        rows.write.parquet(str(tmp_path / name / "chunks"))
        index.write.parquet(str(tmp_path / name / "index"))
        with pytest.raises(Exception, match="token planes"):
            bitplane.read_token_planes(spark, str(tmp_path / name)).collect()


def _plain_gif(b, at):
    """Every header walked to its end by itself."""
    if at + 13 > len(b):
        return None
    p = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1
        if b[p] == 0x21:
            p += 2
        elif b[p] == 0x2C and p + 10 <= len(b):
            p += 10 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0) + 1
        else:
            return None
        while p < len(b) and b[p]:
            p += b[p] + 1
        p += 1
    return None


def test_pictures_are_walked_once_and_alike():
    import random
    import time

    from brambling.llm import media

    rng = random.Random(4)
    for _ in range(400):
        b = b"".join(rng.choice((b"GIF89a", b"!", b",", b";", b"\0", bytes([rng.randrange(256)]), b"\x02ab\0")) for _ in range(rng.randrange(10, 120)))
        for at in range(len(b)):
            assert media._gif(b, at) == _plain_gif(b, at), (b, at)
    b = b"GIF89a!,  abcdefgh0123;!!,," * 40_000
    t = time.time()
    for at in range(0, len(b), 27):
        media._gif(b, at)
    media._pdf_ends(b"".join(b"%%PDF-1.4 startxref %d %%%%EOF " % (k % 977 + 9) for k in range(30_000)))
    assert time.time() - t < 20  # a megabyte of each; ten minutes before


def test_long_documents_lose_lines_in_linear_time(spark):
    import time

    from brambling.llm import linededup

    def took(n):
        text = "\n".join(f"line {k} of a long text with some words in it" for k in range(n))
        docs = spark.createDataFrame([(1, text), (2, text)] + [(None, "a\n" * 60 + "popular")] * 30, "doc_id long, text string")
        t = time.time()
        got = {(r.doc_id, r.n_removed, r.text == "") for r in linededup.dedup_lines(docs).collect()}
        assert {x for x in got if x[0]} == {(1, 0, False), (2, n, True)}
        return time.time() - t

    took(1000)
    assert took(40_000) < 6 * took(10_000)  # by search in the list of removed lines 16 times
