"""Queries and the pipeline against plain versions: posteriors, stored samples, pages with known text, run()."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter
from html.parser import HTMLParser

import public_tokenizers
from pyspark.sql import functions as F

from brambling.llm import htmlmain as hm
from brambling.llm import linededup, media, neardup, quality

SF = "/root/testdata/sf0.001"
CLASHES = ["evidence", "score", "keep", "host_posterior", "path_posterior", "n_removed", "n_lines", "shard", "length", "class_id", "label"]


def test_posteriors_equal_plain_sums(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, rng.choice(["a", "b", None]), rng.choice(["x", "y", None]), rng.random() * 0.98 + 0.01) for k in range(200)] + [(200, "lone", "p", 0.9)]
    strengths = []
    real = quality._strength
    monkeypatch.setattr(quality, "_strength", lambda *a: strengths.append(real(*a)) or strengths[-1])
    frame = spark.createDataFrame(rows, "id long, h string, p string, _qc_p double").withColumn("_qc_evidence", F.lit(0.25))
    got = {r.id: r for r in quality.named(quality.with_sites(frame, host=F.col("h"), path=F.col("p"))).collect()}
    prior = (sum(r[3] for r in rows) + 0.5) / (len(rows) + 1)
    for k, h, p, own in rows:
        host = [r[3] for r in rows if r[1] == h and r[0] != k]
        path = [r[3] for r in rows if r[1:3] == (h, p) and r[0] != k]
        up = (sum(host) + strengths[0] * prior) / (len(host) + strengths[0])
        here = (sum(path) + strengths[1] * up) / (len(path) + strengths[1])
        score = 1 / (1 + math.exp(-(0.25 + math.log(here / (1 - here)))))
        r = got[k]
        assert max(abs(r.host_posterior - up), abs(r.path_posterior - here), abs(r.score - score)) < 1e-9 and r.keep == (score >= 0.5)


def test_media_query_equals_plain_version(spark):
    got = {r.doc_id: r for r in media.op5_media(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        raw = (d.text or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        wav = b"RIFF" + struct.pack("<I", 36 + len(padded)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 16000, 1, 8) + b"data" + struct.pack("<I", len(padded)) + padded
        r = got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())
        assert r.feature == f"audio/wav;declared=text/plain;corrected=1;samples={len(padded)};carved="


class _Article(HTMLParser):
    """The text of the article by the standard library's parser: a block's borders and line breaks are spaces."""

    def __init__(self, source):
        super().__init__()
        self.inside, self.raw, self.parts = 0, 0, []
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.raw += tag in ("script", "style")
        self.parts.append("" if tag in hm.INLINE - hm.VOID else " ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.raw -= tag in ("script", "style")
        self.parts.append("" if tag in hm.INLINE else " ")

    def handle_data(self, data):
        if self.inside and not self.raw:
            self.parts.append(data)

    @property
    def text(self):
        return " ".join("".join(self.parts).split())


def test_held_out_pages(spark):
    model = hm.fit_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    held = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").filter("page_id >= 2200")
    want = {r.page_id: _Article(r.html).text for r in held.collect()}
    assert len(want) > 200 and min(map(len, want.values())) > 0
    for pages in (held, held.withColumn("html", F.regexp_replace("html", "<(/?)article", "<$1div"))):
        got = {r.page_id: r.text for r in hm.extract_pages(pages, model).collect()}
        assert sum(got[k] == v for k, v in want.items()) >= 0.99 * len(want)
    rows = [(1, None, "<p>one"), (1, None, "<p>one"), (None, None, None), (2, "u", ""), (2, "u", "broken <b")]
    edge = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit(1)})
    out = hm.extract_pages(edge, model).collect()
    assert len(out) == 5 and all(r.n_chars == len(r.text) for r in out) and sum(r.text == "" for r in out) >= 2


def _plain_near(texts):
    """One of each group: union of all pairs with five-word Jaccard similarity of 0.8 or more; ids in order."""
    sets = {k: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else t for k, t in texts.items()}
    label = {k: k for k in texts}
    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            same = x == y and x is not None if isinstance(x, str | None) or isinstance(y, str | None) else 5 * len(x & y) >= 4 * len(x | y)
            if same and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return {k for k, v in label.items() if k == v}


def test_run_equals_a_plain_version(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id: r.text for r in quality.score_table(docs, labels).filter("keep").collect()}
    lines = {r.doc_id: r.text for r in linededup.dedup_lines(docs.filter(F.col("doc_id").isin(list(kept)))).collect()}
    assert lines.keys() == kept.keys()
    left = _plain_near(lines)
    library, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for k in left:
        ids = library.encode(lines[k] or "", add_special_tokens=False).ids + [2]
        at, size = 0, len(ids) % 1024 or 1024
        while at < len(ids):
            want[k, at, size, zlib.crc32(struct.pack(f"<{size}I", *ids[at : at + size]))] += 1
            at, size = at + size, 1024
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in got) == want
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in s) <= 1024 and [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:k]) for k in range(len(s))] for s in held.values())


def test_stages_keep_clashing_columns_and_edges(spark):
    import corpus_pipeline

    rows = [(1, None), (2, ""), (3, "one"), (4, " ".join(f"w{k % 977}" for k in range(5_000))), (5, "same text here and there again"), (5, "another text of that id, and longer"), (6, "same text here and there again"), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")} | {c: F.lit("clash") for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert all(r[c] == "clash" for r in out.collect() for c in CLASHES)
        assert stage(spark, docs.limit(0), SF).count() == 0
    near = [(r.doc_id, r.text) for r in neardup.drop_near_duplicates(docs).select("doc_id", "text").collect()]
    assert sorted(x[0] or -1 for x in near) == [-1, 1, 2, 3, 4, 5] and neardup.drop_near_duplicates(docs).count() == 6
