"""Product codes and hard negatives against plain versions; toxicity on held-out rows and against a plain network."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brambling.llm import hardneg, intvec, lloyd
from brambling.llm import toxicity as tx

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, label int, embedding array<float>, bucket string, score string"


def _rows(n, width=8, seed=5):
    rng = random.Random(seed)
    rows = [(k, 0 if rng.random() < 0.4 else rng.randrange(4), [rng.uniform(-1, 1) * rng.choice((1, 1, 3)) for _ in range(width)]) for k in range(n)]
    rows[3] = (3, None, rows[3][2])
    rows[4] = (4, 1, None)
    rows[5] = (5, 1, [float("nan")] * width)
    rows[6] = (6, 1, [None] + [0.5] * (width - 1))
    rows[7] = (7, 1, [])
    rows[8] = (8, 1, [1e9] * width)
    rows[9] = (9, 2, [0.25] * (width + 4))
    rows += [rows[20], rows[30], (None, 1, rows[31][2])] + [(1000 + k, 2, rows[40][2]) for k in range(12)]  # repeats, no id, equal vectors
    return [(*r, "clash", "clash") for r in rows]


def _whole(rows, scale):
    """(id, label, components), one for each usable row."""
    out = []
    for k, label, v, *_ in rows:
        if v and all(x is not None and np.isfinite(x) and abs(np.float32(x) * scale) < 2**26 - 1 for x in v):
            out.append((k, label, tuple(int(np.floor(float(np.float32(x)) * scale)) for x in v)))
    return out


def _plain_negatives(rows, anchors):
    rows = sorted({r for r in _whole(rows, 256) if r[0] is not None and r[1] is not None})
    out = []
    for a in rows:
        if not anchors(a[0]):
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in rows if b[0] != a[0] and len(b[2]) == len(a[2]))
        for p, pid, _ in [s for s in scored if s[2] == a[1]][:5]:
            fit = [(s, i) for s, i, label in scored if label != a[1] and -80 * p <= -100 * s <= -100 * p]
            out += [(a[0], pid, k + 1, i, -p, -s) for k, (s, i) in enumerate(fit[:5])]
    return sorted(out)


def test_hard_negatives(spark, monkeypatch):
    rows = _rows(400)
    vectors = spark.createDataFrame(rows, SCHEMA)
    asked = vectors.filter("vec_id % 5 = 0")
    want = _plain_negatives(rows, lambda k: k % 5 == 0)
    assert len(want) > 500
    for size in (4096, 16):  # one bucket of a label, and many that are pruned
        monkeypatch.setattr(hardneg, "BUCKET_ROWS", size)
        monkeypatch.setattr(hardneg, "BLOCK_BUCKETS", 2)
        got = hardneg.hard_negatives(vectors, asked)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(map(tuple, got.collect())) == want
    assert hardneg.hard_negatives(vectors.limit(0), asked.limit(0)).count() == 0
    assert hardneg.hard_negatives(vectors.filter("label = 1"), asked.filter("label = 1")).count() == 0  # no other label


def test_bounds_leave_rows_out():
    """A bucket below every limit isn't multiplied, and slices end where norms have fallen too far."""
    ids, rows = np.arange(3000), np.ones((3000, 2), np.int64) * 100
    norms = np.sqrt((rows * rows).sum(1))
    one = lambda low: list(hardneg._one_bucket(ids, rows, norms, np.array([-1]), np.array([[1, 1]]), np.array([np.sqrt(2)]), np.array([[low]]), np.array([[hardneg.MOST]]), 5))
    assert one(300) == []
    (q, w, near, score), *more = one(0)
    assert near.tolist() == [0, 1, 2, 3, 4] and set(score) == {200} and not any(len(set(x[2]) & set(range(5))) for x in more)


def test_products_are_exact():
    big = np.array([[(1 << 26) - 1] * 4, [-(1 << 26) + 1, 3, 5, 7]], np.int64)
    assert intvec.products(big, big).tolist() == [[sum(x * y for x, y in zip(a, b)) for b in big.tolist()] for a in big.tolist()]


def _plain_codes(rows, parts, entries, rounds):
    kept = [r for r in _whole(rows, 1024)]
    widths = [len(r[2]) for r in kept if len(r[2]) % parts == 0]
    width = max(sorted(set(widths)), key=widths.count)
    kept = sorted((r for r in kept if len(r[2]) == width), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = width // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[list(cut(r[2], p)) for r in kept[:entries]] for p in range(parts)]
    near = lambda v, p: min((sum((x - y) ** 2 for x, y in zip(cut(v, p), c)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            of = [near(r[2], p)[1] for r in kept]
            for e in range(len(books[p])):
                own = [cut(r[2], p) for r, at in zip(kept, of) if at == e]
                books[p][e] = [sum(x) // len(own) for x in zip(*own)] if own else books[p][e]
    found = [(r[0], r[1], tuple(near(r[2], p)[1] for p in range(parts)), sum(near(r[2], p)[0] for p in range(parts))) for r in kept]
    return sorted(found, key=str), books


def test_product_codes(spark):
    rows = _rows(300)
    vectors = spark.createDataFrame(rows, SCHEMA)
    for entries, rounds in ((16, 4), (400, 1)):
        coded, books = lloyd.product_codes(vectors, entries=entries, rounds=rounds)
        want, plain = _plain_codes(rows, 4, entries, rounds)
        assert books.tolist() == plain
        assert sorted(((r.vec_id, r.label, tuple(r.codes), r.error) for r in coded.collect()), key=str) == want
    summed = {}
    for _, label, _, error in want:
        summed[label] = summed.get(label, 0) + error
    assert {(r.label, r.label_error) for r in lloyd.with_label_error(coded).select("label", "label_error").distinct().collect()} == set(summed.items())
    coded, books = lloyd.product_codes(vectors.limit(0))
    assert coded.count() == 0 and books.size == 0


def test_rounds_shuffle_changes_only(spark):
    """A round's plan joins the codes to the vectors without an exchange, and moves fewer parts than there are."""
    out = []
    write = lloyd._Bucketed.write
    try:
        lloyd._Bucketed.write = lambda self, rows, *p: out.append((rows, write(self, rows, *p))) or out[-1][1]
        lloyd.product_codes(spark.createDataFrame(_rows(300), SCHEMA), entries=16)
    finally:
        lloyd._Bucketed.write = write
    moved = [t.filter("moved = 1").select(F.sum(F.abs("n"))).first()[0] for _, t in out[1:]]
    n = out[0][1].count()
    assert moved[0] == 4 * n and moved[-2] < n
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in out[2][0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


LONG = " ".join(f"wort{k % 977}" for k in range(70_000))
TEXTS = [(1, None), (2, ""), (3, "12 !!"), (4, LONG), (5, "the same here"), (6, "the same here"), (6, "the same here"), (None, "der die das ß 漢字 é")]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/../sf0.1/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.1/labels.parquet")


@pytest.fixture(scope="module")
def network(tables):
    return tx.fit_documents(*tables)


def test_held_out_toxicity(spark, tables, network):
    docs, labels = tables
    got = tx.score_documents(docs, *network).join(labels, "doc_id").filter("held_out").select("doc_id", "score", "predicted", "toxic").toPandas()
    assert len(got) > 500 and set(got.doc_id % 1) == {0} and all(zlib.crc32(str(k).encode()) % 5 == 0 for k in got.doc_id)
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit / (got.predicted == 1).sum() > 0.9 and hit / (got.toxic == 1).sum() > 0.85
    rank, n = got.score.rank(), (got.toxic == 1).sum()
    assert (rank[got.toxic == 1].sum() - n * (n + 1) / 2) / (n * (len(got) - n)) > 0.95


def _plain_score(net, text):
    words = tx.words_of(text)
    e = net.embeddings[tx.word_rows(words)].sum(1)
    pooled = [max([0.0, *(sum(e[i + j] @ net.filters[w][j][:, f] for j in range(width)) + net.bias[w][f] for i in range(len(words) - width + 1))]) for w, width in enumerate(tx.WIDTHS) for f in range(tx.FILTERS)]
    counts = {k: sum(x in tx.FUNCTION_WORDS[k].split() for x in words) for k in tx.LANGUAGES}
    best = max(counts, key=counts.get)
    threshold = net.thresholds.get(best if counts[best] else "", net.thresholds[""])
    return 1 / (1 + np.exp(-np.clip(np.dot(pooled, net.out) + net.base - threshold, -30, 30)))


def test_scores_equal_a_plain_network(spark, network, monkeypatch):
    net = network[0]
    texts = [None, "", "one", "two words", "the idiot and the clown of it", "Der Wörter! viele, " * 9, LONG[:400]]
    monkeypatch.setattr(tx, "BLOCK_WORDS", 7)  # responses run on over blocks
    got, _ = tx.Scorer(net)(texts)
    assert np.abs(got - [_plain_score(net, t) for t in texts]).max() < 1e-5


def test_toxicity_edges(spark, tables, network):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({"score": F.lit("clash"), "held_out": F.lit(1), "language": F.lit(None).cast("string")})
    got = tx.score_documents(docs, *network).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    of = {r.doc_id: r for r in got}
    assert of[1].score == of[2].score == of[3].score and of[5].score == of[6].score and of[None].held_out
    labels = spark.createDataFrame([(k, 1) for k in range(50)] + [(None, 0)], "doc_id long, toxic int")
    net, base = tx.fit_documents(docs, labels.limit(0))
    assert net is None and base == 0.5
    net, base = tx.fit_documents(docs, labels)  # one label only
    assert net is None and {r.score for r in tx.score_documents(docs, net, base).collect()} == {base}
    assert tx.score_documents(docs.limit(0), *network).count() == 0
    both = labels.withColumn("toxic", F.when(F.col("doc_id") % 2 == 0, F.lit(1)).otherwise(F.lit(0)))
    assert tx.score_documents(docs, *tx.fit_documents(docs, both)).count() == len(TEXTS)


def test_labels_of_held_out_rows_are_never_read(tables, network):
    docs, labels = tables
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    net, base = tx.fit_documents(docs, labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert base == network[1] and net.thresholds == network[0].thresholds and (net.embeddings == network[0].embeddings).all()


def test_every_labelled_row_is_learned_from(spark, monkeypatch):
    """Texts beyond 20,000 characters, more rows than any sample had, and each of equal texts; the same in any layout."""
    said = lambda k: "vile scum" if k % 3 == 0 else "kind folk"
    texts = {k: f"{'calm water ' * 1900}{said(k)} {k}" if k < 150 else "an equal text" for k in range(9_500)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 150 and k % 3 == 0)) for k in texts], "doc_id long, toxic int")
    began, start = [], tx.start
    monkeypatch.setattr(tx, "start", lambda seen, n: began.append((seen.sum(), n.tolist())) or start(seen, n))
    monkeypatch.setattr(tx, "SHARD_CHARS", 1_000_000)
    nets = [tx.fit_documents(docs.repartition(k), labels)[0] for k in (3, 5)]
    learned = [k for k in texts if zlib.crc32(str(k).encode()) % 5 and zlib.crc32(texts[k].encode()) % 4 != tx.CALIBRATE]
    toxic = sum(k < 150 and k % 3 == 0 for k in learned)
    assert began[0] == began[1] and began[0][1] == [len(learned) - toxic, toxic]
    assert (nets[0].embeddings == nets[1].embeddings).all() and (nets[0].out == nets[1].out).all() and nets[0].thresholds == nets[1].thresholds
    score, _ = tx.Scorer(nets[0])(["calm water " * 3000 + "vile scum", "calm water " * 3000 + "kind folk", "an equal text"])
    assert score[0] > 0.5 > max(score[1:])


def test_largest_responses_and_their_first_places(monkeypatch):
    rng = np.random.default_rng(4)
    parts = rng.integers(0, 4, (sum(tx.WIDTHS) * tx.FILTERS, 9)).astype(np.float32)  # few values: many ties
    sizes = np.array([0, 1, 2, 7, 0, 3, 20, 1])
    words = rng.integers(0, 9, sizes.sum())
    for block in (1, 5, 60_000):
        monkeypatch.setattr(tx, "BLOCK_WORDS", block)
        top, where = tx.largest(parts, words, sizes, places=True)
        for d, (end, size) in enumerate(zip(np.cumsum(sizes), sizes)):
            at = 0
            for w, width in enumerate(tx.WIDTHS):
                for f in range(tx.FILTERS):
                    r = [sum(parts[at + j * tx.FILTERS + f, words[p + j]] for j in range(width)) for p in range(end - size, end - width + 1)]
                    k = w * tx.FILTERS + f
                    assert top[k, d] == (max(r) if r else -np.inf) and (not r or where[k, d] == end - size + int(np.argmax(r)))
                at += width * tx.FILTERS
