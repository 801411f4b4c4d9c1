"""Operator 6: near duplicates by DartMinHash.

Every element of a weighted set owns a plane of weight by rank on which darts fall at unit rate, seeded
by the element alone. A set of total weight W sees the darts below its weights and below rank
``theta / W``: about ``theta`` darts however many elements it has. A dart also names one of T
coordinates, and the dart of least rank on a coordinate is the sketch there; sets agree on it with
the probability of their weighted Jaccard similarity. A set that leaves a coordinate empty doubles its
rank limit, which changes no coordinate that is filled.

Candidates share a band of sketch coordinates. Equal sets are one node from the start. Every
node is first held against hubs of its buckets, which joins large groups of near copies with
work in proportion to their rows. Buckets that then still hold several groups are compared in blocks:
likely pairs of different groups by their sets, each pair in the first bucket it shares, and only links
that join two groups of the block leave it. Every link is confirmed by the exact Jaccard similarity of
five-word shingles; groups are the connected components.

With 32 bands of 4, two texts of similarity 0.8 share no band with probability 5e-8. Candidates must
also agree on 55 % of their one-byte signatures, which such texts fail with probability 8e-11.

Nulls and edges: null or blank text has no shingles and is its own group, as in the query's SQL, but
``drop_near_duplicates`` keeps one of equal blank texts; null texts are not equal and all stay. A text
of fewer than five words is one shingle; equal sets are a group whatever their number; a document
without doc_id joins groups of equal sets only, and is dropped where one with doc_id or another without
has an equal set or the same blank text; of several texts of one doc_id the one of least key links to others,
each groups with sets equal to its own, and ``drop_near_duplicates`` keeps one row of an id; very long texts
are read whole; of equal ids in a group the least names it; an empty table gives no rows; other columns are
kept, whatever their names (names beginning with ``_nd_`` are reserved).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tune, written
from .components import components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 4
T = BANDS * ROWS
#: A pair of similarity 0.8 agrees on fewer of the 128 one-byte signatures with a probability of 8e-11.
LIKELY = 0.55
#: A block has about so many rows and shingles on each of its sides.
BLOCK, BLOCK_SHINGLES = 1000, 4_000_000
_EDGES = np.array([0, 1 / 256, 1 / 64, 1 / 16, 1 / 4, 1.0])
_U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> _U64(11)).astype(np.float64) * 2.0**-53


_word_hashes: dict[str, int] = {}


def shingles(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle hash and count of the distinct shingles of every text, sorted by both."""
    import xxhash

    if len(_word_hashes) > 100_000:
        _word_hashes.clear()
    flat: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        cut = text.lower().split() if text else []
        for w in set(cut):
            if w not in _word_hashes:
                _word_hashes[w] = xxhash.xxh3_64_intdigest(w)
        flat += map(_word_hashes.__getitem__, cut)
        sizes[k] = len(cut)
    hashes, owner = np.array(flat, _U64), np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    starts = np.flatnonzero((place == 0) | (place + words <= np.repeat(sizes, sizes)))
    short = np.minimum(sizes[owner[starts]], words) if len(starts) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(starts), _U64)
        for k in range(words):
            at = np.minimum(starts + k, max(len(flat) - 1, 0))
            h = _mix(h * _U64(0x9E3779B97F4A7C15) + np.where(k < short, hashes[at] if len(flat) else h, _U64(k + 1)))
    owner = owner[starts]
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return owner[at], h[at], np.diff(np.r_[at, len(h)])


def dart_sketch(owner: np.ndarray, elements: np.ndarray, weights: np.ndarray, n_sets: int, t: int = T) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of weighted sets, given as (set, element, weight) rows: an n_sets x t matrix of darts, and which sets have one.

    Weights are measured in units of 1: within a unit darts are thinned by weight, so weights far below
    1 cost more darts than they keep.
    """
    total = np.bincount(owner, weights, n_sets)
    has = total > 0
    out, filled = np.zeros((n_sets, t), _U64), np.zeros((n_sets, t), bool)
    limit = np.where(has, t * (math.log(t) + 2) / np.where(has, total, 1), 0)
    todo = has.copy()
    with np.errstate(over="ignore"):
        while todo.any():
            rows = np.flatnonzero(todo[owner] & (weights > 0))
            layers = np.ceil(weights[rows]).astype(np.int64)
            rows, layer = np.repeat(rows, layers), np.arange(layers.sum()) - np.repeat(np.cumsum(layers) - layers, layers)
            base = _mix(elements[rows] + _U64(0xD1B54A32D192ED03) * (layer.astype(_U64) + _U64(1)))
            found = []
            top, cell, below = limit[owner[rows]], 0, np.arange(len(rows))
            while True:
                low = _EDGES[cell] if cell < 5 else float(cell - 4)
                high = _EDGES[cell + 1] if cell < 5 else low + 1
                below = live = below[top[below] > low]
                if not len(live):
                    break
                seed = _mix(base[live] + _U64(0x8CB92BA72F3D8DD7) * _U64(cell + 1))
                u, area, k, chance = _unit(seed), high - low, 0, math.exp(-(high - low))
                cdf = chance
                while True:  # the number of darts in the cell has Poisson's law
                    on = np.flatnonzero(u >= cdf)
                    live, seed, u = live[on], seed[on], u[on]
                    if not len(live):
                        break
                    k += 1
                    dart = _mix(seed + _U64(0xA0761D6478BD642F) * _U64(k))
                    rank = low + _unit(_mix(dart + _U64(1))) * area
                    height = layer[live] + _unit(_mix(dart + _U64(2)))
                    ok = (rank <= top[live]) & (height < weights[rows[live]])
                    found.append((owner[rows[live[ok]]], rank[ok], dart[ok]))
                    chance *= area / k
                    cdf = min(cdf + chance, 1.0) if k < 40 else 1.0
                cell += 1
            if found:
                who, rank, dart = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(-rank, kind="stable")
                who, dart = who[order], dart[order]
                column = (_mix(dart + _U64(3)) % _U64(t)).astype(np.int64)
                out[who, column] = dart  # of darts on one place the last, which has the least rank, stays
                filled[who, column] = True
            todo = has & ~filled.all(1)
            limit = np.where(todo, limit * 2, limit)
    return out, has


def band_keys(sketch: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    with np.errstate(over="ignore"):
        keys = np.tile(np.arange(1, bands + 1, dtype=_U64), (len(sketch), 1))
        for k in range(rows):
            keys = _mix(keys * _U64(0x9E3779B97F4A7C15) + sketch[:, k : bands * rows : rows])
    return keys.view(np.int64)


SKETCHES = "doc_id bigint, k1 bigint, k2 bigint, size bigint, bands array<bigint>, sig binary"


def _set_sums(texts: list[str | None], owner: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    """Two sums that name a set of shingles, and a blank text by its own hash."""
    import xxhash

    with np.errstate(over="ignore"):
        sums = [np.zeros(len(texts), _U64) for _ in range(2)]
        for k, s in enumerate(sums):
            np.add.at(s, owner, _mix(h + _U64(k + 11)))
    for k in np.flatnonzero(np.bincount(owner, minlength=len(texts)) == 0):
        if texts[k] is not None:
            for j, s in enumerate(sums):
                s[k] = xxhash.xxh3_64_intdigest(texts[k], seed=j + 11)
    return sums


def _set_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds k1 and k2 to rows with the column _nd_text; null where the text is."""
    for batch in batches:
        texts = batch.column("_nd_text").to_pylist()
        owner, h, _ = shingles(texts)
        null = np.array([x is None for x in texts], bool)
        sums = [pa.array(s.view(np.int64), mask=null) for s in _set_sums(texts, owner, h)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *sums], names=[*batch.schema.names, "_nd_k1", "_nd_k2"])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        owner, h, counts = shingles(texts)
        sketch, has = dart_sketch(owner, h, np.ones(len(counts)), len(texts))
        keys = band_keys(sketch)
        sig = sketch.view(np.uint8).reshape(len(texts), T, 8)[:, :, 3]
        null = np.array([x is None for x in texts], bool)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(s.view(np.int64), mask=null) for s in _set_sums(texts, owner, h)), pa.array(np.bincount(owner, minlength=len(texts)), pa.int64()), pa.array([k if ok else [] for k, ok in zip(keys, has)], pa.list_(pa.int64())), pa.array([s.tobytes() for s in sig], pa.binary())],
            names=["doc_id", "k1", "k2", "size", "bands", "sig"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        owner, h, _ = shingles(texts)
        ends = np.searchsorted(owner, np.arange(len(texts) + 1))
        sums = [pa.array(x.view(np.int64)) for x in _set_sums(texts, owner, h)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *sums, pa.array([h[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], names=["id", "k1", "k2", "set"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [_similar(np.frombuffer(x, _U64), np.frombuffer(y, _U64)) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, T) for c in ("x", "y"))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array((x == y).mean(1) >= LIKELY))


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILARITY * (len(x) + len(y) - both)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows come sorted by block."""
    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and held[0]["block"] != r["block"]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _likely_partners(rows: list[dict], group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Places of a row and of those of other groups that are likely links of it, the likeliest first."""
    sig = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint8).reshape(-1, T)
    bands = np.array([r["bands"] for r in rows], np.int64)
    ids, side, sizes = (np.array([r[c] for r in rows]) for c in ("id", "side", "size"))
    # Side 2: a block of its own, every pair once; side 0: held against the rows of side 1.
    for k in np.flatnonzero(side != 1):
        other = np.flatnonzero((group != group[k]) & (ids > ids[k] if side[k] == 2 else side == 1))
        other = other[np.minimum(sizes[other], sizes[k]) >= SIMILARITY * np.maximum(sizes[other], sizes[k])]
        agree = (sig[other] == sig[k]).mean(1)
        other = other[agree >= LIKELY][np.argsort(-agree[agree >= LIKELY], kind="stable")]
        # Of the buckets that two rows share, the first one compares them.
        first = (bands[other] == bands[k]).argmax(1)
        other = other[bands[other, first] == rows[0]["band"]]
        if len(other):
            yield int(k), other


def _groups(rows: list[dict]) -> np.ndarray:
    return np.unique([r["label"] for r in rows], return_inverse=True)[1]


PLACES = "block bigint, side int, band bigint, id bigint, label bigint"


def _block_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a block that have a likely partner in it."""
    for rows in _blocks(batches):
        hit = np.zeros(len(rows), bool)
        for k, other in _likely_partners(rows, _groups(rows)):
            hit[k] = hit[other] = True
        found = [rows[k] for k in np.flatnonzero(hit)]
        if found:
            kinds = [("block", pa.int64()), ("side", pa.int32()), ("band", pa.int64()), ("id", pa.int64()), ("label", pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], kind) for c, kind in kinds], names=[c for c, _ in kinds])


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exact links that join groups of a block, fewer than it has rows."""
    for rows in _blocks(batches):
        sets, group, out = [np.frombuffer(r["set"], _U64) for r in rows], _groups(rows), []
        for k, other in _likely_partners(rows, group):
            for j in other:
                if group[j] != group[k] and _similar(sets[j], sets[k]):
                    out.append(sorted((rows[k]["id"], rows[j]["id"])))
                    group[group == group[j]] = group[k]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _place(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(1 << 24)).cast("long")


def _marked(rows: DataFrame, c: str, ids: DataFrame) -> DataFrame:
    """Rows with _nd_on: false only where ``c`` is surely none of the ids. A bitmap of hashed ids decides before any
    shuffle: 2^24 bits in at most 2^18 broadcast rows, whatever the number of ids."""
    bit = lambda c: F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{c}`), 64L) AS INT))")
    bitmap = ids.groupBy(F.shiftright(_place("id"), 6).alias("_nd_word")).agg(F.bit_or(bit("id")).alias("_nd_mask"))
    marked = rows.withColumn("_nd_word", F.shiftright(_place(c), 6)).join(F.broadcast(bitmap), "_nd_word", "left")
    return marked.withColumn("_nd_on", F.coalesce(F.col("_nd_mask").bitwiseAND(bit(c)) != 0, F.lit(False))).drop("_nd_word", "_nd_mask")


def _set_table(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, set: the sorted shingle hashes of the documents with these ids, and of few others; of several texts of
    one id the one of least key, which is the one that has a node. Joins on id drop what passes the bitmap by chance."""
    texts = _marked(docs, "doc_id", ids).filter("_nd_on")
    sets = texts.select(F.col("doc_id").alias("id"), "text").mapInArrow(_sets, "id bigint, k1 bigint, k2 bigint, set binary")
    return written(sets.groupBy("id").agg(F.min_by("set", F.struct("k1", "k2")).alias("set")), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs a, b whose shingle sets are similar enough."""
    pairs = written(pairs, "pairs")
    sets = _set_table(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return written(both.select("a", "b", "x", "y").mapInArrow(_exact, "a bigint, b bigint"), "links")


def _with_signatures(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    x = nodes.select(F.col("id").alias("a"), F.col("sig").alias("x"))
    y = nodes.select(F.col("id").alias("b"), F.col("sig").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_likely, "a bigint, b bigint")


def near_duplicate_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the least doc_id of the group) of every row."""
    rows = _grouped(docs, id_col, text_col)
    return rows.select("doc_id", F.when(F.col("size") > 0, F.coalesce("class_id", "doc_id")).otherwise(F.col("doc_id")).alias("class_id"))


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, k1, k2, size, class_id of every row; equal blank texts are a group here, and class_id is null where no row with doc_id has the key."""
    tune(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = written(docs.mapInArrow(_sketches, SKETCHES), "sketches")
    nodes = sketches.filter("k1 is not null and doc_id is not null").groupBy("k1", "k2").agg(F.min_by(F.struct("size", "bands", "sig"), "doc_id").alias("s"), F.min("doc_id").alias("id"))
    nodes = written(nodes.select("k1", "k2", "id", "s.size", "s.bands", "s.sig"), "nodes")
    # Of several texts of one id only that of least key is a node that others may link to.
    several = nodes.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2")).alias("key")).filter("n > 1").select("id", F.col("key.k1").alias("k1"), F.col("key.k2").alias("k2"))
    others = nodes.select("id", "k1", "k2").join(several.select("id"), "id", "left_semi").join(several, ["id", "k1", "k2"], "left_anti")
    others = written(others.select("k1", "k2", "id"), "others")
    alone = bool(others.limit(1).count())
    if alone:
        nodes = written(nodes.join(others.select("k1", "k2"), ["k1", "k2"], "left_anti"), "nodes")

    rows = nodes.select("id", F.explode("bands").alias("band"))
    sizes = rows.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = written(rows.join(sizes, "band"), "sized")
    # The hub of a bucket is the node with most neighbours in all its buckets: of texts that were edited
    # from one, that one or the least edited.
    degrees = buckets.groupBy("id").agg(F.sum("n").alias("degree"))
    buckets = written(buckets.join(degrees, "id").select("band", "id", F.struct(-F.col("degree"), "id").alias("place")), "placed")
    hubs = buckets.groupBy("band").agg(F.min("place").alias("hub"))
    buckets = written(buckets.join(hubs, "band").select("band", "id", "hub"), "buckets")

    # First each node against the best hub it shares a bucket with, then, where that left a bucket
    # with its hub in another group, against the hubs of those buckets.
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    best = buckets.groupBy("id").agg(F.min("hub").alias("hub")).select("id", F.col("hub.id").alias("hub")).filter("id <> hub")
    stars = best.select(*pair(F.col("id"), F.col("hub"))).distinct()
    buckets = buckets.select("band", "id", F.col("hub.id").alias("hub"))
    first = _confirmed(_with_signatures(stars, nodes), docs)
    group = components(first)
    named = written(buckets.join(group, "id", "left").select("band", "id", "hub", F.coalesce("label", "id").alias("label")), "named")
    mixed = named.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("band")
    apart = named.join(mixed, "band", "left_semi").filter("id <> hub").select("hub", "id", "label").distinct()
    apart = apart.join(group.select(F.col("id").alias("hub"), F.col("label").alias("hub_label")), "hub", "left").filter("coalesce(hub_label, hub) <> label")
    apart = apart.select(*pair(F.col("id"), F.col("hub"))).distinct()
    more = _confirmed(_with_signatures(apart.join(stars, ["a", "b"], "left_anti"), nodes), docs)
    first, stars = first.union(more), stars.union(apart)
    group = components(first)

    # Buckets that still hold several groups: the rest against all others, in blocks.
    named = buckets.select("band", "id").join(group, "id", "left").select("band", "id", F.coalesce("label", "id").alias("label"))
    named = named.join(nodes.select("id", "size"), "id")
    counts = named.groupBy("band", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    open_ = counts.groupBy("band").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "label", "size")).alias("major"), F.count("*").alias("labels")).filter("labels > 1")
    open_ = open_.select("band", "n", F.col("size").alias("size_all"), "major")
    dealt = named.join(open_, "band")
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_SHINGLES)).cast("int")
    small = (F.col("n") <= BLOCK) & (F.col("size_all") <= BLOCK_SHINGLES)
    minor_blocks = blocks(F.col("n") - F.col("major.n"), F.col("size_all") - F.col("major.size"))
    major_blocks = blocks(F.col("major.n"), F.col("major.size"))
    mine = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    name = lambda i, j: F.struct(F.col("band").alias("band"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    entry = lambda block, side: F.struct(block.alias("block"), F.lit(side).alias("side"))
    m, mj = mine(minor_blocks), mine(major_blocks)
    as_minor = F.concat(
        F.transform(F.sequence(F.lit(0), minor_blocks - 1), lambda k: F.struct(name(F.least(m, k), F.greatest(m, k)).alias("block"), F.when(k == m, 2).otherwise(F.when(m < k, 0).otherwise(1)).alias("side"))),
        F.transform(F.sequence(F.lit(0), major_blocks - 1), lambda k: entry(name(m, -1 - k), 0)),
    )
    as_major = F.transform(F.sequence(F.lit(0), minor_blocks - 1), lambda k: entry(name(k, -1 - mj), 1))
    where = F.when(small, F.array(entry(name(F.lit(0), F.lit(0)), 2))).when(F.col("label") == F.col("major.label"), as_major).otherwise(as_minor)
    dealt = written(dealt.select("id", "label", "band", F.explode(where).alias("w")).select("id", "label", "band", "w.side", F.xxhash64("w.block").alias("block")), "dealt")
    traits = nodes.select("id", "size", "bands", "sig")
    in_blocks = lambda rows: rows.repartition("block").sortWithinPartitions("block")
    likely = written(in_blocks(dealt.join(traits, "id")).mapInArrow(_block_candidates, PLACES), "likely")
    sets = _set_table(docs, likely.select("id")).join(traits, "id")
    second = written(in_blocks(likely.join(sets, "id")).mapInArrow(_block_links, "a bigint, b bigint"), "links")
    group = components(first.union(second))

    named = nodes.join(group, "id", "left").select("k1", "k2", F.coalesce("label", "id").alias("class_id"))
    if alone:
        named = named.union(others)
    return sketches.select("doc_id", "k1", "k2", "size").join(named, ["k1", "k2"], "left")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the document of least id of every group, once; of those without id one of each key that none with id has.

    Only rows whose id may be dropped, or may occur several times, are shuffled with their texts. Of the
    rows of one id that stays, the one of least text (then of least hash) is kept.
    """
    groups = written(_grouped(docs, id_col, text_col), "groups")
    with_id = groups.filter("doc_id is not null")
    keep = with_id.filter("doc_id = coalesce(class_id, doc_id)").select(F.col("doc_id").alias("_nd_id")).distinct()
    doubtful = with_id.groupBy("doc_id").agg(F.count("*").alias("n"), F.max((F.col("doc_id") != F.coalesce("class_id", "doc_id")).cast("int")).alias("dropped")).filter("n > 1 or dropped = 1")
    marked = _marked(docs.withColumn("_nd_id", F.col(id_col).cast("long")).filter("_nd_id is not null"), "_nd_id", doubtful.select(F.col("doc_id").alias("id")))
    sure = marked.filter("not _nd_on").select(*[F.col(f"`{c}`") for c in docs.columns])
    all_ = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns])
    held = marked.filter("_nd_on").join(keep, "_nd_id", "left_semi").select("_nd_id", all_.alias("_nd_row"), F.struct(F.col(f"`{text_col}`"), F.xxhash64(F.to_json(all_))).alias("_nd_order"))
    held = held.groupBy("_nd_id").agg(F.min_by("_nd_row", "_nd_order").alias("_nd_row")).select("_nd_row.*")
    loose = docs.filter(F.col(id_col).isNull())
    keyed = loose.withColumn("_nd_text", F.col(text_col)).filter("_nd_text is not null")
    keyed = keyed.mapInArrow(_set_keys, keyed.withColumns({"_nd_k1": F.lit(0).cast("long"), "_nd_k2": F.lit(0).cast("long")}).schema)
    firsts = keyed.dropDuplicates(["_nd_k1", "_nd_k2"])
    taken = groups.filter("doc_id is null and class_id is not null").select(F.col("k1").alias("_nd_k1"), F.col("k2").alias("_nd_k2")).distinct()
    loners = firsts.join(taken, ["_nd_k1", "_nd_k2"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    return sure.union(held).union(loners).union(loose.filter(F.col(text_col).isNull()))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
