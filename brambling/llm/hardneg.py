"""Operator 13: hard negatives by norm-bucketed inner-product search.

Candidates of one label and length are ordered by norm and cut into buckets of about ``BUCKET_ROWS``
rows. The product of an anchor with any row of a bucket is at most the anchor's norm times the bucket's largest
norm (Cauchy-Schwarz), so a bucket is left out once that bound lies below what could still be returned:
the lower limit of each window of scores, or the k-th score found in it so far. Two searches run, each in two rounds.
The first finds an anchor's positives among the buckets of its label; their scores are the windows of the
second, which visits the buckets of other labels. A first round visits the bucket of largest norm only
and gives running k-th scores; the second visits what those don't rule out. Inside a task the limits
go on rising from slice to slice of a bucket.

Anchors travel in blocks to the buckets they visit, and are streamed there past one bucket at a time;
candidates are never copied. Scores are exact whole numbers; higher come first, ties by smaller id.

Nulls and edges: a null id or label, a null or empty vector, and one with a null, non-finite or too
large component (``intvec.scaled``) take no part; vectors of another length than the anchor's are no
candidates of it; rows equal in id, label and vector count once, and no row of the anchor's own id is its
positive or negative; fewer rows than asked are all returned; an anchor without positives, or with
negative scores only, has no rows; an empty table gives none; other columns, whatever their names,
are ignored. There are no texts here; very long vectors make larger rows only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import salted_join, table, tune, written
from .intvec import NORM, matrix, products, scaled, squared

POSITIVES, NEGATIVES, SCALE, LOWER_PERCENT = 5, 5, 256, 80
BUCKET_ROWS, BLOCK_BUCKETS, SALTS, QUERY_SLICE, ROW_SLICE = 4096, 25, 32, 256, 2048
#: Norms are counted in steps of a 32nd of a doubling.
STEPS = 32
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _prepared(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    v = scaled(F.col(vector_col), scale)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v")).filter("id is not null and label is not null and v is not null")
    rows = rows.withColumn("norm2", squared(F.col("v"))).filter(F.col("norm2").between(0, NORM))
    return rows.select("id", "label", "v", F.sqrt("norm2").alias("norm"), F.size("v").alias("width"), F.floor(F.log2(F.col("norm2") + 1) * STEPS).cast("int").alias("step"))


def _bucketed(rows: DataFrame) -> DataFrame:
    """Adds ring (from the largest norms down) and bucket; a step of too many rows is cut by the hash of the id."""
    keys = ["width", "label", "step"]
    steps = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("width", "label").orderBy(F.desc("step"))) - F.col("_n")
    steps = steps.select(*keys, "_n", F.floor(before / BUCKET_ROWS).cast("int").alias("ring"), F.ceil(F.col("_n") / (2 * BUCKET_ROWS)).cast("int").alias("_parts"))
    rows = salted_join(rows, written(steps, "hn-steps"), keys, "_n", ["id"])
    part = F.when(F.col("_parts") > 1, F.pmod(F.xxhash64("id"), F.col("_parts"))).otherwise(-1)
    return rows.withColumn("bucket", F.concat_ws("/", "width", "ring", part, "label"))  # the label last: it may hold the separator


def _top(score: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every row of scores its k best columns within low and high, without the row's own id: row, column, and low risen to the k-th."""
    ok = (score >= low[:, None]) & (score <= high[:, None]) & (ids != own[:, None])
    if ok.sum() > 20 * k * len(score):
        kth = np.partition(np.where(ok, score, LEAST), -k, axis=1)[:, -k]
        ok &= score >= kth[:, None]
    q, c = np.nonzero(ok)
    order = np.lexsort((ids[c], -score[q, c], q))
    q, c = q[order], c[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    q, c, place = q[place < k], c[place < k], place[place < k]
    low = low.copy()
    last = place == k - 1
    low[q[last]] = np.maximum(low[q[last]], score[q[last], c[last]])
    return q, c, low


def _one_bucket(ids: np.ndarray, rows: np.ndarray, norms: np.ndarray, own: np.ndarray, asked: np.ndarray, away: np.ndarray, lows: np.ndarray, highs: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Queries (at most QUERY_SLICE) against a bucket ordered by norm, slice after slice: query, window, id and score of what is found."""
    lows = lows.copy()
    for at in range(0, len(rows), ROW_SLICE):
        here = slice(at, at + ROW_SLICE)
        bound = np.floor(away * norms[here].max() * (1 + 1e-9)) + 1
        open_ = (lows <= highs) & (lows.astype(float) <= bound[:, None])
        who = np.flatnonzero(open_.any(1))
        if not len(who):
            return  # norms only fall from here on
        score = products(asked[who], rows[here])
        for w in range(lows.shape[1]):
            on = np.flatnonzero(open_[who, w])
            q, c, low = _top(score[on], lows[who[on], w], highs[who[on], w], ids[here], own[who[on]], k)
            lows[who[on], w] = low
            if len(q):
                yield who[on][q], np.full(len(q), w), ids[here][c], score[on][q, c]


def _scan(k: int, windows: int):
    """Over rows ordered by bucket, candidates first: holds one bucket at a time and streams its queries past it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, bucket = None, [], None
        for batch in batches:
            names = np.array(batch.column("bucket").to_pylist(), dtype=object)
            query = batch.column("query").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((names[1:] != names[:-1]) | (query[1:] != query[:-1])) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(names)]):
                if names[a] != name:
                    name, held, bucket = names[a], [], None
                part = batch.slice(a, b - a)
                width = len(part.column("v")[0])
                ids, v, norm = part.column("id").to_numpy(), matrix(part.column("v"), width), part.column("norm").to_numpy()
                if not query[a]:
                    held.append((ids, v, norm))
                    continue
                if not held:
                    continue
                if bucket is None:
                    i, x, n = (np.concatenate(y) for y in zip(*held))
                    first = np.unique(np.c_[i, x], axis=0, return_index=True)[1]  # equal rows count once
                    first = first[np.argsort(-n[first], kind="stable")]
                    bucket = i[first], x[first], n[first]
                lows, highs = (matrix(part.column(c), windows) for c in ("lows", "highs"))
                keys = part.column("query").to_numpy()
                for at in range(0, len(part), QUERY_SLICE):
                    s = slice(at, at + QUERY_SLICE)
                    got = list(_one_bucket(*bucket, ids[s], v[s], norm[s], lows[s], highs[s], k))
                    if got:
                        q, w, near, score = (np.concatenate(y) for y in zip(*got))
                        yield pa.RecordBatch.from_arrays([pa.array(keys[s][q]), pa.array(w.astype(np.int32)), pa.array(near), pa.array(score)], names=["query", "window", "id", "score"])

    return run


def _search(rows: DataFrame, blocks: DataFrame, visits: DataFrame, k: int, windows: int) -> DataFrame:
    """query, window, id, score. ``rows``: bucketed candidates; ``blocks``: queries with their block, lows and highs; ``visits``: block, bucket."""
    asked = blocks.join(visits, "block").select("bucket", "query", "id", "norm", "lows", "highs", "v")
    none = F.lit(None)
    wanted = rows.join(visits.select("bucket").distinct(), "bucket", "left_semi")
    both = wanted.select("bucket", none.cast("long").alias("query"), "id", "norm", none.cast("array<bigint>").alias("lows"), none.cast("array<bigint>").alias("highs"), "v").union(asked)
    tasks = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(tasks, "bucket").sortWithinPartitions("bucket", F.col("query").asc_nulls_first()).mapInArrow(_scan(k, windows), "query long, window int, id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _risen(blocks: DataFrame, first: DataFrame, k: int, windows: int) -> DataFrame:
    """Blocks with each window's low risen to the k-th score of a first round."""
    kth = first.filter(F.col("rank") == k).groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("_kth"))
    lows = F.array(*[F.greatest(F.col("lows")[w], F.coalesce(F.try_element_at("_kth", F.lit(w)), F.lit(LEAST))) for w in range(windows)])
    return blocks.join(kth, "query", "left").withColumn("lows", lows).drop("_kth")


def _summaries(blocks: DataFrame, windows: int) -> DataFrame:
    """A row for each block: its largest norm, and the least low of its open windows."""
    low = F.least(*[F.when(F.col("lows")[w] <= F.col("highs")[w], F.col("lows")[w]) for w in range(windows)], F.lit(MOST))
    return blocks.groupBy("block", "width", "label").agg(F.max("norm").alias("_norm"), F.min(low).alias("_low"))


def _reached(summaries: DataFrame, buckets: DataFrame, on: list[str], also: Column | None = None) -> DataFrame:
    """Pairs of a block and a bucket that the length bound doesn't rule out; blocks are dealt over SALTS tasks of a key."""
    a = summaries.withColumn("_salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int"))
    b = buckets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("label", "label" if "label" in on else "_label")
    pairs = a.join(b, [*on, "_salt"]).filter(F.floor(F.col("_norm") * F.col("_most") * (1 + 1e-9)) + 1 >= F.col("_low").cast("double"))
    return (pairs if also is None else pairs.filter(also)).select("block", "bucket")


def _two_rounds(rows: DataFrame, blocks: DataFrame, buckets: DataFrame, heads: DataFrame, k: int, windows: int, on: list[str], also: Column | None) -> DataFrame:
    blocks = written(blocks, "hn-blocks")
    home = written(_summaries(blocks, windows).join(heads, on).transform(lambda d: d if also is None else d.filter(also)).groupBy("block").agg(F.max_by("bucket", F.struct("_most", "bucket")).alias("bucket")), "hn-home")
    first = written(_best(_search(rows, blocks, home, k, windows), k), "hn-first")
    risen = written(_risen(blocks, first, k, windows), "hn-risen")
    rest = written(_reached(_summaries(risen, windows), buckets, on, also).join(home, ["block", "bucket"], "left_anti"), "hn-visits")
    return _best(first.drop("rank").union(_search(rows, risen, rest, k, windows)), k)


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, lower_percent: int = LOWER_PERCENT, scale: int = SCALE, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each positive of an anchor the best rows of
    other labels that score between ``lower_percent`` of the positive's score and that score."""
    tune(vectors.sparkSession)
    rows = written(_bucketed(_prepared(vectors, id_col, label_col, vector_col, scale)), "hn-rows")
    buckets = written(rows.groupBy("bucket", "width", "label").agg(F.max("norm").alias("_most")), "hn-buckets")
    heads = buckets.groupBy("width", "label").agg(F.max(F.struct("_most", "bucket")).alias("_head")).select("width", "label", "_head.*")

    named = F.xxhash64("id", "label", "v")
    asked = _prepared(anchors, id_col, label_col, vector_col, scale).withColumn("query", named)
    asked = salted_join(asked, written(rows.groupBy("width", "label", "step").agg(F.max("ring").alias("_ring"), F.count("*").alias("_n")), "hn-rings"), ["width", "label", "step"], "_n", ["id"])
    block = F.concat_ws("/", "width", F.floor(F.col("_ring") / BLOCK_BUCKETS), "label")
    asked = written(asked.dropDuplicates(["query"]).select("query", "id", "label", "width", "norm", "v", block.alias("block")), "hn-asked")

    one = lambda x: F.array(F.lit(x).cast("long"))
    near = _two_rounds(rows, asked.withColumns({"lows": one(LEAST), "highs": one(MOST)}), buckets, heads, positives, 1, ["width", "label"], None)
    near = written(near.select("query", (F.col("rank") - 1).cast("int").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "hn-positives")

    highs = near.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("window", "positive_score"))).alias("_of"))
    wanted = asked.join(highs, "query").withColumn("highs", F.array(*[F.coalesce(F.try_element_at("_of", F.lit(j)), F.lit(LEAST)) for j in range(positives)]))
    wanted = wanted.withColumn("lows", F.expr(f"transform(highs, p -> if(p < 0, {MOST}L, (p * {lower_percent} + 99) div 100))")).drop("_of")
    two = Window.partitionBy("width").orderBy(F.desc("_most"), "label")
    heads = heads.withColumn("_n", F.row_number().over(two)).filter("_n <= 2").drop("_n").withColumnRenamed("label", "_label")  # one of the two is of another label
    found = _two_rounds(rows, wanted, buckets, heads, negatives, positives, ["width"], F.col("label") != F.col("_label"))
    answers = found.join(near, ["query", "window"]).join(asked.select("query", F.col("id").alias("anchor_id")), "query")
    return answers.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    return hard_negatives(rows, rows.filter("vec_id % 100 = 0"))
