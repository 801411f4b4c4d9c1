"""Operator 1: approximate nearest neighbours by vantage-point trees, one tree per shard.

Rows belong to the cell of their nearest pivot. A cell is cut into rings by the distance from its pivot,
and a ring that still is too large by hash: those are the shards. A query first searches the ring of its
nearest pivot that lies nearest to it, which bounds its k-th distance; then every shard whose pivot
distance and ring don't rule it out by the triangle inequality. Inside a shard a vantage-point tree is
searched in the same way, for all queries of a block at once. A bound rules something out once ``factor``
times the bound exceeds the k-th distance so far; ``factor`` 1 is exact search, a larger one prunes more
and may lose neighbours. Bounds are compared with a slack for rounding.

Only pivots (``MAX_PIVOTS`` at most, rows of least hash) are fitted on a sample; every row is indexed.
Equal vectors are one point, named by two 64-bit hashes, that keeps its ``k + 1`` least ids, which is all
that a list of k can show of them; equal queries are searched once. Shards are copied only to the
blocks of queries that visit them.

Distances are computed from the original vectors in double precision, ties go to the smaller id.

Nulls and edges: a null, zero or empty vector, one with a null or non-finite component, and a null id
take no part; vectors of another length than most are only near those of the same length; repeated
rows of one id and vector count once; with fewer candidates than k all are returned; an empty table
gives no rows; other columns, whatever their names, are ignored. There are no texts here; very long
vectors make larger rows only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import salted_join, sample_by_hash, table, tune, written

K, FACTOR = 10, 1.0
MAX_PIVOTS, SHARD_ROWS, LEAF_ROWS, QUERY_BLOCK = 1024, 4096, 256, 4096
LEAST_SHARDS, BINS = 24, 1024
SLACK = 1e-9


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of all rows of x, each summed from the first component to the last."""
    d = x - q
    return np.sqrt(np.add.accumulate(d * d, axis=1)[:, -1])


class VPTree:
    """Rows in tree order; a node is a range of them, its first row the vantage point."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF_ROWS) -> None:
        self.x, self.order, self.nodes = x, np.arange(len(x)), []
        self._build(0, len(x), leaf)

    def _build(self, low: int, high: int, leaf: int) -> int:
        me = len(self.nodes)
        self.nodes.append(None)
        if high - low <= leaf:
            self.nodes[me] = (low, high, None, None, None)
            return me
        part = self.order[low + 1 : high]
        d = distances(self.x[part], self.x[self.order[low]])
        middle = len(d) // 2
        cut = np.argpartition(d, middle)
        self.order[low + 1 : high], d = part[cut], d[cut]
        spans = (d[:middle].min(initial=np.inf), d[:middle].max(initial=0.0), d[middle:].min(), d[middle:].max())
        self.nodes[me] = (low, high, self._build(low + 1, low + 1 + middle, leaf), self._build(low + 1 + middle, high, leaf), spans)
        return me

    def search(self, q: np.ndarray, k: int, bound: float = np.inf, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and distances of the k nearest that were found (and ties with the last), and how many rows were looked at."""
        _, rows, d, looked = self.search_many(q[None], k, np.array([bound]), factor)
        return rows, d, looked

    def search_many(self, q: np.ndarray, k: int, bounds: np.ndarray, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """For all rows of q at once: query, row and distance of the k nearest found within each bound (and ties), and how many were looked at."""
        near, found, looked, norms = np.repeat(bounds[:, None], k, 1), [], 0, (q * q).sum(1)
        stack = [(0, np.arange(len(q)), np.zeros(len(q)))]
        while stack:
            node, who, least = stack.pop()
            on = factor * least <= near[who, -1] * (1 + SLACK) + SLACK
            who, least = who[on], least[on]
            if not len(who):
                continue
            low, high, inner, outer, spans = self.nodes[node]
            if inner is None:
                rows = self.order[low:high]
                looked += len(rows) * len(who)
                found.append(self._leaf(q, norms, rows, who, near, k))
                continue
            d, vantage = distances(q[who], self.x[self.order[low]]), self.order[low]
            looked += len(who)
            ok = d <= near[who, -1]
            found.append((who[ok], np.full(ok.sum(), vantage), d[ok]))
            near[who] = np.sort(np.c_[near[who], d], axis=1)[:, :k]
            a, b = (np.maximum.reduce([spans[j] - d, d - spans[j + 1], least]) for j in (0, 2))
            both = [(inner, who, a), (outer, who, b)]
            stack += both[:: 1 if a.sum() > b.sum() else -1]
        who, rows, d = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        ok = d <= near[who, -1]
        return who[ok], rows[ok], d[ok], looked

    def _leaf(self, q: np.ndarray, norms: np.ndarray, rows: np.ndarray, who: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A matrix product finds what may be among the k nearest; only that is measured exactly."""
        x, limit = self.x[rows], near[who, -1]
        size = (x * x).sum(1)
        about = size + norms[who][:, None] - 2 * (q[who] @ x.T)
        slack = 1e-11 * (size.max() + norms[who])
        kth = np.partition(about, k - 1, axis=1)[:, k - 1] if len(rows) >= k else np.full(len(who), np.inf)
        i, j = np.nonzero(about <= np.minimum(limit**2 * (1 + SLACK), kth + slack)[:, None] + slack[:, None])
        d = distances(x[j], q[who[i]])
        ok = d <= limit[i]
        i, j, d = i[ok], j[ok], d[ok]
        exact = np.full(about.shape, np.inf)
        exact[i, j] = d
        near[who] = np.sort(np.partition(np.c_[near[who], exact], k - 1, axis=1)[:, :k], axis=1)
        return who[i], rows[j], d


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & (x > float("-inf")) & (x < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))


def _by_length(pivots: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Numbers and matrix of the pivots of every length."""
    of = {n: [k for k, p in enumerate(pivots) if len(p) == n] for n in {len(p) for p in pivots}}
    return {n: (np.array(ks), np.stack([pivots[k] for k in ks])) for n, ks in of.items()}


def _lengths(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of a column of lists: every length, the places of its vectors, and they as a matrix."""
    sizes = np.diff(column.offsets.to_numpy())
    flat, ends = column.flatten().to_numpy(), np.cumsum(sizes)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield int(n), at, flat[(ends[at] - n)[:, None] + np.arange(n)]


def _apart(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distances of all rows of x from all of p, up to rounding."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * (x @ p.T), 0))


def _nearest_pivot(pivots: list[np.ndarray]):
    """Adds the cell of every vector, and its distance from the pivot; lengths without a pivot are cells of their own."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _by_length(pivots)
        for batch in batches:
            cells, away = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            for n, at, x in _lengths(batch.column("v")):
                cells[at] = -n
                if n in of:
                    numbers, p = of[n]
                    nearest = _apart(x, p).argmin(1)
                    cells[at], away[at] = numbers[nearest], distances(x, p[nearest])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    return assign


def _routes(pivots: list[np.ndarray], spans: dict[int, tuple[float, float]], factor: float):
    """The cells that a query's bound doesn't rule out, with its distance from their pivot; as many spans as there are cells."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _by_length(pivots)
        for batch in batches:
            bound = batch.column("bound").to_numpy(zero_copy_only=False).astype(float)
            bound[np.isnan(bound)] = np.inf
            for n, at, x in _lengths(batch.column("v")):
                if n not in of:
                    continue
                numbers, p = of[n]
                low, high = (np.array([spans.get(int(c), (np.inf, -np.inf))[j] for c in numbers]) for j in (0, 1))
                d = _apart(x, p)
                q, c = np.nonzero(factor * np.maximum(low - d, d - high) <= (bound[at] * (1 + SLACK) + SLACK)[:, None] + 1e-6 * (1 + d))
                yield pa.RecordBatch.from_arrays([batch.column("point").take(pa.array(at[q])), pa.array(numbers[c].astype(np.int32)), pa.array(distances(x[q], p[c])), pa.array(bound[at[q]])], names=["point", "cell", "away", "bound"])

    return route


def _search_shard(k: int, factor: float):
    import pandas as pd

    def search(key, points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if points.empty or queries.empty:
            return pd.DataFrame({"point": pd.Series(dtype="object"), "near": pd.Series(dtype="object"), "d": pd.Series(dtype="float64")})
        tree = VPTree(np.stack(points["v"].to_numpy()))
        q, r, d, _ = tree.search_many(np.stack(queries["v"].to_numpy()), k, queries["bound"].fillna(np.inf).to_numpy(float), factor)
        return pd.DataFrame({"point": queries["point"].to_numpy()[q], "near": points["point"].to_numpy()[r], "d": d})

    return search


def _sharded(cells: DataFrame) -> DataFrame:
    """Adds ring and part to rows with their cell and distance: rings of about SHARD_ROWS rows, counted in BINS of distance."""
    spans = cells.groupBy("cell").agg(F.min("away").alias("_low"), F.max("away").alias("_high"), F.count("*").alias("_rows"))
    spans = written(spans, "vp-spans")  # a row for every cell: MAX_PIVOTS and the odd lengths at most
    step = F.when(F.col("_high") > F.col("_low"), (F.col("away") - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.0)
    binned = salted_join(cells, spans, ["cell"], "_rows", ["point"]).withColumn("bin", F.least(F.floor(step * BINS), F.lit(BINS - 1)).cast("int")).drop("_low", "_high", "_rows")
    bins = binned.groupBy("cell", "bin").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("cell").orderBy("bin")) - F.col("_n")
    bins = written(bins.select("cell", "bin", "_n", F.floor(before / SHARD_ROWS).cast("int").alias("ring"), F.ceil(F.col("_n") / (2 * SHARD_ROWS)).cast("int").alias("_parts")), "vp-bins")
    rows = salted_join(binned, bins, ["cell", "bin"], "_n", ["point"])
    return rows.withColumn("part", F.when(F.col("_parts") > 1, F.pmod(F.xxhash64("point", F.lit(3)), F.col("_parts"))).otherwise(-1).cast("long")).drop("bin", "_n", "_parts")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id, score (distance): the k rows found nearest to every query, itself left out."""
    spark = vectors.sparkSession
    tune(spark)
    name = F.concat_ws("-", F.hex(F.xxhash64("v")), F.hex(F.xxhash64(F.lit(1), F.col("v"))))
    rows = _usable(vectors, id_col, vector_col).withColumn("point", name)
    first = Window.partitionBy("point").orderBy("id")
    # Of equal vectors only the k + 1 of least id can be in a list (one may be the query itself).
    members = written(rows.dropDuplicates(["id", "point"]).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k + 1).select("point", "id", "v", "_n"), "vp-members")
    points = members.filter("_n = 1").select("point", "v")

    wanted = min(MAX_PIVOTS, max(LEAST_SHARDS, points.count() // SHARD_ROWS + 1))
    pivots = [np.array(r["v"]) for r in sample_by_hash(points, ["point"], wanted).collect()]
    cells = written(points.mapInArrow(_nearest_pivot(pivots), "point string, v array<double>, cell int, away double"), "vp-cells")
    keys = ["cell", "ring", "part"]
    shards = written(_sharded(cells).select(*keys, "point", "v", "away"), "vp-shards")
    rings = written(shards.groupBy(*keys).agg(F.min("away").alias("low"), F.max("away").alias("high")), "vp-rings")
    spans = {r["cell"]: (r["low"], r["high"]) for r in rings.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}

    asked = _usable(queries, id_col, vector_col).select(F.col("id").alias("query_id"), name.alias("point"), "v").distinct()
    distinct = written(asked.select("point", "v").dropDuplicates(["point"]).mapInArrow(_nearest_pivot(pivots), "point string, v array<double>, cell int, away double"), "vp-queries")
    blocks = max(1, -(-distinct.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("point", F.lit(5)), F.lit(blocks)).cast("int")

    def searched(visits: DataFrame) -> DataFrame:
        """Visits: point, bound and a shard. Every shard goes to the blocks of queries that visit it, and to no other."""
        visits = written(visits.withColumn("block", block), "vp-visits")
        copies = shards.join(visits.select(*keys, "block").distinct(), keys).select(*keys, "block", "point", "v")
        by = [*keys, "block"]
        visits = visits.join(distinct.select("point", "v"), "point")
        copies, visits = (d.toDF(*d.columns) for d in (copies, visits))  # both come from the visits: columns of their own
        return copies.groupBy(by).cogroup(visits.groupBy(by)).applyInPandas(_search_shard(k + 1, factor), "point string, near string, d double")

    gap = F.greatest(F.col("low") - F.col("away"), F.col("away") - F.col("high"), F.lit(0.0))
    homes = distinct.drop("v").join(rings, "cell").groupBy("point").agg(F.min(F.struct(gap.alias("gap"), *keys)).alias("home"))
    homes = written(homes.select("point", *[F.col(f"home.{c}") for c in keys]), "vp-homes")
    at_home = written(searched(homes.withColumn("bound", F.lit(None).cast("double"))), "vp-home")
    in_order = Window.partitionBy("point").orderBy("d")
    bounds = at_home.withColumn("_n", F.row_number().over(in_order)).filter(F.col("_n") == k + 1).select("point", F.col("d").alias("bound"))

    routed = distinct.select("point", "v").join(bounds, "point", "left").mapInArrow(_routes(pivots, spans, factor), "point string, cell int, away double, bound double")
    alone = distinct.filter("cell < 0").select("point", "cell", "away").join(bounds, "point", "left").select("point", "cell", "away", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    routed = routed.union(alone).join(rings, "cell").filter(factor * gap <= F.col("bound") * (1 + SLACK) + SLACK)
    found = at_home.union(searched(routed.select("point", "bound", *keys).join(homes, ["point", *keys], "left_anti")))

    # Points that can still be in a list: the k + 1 nearest, and those as near as the last.
    close = found.withColumn("_n", F.rank().over(in_order)).filter(F.col("_n") <= k + 1).drop("_n")
    near = close.join(members.select(F.col("point").alias("near"), "id", "_n"), "near").select("point", "d", "id")
    lists = near.withColumn("_n", F.row_number().over(Window.partitionBy("point").orderBy("d", "id"))).filter(F.col("_n") <= k + 1).drop("_n")
    answers = asked.select("query_id", "point").join(lists, "point").filter("id <> query_id")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("d", "id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), F.col("d").alias("score"))


def op1_vp_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"))
