"""Operator 3: a hierarchical empirical Bayes quality classifier.

A logistic classifier over the whole text, fitted on a bounded sample of labelled rows, gives each
document's evidence: eight surface features, and how often words and word endings fall into hashed
classes. Grouped sums of those probabilities give every host and every path of a host a posterior
mean: a host is shrunk towards the corpus, a path towards its host, by prior strengths that are
estimated from the spread between groups (method of moments), so sparse sites follow the prior and large
ones their own record. A document's score joins its evidence with the posterior of its path; both
posteriors are computed without the document itself, so that nothing counts twice.

Only the fit uses the labelled sample (``FIT_ROWS`` rows of least hash). Features, group sums, prior
strengths and scores use every row.

Nulls and edges: null or blank text has no evidence and follows its path; null hosts and paths are
groups of their own; rows of equal ids count one by one; very long texts are read whole; a score at the
threshold is kept; without labels all evidence is even; an empty table gives no rows; other columns are
kept, but columns named as those added are replaced (names beginning with ``_qc_`` are reserved).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import salted_join, sample_by_hash, table, written

FIT_ROWS, THRESHOLD, RIDGE, HASH_RIDGE = 20_000, 0.5, 1.0, 30.0
FEATURES = ("symbols", "upper", "shout", "bars", "variety", "word_length", "words", "marks")
#: Classes of whole words, then of word endings (two characters).
WORD_CLASSES, ENDING_CLASSES = 192, 64
ADDED = ("evidence", "host_posterior", "path_posterior", "score", "keep")


def _words(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\\s+")


def features(text: Column) -> list[Column]:
    """Numbers about the whole text, from built-in functions."""
    t, words = F.coalesce(text, F.lit("")), _words(text)
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    return [
        F.least(count("[#$%&*@~^]") / n, F.lit(3.0)),
        count("[\\p{Lu}]") / chars,
        count("!!") / n,
        F.least(count("[|]") / n, F.lit(1.0)),
        F.log1p(F.size(F.array_distinct(words)).cast("double")) / F.log1p(n),
        F.least(chars / n, F.lit(30.0)) / 10.0,
        F.log1p(n) / 10.0,
        F.least(count("[.,;:?]") / n, F.lit(1.0)),
    ]


def _classes(word: Column) -> list[Column]:
    """The hashed classes of a word: its own and its ending's."""
    return [F.pmod(F.xxhash64(word), F.lit(WORD_CLASSES)).cast("int"), (F.pmod(F.xxhash64(F.right(word, F.lit(2)), F.lit(3)), F.lit(ENDING_CLASSES)) + WORD_CLASSES).cast("int")]


def _line(text: Column, weights: np.ndarray) -> Column:
    """The fitted line for a text: surface features, and the mean weight of its words' classes."""
    words, hashed = _words(text), F.lit([float(w) for w in weights[len(FEATURES) : -1]])
    per_word = F.aggregate(words, F.lit(0.0), lambda total, w: total + F.get(hashed, _classes(w)[0]) + F.get(hashed, _classes(w)[1]))
    surface = sum((F.lit(float(w)) * x for w, x in zip(weights, features(text))), F.lit(float(weights[-1])))
    return surface + per_word / F.greatest(F.size(words), F.lit(1))


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps: weights on raw features (the last is the intercept), base rate.

    Sums run over blocks of rows, so that beside ``x`` nothing of its size is held.
    """
    base = (y.sum() + 1) / (len(y) + 2)
    if not len(y):
        return np.zeros(x.shape[1] + 1), 0.5
    blocks = [slice(k, k + 1000) for k in range(0, len(y), 1000)]
    mean = sum(x[b].sum(0, dtype=float) for b in blocks) / len(y)
    scale = np.sqrt(sum(((x[b] - mean) ** 2).sum(0) for b in blocks) / len(y)) + 1e-9
    hashed = max(0, x.shape[1] - len(FEATURES))
    w, ridge = np.zeros(x.shape[1] + 1), np.r_[np.full(x.shape[1] - hashed, RIDGE), np.full(hashed, HASH_RIDGE), 1e-6]
    for _ in range(30):
        slope, bend = -ridge * w, np.diag(ridge)
        for b in blocks:
            z = np.c_[(x[b] - mean) / scale, np.ones(len(x[b]))]
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope, bend = slope + z.T @ (y[b] - p), bend + (z * (p * (1 - p))[:, None]).T @ z
        step = np.linalg.solve(bend, slope)
        w += np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return np.r_[w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum()], float(base)


def _fit_on(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, fit_rows: int) -> tuple[np.ndarray, float]:
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("_qc_y"))
    known = sample_by_hash(known, ["doc_id"], fit_rows)  # before the join: at most fit_rows broadcast rows, and features of their texts only
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_qc_t")).join(F.broadcast(known), "doc_id")
    rows = rows.select(F.xxhash64("doc_id", "_qc_t").alias("_qc_k"), "_qc_t", "_qc_y")
    surface = rows.groupBy("_qc_k").agg(F.first(F.array(*features(F.col("_qc_t")))).alias("x"), F.first(F.size(_words(F.col("_qc_t")))).alias("n"), F.first("_qc_y").alias("y"))
    classes = F.flatten(F.transform(_words(F.col("_qc_t")), lambda w: F.array(*_classes(w))))
    hashed = rows.select("_qc_k", F.explode(classes).alias("c")).groupBy("_qc_k", "c").agg(F.count("*").alias("m"))
    hashed = hashed.groupBy("_qc_k").agg(F.collect_list(F.struct(F.col("c").cast("short").alias("c"), F.col("m").cast("float").alias("m"))).alias("h"))  # as many as there are classes
    got = surface.join(hashed, "_qc_k").orderBy("_qc_k").limit(fit_rows).drop("_qc_k").toArrow()
    x = np.zeros((len(got), len(FEATURES) + WORD_CLASSES + ENDING_CLASSES), np.float32)
    at = 0
    for part in got.to_batches():
        rows = np.arange(at, at + len(part))
        h, n = part.column("h"), part.column("n").to_numpy()
        owner, cells = np.repeat(rows, np.diff(h.offsets.to_numpy())), h.flatten()
        x[rows, : len(FEATURES)] = part.column("x").flatten().to_numpy().reshape(len(part), -1)
        x[owner, len(FEATURES) + cells.field("c").to_numpy()] = cells.field("m").to_numpy() / n[owner - at]
        at += len(part)
    y = got["y"].to_numpy().astype(float)
    del got
    return fit(x, y)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, prior: Column, mean: Column, n: Column) -> float:
    """How many documents the prior is worth: p(1-p) over the spread between groups that chance doesn't explain."""
    r = groups.filter(n > 1).agg(F.avg(F.pow(mean - prior, 2)).alias("v"), F.avg(prior * (1 - prior)).alias("pq"), F.avg(prior * (1 - prior) / n).alias("e")).first()
    if r is None or r["v"] is None or r["pq"] <= 0:
        return 10.0
    return float(min(max(r["pq"] / max(r["v"] - r["e"], 1e-4) - 1, 1.0), 1000.0))


def with_evidence(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` with _qc_p, the classifier's probability (the base rate where there is no text), and _qc_evidence added."""
    weights, base = _fit_on(docs, labels, id_col, text_col, fit_rows)
    line = _line(F.col(text_col), weights)
    blank = F.coalesce(F.length(F.trim(text_col)) == 0, F.lit(True))
    rows = docs.withColumn("_qc_p", F.when(blank, F.lit(base)).otherwise(1 / (1 + F.exp(-F.least(F.greatest(line, F.lit(-30.0)), F.lit(30.0))))))
    return rows.withColumn("_qc_evidence", _logit(F.col("_qc_p")) - _logit(F.lit(base)))


def with_sites(rows: DataFrame, *, host: Column, path: Column, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``with_evidence``, whole, with _qc_host_posterior, _qc_path_posterior, _qc_score and _qc_keep added."""
    names = rows.columns
    key = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    rows = rows.withColumns({"_qc_host": key(host), "_qc_path": key(path)})
    paths = rows.groupBy("_qc_host", "_qc_path").agg(F.count("*").alias("_qc_n"), F.sum("_qc_p").alias("_qc_s"))
    paths = written(paths, "paths")
    total = paths.agg(F.sum("_qc_n").alias("n"), F.sum("_qc_s").alias("s")).first()
    prior = (total["s"] + 0.5) / (total["n"] + 1) if total["n"] else 0.5
    hosts = paths.groupBy("_qc_host").agg(F.sum("_qc_n").alias("_qc_hn"), F.sum("_qc_s").alias("_qc_hs"))
    host_strength = _strength(hosts, F.lit(prior), F.col("_qc_hs") / F.col("_qc_hn"), F.col("_qc_hn"))
    mean = (F.col("_qc_hs") + host_strength * prior) / (F.col("_qc_hn") + host_strength)
    sites = written(paths.join(hosts, "_qc_host"), "sites")
    path_strength = _strength(sites, mean, F.col("_qc_s") / F.col("_qc_n"), F.col("_qc_n"))

    rows = salted_join(rows, sites, ["_qc_host", "_qc_path"], "_qc_n", ["_qc_p"])
    rows = rows.withColumn("_qc_host_posterior", (F.col("_qc_hs") - F.col("_qc_p") + host_strength * prior) / (F.col("_qc_hn") - 1 + host_strength))
    rows = rows.withColumn("_qc_path_posterior", (F.col("_qc_s") - F.col("_qc_p") + path_strength * F.col("_qc_host_posterior")) / (F.col("_qc_n") - 1 + path_strength))
    rows = rows.withColumn("_qc_score", 1 / (1 + F.exp(-(F.col("_qc_evidence") + _logit(F.col("_qc_path_posterior"))))))
    return rows.select(*[F.col(f"`{c}`") for c in names], "_qc_host_posterior", "_qc_path_posterior", "_qc_score", (F.col("_qc_score") >= threshold).alias("_qc_keep"))


def named(rows: DataFrame) -> DataFrame:
    """Rows of ``with_sites`` with the added columns under their own names."""
    return rows.drop(*ADDED, "_qc_p").withColumnsRenamed({f"_qc_{c}": c for c in ADDED})


def score_documents(docs: DataFrame, labels: DataFrame, *, host: Column, path: Column, **options) -> DataFrame:
    """``docs`` with evidence, host_posterior, path_posterior, score and keep added."""
    return named(with_sites(with_evidence(docs, labels, **options), host=host, path=path))


def _site() -> dict[str, Column]:
    """The documents table: a source stands for a host, a language of a source for a path."""
    return {"host": F.col("source"), "path": F.concat_ws("/", F.col("source"), F.col("lang"))}


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``with_sites`` of ``docs``; evidence is written beside them, as both the sites and the scores read it."""
    return with_sites(written(with_evidence(docs, labels), "evidence"), **_site())


def score_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return named(scored(docs, labels))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_evidence(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    rows = written(rows.select("doc_id", "source", "lang", "_qc_p", "_qc_evidence"), "evidence")
    return named(with_sites(rows, **_site()))
