"""Exact vector retrieval and recursive chunking."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brambling.functions import similarity, squared_distance


def top_k(vectors: DataFrame, query: list[float], k: int, keep: Column | None = None) -> DataFrame:
    """rank, vec_id, similarity of the k nearest rows (10 at most), nearest first, ties to the smaller id."""
    rows = vectors if keep is None else vectors.filter(keep)
    q = F.array(*[F.lit(float(x)) for x in query])
    near = rows.select("vec_id", "label", squared_distance(F.col("embedding").cast("array<double>"), q).alias("d2")).orderBy("d2", "vec_id").limit(min(k, 10))
    return near.withColumn("rank", F.row_number().over(Window.orderBy("d2", "vec_id"))).select("rank", "vec_id", "label", similarity(F.col("d2")).alias("similarity"))


# Where a text may be cut, the best place first.
SEPARATORS = ["\n\n", "\n", "。", ".", "；", ";", "，", ",", " ", ""]


def split_text(text: str, size: int, overlap: int, separators: list[str] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the best separator there is; each may repeat the end of the one before."""
    pieces = _pieces(text, size, separators)
    chunks, held, length = [], [], 0
    for p in pieces:
        if held and length + len(p) > size:
            chunks.append("".join(held))
            while held and (length > overlap or length + len(p) > size):
                length -= len(held.pop(0))
        held.append(p)
        length += len(p)
    if held:
        chunks.append("".join(held))
    return [c for c in (x.strip() for x in chunks) if c]


def _pieces(text: str, size: int, separators: list[str]) -> list[str]:
    if len(text) <= size:
        return [text]
    sep, rest = separators[0], separators[1:]
    if not sep:
        return [text[k : k + size] for k in range(0, len(text), size)]
    parts = text.split(sep)
    parts = [p + sep for p in parts[:-1]] + [parts[-1]]
    return [x for p in parts if p for x in (_pieces(p, size, rest) if len(p) > size else [p])]


def chunk(docs: DataFrame, size: int = 800, overlap: int = 100, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns to keep, chunk_no, text of the chunks of every whole document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(*kept, k, c) for *kept, t in pdf.itertuples(index=False) for k, c in enumerate(split_text(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=[*keep, "chunk_no", "text"])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, "text").mapInPandas(run, ", ".join([*kinds, "chunk_no int", "text string"]))
