"""Operator 2: token ids in bit planes.

Ids of consecutive documents form one stream in doc_id order. The stream of each file is cut into
blocks of a fixed number of ids; a block is transposed into bit planes (or byte planes), and each
plane is compressed by zstandard. A chunk index says for each block which ids it holds, how long
each plane is, and where the block starts in the whole stream.

Layout of a stored dataset (Spark writes it, so a retried task leaves no half file):

``chunks/``  file int, chunk int, n_ids int, blob binary, doc_ids array<long>, doc_lens array<int>
             (documents that start in this block), plane_bytes array<int>
``index/``   file int, chunk int, start long (ids before the block), n_ids int, blob_bytes int,
             plane_bytes array<int>, crc32 long (of the blob)

A blob: ``BPL1``, mode (0 bit planes, 1 byte planes), number of planes, two zero bytes, then as
little-endian u32 the number of ids and the length of every plane, then the zstandard frames.

The reader holds every block against its line of the index (place, number of ids, plane lengths, checksum)
and every document against its length; a missing or damaged block is an error, never a shorter result.

Nulls and edges: null text counts as empty (it still gets the end id); a null doc_id sorts first and
stays null; a very long text spans any number of blocks; documents of equal doc_id follow each other in any order; an empty table gives an empty
dataset; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark import TaskContext

from .common import fresh_path, table, tune
from .tokens import chunks, encoder

MAGIC, BLOCK_IDS, END_ID = b"BPL1", 32_768, 1
CHUNKS = "file int, chunk int, n_ids int, blob binary, doc_ids array<bigint>, doc_lens array<int>, plane_bytes array<int>"


def pack_block(ids: np.ndarray, mode: str = "bit", level: int = 1) -> bytes:
    """One block of ids as a blob."""
    import zstandard

    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if mode == "bit":
        width = int(ids.max()).bit_length() if len(ids) else 0
        planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T[:width], axis=1, bitorder="little")
    else:
        width = (int(ids.max()).bit_length() + 7) // 8 if len(ids) else 0
        planes = np.ascontiguousarray(raw.T[:width])
    c = zstandard.ZstdCompressor(level=level)
    frames = [c.compress(x.tobytes()) for x in planes]
    head = struct.pack("<4sBBHI", MAGIC, mode != "bit", width, 0, len(ids))
    return head + struct.pack(f"<{width}I", *map(len, frames)) + b"".join(frames)


def plane_lengths(blob: bytes) -> list[int]:
    return list(struct.unpack_from(f"<{blob[5]}I", blob, 12))


def unpack_block(blob: bytes) -> np.ndarray:
    """The ids of a blob."""
    import zstandard

    magic, by_byte, width, _, n = struct.unpack_from("<4sBBHI", blob)
    if magic != MAGIC:
        raise ValueError("not a block of bit planes")
    d, at, planes = zstandard.ZstdDecompressor(), 12 + 4 * width, []
    for size in plane_lengths(blob):
        planes.append(np.frombuffer(d.decompress(blob[at : at + size]), np.uint8))
        at += size
    out = np.zeros((4, n), np.uint8)
    if by_byte:
        for k, x in enumerate(planes):
            out[k] = x
    elif n:
        bits = np.zeros((32, n), np.uint8)
        for k, x in enumerate(planes):
            bits[k] = np.unpackbits(x, count=n, bitorder="little")
        out = np.packbits(bits, axis=0, bitorder="little")
    return np.ascontiguousarray(out.T).view("<u4").reshape(-1)


def _chunk_writer(path: str, end_id: int, block: int, mode: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, chunk, held, size, taken, total = TaskContext.get().partitionId(), 0, [], 0, 0, 0
        enc, end = encoder(path, "word"), np.array([end_id], "<u4")
        starts: list[tuple[int, int, int]] = []  # document, ids, place in the stream of the file

        def row(ids: np.ndarray) -> pa.RecordBatch:
            nonlocal starts, taken
            k = 0
            while k < len(starts) and starts[k][2] < taken + len(ids):
                k += 1
            here, starts, taken = starts[:k], starts[k:], taken + len(ids)
            blob = pack_block(ids, mode)
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int32()), pa.array([chunk], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([blob], pa.binary()), pa.array([[x[0] for x in here]], pa.list_(pa.int64())), pa.array([[x[1] for x in here]], pa.list_(pa.int32())), pa.array([plane_lengths(blob)], pa.list_(pa.int32()))],
                names=["file", "chunk", "n_ids", "blob", "doc_ids", "doc_lens", "plane_bytes"],
            )

        for batch in chunks(batches):
            docs = batch.column("doc_id").to_pylist()
            for doc, ids in zip(docs, enc.encode(batch.column("text"))):
                starts.append((doc, len(ids) + 1, total))
                held += [ids, end]
                size, total = size + len(ids) + 1, total + len(ids) + 1
            whole = np.concatenate(held)
            while len(whole) >= block:
                yield row(whole[:block])
                chunk, whole = chunk + 1, whole[block:]
            held, size = [whole.copy()], len(whole)
        if size:
            yield row(np.concatenate(held))

    return write


def write_token_planes(docs: DataFrame, path: str, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, block: int = BLOCK_IDS, mode: str = "bit", files: int | None = None) -> None:
    """Encode every whole text and store the ids under ``path``, ascending by ``id_col``."""
    spark = docs.sparkSession
    tune(spark)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id")
    rows.mapInArrow(_chunk_writer(vocabulary, end_id, block, mode), CHUNKS).write.option("compression", "none").parquet(f"{path}/chunks")
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    # A row for each file: as many as the write had tasks.
    files_before = chunks.groupBy("file").agg(F.sum("n_ids").alias("n")).select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    within = Window.partitionBy("file").orderBy("chunk")
    index = chunks.select("file", "chunk", "n_ids", F.length("blob").alias("blob_bytes"), "plane_bytes", F.crc32("blob").alias("crc32"))
    index = index.withColumn("inside", F.sum("n_ids").over(within) - F.col("n_ids"))
    index = index.join(F.broadcast(files_before), "file").select("file", "chunk", (F.col("before") + F.col("inside")).alias("start"), "n_ids", "blob_bytes", "plane_bytes", "crc32")
    index.write.parquet(f"{path}/index")


def _checked(line: dict | None, r: dict) -> np.ndarray:
    """The ids of a block, if all that the index says of it holds."""
    blob = r["blob"]
    if line is None or (line["file"], line["chunk"]) != (r["file"], r["chunk"]) or zlib.crc32(blob) != line["crc32"] or plane_lengths(blob) != line["plane_bytes"]:
        raise ValueError(f"token planes: block {r['chunk']} of file {r['file']} is not what the index says")
    ids = unpack_block(blob)
    if len(ids) != line["n_ids"]:
        raise ValueError(f"token planes: block {r['chunk']} of file {r['file']} holds {len(ids)} ids of {line['n_ids']}")
    return ids


def _chunk_reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a file follow each other, each after its line of the index; a document may span any number of them."""
    left, start, ended, file, line = b"", 0, 0, None, None
    waiting: list[tuple[int, int]] = []
    out: list[tuple] = []

    def whole() -> None:
        if line is not None or waiting or left:
            raise ValueError(f"token planes: file {file} ends before its last document")

    def flush() -> pa.RecordBatch:
        nonlocal out
        got, out = list(zip(*out)), []
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(got, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "n_tokens", "ids"])

    for batch in batches:
        for r in batch.to_pylist():
            if r["file"] != file:
                whole()
                file, start, ended = r["file"], r["start"], r["start"]
            if r["blob"] is None:
                if line is not None or r["start"] != ended:
                    raise ValueError(f"token planes: file {file} lacks the block before {r['chunk']}")
                line = r
                continue
            ids = _checked(line, r)
            line, ended = None, ended + len(ids)
            waiting += zip(r["doc_ids"], r["doc_lens"])
            left, at, k = left + ids.tobytes(), 0, 0
            while k < len(waiting) and at + 4 * waiting[k][1] <= len(left):
                doc, want = waiting[k]
                out.append((doc, start, want, left[at : at + 4 * want]))
                at, start, k = at + 4 * want, start + want, k + 1
            left, waiting = left[at:], waiting[k:]
            if len(out) >= 500:
                yield flush()
    whole()
    if out:
        yield flush()


def read_token_planes(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every stored document."""
    tune(spark)
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").drop("n_ids", "plane_bytes")
    index = spark.read.parquet(f"{path}/index").drop("blob_bytes")
    rows = index.unionByName(chunks, allowMissingColumns=True).repartition("file").sortWithinPartitions("file", "chunk", F.col("start").asc_nulls_last())
    return rows.mapInArrow(_chunk_reader, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def op2_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "token-planes")
    write_token_planes(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_planes(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
