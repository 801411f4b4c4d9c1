"""Operator 5: media columns. Signatures are found by Aho-Corasick, confirmed by each format's own
structure and lengths, and so correct declared types and carve embedded media.

``sniff`` looks at a whole payload once: the automaton gives every place where magic bytes stand, a
validator for the format walks its headers and returns where the object ends, or nothing. An object
at 0 decides the type; others inside it are carved, the outermost first.

Nulls and edges: a null payload has type null and carves nothing; an empty one is
``application/octet-stream``; a header that the payload's end cuts off confirms nothing; ties at a
place go to the format listed first; very long payloads are looked at whole, their chains of boxes and
pages walked once; the query takes null text as empty, keeps repeated rows and null ids, ignores other
columns, and gives no rows for an empty table. ``sniff_columns`` keeps other columns, but replaces any
that are named ``media_type``, ``corrected`` or ``carved``, after it has read the declared type.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tune, written

# Magic bytes, how far from the start of the object they stand, and the media type.
SIGNATURES = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"RIFF", 0, "audio/wav"),
    (b"RIFF", 0, "image/webp"),
    (b"BM", 0, "image/bmp"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"OggS", 0, "audio/ogg"),
    (b"ftyp", 4, "video/mp4"),
]
UNKNOWN = "application/octet-stream"
SAMPLE_RATE, UNIT, PAD = 16_000, 192, b" "
_XREF_AT = re.compile(rb"(?=\s{0,4}(?:xref|[0-9]{1,10}\s{1,4}[0-9]{1,5}\s{1,4}obj))")


def _png(b: bytes, at: int) -> int | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or first != (kind == b"IHDR") or first and n != 13:
            return None
        if zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p
    return None


@lru_cache(maxsize=1)
def _gif_walked(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of every place that was walked: where the sub-blocks that begin there end, and the picture whose blocks do (0: not walked, -1: nowhere)."""
    return np.zeros(len(b) + 1, np.int64), np.zeros(len(b) + 1, np.int64)


def _walked(ends: np.ndarray, way: list[int], end: int) -> int:
    ends[way] = end
    return end


def _gif(b: bytes, at: int) -> int | None:
    """Chains of blocks that meet go on as one: each place is walked once, however many headers lead to it."""
    if at + 13 > len(b):
        return None
    inner, outer = _gif_walked(b)
    p = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    way = []
    while True:
        if p >= len(b):
            end = -1
        elif outer[p]:
            end = int(outer[p])
        elif b[p] == 0x3B:
            end = p + 1
        elif b[p] == 0x21 or b[p] == 0x2C and p + 10 <= len(b):
            way.append(p)
            p += 2 if b[p] == 0x21 else 10 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0) + 1
            steps = []
            while p < len(b) and b[p] and not inner[p]:
                steps.append(p)
                p += b[p] + 1
            p = _walked(inner, steps, int(inner[p]) if p < len(b) and inner[p] else p + 1)
            continue
        else:
            end = -1
        _walked(outer, way, end)
        return end if end > 0 else None


def _jpeg(b: bytes, at: int) -> int | None:
    p = at + 2
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return None
        marker = b[p + 1]
        if marker == 0xD9:
            return p + 2
        n = struct.unpack_from(">H", b, p + 2)[0]
        if not 0xC0 <= marker <= 0xFE or n < 2:
            return None
        p += 2 + n
        if marker == 0xDA:  # the scan: up to a marker that is neither stuffing nor a restart
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return None
                if b[p + 1] and not 0xD0 <= b[p + 1] <= 0xD7:
                    break
                p += 2
    return b.startswith(b"\xff\xd9", p) and p + 2 or None


def _riff(b: bytes, at: int, form: bytes, needed: bytes) -> int | None:
    if at + 12 > len(b) or b[at + 8 : at + 12] != form:
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    p, seen = at + 12, set()
    if end > len(b):
        return None
    while p + 8 <= end:
        kind, n = struct.unpack_from("<4sI", b, p)
        seen.add(kind[: len(needed)])
        p += 8 + n + n % 2
    return end if needed in seen and p in (end, end + 1) else None


def _wav(b: bytes, at: int) -> int | None:
    end = _riff(b, at, b"WAVE", b"data")
    if end is None or b[at + 12 : at + 16] != b"fmt " or struct.unpack_from("<I", b, at + 16)[0] < 16:
        return None
    channels, rate, per_second, align = struct.unpack_from("<HIIH", b, at + 22)
    return end if channels and rate and per_second == rate * align else None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 30 > len(b):
        return None
    size, reserved, start, header = struct.unpack_from("<IIII", b, at + 2)
    ok = not reserved and header in (12, 40, 52, 56, 108, 124) and 14 + header <= start <= size and at + size <= len(b)
    return at + size if ok else None


@lru_cache(maxsize=1)
def _pdf_ends(b: bytes) -> dict[int, int]:
    """Of every PDF header with an end: where its last update ends.

    An end belongs to the latest header from which its startxref leads to a table or an object. Where
    none is led right, it closes the innermost header that has no end yet, or else the latest.
    """
    ends, headers, unclosed = {}, [], []
    starts = np.array([m.start() for m in re.finditer(rb"%PDF-[0-9]", b)], np.int64)
    leads = np.zeros(len(b) + 1, bool)  # places from which a table or an object can be read
    if len(starts):
        leads[[m.start() for m in _XREF_AT.finditer(b)]] = True
    for m in re.finditer(rb"%PDF-[0-9]|startxref\s*([0-9]*)(?:(?!startxref|%PDF-[0-9]).)*?%%EOF", b, re.DOTALL):
        if m[1] is None:
            headers.append(m.start())
            unclosed.append(m.start())
        elif headers:
            to = int(m[1]) if 0 < len(m[1]) < 16 else 0
            near = starts[: np.searchsorted(starts, m.start() - to)] if 0 < to < m.start() else starts[:0]
            right = np.flatnonzero(leads[near[: len(headers)] + to])
            led = int(near[right[-1]]) if len(right) else None
            owner = led if led is not None else unclosed[-1] if unclosed else headers[-1]
            while unclosed and unclosed[-1] >= owner:
                unclosed.pop()
            ends[owner] = m.end()
    return ends


def _pdf(b: bytes, at: int) -> int | None:
    return _pdf_ends(b).get(at)


@lru_cache(maxsize=1)
def _zip_ends(b: bytes) -> dict[int, int]:
    """Of every place to which the directory of an end record leads back: where the first such record ends."""
    ends, p = {}, b.find(b"PK\x05\x06")
    while 0 <= p <= len(b) - 22:
        size, start, note = struct.unpack_from("<IIH", b, p + 12)
        if p >= start + size and b.startswith(b"PK\x01\x02", p - size):
            ends.setdefault(p - size - start, p + 22 + note)
        p = b.find(b"PK\x05\x06", p + 4)
    return ends


def _zip(b: bytes, at: int) -> int | None:
    return _zip_ends(b).get(at)


def _gzip(b: bytes, at: int) -> int | None:
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return None
    d = zlib.decompressobj(31)
    try:
        p = at
        while not d.eof and p < len(b):  # piece by piece: what it holds is not kept
            d.decompress(d.unconsumed_tail or b[p : p + 65_536], 1 << 20)
            p += 0 if d.unconsumed_tail else 65_536
    except zlib.error:
        return None
    return min(p, len(b)) - len(d.unused_data) if d.eof else None


@lru_cache(maxsize=1)
def _ogg_ends(b: bytes) -> dict[int, int]:
    """Of every page: where the whole pages that follow each other from it end. Each page is walked once."""
    ends: dict[int, int] = {}
    p = b.rfind(b"OggS\x00")
    while p >= 0:
        if p + 27 <= len(b) and p + 27 + b[p + 26] <= len(b):
            end = p + 27 + b[p + 26] + sum(b[p + 27 : p + 27 + b[p + 26]])
            if end <= len(b):
                ends[p] = ends.get(end, end)
        p = b.rfind(b"OggS\x00", 0, p)
    return ends


def _ogg(b: bytes, at: int) -> int | None:
    return _ogg_ends(b).get(at)


@lru_cache(maxsize=1)
def _mp4_boxes(b: bytes) -> dict[int, tuple[int, bool]]:
    """Filled by ``_mp4``: of every box that was walked, where the boxes from it on end and whether one is moov."""
    return {}


def _mp4(b: bytes, at: int) -> int | None:
    seen, p, walked = _mp4_boxes(b), at, []
    while p not in seen and p + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if n < 8 or p + n > len(b) or not kind.isalnum():
            break
        walked.append((p, kind))
        p += n
    end, moov = seen.get(p, (p, False))
    for start, kind in reversed(walked):
        moov = moov or kind == b"moov"
        seen[start] = end, moov
    return end if b.startswith(b"ftyp", at + 4) and seen.get(at, (0, False))[1] else None


VALIDATORS: dict[str, Callable[[bytes, int], int | None]] = {
    "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "audio/wav": _wav,
    "image/webp": lambda b, at: _riff(b, at, b"WEBP", b"VP8"), "image/bmp": _bmp, "application/pdf": _pdf,
    "application/zip": _zip, "application/gzip": _gzip, "audio/ogg": _ogg, "video/mp4": _mp4,
}

_automaton = None


def _magic():
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        by_magic: dict[bytes, list[tuple[int, str]]] = {}
        for magic, back, kind in SIGNATURES:
            by_magic.setdefault(magic, []).append((len(magic) - 1 + back, kind))
        for magic, kinds in by_magic.items():
            _automaton.add_word(magic.decode("latin-1"), kinds)
        _automaton.make_automaton()
    return _automaton


def sniff(payload: bytes | None) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The media type, and the objects carved from inside: type, place, length."""
    if payload is None:
        return None, []
    kind, carved, past = UNKNOWN, [], 0
    starts = sorted({(at, k) for end, kinds in _magic().iter(payload.decode("latin-1")) for k, (back, _) in enumerate(kinds) for at in [end - back] if at >= 0 for k in [kinds[k][1]]}, key=lambda x: (x[0], [s[2] for s in SIGNATURES].index(x[1])))
    for at, found in starts:
        if at < past or at == 0 and kind != UNKNOWN:
            continue
        end = VALIDATORS[found](payload, at)
        if end is None:
            continue
        if at == 0:
            kind = found
        else:
            carved.append((found, at, end - at))
            past = end
    return kind, carved


def as_wav(samples: bytes, rate: int = SAMPLE_RATE) -> bytes:
    """One channel of unsigned 8-bit samples."""
    pad = b"\x80" * (len(samples) % 2)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 36 + len(samples) + len(pad), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(samples)) + samples + pad


def wav_samples(media: bytes) -> bytes:
    """The samples of a file that ``as_wav`` made."""
    kind, n = struct.unpack_from("<4sI", media, 36)
    if media[:4] != b"RIFF" or kind != b"data":
        raise ValueError("not 8-bit PCM with a plain header")
    return media[44 : 44 + n]


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [x.encode() for x in batch.column("text").to_pylist()]
        media = [as_wav(x + PAD * ((-len(x)) % UNIT or UNIT * (not x))) for x in raw]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(["text/plain"] * len(raw)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])


FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, media_type string, carved array<struct<type:string,start:bigint,length:bigint>>, feature string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("media_type", pa.string()), ("carved", pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))), ("feature", pa.string())])
    for batch in batches:
        rows = []
        for doc, n, declared, media in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "declared", "media"))):
            samples = wav_samples(media)
            kind, carved = sniff(media)
            feature = f"{kind};declared={declared};corrected={int(kind != declared)};samples={len(samples)};carved=" + ",".join(f"{k}@{at}+{size}" for k, at, size in carved)
            rows.append({"doc_id": doc, "n_bytes": n, "payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-16:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "media_type": kind, "carved": [dict(zip(("type", "start", "length"), c)) for c in carved], "feature": feature})
        yield pa.RecordBatch.from_pylist(rows, schema)


def store_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text as 8-bit samples in a WAV object, written and read back."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return written(rows.mapInArrow(_store, "doc_id bigint, n_bytes bigint, declared string, media binary"), "media")


def sniff_columns(df: DataFrame, payload: str, declared: str) -> DataFrame:
    """Adds media_type (the declared one where nothing is recognised), corrected, and carved objects with their bytes."""
    tune(df.sparkSession)

    @F.pandas_udf("struct<kind:string,carved:array<struct<type:string,start:bigint,bytes:binary>>>")
    def look(x):
        import pandas as pd

        seen = [sniff(None if b is None else bytes(b)) for b in x]
        return pd.DataFrame({"kind": [k for k, _ in seen], "carved": [[{"type": t, "start": at, "bytes": bytes(b)[at : at + n]} for t, at, n in c] for (_, c), b in zip(seen, x)]})

    out = df.withColumn("_ms_seen", look(F.col(payload)))
    known = F.when(F.col("_ms_seen.kind") != UNKNOWN, F.col("_ms_seen.kind"))
    return out.withColumns({"media_type": F.coalesce(known, F.col(declared)), "corrected": F.coalesce(known != F.col(declared), F.lit(False)), "carved": F.col("_ms_seen.carved")}).drop("_ms_seen")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_documents(table(spark, sf_dir, "documents")).mapInArrow(_features, FEATURES)
