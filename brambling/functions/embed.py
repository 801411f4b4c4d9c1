"""Text to vectors: embedders by name, and one that hashes words and pairs of words with signs."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

DIMENSIONS, LONGEST = 64, 2
#: Words of the texts that are counted together, and of how many on their grams are digested by arrays.
GROUP_WORDS, MANY_WORDS = 200_000, 2_000
# Words stand between blanks and line ends.
_WORDS = re.compile(r"[^ \n]+")


@dataclass(frozen=True)
class Embedder:
    """A name, the vectors' length, and the function from a text column to a column of vectors: any pandas or Arrow function, or a Column."""

    name: str
    dimensions: int
    column: Callable[[Column], Column]


EMBEDDERS: dict[str, Embedder] = {}


def register(embedder: Embedder) -> Embedder:
    EMBEDDERS[embedder.name] = embedder
    return embedder


def _counts(words: list[list[str]], dimensions: int, longest: int) -> np.ndarray:
    """The sum of each text's signed units; a gram is digested once, however often it stands in these texts."""
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for ws in words for w in ws], np.int64)
    sizes, flat = np.array([len(ws) for ws in words], np.int64), [w for ws in words for w in ws]
    doc, ends = np.repeat(np.arange(len(words)), sizes), np.cumsum(sizes)
    total, run, at = np.zeros(len(words) * dimensions), ids, np.arange(len(ids))
    for n in range(1, longest + 1):
        if n > 1:
            stays = at + n <= ends[doc[at]]
            at, run = at[stays], run[stays]
            run = run * len(number) + ids[at + n - 1]
        if not len(at):
            break
        _, first, run = np.unique(run, return_index=True, return_inverse=True)
        found = (" ".join(flat[p : p + n]) for p in at[first].tolist()) if n > 1 else (flat[p] for p in at[first].tolist())
        h = np.frombuffer(b"".join([md5(g.encode()).digest()[:4] for g in found]), ">u4").astype(np.int64)
        place, sign = h % dimensions, 1.0 - 2 * (h // dimensions % 2)
        total += np.bincount(doc[at] * dimensions + place[run], sign[run], len(total))
    return total.reshape(len(words), dimensions)


_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [np.uint32(int(abs(math.sin(k + 1)) * 2**32)) for k in range(64)]
#: Bytes of a gram that fit one block of the digest, and grams whose blocks stay in a core's cache.
_ONE_BLOCK, _CACHED = 55, 16_384


def _first_words(blocks: np.ndarray) -> np.ndarray:
    """The first four bytes of the MD5 digests of padded blocks (n, 16 words of 32 bits), all blocks in step."""
    w, start = np.ascontiguousarray(blocks.T), [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(len(blocks), x) for x in start)
    f, low = np.empty_like(a), np.empty_like(a)
    for k in range(64):
        turn = k // 16
        if turn == 0:
            g = k
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            g = (5 * k + 1) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            g = (3 * k + 5) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            g = 7 * k % 16
            np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        f += a
        f += _SINES[k]
        f += w[g]
        n = _TURNS[turn][k % 4]
        np.right_shift(f, np.uint32(32 - n), out=low), np.left_shift(f, np.uint32(n), out=f), np.bitwise_or(f, low, out=f)
        f += b
        a, d, c, b, f = d, c, b, f, a
    return (a + start[0]).byteswap().astype(np.int64)


def _digests(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first four bytes, as a number, of the MD5 digest of each run of bytes."""
    h, width = np.empty(len(starts), np.int64), _ONE_BLOCK + 1
    windows = np.ndarray((len(buffer) + 1,), f"V{width}", np.concatenate([buffer, np.zeros(width, np.uint8)]).data, strides=(1,))
    whole, place = np.flatnonzero(sizes <= _ONE_BLOCK), np.arange(width)
    for at in range(0, len(whole), _CACHED):
        rows = whole[at : at + _CACHED]
        size, block = sizes[rows], np.zeros((len(rows), 64), np.uint8)
        np.multiply(windows[starts[rows]].view(np.uint8).reshape(-1, width), place < size[:, None], out=block[:, :width])
        block[np.arange(len(rows)), size] = 0x80
        words = block.view("<u4")
        words[:, 14] = size * 8
        h[rows] = _first_words(words)
    for p in np.flatnonzero(sizes > _ONE_BLOCK).tolist():
        h[p] = int.from_bytes(md5(buffer[starts[p] : starts[p] + sizes[p]].tobytes()).digest()[:4])
    return h


def _counts_by_arrays(texts: list[str], dimensions: int, longest: int) -> np.ndarray:
    """As ``_counts``, of texts in lower case: every gram is digested, many at a time, as runs of bytes of all texts."""
    coded = [t.encode() for t in texts]
    ends = np.cumsum([len(t) + 1 for t in coded])
    raw = np.frombuffer(b"\n".join([*coded, b""]), np.uint8)
    inner = np.concatenate([[False], (raw != 32) & (raw != 10)])  # parts of words
    first = np.flatnonzero(inner[1:] & ~inner[:-1])
    doc = np.searchsorted(ends, first, "right")
    kept = inner[1:] | inner[:-1]  # and one byte after each
    buffer = np.where(inner[1:], raw, 32)[kept].astype(np.uint8)
    stop = np.flatnonzero(buffer == 32)
    start = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
    total = np.zeros(len(texts) * dimensions)
    for n in range(1, longest + 1):
        at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
        h = _digests(buffer, start[at], stop[at + n - 1] - start[at])
        total += np.bincount(doc[at] * dimensions + h % dimensions, 1.0 - 2 * (h // dimensions % 2), len(total))
    return total.reshape(len(texts), dimensions)


def _vectors_of(held: list[str], words: int, dimensions: int, longest: int) -> np.ndarray:
    if words < MANY_WORDS:
        return _counts([_WORDS.findall(t) for t in held], dimensions, longest)
    return _counts_by_arrays(held, dimensions, longest)


def hashed_vectors(texts: Iterable[str | None], dimensions: int = DIMENSIONS, longest: int = LONGEST) -> np.ndarray:
    """The sum of a signed unit for each gram, its place and sign by the gram's digest, brought to length one; zeros for a text without words.

    Grams are words and runs of words, in lower case. Equal texts are counted once.
    """
    place: dict[str | None, int] = {}
    which = [place.setdefault(t, len(place)) for t in texts]
    parts, held, n = [np.zeros((0, dimensions))], [], 0
    for text in place:
        held.append(text.lower() if text else "")
        n += 1 + held[-1].count(" ") + held[-1].count("\n")  # words at most
        if n >= GROUP_WORDS:
            parts.append(_vectors_of(held, n, dimensions, longest))
            held, n = [], 0
    total = np.concatenate([*parts, _vectors_of(held, n, dimensions, longest)])
    size = np.sqrt((total * total).sum(1, keepdims=True))
    return np.divide(total, size, out=total, where=size > 0)[which]


def hashed_vector(text: str | None, dimensions: int = DIMENSIONS, longest: int = LONGEST) -> list[float]:
    return hashed_vectors([text], dimensions, longest)[0].tolist()


def hashed(dimensions: int = DIMENSIONS, longest: int = LONGEST) -> Embedder:
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(hashed_vectors(texts, dimensions, longest)), dtype=object)

    return Embedder(f"hashed-{longest}-{dimensions}", dimensions, F.pandas_udf(embed, ArrayType(DoubleType())))


DEFAULT = register(hashed())
