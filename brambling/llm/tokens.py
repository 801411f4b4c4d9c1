"""Exact token ids from the tokenizers library, with whole texts cut at places where no token can cross.

In byte-level BPE a pre-token holds a space at its start only, and in the word-level vocabulary white
space is dropped, so the ids of a text are the ids of its space-separated units in a row. Letters and
what follows them are different pre-tokens in both, so a unit's ids are those of its letters and of
its tail. The units of many texts are made distinct by Arrow, each distinct run of letters is encoded
once, many in one text, and kept in a bounded memo, and the ids are gathered by numpy. Texts in which white space is
arranged so that a cut could matter are encoded whole, and so are those that hold the literal of an
added token ('<|endoftext|>'), which the library's encode turns into that token's one id.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RARE = r"\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WHOLE = {"byte": rf"  |\n |[\t\r{_RARE}] |\x00", "word": f"[{_RARE}]"}
_TAIL = ".,;:!?*$#%&@|'\")(-"
_FIRST = "\0"
_LETTER_LAST = {"byte": "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]$", "word": "^[\\x00-\u00ff]*[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]$"}
#: Units of letters only, which are one pre-token each; and how a token shows that a unit starts (or ends) with it.
_LETTERS = {"byte": re.compile(" [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"), "word": re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")}
_EDGE = {"byte": lambda token: token.startswith("\u0120"), "word": lambda token: token.endswith("</w>")}
TOGETHER = 256
MEMO_UNITS, MEMO_CHARS, CHUNK_BYTES, CALL = 550_000, 64, 12 << 20, 5_000


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches joined to about ``limit`` bytes of text: the more texts, the fewer distinct units each."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    rows = pa.Table.from_batches(held).combine_chunks().to_batches() if held else []
    yield from rows[:1]


class UnitEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit numbers.

    kind ``byte``: units are what stands between single spaces, each with the space before it, but for
    the first. kind ``word``: units are what stands between white space, and case doesn't matter.
    """

    def __init__(self, path: str, kind: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind, self.space = kind, " " * (kind == "byte")
        # Units of kind ``word`` are put in lower case, which must not make an added token of one that isn't.
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([_WHOLE[kind], *(f"(?i:{x})" if kind == "word" else x for x in added)])
        self.memo: dict[str, bytes] = {"": b""}
        self.edges = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.edges[[k for token, k in self.tokenizer.get_vocab().items() if _EDGE[kind](token)]] = True

    def _library(self, texts: list[str]) -> list[bytes]:
        run = self.tokenizer.encode_batch_fast
        return [np.asarray(x.ids, "<u4").tobytes() for k in range(0, len(texts), CALL) for x in run(texts[k : k + CALL], add_special_tokens=False)]

    def _together(self, units: list[str]) -> list[bytes]:
        """Ids of units of letters: many in one text, told apart by the tokens at which a unit starts or ends."""
        groups, out = [units[k : k + TOGETHER] for k in range(0, len(units), TOGETHER)], []
        for group, b in zip(groups, self._library([("" if self.space else " ").join(g) for g in groups])):
            at = np.flatnonzero(self.edges[np.frombuffer(b, "<u4")])
            bounds = (4 * (np.r_[at, len(b) // 4] if self.space else np.r_[0, at + 1])).tolist()
            if len(at) == len(group) and bounds[0] == 0 and bounds[-1] == len(b):
                out += [b[x:y] for x, y in zip(bounds, bounds[1:])]
            else:
                out += self._library(group)
        return out

    def _ids(self, strings: list[str]) -> list[bytes]:
        """Ids of distinct strings, most of them from the memo."""
        new = [x for x in strings if x not in self.memo]
        letters = [x for x in new if _LETTERS[self.kind].fullmatch(x)]
        got = dict(zip(letters, self._together(letters)))
        rest = [x for x in new if x not in got]
        got.update(zip(rest, self._library(rest)))
        if len(self.memo) + len(got) > MEMO_UNITS:
            self.memo = {x: self.memo[x] for x in strings if x in self.memo} | {"": b""}
        memo = self.memo
        memo.update((x, b) for x, b in got.items() if len(x) <= MEMO_CHARS)
        return [memo[x] if x in memo else got[x] for x in strings]

    def _halves(self, units: pa.Array) -> tuple[pa.Array, np.ndarray, list[str]]:
        """Of every unit the letters at its start with the space before them, and which of some tails follows."""
        first = pc.starts_with(units, _FIRST) if self.space else pa.array(np.zeros(len(units), bool))
        body = pc.if_else(first, pc.utf8_slice_codeunits(units, 1), units) if self.space else units
        head = pc.utf8_rtrim(body, characters=_TAIL)
        cut = pc.and_(pc.match_substring_regex(head, _LETTER_LAST[self.kind]), pc.not_equal(head, body))
        head, tails, which = pc.if_else(cut, head, body), [""], np.zeros(len(units), np.int64)
        at = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
        if len(at):
            rows = pa.array(at)
            rest = pa.array([b[len(h) :] for b, h in zip(body.take(rows).to_pylist(), head.take(rows).to_pylist())]).dictionary_encode()
            tails += rest.dictionary.to_pylist()
            which[at] = rest.indices.to_numpy() + 1
        if self.space:
            space, nothing = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
            head = pc.binary_join_element_wise(pc.if_else(first, nothing, space), head, nothing)
        else:
            head = pc.if_else(pc.match_substring_regex(head, "^[\\x00-\u00ff]*$"), pc.utf8_lower(head), head)
        return head, which, tails

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text of an array without nulls."""
        if not len(texts):
            return []
        texts = texts.cast(pa.large_string())
        whole = pc.match_substring_regex(texts, self.whole)
        first, nothing = (pa.scalar(x, pa.large_string()) for x in (_FIRST, ""))
        plain = pc.if_else(whole, nothing, texts)
        cut = pc.split_pattern(pc.binary_join_element_wise(first, plain, nothing), " ") if self.space else pc.utf8_split_whitespace(plain)
        units = cut.flatten().dictionary_encode()
        head, which, tails = self._halves(units.dictionary)
        heads = head.dictionary_encode()
        ids = self._ids(heads.dictionary.to_pylist() + tails)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        parts = np.stack([heads.indices.to_numpy(), which + len(heads.dictionary)], 1)
        pool, _ = _gather(np.frombuffer(b"".join(ids), "<u4"), sizes, parts.ravel())
        pool, ends = _gather(pool, sizes[parts].sum(1), units.indices.to_numpy())
        bounds = np.r_[0, ends][cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        out = [pool[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        at = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        for k, b in zip(at, self._library(texts.take(pa.array(at)).to_pylist()) if len(at) else ()):
            out[k] = np.frombuffer(b, "<u4")
        return out


def _gather(pool: np.ndarray, sizes: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of a pool, of the given sizes in a row there, put together in the order of ``where``; where each ends."""
    lengths = sizes[where]
    ends = np.cumsum(lengths)
    starts = (np.cumsum(sizes) - sizes)[where] - (ends - lengths)
    return pool[np.repeat(starts, lengths) + np.arange(ends[-1] if len(ends) else 0)], ends


_encoders: dict[tuple[str, str], UnitEncoder] = {}


def encoder(path: str, kind: str) -> UnitEncoder:
    """One encoder for each worker process, vocabulary and kind of unit (``byte`` or ``word``)."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = UnitEncoder(path, kind)
    return _encoders[path, kind]
