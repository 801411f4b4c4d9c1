"""Operator 8: SentencePiece encoding and decoding by Viterbi over a trie of the distinct marked words.

Spaces become marks and a text is cut before every mark that follows another character, around
line ends, and between a letter or digit and punctuation: there no piece of the vocabulary reaches
across, so no merge does (which punctuation that holds for is read from the vocabulary). The distinct words of a batch are sorted,
which makes them a trie, and walked depth first: the forward state of a prefix is kept while words go
on from it, so common prefixes are scored once.

The public vocabulary is a BPE one, in which a best path is not the one of largest summed score but the
one whose neighbouring pieces all are what the merges would leave: a transition scores 0 when merging
the two pieces' characters gives just these pieces, and minus infinity otherwise. Exactly one path has
a score of 0, for every prefix, so the forward state is one piece and the results equal the library's.
Whether a pair may stand together is read from the merges that made it, and kept. Words with runs of
marks, whose pieces tie in score, are merged directly, from a heap of pairs. A model whose scores are no
order of merges (a unigram one) is refused.

Nulls and edges: null and empty texts have no ids; characters outside the vocabulary become their UTF-8
bytes; very long words are walked like others but not kept; repeated rows and null ids stay; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tune

MARK = "▁"
MEMO_WORDS, MEMO_CHARS, MEMO_PAIRS = 500_000, 48, 1_000_000


class TrieEncoder:
    def __init__(self, model_file: str) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(m.vocab_size())
        plain = [k for k in ids if not (m.is_control(k) or m.is_unknown(k) or m.is_byte(k) or m.is_unused(k))]
        self.ids = {m.id_to_piece(k): k for k in plain}
        by_score = sorted((p for p in self.ids if len(p) > 1), key=lambda p: (-m.get_score(self.ids[p]), self.ids[p]))
        self.rank = {p: r for r, p in enumerate(by_score)}
        self.longest = max(map(len, self.ids))
        self.bytes = {int(m.id_to_piece(k)[3:5], 16): k for k in ids if m.is_byte(k)}
        self.unknown = m.unk_id()
        self.bytes_of = {k: b"" for k in ids} | {v: k.encode() for k, v in self.ids.items()} | {v: bytes([k]) for k, v in self.bytes.items()}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("pieces reach across words")
        self.words = re.compile(self._word_form())
        scores = [m.get_score(self.ids[p]) for p in by_score if MARK * 2 not in p]
        if len(set(scores)) < len(scores) or any(x != int(x) for x in scores):
            raise ValueError("not a BPE model: scores are not the order of merges, and summed scores are not computed here")
        merges = {p: self.merged(p) for p in by_score}
        #: The last merge of every piece that merges make.
        self.halves = {p: last for p, (parts, last) in merges.items() if len(parts) == 1}
        self.reached = self.halves.keys()
        self.fits: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, bytes] = {}

    def _word_form(self) -> str:
        """What is walked as a word: it ends before marks, line ends, and punctuation after a letter or digit if no piece joins such two."""
        pairs = {(a, b) for p in self.ids for a, b in zip(p, p[1:])}
        joined = {b for a, b in pairs if re.fullmatch(r"[^\W_]", a)}
        cut = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum() and c not in joined)
        if not cut:
            return f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n"
        more = rf"(?:[^{MARK}\n{cut}]+|(?<![^\W_])[{cut}]+)"
        return f"(?:{MARK}+|[{cut}]){more}*|{more}+|\n"

    def merged(self, word: str) -> tuple[list[str], tuple[str, str] | None]:
        """What the merges leave of a word, best first and leftmost of equals, and the last pair merged.

        Parts are known by where they start; a pair waits in a heap and is stale once a part of it has grown.
        """
        parts, after, before, last = list(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1)), None
        rank = self.rank
        waiting = [(rank[a + b], k, a, b) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]
        heapq.heapify(waiting)
        while waiting:
            _, k, a, b = heapq.heappop(waiting)
            right = after[k]
            if parts[k] != a or right >= len(parts) or parts[right] != b:
                continue
            last = (a, b)
            parts[k], parts[right] = a + b, ""
            after[k] = end = after[right]
            if end < len(parts):
                before[end] = k
                if parts[k] + parts[end] in rank:
                    heapq.heappush(waiting, (rank[parts[k] + parts[end]], k, parts[k], parts[end]))
            left = before[k]
            if left >= 0 and parts[left] + parts[k] in rank:
                heapq.heappush(waiting, (rank[parts[left] + parts[k]], left, parts[left], parts[k]))
        return [x for x in parts if x], last

    def _together(self, a: str, b: str) -> bool:
        """Whether merging the characters of both leaves just a and b: no merge across them comes first."""
        key = (a, b)
        if key not in self.fits:
            if len(self.fits) > MEMO_PAIRS:
                self.fits.clear()
            rank, limit = self.rank, 1 << 60
            while True:
                if rank.get(a + b, limit) < limit:
                    self.fits[key] = False
                    break
                ra, rb = (rank[x] if len(x) > 1 else -1 for x in (a, b))
                if ra > rb:
                    limit, a = ra, self.halves[a][1]
                elif rb >= 0:
                    limit, b = rb + 1, self.halves[b][0]
                else:
                    self.fits[key] = True
                    break
        return self.fits[key]

    def _ids(self, parts: list[str]) -> bytes:
        out: list[int] = []
        for p in parts:
            if p in self.ids:
                out.append(self.ids[p])
            else:
                out += [self.bytes.get(b, self.unknown) for b in p.encode()]
        return struct.pack(f"<{len(out)}I", *out)

    def walk(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct words, by one walk over their trie."""
        out, before = {}, ""
        last: list[str] = []  # the last piece of every prefix of the word before
        fits, reached, longest, together = self.fits, self.reached, self.longest, self._together
        for word in sorted(words):
            if MARK * 2 in word:
                out[word] = self._ids(self.merged(word)[0])
                continue
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared:]
            for end in range(shared + 1, len(word) + 1):
                piece = word[end - 1]
                if end > 1 and not (fits[pair] if (pair := (last[end - 2], piece)) in fits else together(*pair)):
                    for start in range(max(0, end - longest), end - 1):
                        piece = word[start:end]
                        if piece in reached and (not start or (fits[pair] if (pair := (last[start - 1], piece)) in fits else together(*pair))):
                            break
                last.append(piece)
            parts, end = [], len(word)
            while end:
                parts.append(last[end - 1])
                end -= len(parts[-1])
            out[word], before = self._ids(parts[::-1]), word
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every whole text, little-endian unsigned 32-bit."""
        cut = [self.words.findall(MARK + x.replace(" ", MARK)) if x else [] for x in texts]
        if len(self.memo) > MEMO_WORDS:
            self.memo = {}
        memo = self.memo
        memo.update(self.walk(list(set(chain.from_iterable(cut)).difference(memo))))
        out = [b"".join(map(memo.__getitem__, ws)) for ws in cut]
        for w in {w for ws in cut for w in ws if len(w) > MEMO_CHARS}:
            del memo[w]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces in a row, marks as spaces, without the one that encoding puts first."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = raw.decode("utf-8", errors="replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_encoders: dict[str, TrieEncoder] = {}


def trie_encoder(model_file: str) -> TrieEncoder:
    if model_file not in _encoders:
        _encoders[model_file] = TrieEncoder(model_file)
    return _encoders[model_file]


def encode_pieces(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary) and decodes (whether decoding gives the text back) of every row."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = trie_encoder(model_file)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids = enc.encode(texts)
            back = [enc.decode(b) == (x or "").replace(MARK, " ") for b, x in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(back)], names=["doc_id", "ids", "decodes"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, ids binary, decodes boolean")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ids = encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return ids.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "decodes")
