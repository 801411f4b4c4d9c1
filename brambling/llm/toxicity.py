"""Operator 11: toxicity by a convolutional text classifier.

A word's embedding is the sum of hashed rows: of the whole word, its beginnings and its endings. Filters of
several widths run over the words, the largest response of each over the whole text is kept, and
a last layer turns those into log-odds. The network learns from every labelled row whose remainder isn't 0, from its whole text:

- Rows are dealt by hash over shards of about ``SHARD_CHARS`` characters, as many as the rows need; a shard is written once, as numbers of words.
- One dimension of the embeddings starts at the log-odds of a row's appearance in toxic texts, counted over all shards; the others
  start near zero, so a word that was never seen says nothing.
- In each epoch every shard is gone through in small batches, all from the same network; the next network is the mean of what the shards made
  of it, of each embedding the mean over the shards that moved it. Changes are summed as integers, so the order of tasks plays no part.
- Thresholds are calibrated by language on the rows that the training didn't see, told by a hash of the text, so that equal texts stay
  together; all of them are counted, by narrow bins of log-odds. A language with few of them uses the common one. The language is
  told from the text's own function words. If either part lacks a label, all rows serve for both.

A score is the logistic function of the log-odds less the threshold, so 0.5 is the threshold. The driver holds the network, the sums of
its changes (both of the network's size) and the bins, never rows. Scoring reads every whole text: the largest
responses run on from block to block of its words.

Nulls and edges: a null, empty or wordless text scores as one without any response; a null id is scored and
counts as held out; equal texts score alike; repeated rows stay, and each is learned from; a doc_id of several labels counts by their mean; with no
labelled rows, or all of one label, every score is that of the base rate; an empty table gives no rows; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, tune, written
from .neardup import _marked

ROWS, DIMENSIONS, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 12
EPOCHS, BATCH, RATE = 6, 64, 0.05
#: Characters of a shard in the mean; one of more than twice as many is cut into pieces. Most shards for one task, where there are more than cores.
SHARD_CHARS, SHARDS_AT_ONCE = 16_000_000, 8
#: Rows of which remainder (of the text's crc32, mod 4) calibrate the thresholds instead of training; fewest toxic ones for a language's own.
CALIBRATE, LEAST_TOXIC = 1, 20
#: Bins of log-odds in a unit, and where the outermost lie.
BINS, FARTHEST = 1024, 64
MEMO_WORDS, BLOCK_WORDS = 300_000, 60_000
SEED = 11

# Frequent function words, by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for on with as was at by this are be or from",
    "de": "der die und das ist nicht ein eine zu den mit von auf für sich des dem im auch es",
    "fr": "le la les et des en un une du est que pour dans par sur au ne pas qui avec",
    "es": "el los las y que del se por un una con para al lo como su más pero es o",
}
LANGUAGES = list(FUNCTION_WORDS)
_SPEAKS = {w: [j for j, k in enumerate(LANGUAGES) if w in FUNCTION_WORDS[k].split()] for words in FUNCTION_WORDS.values() for w in words.split()}
_WORD = re.compile(r"[^\W\d_]+")
#: Odd multipliers of the hash.
_MIX = np.array([0x100000001B3, 0x9E3779B97F4A7C15], np.uint64)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_rows(words: list[str]) -> np.ndarray:
    """The hashed rows of words: of the whole (its first 24 letters, its last five and its length), of its first 3 to 6 and last 3 to 5 letters."""
    if not words:
        return np.zeros((0, 8), np.int64)
    size = np.fromiter(map(len, words), np.uint64, len(words))
    head = np.array(words, "U24").view(np.uint32).reshape(len(words), 24).astype(np.uint64)
    tail = np.array([w[:-6:-1] for w in words], "U5").view(np.uint32).reshape(len(words), 5).astype(np.uint64)
    rows, h = np.zeros((len(words), 8), np.uint64), np.full(len(words), 1, np.uint64)
    for k in range(24):
        h = h * _MIX[0] + head[:, k]
        if 2 <= k <= 5:
            rows[:, k - 1] = h + np.uint64(k)
    whole, h = h, np.full(len(words), 2, np.uint64)
    for k in range(5):
        h = h * _MIX[0] + tail[:, k]
        if k >= 2:
            rows[:, k + 3] = h + np.uint64(10 * k)
    rows[:, 0] = (whole * _MIX[0] + h) * _MIX[0] + size
    rows ^= rows >> np.uint64(31)
    rows *= _MIX[1]
    return (rows >> np.uint64(64 - ROWS.bit_length() + 1)).astype(np.int64)


@dataclass
class Network:
    embeddings: np.ndarray
    filters: list[np.ndarray]  # of every width: width x DIMENSIONS x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    base: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def responses(self, rows: np.ndarray) -> np.ndarray:
        """Of words, given by their hashed rows: what each filter makes of each at each of its places."""
        e = self.embeddings[rows].sum(1, dtype=np.float64)
        return np.concatenate([e @ f for k in self.filters for f in k.astype(np.float64)], 1).astype(np.float32)

    def log_odds(self, pooled: np.ndarray) -> np.ndarray:
        return pooled.astype(np.float64) @ self.out + self.base


def largest(parts: np.ndarray, words: np.ndarray, sizes: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The largest response of every filter in every text (minus infinity where it has no place), and the first place of it if ``places``.

    ``words``: the texts' words in a row, as columns of ``parts``, whose rows are the filters at each of their places."""
    ends = np.cumsum(sizes)
    top = np.full((len(WIDTHS) * FILTERS, len(sizes)), -np.inf, np.float32)
    where = np.zeros(top.shape, np.int64)
    for a in range(0, len(words), BLOCK_WORDS):
        at = 0
        for w, width in enumerate(WIDTHS):
            n = min(a + BLOCK_WORDS, len(words) - width + 1) - a
            if n > 0:
                across = np.concatenate([ends - a - j for j in range(1, width)]) if width > 1 else ends[:0]  # places that run into the next text
                across = across[(across >= 0) & (across < n)]
                first, last = np.maximum(ends - sizes, a) - a, np.minimum(ends, a + n) - a
                some = np.flatnonzero(last > first)
                first, length = first[some], (last - first)[some]
                owner = np.repeat(np.arange(len(some)), length) if places else None
                at_place = [words[a + j : a + j + n] for j in range(width)]
                for f in range(FILTERS):
                    r = parts[at + f].take(at_place[0])
                    for j in range(1, width):
                        r += parts[at + j * FILTERS + f].take(at_place[j])
                    r[across] = -np.inf
                    found, k = np.maximum.reduceat(r, first), w * FILTERS + f
                    if places:
                        equal = np.flatnonzero(r == found[owner])[::-1]
                        place = np.zeros(len(some), np.int64)
                        place[owner[equal]] = equal + a  # the first one is written last
                        where[k, some] = np.where(found > top[k, some], place, where[k, some])
                    top[k, some] = np.maximum(top[k, some], found)
            at += width * FILTERS
    return top, where


def distinct(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of numbers below ``n``, and each as its place among them."""
    place = np.zeros(n, np.int64)
    place[words] = 1
    used = np.flatnonzero(place)
    place[used] = np.arange(len(used))
    return used, place[words]


def pooled_responses(net: Network, responses: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The largest response of every filter in every text, 0 at least. ``words``: the texts' words in a row, as rows of ``responses``."""
    used, words = distinct(words, len(responses))
    top, _ = largest(np.ascontiguousarray(responses[used].T), words, sizes)
    return np.maximum(top + np.concatenate(net.bias)[:, None], 0).T


def speaks(words: list[str]) -> np.ndarray:
    """1 where a word is a function word of a language."""
    out = np.zeros((len(words), len(LANGUAGES)), np.float32)
    for k, w in enumerate(words):
        if w in _SPEAKS:
            out[k, _SPEAKS[w]] = 1
    return out


def spoken(flags: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> list[str]:
    """Of every text the language most of whose function words occur; the first of equal ones, "" where none does."""
    n = np.zeros((len(sizes), len(LANGUAGES)))
    some = np.flatnonzero(sizes)
    if len(some):
        n[some] = np.add.reduceat(flags[words], (np.cumsum(sizes) - sizes)[some], axis=0)
    return [LANGUAGES[k] if m else "" for k, m in zip(n.argmax(1), n.max(1))]


class _Numbered(dict):
    """Numbers of distinct words, in the order in which they came."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class _Adam:
    def __init__(self, x: np.ndarray, m: np.ndarray, v: np.ndarray, t: float) -> None:
        self.x, self.m, self.v, self.t = x, m, v, t

    def step(self, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        self.x -= RATE / 5 * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


#: Of filters, bias, last layer and base. Beside each number stand its two moments; the number of steps comes last.
_SHAPES = [(w, DIMENSIONS, FILTERS) for w in WIDTHS] + [(FILTERS,) for _ in WIDTHS] + [(len(WIDTHS) * FILTERS,), (1,)]
_DENSE = sum(int(np.prod(x)) for x in _SHAPES)
_TAIL = -(-(3 * _DENSE + 1) // (DIMENSIONS + 1))


@dataclass
class State:
    """A network in training: embeddings, how far each has moved, and the rest. As a table: embeddings and distance side by side, then the rest."""

    embeddings: np.ndarray
    moved: np.ndarray
    dense: list[_Adam]

    @staticmethod
    def of(x: np.ndarray) -> State:
        tail, dense, at = x[ROWS:].ravel().astype(float), [], 0
        for shape in _SHAPES:
            n = int(np.prod(shape))
            dense.append(_Adam(*(tail[k + at : k + at + n].reshape(shape) for k in (0, _DENSE, 2 * _DENSE)), tail[3 * _DENSE]))
            at += n
        return State(np.ascontiguousarray(x[:ROWS, :DIMENSIONS]), x[:ROWS, DIMENSIONS].copy(), dense)

    def table(self) -> np.ndarray:
        tail = np.zeros(_TAIL * (DIMENSIONS + 1))
        tail[: 3 * _DENSE + 1] = np.concatenate([*(np.ravel(y) for y in (*(a.x for a in self.dense), *(a.m for a in self.dense), *(a.v for a in self.dense))), [self.dense[0].t]])
        return np.r_[np.c_[self.embeddings, self.moved], tail.reshape(_TAIL, -1)].astype(np.float32)

    def network(self) -> Network:
        x, n = [a.x for a in self.dense], len(WIDTHS)
        return Network(self.embeddings, [f.astype(np.float32) for f in x[:n]], [b.astype(np.float32) for b in x[n : 2 * n]], x[-2], float(x[-1][0]))


def units() -> np.ndarray:
    """In what units changes of a state, as a table, are summed: small ones for all but embeddings."""
    out = np.full((ROWS + _TAIL, DIMENSIONS + 1), 2.0**-40)
    out[:ROWS, :DIMENSIONS] = 2.0**-26
    return out


def start(seen: np.ndarray, n: np.ndarray) -> State:
    """``seen``: in how many clean and toxic texts every hashed row is; ``n``: how many of either there are."""
    rng = np.random.default_rng(SEED)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    shrunk = odds * seen.sum(0) / (seen.sum(0) + 5)  # little is known of rare ones
    e = rng.normal(0, 0.005, (ROWS, DIMENSIONS)).astype(np.float32)
    e[:, 0] = shrunk / 8
    e[seen.sum(0) == 0] = 0
    filters = [rng.normal(0, 0.3, (w, DIMENSIONS, FILTERS)) for w in WIDTHS]
    for f in filters:
        f[0, 0, : FILTERS // 2] = 1.0
    x = [*filters, *(np.zeros(FILTERS) for _ in WIDTHS), np.full(len(WIDTHS) * FILTERS, 0.1), np.array([-1.0])]
    return State(e, np.zeros(ROWS, np.float32), [_Adam(y, np.zeros_like(y), np.zeros_like(y), 0.0) for y in x])


@dataclass
class Shard:
    """Texts as numbers of words in a row, the words' hashed rows, and of every text its label, whether it calibrates, and its language."""

    seed: tuple[int, int]
    y: np.ndarray
    calibrates: np.ndarray
    language: np.ndarray
    sizes: np.ndarray
    words: np.ndarray
    rows: np.ndarray

    def some(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some texts: the distinct words, the words as places among them, the sizes."""
        ends, sizes = np.cumsum(self.sizes)[texts], self.sizes[texts]
        words = np.concatenate([self.words[e - n : e] for e, n in zip(ends, sizes)]) if len(texts) else self.words[:0]
        return *distinct(words, len(self.rows)), sizes


def train(state: State, shard: Shard, texts: np.ndarray, weight: np.ndarray, seed: int) -> None:
    """Moves ``state`` by one epoch over ``texts`` of a shard; ``weight``: of clean and of toxic ones."""
    *_, out, base = state.dense
    filters, bias = state.dense[: len(WIDTHS)], state.dense[len(WIDTHS) : 2 * len(WIDTHS)]
    order = np.random.default_rng([SEED, seed, *shard.seed]).permutation(texts)
    for k in range(0, len(order), BATCH):
        batch = order[k : k + BATCH]
        used, words, sizes = shard.some(batch)
        y = shard.y[batch]
        e = state.embeddings[shard.rows[used]].sum(1)
        # By dimensions and not as one product, which a library would spread over more threads than a task has.
        by, across = np.concatenate([place.T for f in filters for place in f.x]).astype(np.float32), np.ascontiguousarray(e.T)
        parts = by[:, :1] * across[0]
        for d in range(1, DIMENSIONS):
            parts += by[:, d : d + 1] * across[d]
        top, where = largest(parts, words, sizes, places=True)
        pooled = np.maximum(top + np.concatenate([b.x for b in bias])[:, None], 0).T
        p = 1 / (1 + np.exp(-np.clip(pooled @ out.x + base.x[0], -30, 30)))
        slope = weight[y] * (p - y) / len(batch)
        back = slope[:, None] * out.x * (pooled > 0)
        to_words, grads = np.zeros(e.size), []
        for w, width in enumerate(WIDTHS):
            g, at = back[:, w * FILTERS : (w + 1) * FILTERS], where[w * FILTERS : (w + 1) * FILTERS].T
            to_filter = np.zeros(_SHAPES[w])
            for j in range(width if len(words) else 0):
                word = words[np.minimum(at + j, len(words) - 1)]
                to_filter[j] = np.einsum("bfd,bf->df", e[word], g)
                cells = word[:, :, None] * DIMENSIONS + np.arange(DIMENSIONS)
                to_words += np.bincount(cells.ravel(), (g[:, :, None] * filters[w].x[j].T).ravel(), e.size)
            grads.append((to_filter, g.sum(0)))
        for a, g in zip(state.dense, [*(x for x, _ in grads), *(x for _, x in grads), slope @ pooled + 1e-4 * out.x, np.array([slope.sum()])]):
            a.step(g)
        to_words = to_words.reshape(e.shape).astype(np.float32)
        hit = np.flatnonzero(np.abs(to_words).sum(1))
        at, g = shard.rows[used[hit]].ravel(), np.repeat(to_words[hit], shard.rows.shape[1], axis=0)
        np.add.at(state.moved, at, (g * g).mean(1))
        steps = -RATE * g / (np.sqrt(state.moved[at])[:, None] + 1e-6)
        np.add.at(state.embeddings.ravel(), (at[:, None] * DIMENSIONS + np.arange(DIMENSIONS)).ravel(), steps.ravel())


def best_threshold(low: np.ndarray, high: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> float:
    """Between two bins of log-odds (their least, largest, toxic rows and rows), where the F measure is largest; of equal ones the widest gap."""
    order = np.argsort(-low, kind="stable")
    low, high, hits, taken = low[order], high[order], np.cumsum(toxic[order]), np.cumsum(n[order])
    f, below = 2 * hits / (taken + hits[-1]), np.r_[high[1:], low[-1] - 2]
    best = np.flatnonzero(f >= f.max() - 1e-12)
    k = best[np.argmax(low[best] - below[best])]
    return float((low[k] + below[k]) / 2)


_SHARD = "shard int, piece int, y binary, calibrates binary, language binary, sizes binary, words binary, rows binary"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shard, or piece of one, from its texts in order."""
    shard, piece, chars, number, texts = None, 0, 0, _Numbered(), []

    def row() -> pa.RecordBatch:
        y, calibrates, docs = zip(*texts)
        vocabulary, sizes, language = list(number), np.array([len(d) for d in docs]), []
        flags = speaks(vocabulary)
        for k in range(0, len(docs), 500):
            language += [LANGUAGES.index(x) if x else -1 for x in spoken(flags, np.concatenate(docs[k : k + 500]), sizes[k : k + 500])]
        rows = [word_rows(vocabulary[k : k + 20_000]).astype(np.int32).tobytes() for k in range(0, len(vocabulary), 20_000)]
        cells = [np.array(y, np.int8), np.array(calibrates, np.int8), np.array(language, np.int8), sizes.astype(np.int32), np.concatenate(docs)]
        columns = [pa.array([shard], pa.int32()), pa.array([piece], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in cells), pa.array([b"".join(rows)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _SHARD.split(", ")])

    for batch in batches:
        for k in range(0, len(batch), 100):
            for r in batch.slice(k, 100).to_pylist():
                if texts and (r["_tx_shard"] != shard or chars >= 2 * SHARD_CHARS):
                    yield row()
                    piece, chars, number, texts = piece + 1 if r["_tx_shard"] == shard else 0, 0, _Numbered(), []
                shard, chars = r["_tx_shard"], chars + len(r["_tx_t"])
                texts.append((r["_tx_y"], r["_tx_c"], number.numbers(words_of(r["_tx_t"])).astype(np.int32)))
    if texts:
        yield row()


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for k in range(len(batch)):
            r = batch.slice(k, 1).to_pylist()[0]
            of = lambda name, kind: np.frombuffer(r[name], kind)
            yield Shard((r["shard"], r["piece"]), of("y", np.int8), of("calibrates", np.int8), of("language", np.int8), of("sizes", np.int32).astype(np.int64), of("words", np.int32), of("rows", np.int32).reshape(-1, 8))


def _summed(shards: DataFrame, made_of: Callable[[Shard], np.ndarray | None], height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum over all shards of the integers that ``made_of`` gives, and how many shards gave others than 0 in each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((height, width), np.int64), np.zeros(height, np.int64)
        for shard in _shards(batches):
            made = made_of(shard)
            if made is not None:
                total += made
                n += made.any(1)
        at = np.flatnonzero(n)
        for k in range(0, len(at), 10_000):
            some = at[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, n[some], *total[some].T.copy())], names=["at", "n", *(f"d{j}" for j in range(width))])

    columns = [f"d{j}" for j in range(width)]
    rows = shards.mapInArrow(run, ", ".join(f"{c} bigint" for c in ["at", "n", *columns])).groupBy("at").agg(*(F.sum(c).alias(c) for c in ["n", *columns]))
    got = rows.toArrow()  # at most ``height`` rows
    at, total, n = got["at"].to_numpy(), np.zeros((height, width), np.int64), np.zeros(height, np.int64)
    n[at], total[at] = got["n"].to_numpy(), np.stack([got[c].to_numpy() for c in columns], 1)
    return total, n


def _counted(all_rows: bool) -> Callable[[Shard], np.ndarray]:
    """In how many clean and toxic texts of the training each hashed row is; the last row has their numbers."""

    def run(shard: Shard) -> np.ndarray:
        seen, ends = np.zeros((ROWS + 1, 2), np.int64), np.cumsum(shard.sizes)
        for k in np.flatnonzero(all_rows | (shard.calibrates == 0)):
            seen[np.unique(shard.rows[np.unique(shard.words[ends[k] - shard.sizes[k] : ends[k]])]), shard.y[k]] += 1
            seen[ROWS, shard.y[k]] += 1
        return seen

    return run


def _moved(state: np.ndarray, weight: np.ndarray, epoch: int, all_rows: bool) -> Callable[[Shard], np.ndarray | None]:
    """What one epoch over a shard changes in ``state``, in units."""

    def run(shard: Shard) -> np.ndarray | None:
        texts = np.flatnonzero(all_rows | (shard.calibrates == 0))
        if not len(texts):
            return None
        own = State.of(state)
        train(own, shard, texts, weight, epoch)
        return np.rint((own.table().astype(float) - state) / units()).astype(np.int64)

    return run


def _log_odds(net: Network, all_rows: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of every calibrating text: language, log-odds, label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            texts = np.flatnonzero(all_rows | (shard.calibrates == 1))
            for k in range(0, len(texts), 500):
                at = texts[k : k + 500]
                used, words, sizes = shard.some(at)
                z = net.log_odds(pooled_responses(net, net.responses(shard.rows[used]), words, sizes))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard.language[at].astype(np.int32), z, shard.y[at].astype(np.int32))], names=["language", "z", "y"])

    return run


def fit(shards: DataFrame, all_rows: bool) -> Network:
    """Network and thresholds from shards. ``all_rows``: all of them serve for both training and calibration."""
    tasks = max(shards.sparkSession.sparkContext.defaultParallelism, -(-shards.count() // SHARDS_AT_ONCE))
    shards = shards.coalesce(tasks)  # a task sums its own shards before they are shuffled
    seen, _ = _summed(shards, _counted(all_rows), ROWS + 1, 2)
    n = seen[ROWS]
    state, weight = start(seen[:ROWS].T, n).table(), n.sum() / (2 * np.maximum(n, 1))  # both labels weigh the same in sum
    for epoch in range(EPOCHS):
        change, touched = _summed(shards, _moved(state, weight, epoch, all_rows), ROWS + _TAIL, DIMENSIONS + 1)
        state = (state + change * units() / np.maximum(touched, 1)[:, None]).astype(np.float32)
    net = State.of(state).network()
    z, farthest = F.col("z"), F.lit(float(FARTHEST))
    bins = shards.mapInArrow(_log_odds(net, all_rows), "language int, z double, y int").groupBy("language", F.floor(F.least(F.greatest(z, -farthest), farthest) * BINS).alias("bin"))
    got = bins.agg(F.min("z").alias("low"), F.max("z").alias("high"), F.sum("y").alias("toxic"), F.count("*").alias("n")).toArrow()  # at most 2 * FARTHEST * BINS + 1 for each language
    tongue, place = got["language"].to_numpy(), got["bin"].to_numpy()
    for k, language in enumerate(["", *LANGUAGES], -1):
        of = np.flatnonzero((tongue == k) | (k < 0))
        _, inverse = np.unique(place[of], return_inverse=True)
        joined = [np.full(inverse.max(initial=-1) + 1, x) for x in (np.inf, -np.inf, 0, 0)]
        for to, by, name in zip(joined, (np.minimum, np.maximum, np.add, np.add), ("low", "high", "toxic", "n")):
            by.at(to, inverse, got[name].to_numpy()[of])
        toxic, n = joined[2].sum(), joined[3].sum()
        if k < 0 or LEAST_TOXIC <= toxic < n:
            net.thresholds[language] = best_threshold(*joined)
    return net


def _remainder(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


def fit_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[Network | None, float]:
    """The network, and the share of toxic rows among the labelled ones. Rows of remainder 0 are never read."""
    tune(docs.sparkSession)
    known = labels.filter(F.col(label_col).isNotNull() & (_remainder("doc_id") != 0)).groupBy(F.col("doc_id").cast("long").alias("_tx_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("_tx_y"))
    n = {r["_tx_y"]: r["n"] for r in known.groupBy("_tx_y").agg(F.count("*").alias("n")).collect()}
    base = (n.get(1, 0) + 0.5) / (sum(n.values()) + 1)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("_tx_id"), text.alias("_tx_t")).filter(_remainder("_tx_id") != 0)
    calibrates = (F.pmod(F.crc32(F.col("_tx_t").cast("binary")), F.lit(4)) == CALIBRATE).cast("int")
    rows = rows.withColumns({"_tx_c": calibrates, "_tx_n": F.length("_tx_t")})
    found = rows.drop("_tx_t").join(known, "_tx_id").groupBy("_tx_y", "_tx_c").agg(F.count("*").alias("n"), F.sum("_tx_n").alias("chars")).collect()  # at most four rows
    if len({r["_tx_y"] for r in found}) < 2:
        return None, base
    shards = int(-(-sum(r["chars"] for r in found) // SHARD_CHARS)) or 1
    rows = _marked(rows, "_tx_id", known.select(F.col("_tx_id").alias("id"))).filter("_nd_on").drop("_nd_on", "_tx_n")
    # Texts and labels meet in the shards themselves: texts are shuffled once, into so many partitions whatever a join would choose.
    both = rows.withColumn("_tx_y", F.lit(None).cast("int")).unionByName(known, allowMissingColumns=True).repartition(shards, "_tx_id")
    rows = both.withColumn("_tx_y", F.max("_tx_y").over(Window.partitionBy("_tx_id"))).filter("_tx_t is not null and _tx_y is not null")
    rows = rows.withColumns({"_tx_shard": F.pmod(F.hash("_tx_id"), F.lit(shards)), "_tx_h": F.xxhash64("_tx_t")}).sortWithinPartitions("_tx_shard", "_tx_id", "_tx_h")
    return fit(written(rows.mapInArrow(_encode, _SHARD), "shards"), all_rows=len(found) < 4), base


class Scorer:
    """Scores of texts, with a bounded memo of the responses to words."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.have, self.number, self.known, self.flags = 0, _Numbered(), np.zeros((0, sum(WIDTHS) * FILTERS), np.float32), np.zeros((0, len(LANGUAGES)), np.float32)

    def _learn(self) -> None:
        """Responses to the words that are new; room for them doubles."""
        have, n = self.have, len(self.number)
        if n > len(self.known):
            more = max(n, 2 * len(self.known)) - len(self.known)
            self.known, self.flags = (np.concatenate([x, np.zeros((more, x.shape[1]), np.float32)]) for x in (self.known, self.flags))
        fresh = list(islice(self.number, have, n))
        for k in range(0, len(fresh), 20_000):
            some = slice(have + k, min(have + k + 20_000, n))
            self.known[some], self.flags[some] = self.net.responses(word_rows(fresh[k : k + 20_000])), speaks(fresh[k : k + 20_000])
        self.have = n

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, list[str]]:
        """Scores, and the languages found."""
        if len(self.number) > MEMO_WORDS:
            self.clear()
        numbers = [self.number.numbers(words_of(t)) for t in texts]
        self._learn()
        words, sizes = np.concatenate(numbers), np.array([len(x) for x in numbers])
        pooled, languages = pooled_responses(self.net, self.known, words, sizes), spoken(self.flags, words, sizes)
        t = np.array([self.net.thresholds.get(x, self.net.thresholds[""]) for x in languages])
        z = np.clip(self.net.log_odds(pooled) - t, -30, 30)
        return np.round(1 / (1 + np.exp(-z)), 9), languages


def score_documents(docs: DataFrame, net: Network | None, base: float = 0.5, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, language of every row."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net) if net else None
        for batch in batches:
            for k in range(0, len(batch), 100):
                part = batch.slice(k, 100)
                texts = part.column("text").to_pylist()
                score, language = scorer(texts) if scorer else (np.full(len(texts), base), [None] * len(texts))
                cols = [part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(language, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted", "language"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(_remainder(id_col) == 0, F.lit(True)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, language string")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, *fit_documents(docs, table(spark, sf_dir, "labels")))
