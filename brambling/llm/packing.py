"""Operator 9: packing documents into fixed-size sequences by the configuration linear program.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the driver. Its
covering program - use as few configurations (multisets of lengths that fit) as possible so that
every piece is covered - is solved by multiplicative weights: a length gets cheaper by what a round
covers of it, and a knapsack dynamic program prices the configurations. Any prices give a lower bound
of the program, and the rounds end when the solution is within ``GAP`` of the best one, or sooner if it already rounds to the
fewest sequences that any plan can have. Amounts are rounded down, what they lack is carried on to the next
configuration, and the program is solved again for the pieces that are left, until these are few. Those are packed one
sequence after the other, by the knapsack program with each length as its price: the fullest
one that holds the longest piece left. Where it makes for fewer sequences, a smaller share of the program's amounts is
taken and best fit places the rest; best fit alone is taken only where none of these is as short. The plan, whose size
depends on the lengths, goes back to the pieces: each gets its rank among the pieces of its length, and the plan
says which ranks lie in which sequence.

Nulls and edges: null and empty texts are documents of one id, the end id; a null doc_id is kept;
very long texts give any number of full pieces, each a sequence of its own; pieces of equal length
are interchangeable, and their order in the written table breaks the tie; repeated rows are packed
each for itself; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, tune, written
from .tokens import chunks, encoder

CAPACITY, END_ID = 1024, 2
#: The solution's distance from its lower bound, how much a round may cover of a length, how fast prices fall, how far from the
#: dearest a configuration may be at first (it then halves after 40 rounds, and so on).
GAP, STEP, RATE, SLACK, ROUNDS = 0.02, 0.1, 0.4, 0.05, 400
#: After so many rounds, and twice as many, and so on, the rounded plan is looked at; rounds of a program that is solved again.
LOOK, AGAIN = 10, 40
#: So many pieces are packed one sequence after the other; sequences beyond the bound that are near enough, one of so many.
FEW, NEAR = 1500, 500
#: Shares of the program's amounts that are tried with best fit for the rest, the last ones only where best fit alone is shorter.
SHARES = (1.0, 0.75, 0.5, 0.25, 0.1, 0.03)
#: Ranks of a length are counted in buckets of about so many pieces.
RANK_ROWS = 100_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _cutter(path: str, end_id: int, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path, "byte"), np.array([end_id], "<u4").tobytes()
        for batch in chunks(batches):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text"))):
                ids, at = ids.tobytes() + end, 0
                n = len(ids) // 4
                size = n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    rows.append((doc, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                    at, size = at + size, capacity
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def cut_pieces(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every whole text; a first piece may be shorter, the others are full."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_cutter(vocabulary, end_id, capacity), PIECES)


def _knapsack(price: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """For each room the largest price of a multiset of lengths (ascending) that fits."""
    best, of, fitting = np.zeros(capacity + 1), price[lengths], np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        m = fitting[room]
        best[room] = max(best[room - 1], (of[:m] + best[room - lengths[:m]]).max()) if m else best[room - 1]
    return best


def _configuration(first: int, price: np.ndarray, best: np.ndarray, live: np.ndarray, lengths: np.ndarray, least: float) -> list[int] | None:
    """A configuration that holds ``first`` and costs ``least`` or more, of live lengths; the dearest choice that is left at each room."""
    items, worth, room = [first], price[first], len(best) - 1 - first
    while room > 0:
        fit = lengths[: np.searchsorted(lengths, room, side="right")]
        fit = fit[live[fit]]
        if not len(fit):
            break
        dear = price[fit] + best[room - fit]
        k = len(dear) - 1 - int(dear[::-1].argmax())  # of equal ones the longest
        if worth + dear[k] < least:
            return None
        items.append(int(fit[k]))
        worth, room = worth + price[fit[k]], room - int(fit[k])
    return items if worth >= least else None


def fractional_configurations(need: dict[int, int], capacity: int, rounds: int = ROUNDS, enough=lambda amounts, lower: False) -> tuple[dict[tuple[int, ...], float], float]:
    """Multiplicative weights for the covering program: how often to use each configuration, and a lower bound.

    Prices start at the share of a sequence that a length takes. A round runs the knapsack program
    once; every configuration close to the dearest may then be used until one of its lengths has been
    covered by ``STEP`` in this round, as prices can't have fallen far. The amounts cover every
    length; their sum is at most (1 + GAP) times the bound unless the rounds run out, or ``enough``, asked now and then,
    says that they do.
    """
    n = np.zeros(capacity + 1)
    for length, count in need.items():
        n[length] = count
    lengths = np.flatnonzero(n)
    if not len(lengths):
        return {}, 0.0
    price, covered, used, lower = np.arange(capacity + 1) / capacity, np.zeros(capacity + 1), Counter(), 0.0
    price[n == 0] = 0
    look = LOOK
    for t in range(rounds):
        best = _knapsack(price, lengths, capacity)
        lower = max(lower, float(n @ price) / best[capacity])  # prices over the dearest configuration are a dual solution
        left, live, least = n * STEP, n > 0, (1 - SLACK * 40 / (40 + t)) * best[capacity]
        for first in lengths[np.argsort(-price[lengths] / lengths, kind="stable")]:
            while live[first] and price[first] + best[capacity - first] >= least:
                items = _configuration(int(first), price, best, live, lengths, least)
                if items is None:
                    break
                counts = Counter(items)
                step = min(left[k] / c for k, c in counts.items())
                used[tuple(sorted(items, reverse=True))] += step
                for k, c in counts.items():
                    left[k] -= c * step
                    live[k] = left[k] > 1e-9 * n[k]
        share = (n[lengths] * STEP - left[lengths]) / n[lengths]
        covered[lengths] += share
        price[lengths] *= np.exp(-RATE * share)
        scale = covered[lengths].min()
        if scale > 0 and sum(used.values()) <= (1 + GAP) * lower * scale:
            break
        if scale > 0 and t + 1 >= look:
            look *= 2
            if enough({items: amount / scale for items, amount in used.items()}, lower):
                break
    scale = covered[lengths].min()
    if scale <= 0:  # the rounds ended before every length was covered: those get sequences of their own
        for k in lengths[covered[lengths] <= 0]:
            used[int(k),] += n[k]
        scale = min(1.0, covered[lengths][covered[lengths] > 0].min(initial=1.0))
    return {items: amount / scale for items, amount in used.items()}, lower


def _best_fit(need: Counter, capacity: int) -> Counter:
    """Best fit, longest first, for whole classes of equal sequences at a time."""
    open_by_room: dict[int, Counter] = {capacity: Counter()}
    for length in sorted(need, reverse=True):
        left = need[length]
        for room in sorted(r for r in open_by_room if length <= r < capacity):
            classes = open_by_room[room]
            for items in list(classes):
                k = min(left, classes[items])
                if not k:
                    break
                classes[items] -= k
                if not classes[items]:
                    del classes[items]
                open_by_room.setdefault(room - length, Counter())[(*items, length)] += k
                left -= k
                if length <= room - length:  # best fit: the tightest room first
                    more = min(left, k * ((room - length) // length))
                    left = _fill(open_by_room, room - length, (*items, length), length, more, left)
        if left:
            per = capacity // length
            full, rest = divmod(left, per)
            if full:
                open_by_room.setdefault(capacity - per * length, Counter())[(length,) * per] += full
            if rest:
                open_by_room.setdefault(capacity - rest * length, Counter())[(length,) * rest] += 1
    total: Counter = Counter()
    for classes in open_by_room.values():
        total.update(classes)
    return +total


def _fill(open_by_room: dict[int, Counter], room: int, items: tuple, length: int, more: int, left: int) -> int:
    """Put further pieces of the same length into the sequences that just got one."""
    while more and room >= length and open_by_room[room][items]:
        k = min(more, open_by_room[room][items])
        open_by_room[room][items] -= k
        if not open_by_room[room][items]:
            del open_by_room[room][items]
        room, items = room - length, (*items, length)
        open_by_room.setdefault(room, Counter())[items] += k
        more, left = more - k, left - k
    return left


def plan(need: dict[int, int], capacity: int = CAPACITY) -> Counter:
    """Configurations and how many sequences use each; together they hold every piece shorter than ``capacity`` exactly once."""
    short = Counter({k: v for k, v in need.items() if 0 < k < capacity and v > 0})
    found: list[Counter] = []

    def with_best_fit(amounts: dict, share: float) -> None:
        out, left = _rounded(short, {k: v * share for k, v in amounts.items()}, capacity)
        found.append(out + _best_fit(left, capacity))

    def enough(amounts: dict, lower: float) -> bool:
        least = int(np.ceil(lower - 1e-6))
        found.append(_integral(short, amounts, capacity))
        for share in SHARES[:3]:
            with_best_fit(amounts, share)
        return min(sum(p.values()) for p in found) <= least + least // NEAR

    amounts, lower = fractional_configurations(short, capacity, enough=enough)
    enough(amounts, lower)
    alone = _best_fit(short, capacity)
    for share in SHARES[3:]:
        if min(sum(p.values()) for p in found) > sum(alone.values()):
            with_best_fit(amounts, share)
    found.append(alone)  # a whole solution of the program too: it counts where no other is as short
    return min(found, key=lambda p: sum(p.values()))


def _integral(need: Counter, amounts: dict[tuple[int, ...], float], capacity: int) -> Counter:
    """Whole configurations from a program's amounts: rounded down, and solved again for what is left until that is little."""
    left, out = Counter(need), Counter()
    while sum(left.values()) > FEW:
        taken, left = _rounded(left, amounts, capacity)
        out += taken
        if not taken or sum(left.values()) <= FEW:
            break
        amounts, _ = fractional_configurations(left, capacity, AGAIN)
    if sum(left.values()) > FEW:
        return out + _best_fit(left, capacity)
    taken, left = _rounded(left, fractional_configurations(left, capacity, AGAIN)[0] if out else amounts, capacity)
    return out + taken + min(_filled(left, capacity), _best_fit(left, capacity), key=lambda p: sum(p.values()))


def _rounded(need: Counter, amounts: dict[tuple[int, ...], float], capacity: int) -> tuple[Counter, Counter]:
    """Sequences of the program, the fullest first, and the pieces that are left.

    Amounts are rounded down as far as pieces are left; the fraction (and what pieces lacked, two at
    most) goes on to the next.
    """
    left, out, carried = Counter(need), Counter(), 0.0
    for items, amount in sorted(amounts.items(), key=lambda x: (-sum(x[0]), x[0])):
        counts, carried = Counter(items), carried + amount
        k = min(int(carried + 1e-9), *(left[x] // c for x, c in counts.items()))
        if k > 0:
            out[items] += k
            left.subtract({x: c * k for x, c in counts.items()})
        carried = min(carried - k, 2.0)
    return out, +left


def _filled(need: Counter, capacity: int) -> Counter:
    """One sequence after the other: the longest piece left, and the lengths that fill most of its room, long ones first."""
    left, out = Counter(need), Counter()
    while left:
        lengths = sorted(left, reverse=True)
        room = capacity - lengths[0]
        mask, sums, steps = (1 << (room + 1)) - 1, 1, []
        for x in lengths:
            for _ in range(min(left[x] - (x == lengths[0]), room // x)):
                steps.append((x, sums))
                sums |= (sums << x) & mask
        at, items = sums.bit_length() - 1, [lengths[0]]
        for x, before in reversed(steps):
            if not before >> at & 1:
                items.append(x)
                at -= x
        out[tuple(items)] += 1
        left.subtract(items)
        left = +left
    return out


def plan_rows(configurations: Counter) -> list[tuple[int, int, int, int, int, list[int]]]:
    """length, first rank, last rank, pieces of the length in a sequence, first sequence, their offsets."""
    rows, sequence, rank = [], 0, Counter()
    for items, copies in sorted(configurations.items(), reverse=True):
        offsets: dict[int, list[int]] = {}
        at = 0
        for x in items:
            offsets.setdefault(x, []).append(at)
            at += x
        for x, places in offsets.items():
            rows.append((x, rank[x], rank[x] + copies * len(places) - 1, len(places), sequence, places))
            rank[x] += copies * len(places)
        sequence += copies
    return rows


def _ranked(pieces: DataFrame, need: dict[int, int], capacity: int) -> DataFrame:
    """Adds _pk_rank, the number of a piece among those of its length, counted in buckets of the written rows."""
    buckets = F.array(*[F.lit(1 + need.get(k, 0) // RANK_ROWS) for k in range(capacity)])  # a constant of ``capacity`` numbers
    dealt = pieces.withColumn("_pk_bucket", F.pmod("_pk_row", F.get(buckets, F.col("length").cast("int")).cast("long")))
    sizes = dealt.groupBy("length", "_pk_bucket").agg(F.count("*").alias("_pk_n"))
    sizes = sizes.select("length", "_pk_bucket", (F.sum("_pk_n").over(Window.partitionBy("length").orderBy("_pk_bucket")) - F.col("_pk_n")).alias("_pk_before"))
    within = Window.partitionBy("length", "_pk_bucket").orderBy("_pk_row")
    ranked = dealt.withColumn("_pk_in", F.row_number().over(within)).join(sizes, ["length", "_pk_bucket"])
    return ranked.withColumn("_pk_rank", F.col("_pk_before") + F.col("_pk_in") - 1).drop("_pk_bucket", "_pk_in", "_pk_before")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to the pieces.

    A full piece is a sequence by itself and needs no rank. A shorter one finds the latest row of the
    plan at or before its rank, among plan rows and pieces of one stretch of ranks: no stretch is
    longer than ``RANK_ROWS``, however often a length occurs.
    """
    spark, names = pieces.sparkSession, pieces.columns
    pieces = written(pieces.withColumn("_pk_row", F.monotonically_increasing_id()), "pieces")
    need = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    plans = spark.createDataFrame(plan_rows(plan(need, capacity)), "length bigint, low bigint, high bigint, per int, first bigint, places array<int>")

    stretch = lambda rank: F.floor(rank / RANK_ROWS).cast("long")
    marks = plans.withColumn("_pk_stretch", F.explode(F.sequence(stretch(F.col("low")), stretch(F.col("high")))))
    marks = marks.select("length", "_pk_stretch", F.greatest(F.col("low"), F.col("_pk_stretch") * RANK_ROWS).alias("_pk_rank"), F.struct("low", "per", "first", "places").alias("_pk_plan"))
    ranked = _ranked(pieces.filter(F.col("length") < capacity), need, capacity).withColumn("_pk_stretch", stretch(F.col("_pk_rank"))).withColumn("_pk_piece", F.lit(1))
    upto = Window.partitionBy("length", "_pk_stretch").orderBy("_pk_rank", F.col("_pk_piece").asc_nulls_first())
    placed = ranked.unionByName(marks, allowMissingColumns=True).withColumn("_pk_plan", F.last("_pk_plan", ignorenulls=True).over(upto)).filter("_pk_piece = 1")
    nth = F.col("_pk_rank") - F.col("_pk_plan.low")
    sequence = F.col("_pk_plan.first") + F.floor(nth / F.col("_pk_plan.per"))
    offset = F.element_at("_pk_plan.places", F.pmod(nth, F.col("_pk_plan.per")).cast("int") + 1)
    short = placed.select(*names, sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))
    full = pieces.filter(F.col("length") >= capacity).select(*names, (-1 - F.col("_pk_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return short.union(full)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(cut_pieces(docs, vocabulary, capacity=capacity), capacity)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
