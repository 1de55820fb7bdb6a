"""Packing of pieces into sequences of a fixed capacity by a configuration linear program.

The program has a row for each piece length and a column for each pattern (a
multiset of lengths that fits); it asks for the fewest patterns that cover all
counts.  Multiplicative weights price the lengths, a knapsack dynamic program
finds the patterns of best price, and their sum is the fractional packing; any
prices also give a lower bound, the worth of all pieces over that of the best
pattern.  Where the rounded packing stays above the bound, the weights start
column generation (pivots over patterns priced by the same knapsack), which
goes on to the optimum.  All patterns are rounded, full or not; what rounding
leaves is placed by best fit.  The driver sees only the histogram of lengths,
which the capacity bounds; ranks inside a length and places are worked out on
the executors.
"""

from __future__ import annotations

import bisect
import math
from collections import defaultdict
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage
from .textkernel import frugal
from .word_ids import word_ids

#: Rounds of multiplicative weights, how strongly coverage moves a price, and by what part a pattern may miss the best price.
ROUNDS, STEP, SLACK = 8, 0.5, 0.002
#: Most steps of column generation's arithmetic: a pivot takes about 4 m**2 of them for m lengths, a table 2 m * capacity.
#: With more than ``MOST_LENGTHS`` these do not reach the optimum, and its matrices would fill a driver; then the
#: multiplicative weights go on instead, for as many further rounds.
WORK, MOST_LENGTHS, FURTHER_ROUNDS = 6_000_000_000, 700, 12
#: Rows of one length that are ranked by one task: that share of all rows, but not below that number.
PARTS, LEAST_PART = 4096, 500

Pattern = tuple[tuple[int, int], ...]  # (length, times), longest first


class Plan(NamedTuple):
    """Patterns with how often each is used, and a number of sequences that no packing goes below."""

    patterns: list[tuple[Pattern, int]]
    bound: int

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The best price that each room can be filled for, and where in ``lengths`` (descending) those that fit it begin."""
    best = np.zeros(capacity + 1)
    fits = np.searchsorted(-lengths, -np.arange(capacity + 1), "left")
    for room in range(int(lengths[-1]), capacity + 1):
        k = fits[room]
        best[room] = max(best[room - 1], (prices[k:] + best[room - lengths[k:]]).max())
    return best, fits


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS, seed: int = 7) -> tuple[dict[Pattern, float], float, np.ndarray]:
    """Patterns and amounts that cover the counts without going beyond them, the best lower bound met, and its prices; lengths descend.

    In each round every length that lags behind the round's goal starts a
    pattern, which is walked down the knapsack table.  The next length is drawn,
    in proportion to what each lacks, from those whose price keeps the pattern
    within ``SLACK`` of the best (those among them first that close it exactly,
    at once or with one more); else it is the best-priced that lacks anything.
    """
    draw = np.random.default_rng(seed)
    prices = lengths / capacity
    covered = np.zeros(len(lengths))
    amounts: dict[Pattern, float] = defaultdict(float)
    sizes = lengths.tolist()
    bound, at_bound = 0.0, prices
    for t in range(1, rounds + 1):
        best, fits = knapsack(lengths, prices, capacity)
        worth = float(counts @ prices / best[capacity])
        if worth > bound:
            bound, at_bound = worth, prices / best[capacity]
        goal = counts * (t / rounds)
        lack = np.maximum(goal - covered, 0)
        closes = np.zeros(capacity + 1, bool)
        for i, first in enumerate(sizes):
            closes[lengths] = lack > 1e-6
            closes[0] = True
            for _ in range(4):
                if lack[i] <= 1e-6:
                    break
                items, room = {i: 1}, capacity - first
                while room >= sizes[-1]:
                    k = fits[room]
                    value = prices[k:] + best[room - lengths[k:]]
                    wanted = np.where(lack[k:] > 1e-6, lack[k:], 0)
                    good = np.where(value >= best[room] * (1 - SLACK), wanted, 0)
                    closing = good * closes[room - lengths[k:]]
                    odds = np.cumsum(closing if closing.any() else good)
                    if odds[-1] > 0:
                        took = min(k + int(np.searchsorted(odds, draw.random() * odds[-1], "right")), len(sizes) - 1)
                    elif wanted.any():
                        took = k + int(np.where(wanted > 0, value, -1).argmax())
                    else:
                        break
                    times = max(1, min(room // sizes[took], int(lack[took] / max(lack[i], 1e-9))))
                    items[took] = items.get(took, 0) + times
                    room -= times * sizes[took]
                more = min(lack[x] / n for x, n in items.items())
                if more <= 0:
                    break
                for x, n in items.items():
                    lack[x] -= more * n
                    covered[x] += more * n
                amounts[tuple(sorted(((sizes[x], n) for x, n in items.items()), reverse=True))] += more
        prices = prices * np.exp(STEP * lack / np.maximum(goal, 1e-9))  # what patterns miss grows dearer
        prices /= prices.max()
    return amounts, bound, at_bound


def reachable(lengths: np.ndarray, capacity: int) -> int:
    """The largest sum of lengths, each taken any number of times, that is within the capacity."""
    sums, mask = 1, (1 << capacity + 1) - 1
    for length in lengths.tolist():
        step = length
        while step <= capacity:
            sums |= sums << step & mask
            step *= 2
    return sums.bit_length() - 1


def best_patterns(lengths: np.ndarray, prices: np.ndarray, capacity: int, least: float) -> tuple[float, list[np.ndarray]]:
    """The best price of a pattern, and for each length the best-priced pattern that holds it, if that is worth more than ``least``; best first."""
    best, fits = knapsack(lengths, prices, capacity)
    found = []
    for i in np.argsort(-(prices + best[capacity - lengths]), kind="stable").tolist():
        if prices[i] + best[capacity - lengths[i]] <= least:
            break
        pattern, room = np.zeros(len(lengths)), capacity - int(lengths[i])
        pattern[i] = 1
        while room >= lengths[-1] and best[room] > 0:
            k = fits[room]
            took = k + int((prices[k:] + best[room - lengths[k:]]).argmax())
            pattern[took] += 1
            room -= int(lengths[took])
        found.append(pattern)
    return float(best[capacity]), found


def column_generation(lengths: np.ndarray, counts: np.ndarray, capacity: int, prices: np.ndarray, bound: float) -> tuple[dict[Pattern, float], float]:
    """Patterns and amounts of the linear program's optimum (or of the cover when ``WORK`` is spent), and the best lower bound; lengths descend.

    A pattern for each length begins the basis.  One knapsack table gives many
    patterns, first under the prices of the multiplicative weights, then under
    the basis's duals; each that still pays is pivoted in.  It ends where no
    pattern pays, or the cover cannot lose a whole sequence any more.
    """
    basis = np.diag((capacity // lengths).astype(float))  # a column for each pattern
    inverse = np.diag(1 / basis.diagonal())
    amount = counts / basis.diagonal()
    m, left = len(lengths), WORK
    while left > 0 and math.ceil(amount.sum() - 1e-6) > math.ceil(bound - 1e-6):
        worth, patterns = best_patterns(lengths, prices, capacity, 1 + 1e-9)
        left -= 2 * m * capacity
        if worth > 0:
            bound = max(bound, float(counts @ prices) / worth)
        duals, pivots = inverse.sum(axis=0), 0
        for entering in patterns:
            if duals @ entering <= 1 + 1e-9:
                continue
            change = inverse @ entering
            ratio = np.divide(amount, change, out=np.full(m, np.inf), where=change > 1e-9)
            out = int(ratio.argmin())
            least = max(ratio[out], 0.0)
            amount = np.maximum(amount - least * change, 0)
            amount[out] = least
            row = inverse[out] / change[out]
            inverse -= np.outer(change, row)
            inverse[out] = row
            basis[:, out] = entering
            duals, pivots, left = inverse.sum(axis=0), pivots + 1, left - 4 * m * m
            if left <= 0:
                break
        own = np.maximum(duals, 0)
        if not pivots and np.array_equal(own, prices):
            break
        prices = own
    found: dict[Pattern, float] = defaultdict(float)
    for k in np.flatnonzero(amount > 0).tolist():
        found[tuple((int(lengths[i]), int(basis[i, k])) for i in np.flatnonzero(basis[:, k]))] += float(amount[k])
    return found, bound


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit, longest first, over counts of lengths; equal bins are handled together."""
    rooms: list[int] = []
    bins: dict[int, list[tuple[dict[int, int], int]]] = {}

    def put(room: int, items: dict[int, int], times: int) -> None:
        if room not in bins:
            bisect.insort(rooms, room)
            bins[room] = []
        bins[room].append((items, times))

    for length in sorted(left, reverse=True):
        n = left[length]
        while n > 0:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                each = capacity // length
                if n >= each:
                    put(capacity - each * length, {length: each}, n // each)
                    n %= each
                if n:
                    put(capacity - n * length, {length: n}, 1)
                break
            room = rooms[k]
            items, times = bins[room].pop()
            if not bins[room]:
                del bins[room], rooms[k]
            each = min(room // length, n)
            used = min(times, n // each)
            if used < times:
                put(room, items, times - used)
            put(room - each * length, {**items, length: items.get(length, 0) + each}, used)
            n -= each * used
    return [(tuple(sorted(items.items(), reverse=True)), times) for group in bins.values() for items, times in group]


def rounded(amounts: list[tuple[Pattern, float]], histogram: dict[int, int], capacity: int, carry: bool) -> list[tuple[Pattern, int]]:
    """Amounts rounded down, then either what rounding leaves is carried from one to the next, or the largest remainders that still fit are rounded up; the rest by best fit."""
    left = dict(histogram)
    plan: dict[Pattern, int] = defaultdict(int)

    def use(pattern: Pattern, times: int) -> int:
        times = min(times, *(left[x] // n for x, n in pattern))
        if times > 0:
            plan[pattern] += times
            for x, n in pattern:
                left[x] -= n * times
        return times

    carried = 0.0
    for pattern, amount in amounts:
        carried = min(carried + amount - use(pattern, int((carried if carry else 0) + amount + 1e-6)), 1.0)
    if not carry:
        for pattern, _ in sorted(amounts, key=lambda x: (-(x[1] % 1), x[0])):
            use(pattern, 1)
    return [*plan.items(), *best_fit({x: n for x, n in left.items() if n}, capacity)]


def packing_plan(histogram: Iterable[tuple[int, int]], capacity: int, rounds: int = ROUNDS) -> Plan:
    """Patterns that together hold exactly the histogram, as few as were found, and the lower bound.

    Tried in turn until one is at the bound: the packing of the multiplicative
    weights rounded, plain best fit, and the linear program's optimum rounded.
    """
    left = {int(k): int(n) for k, n in histogram if n}
    if not left:
        return Plan([], 0)
    if min(left) < 1 or max(left) > capacity:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    lengths = np.array(sorted(left, reverse=True))
    counts = np.array([left[int(x)] for x in lengths], float)
    capacity = reachable(lengths, capacity)  # no sequence can hold more
    size = lambda plan: sum(n for _, n in plan)
    by_use = lambda found: sorted(found.items(), key=lambda x: (-sum(a * n for a, n in x[0]), x[0]))
    amounts, bound, prices = fractional(lengths, counts, capacity, rounds)
    bound = max(bound, float(counts @ lengths) / capacity, float(counts[2 * lengths > capacity].sum()))
    whole = lambda: math.ceil(bound - 1e-6)
    plan = min((rounded(by_use(amounts), left, capacity, carry) for carry in (True, False)), key=size)
    if size(plan) > whole():
        plan = min(plan, best_fit(left, capacity), key=size)
    if size(plan) > whole():
        if len(lengths) <= MOST_LENGTHS:
            more, bound = column_generation(lengths, counts, capacity, prices, bound)
        else:
            more, worth, _ = fractional(lengths, counts, capacity, FURTHER_ROUNDS, seed=8)
            bound = max(bound, worth)
        plan = min(plan, *(rounded(by_use(more), left, capacity, carry) for carry in (True, False)), key=size)
    return Plan(plan, whole())


def pack_pieces(pieces: DataFrame, length_col: str = "length", capacity: int = 4096, key_cols: tuple[str, ...] = ("doc_id", "piece"), rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: gapless from 0 in each sequence, at most ``capacity`` long.

    All other columns are carried along.  Rows whose length is null or below 1
    take no room and get null for both; a length above the capacity is an
    error.  Rows with equal keys each get a place of their own.  Columns that
    have the two names already are replaced.  An empty table gives an empty
    table with the two columns.
    """
    pieces = stage(pieces.drop("sequence_id", "offset"))
    real = F.col(length_col) >= 1
    size = F.col(length_col).cast("long")
    histogram = {r["len"]: r["n"] for r in pieces.where(real).groupBy(size.alias("len")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most the capacity
    # where the rows of one length stand does not matter, so those of a frequent one are dealt over parts and numbered in each
    most = max(LEAST_PART, -(-sum(histogram.values()) // PARTS))
    many = {k: -(-n // most) for k, n in histogram.items() if n > most}
    salt = F.pmod(F.xxhash64(*key_cols), F.coalesce(F.create_map(*(F.lit(x) for pair in many.items() for x in pair))[size], F.lit(1))) if many else F.lit(0).cast("long")
    parts = pieces.where(real & size.isin(list(many))).groupBy(size.alias("len"), salt.alias("salt")).agg(F.count(F.lit(1)).alias("n")).collect() if many else []  # at most PARTS and one more for each length
    first_rank, seen = {}, defaultdict(int)
    for r in sorted(parts, key=lambda r: (r["len"], r["salt"])):
        first_rank[r["len"] << 32 | r["salt"]] = seen[r["len"]]
        seen[r["len"]] += r["n"]
    first_rank.update((k << 32, 0) for k in histogram.keys() - many.keys())
    plan = packing_plan(histogram.items(), capacity, rounds)
    slots, rank, sequence = [], defaultdict(int), 0  # length, first rank, times, first sequence, offset
    for pattern, times in plan.patterns:
        offset = 0
        for length, n in pattern:
            slots.append((length, rank[length], n, sequence, offset))
            rank[length] += n * times
            offset += length * n
        sequence += times
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 5)
    keys = np.array(sorted(first_rank), np.int64)
    spark = pieces.sparkSession
    shift = 62 - int(capacity).bit_length()
    shared = spark.sparkContext.broadcast((table, keys, np.array([first_rank[int(k)] for k in keys], np.int64)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, part: pd.Series, number: pd.Series) -> pd.DataFrame:
        table, keys, first = shared.value
        size = length.to_numpy(np.int64)
        rank = first[np.searchsorted(keys, size << 32 | part.to_numpy(np.int64))] + number.to_numpy(np.int64) - 1
        # one ordered number for (length, rank); lengths are at most the capacity
        found = np.searchsorted(table[:, 0] << shift | table[:, 1], size << shift | rank, "right") - 1
        row = table[found]
        instance, copy = np.divmod(rank - row[:, 1], row[:, 2])
        return pd.DataFrame({"sequence_id": row[:, 3] + instance, "offset": row[:, 4] + copy * size})

    window = Window.partitionBy("__len", "__salt").orderBy(*key_cols)
    numbered = pieces.where(real).withColumns({"__len": size, "__salt": salt}).withColumn("__k", F.row_number().over(window))
    placed = numbered.withColumn("__place", place("__len", "__salt", "__k")).select(*pieces.columns, "__place.sequence_id", "__place.offset")
    nowhere = pieces.where(~real | F.col(length_col).isNull()).select(*pieces.columns, F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    return placed.unionByName(nowhere)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts as ids with the end id, cut into pieces of ``capacity`` where longer: id, ``piece``, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit).

    Null text counts as empty and gives one piece of the end id; null and
    repeated ids are carried, each row on its own; other columns are ignored;
    an empty table gives no rows.
    """

    @frugal
    def cut(batches):
        coder = word_ids(tokenizer)
        for batch in batches:
            done = 0
            for ids, bounds in coder.encode(batch.column(1), end_id):
                data, sizes = ids.astype("<u4").tobytes(), np.diff(bounds)
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                length = np.minimum(sizes[row] - start, capacity)
                at = bounds[row] + start
                out = [data[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + done)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(out, pa.binary())], ["id", "piece", "start", "length", "ids"])
                done += len(sizes)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "id long, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)
