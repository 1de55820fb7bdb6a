"""Hierarchical Pitman-Yor language model over words, trained and applied by hash buckets of the word before.

Three levels of restaurants share parents: one for each two words before, one
for each word before, and the root, whose base gives a share to the unknown
word and deals the rest evenly over the vocabulary.  Contexts are whole words
(64-bit hashes), the end of the text before standing where a text begins; so
restaurants grow with the corpus as the dishes do.

All contexts that end in one word lie in the bucket of that word, with their
dishes, tables and totals.  Only the root is shared: its dishes are dealt over
buckets of their own by the hash of the word.  In a sweep every bucket tells
the root the tables that its words have one level below, and the root tells
each bucket the customers and tables of its words.

A word before that would fill more than half a bucket alone (in a sample) is
split: its contexts are dealt by both words, and the dishes of its restaurant
stand beside those of the root, each with the root's dish of the same word.
Buckets tell the customers that they have for these dishes and are told all of
them with their tables; the totals of split restaurants are summed as the
root's are.  So a bucket's size hangs on no word before.

Seating is sampled by Gibbs sweeps.  In a sweep the tables of each dish are
drawn anew given all others in its restaurant: who sits where among a dish's
customers is summed out by generalised Stirling numbers, so the draw is from
the whole conditional of the Chinese restaurant process under the parent's
current probability, whatever the dish's seating was.  The tables of a
restaurant are the customers of its parent.  Sweeps run over all buckets side
by side with the totals of each restaurant as they stood after the sweep before.
A dish of more than ``EXACT`` customers takes Metropolis steps on its number of
tables instead, with Stirling numbers by their series for few tables and by
their saddle point for many; where it begins, a quick seating of its customers
by blocks gives the first number.
Probabilities are averaged over the kept sweeps.

Data move as compressed blocks: each task turns about ``CHUNK_BYTES`` of text
into one block of tokens with their contexts for each bucket, and gets sums by
document back.  Tables of buckets are written bucketed, so that sweeps move
nothing but the messages between buckets and root.  Only sums over buckets are
collected to the driver.
"""

from __future__ import annotations

import functools
import pickle
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shared import until_exit
from .staging import discard, shared_folder
from .textkernel import U, frugal, mix, release_memory, slices, string_bytes, words

CHUNK_BYTES = 16 << 20
BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 24
#: Text of the sample that tells frequent words, and dishes or pairs that are worked on at a time.
SAMPLE_BYTES, PIECE = 16 << 20, 1 << 17
BURN_IN, KEPT = 2, 3
STRENGTH = 1.0
#: Customers of a dish up to which its tables are drawn from their exact conditional, and Metropolis steps in a sweep beyond that.
EXACT, STEPS = 64, 8
#: Terms of the series of Stirling numbers, and up to how many tables (times customers ** discount) it is taken.
TERMS, FEW = 48, 1.3
#: The hash of the end of a text, counted as a word.
END = U(0x5EED0FE2D0F7E47)
#: Levels: no context, the word before, the two words before.
ROOT, LAST, TWO = 0, 1, 2


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays with their bytes sorted by place, compressed one by one, so that no more than one stands in memory twice; hashes, which mostly come sorted, as differences."""
    arrays = [np.diff(a, prepend=U(0)) if a.dtype == U else a for a in arrays]
    pack = zstandard.ZstdCompressor(level=3).compress
    planes = [(a.dtype.str, len(a), pack(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).reshape(-1))) for a in arrays]
    return pickle.dumps(planes, protocol=5)


def expand(data: bytes, only: slice = slice(None)) -> list[np.ndarray]:
    """The arrays of :func:`squeeze`, or some of them."""
    out, unpack = [], zstandard.ZstdDecompressor().decompress
    for kind, n, plane in pickle.loads(data)[only]:  # noqa: S301  written by squeeze
        dtype = np.dtype(kind)
        a = np.ascontiguousarray(np.frombuffer(unpack(plane), np.uint8).reshape(dtype.itemsize, n).T).view(dtype).reshape(-1)
        out.append(np.cumsum(a, dtype=U) if dtype == U else a)
    return out


def pieces(n: int) -> list[slice]:
    return [slice(k, min(n, k + PIECE)) for k in range(0, n, PIECE)]


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and for each value its place among them; takes no sort where ``x`` is sorted, and little memory."""
    order = None
    if len(x) and not (x[1:] >= x[:-1]).all():
        order = np.argsort(x)
        x = x[order]
    fresh = np.ones(len(x), bool)
    fresh[1:] = x[1:] != x[:-1]
    x = x[fresh]
    place = np.cumsum(fresh, dtype=np.uint32)
    place -= np.uint32(1)
    if order is None:
        return x, place
    out = np.empty_like(place)
    out[order] = place
    return x, out


def text_tokens(data: bytes | np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end after each text, and the number of tokens of each text."""
    row, _, _, value = words(data, bounds, lower=True)
    count = np.bincount(row, minlength=len(bounds) - 1)
    return np.insert(value, np.cumsum(count), END), count + 1


def contexts(token: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens two before and one before; ``end`` before the start of a text."""
    before = np.empty_like(token)
    before[1:] = token[:-1]
    starts = np.cumsum(lengths) - lengths
    before[starts] = end
    earlier = np.empty_like(token)
    earlier[1:] = before[:-1]
    earlier[starts] = end
    return earlier, before


def dealt(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bucket of each hash; buckets are ranges of hashes."""
    return ((hashes >> U(32)) * U(n_buckets) >> U(32)).astype(np.int64)


def places(hashes: np.ndarray, earlier: np.ndarray, before: np.ndarray, n_buckets: int, split: np.ndarray) -> np.ndarray:
    """The bucket of each token: that of the word before, or of both words before where that one is split."""
    bucket = dealt(hashes, n_buckets).astype(np.min_scalar_type(n_buckets))[before]
    both = np.flatnonzero(np.isin(hashes, split)[before])
    bucket[both] = dealt(mix(hashes[before[both]] ^ mix(hashes[earlier[both]] + U(1))), n_buckets)
    return bucket


def labels(n: int) -> list[int]:
    """A key for each bucket, in the order of the buckets, so that Spark's hash of the key deals each of them to a partition of its own among ``n``; else some tasks hold several buckets in memory."""
    most, free, out = (1 << 32) - 1, set(range(n)), []

    def turned(x: int, by: int) -> int:
        return (x << by | x >> 32 - by) & most

    def partition(key: int) -> int:
        h = 42  # Murmur3 of a long, as Spark's hash() has it
        for part in (key & most, key >> 32):
            h = (turned(h ^ turned(part * 0xCC9E2D51 & most, 15) * 0x1B873593 & most, 13) * 5 + 0xE6546B64) & most
        h ^= 8
        for by, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ h >> by) * factor & most
        h ^= h >> 16
        return (h - (h >> 31 << 32)) % n

    for bucket in range(n):
        key = bucket << 32
        while (found := partition(key)) not in free:
            key += 1
        free.remove(found)
        out.append(key)
    return out


def _often(n_buckets: int):
    @frugal
    def run(batches):
        """Words and their tokens: those of a batch that a word must reach in some batch to be split; and all tokens, as of no word."""
        for batch in batches:
            data, bounds = string_bytes(batch.column(0))
            found = [text_tokens(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])[0] for i, j in slices(bounds)]
            word, n = np.unique(np.concatenate(found or [np.zeros(0, U)]), return_counts=True)
            most = n > n.sum() / (8 * n_buckets)
            yield pa.RecordBatch.from_arrays([pa.array([None, *word[most].view(np.int64).tolist()], pa.int64()), pa.array([int(n.sum()), *n[most].tolist()], pa.int64())], names=["word", "n"])

    return run


def frequent_words(rows: DataFrame, size: int, n_buckets: int) -> np.ndarray:
    """Sorted hashes of the words that have more tokens than half a bucket, as a sample by the hash of rows has it; there are at most ``2 * n_buckets``."""
    share = min(1 << 20, max(1, -(-(SAMPLE_BYTES << 20) // max(1, size))))
    sample = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < share).select("text")
    found = sample.mapInArrow(_often(n_buckets), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = {x.word: x.n for x in found.collect()}  # at most 8 * n_buckets words of each batch of the sample
    total = counted.pop(None, 0)
    return np.sort(np.array([w for w, n in counted.items() if n * 2 * n_buckets > total], np.int64).view(U))


def _blocks(n_buckets: int, split: np.ndarray, names_of: list[int]):
    @frugal
    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        names, held, value, lengths, size = [], [], [], [], 0

        def flush():
            ids = np.concatenate(names)
            known, away = np.concatenate(held, axis=1)
            tokens, each = np.concatenate(value), np.concatenate(lengths)
            distinct, word = numbered(tokens)
            earlier, before = contexts(word, each, int(np.searchsorted(distinct, END)))
            document = np.repeat(np.arange(len(ids), dtype=np.uint32), each)
            chunk = part << 24 | number
            # documents go with the tokens, under a key below 0 of their own
            yield -1 - chunk, chunk, squeeze(ids, known.astype(np.uint8), away.astype(np.uint8), each.astype(np.int64))
            bucket = places(distinct, earlier, before, n_buckets, split)
            order = np.argsort(bucket, kind="stable")
            edge = np.r_[0, np.cumsum(np.bincount(bucket, minlength=n_buckets))]
            place, frequent = np.zeros(len(distinct), np.uint32), np.zeros(len(distinct), bool)
            frequent[np.argsort(np.bincount(word))[-255:]] = True
            for b in range(n_buckets):
                own = order[edge[b] : edge[b + 1]]
                if not len(own):
                    continue
                place[earlier[own]] = place[before[own]] = place[word[own]] = 1
                used = np.flatnonzero(place)
                used = np.r_[used[frequent[used]], used[~frequent[used]]]  # low numbers for frequent words take less room
                place[used] = np.arange(len(used))
                row, count = np.unique(document[own], return_counts=True)
                yield names_of[b], chunk, squeeze(distinct[used], place[earlier[own]], place[before[own]], place[word[own]], row, count.astype(np.uint32), away[row].astype(np.uint8))
                place[used] = 0

        def batches_of(rows):
            for bucket, chunk, data in rows:
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([chunk], pa.int64()), pa.array([data], pa.binary())], schema=_BLOCK)

        for batch in batches:
            data, bounds = string_bytes(batch.column(2))
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            away = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in slices(bounds):
                v, n = text_tokens(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                for store, x in ((names, ids[i:j]), (held, np.vstack([known[i:j], away[i:j]])), (value, v), (lengths, n)):
                    store.append(x)
                size += int(bounds[j] - bounds[i])
                if size >= CHUNK_BYTES:
                    yield from batches_of(flush())
                    number, size = number + 1, 0
                    for store in (names, held, value, lengths):
                        store.clear()
        if names:
            yield from batches_of(flush())

    return run


def gather(messages: list[tuple[int, bytes]], split: np.ndarray = np.zeros(0, U)) -> tuple[bytes, bytes]:
    """The distinct pairs of word and two-word context in a bucket's tokens, with their training counts; and for each chunk and document its tokens as numbers of pairs.

    Where words are split, each word before comes with its number among these from 1 on, or 0.
    """
    chunks, tables, columns = [], [], ([], [], [], [], [], [])
    for chunk, data in messages:
        hashes, *rest = expand(data)
        chunks.append((chunk, len(rest[3])))
        tables.append(hashes)
        for store, x in zip(columns, rest, strict=True):
            store.append(x)
    distinct, at = numbered(np.concatenate(tables))
    tables = np.split(at, np.cumsum([len(x) for x in tables])[:-1])
    row, each, away = (np.concatenate(x) for x in columns[3:])
    kept = np.repeat(away == 0, each)

    def tokens(k: int) -> np.ndarray:
        out = np.concatenate([t[x] for t, x in zip(tables, columns[k], strict=True)]).astype(np.int64)
        columns[k].clear()
        return out

    # contexts are numbered by the word before first, so that their parents come in order
    key = tokens(1) * len(distinct)
    key += tokens(0)
    known, context = numbered(key)
    key = tokens(2) * len(known)
    key += context
    del context
    keys, pair = numbered(key)
    del key
    train = np.bincount(pair[kept], minlength=len(keys))
    own, of = numbered(keys // len(known))
    last, parent = numbered(known // len(distinct))
    number = np.searchsorted(split, distinct[last])
    number = np.where(np.isin(distinct[last], split), number + 1, 0).astype(np.uint32)
    data = squeeze(distinct[own], np.bincount(of).astype(np.uint32), (keys % len(known)).astype(np.uint32), train.astype(np.uint32), parent, *([number] if len(split) else []))
    ask = squeeze(*np.array(chunks, np.int64).reshape(-1, 2).T, row, each, pair)
    return data, ask


_BLOCK = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary())])
#: A bucket of contexts or of the root: what it holds, what it asks for, messages to the other side, and numbers to be summed.
_HELD = "bucket long, data binary, ask binary, out array<struct<bucket: long, data: binary>>, sums array<double>"
_COLUMNS = ["bucket", "data", "ask", "out", "sums"]


@dataclass
class Totals:
    """Customers and tables of every restaurant, by level (those of shared restaurants: the root's and, by their numbers, those of split words); with the discounts and the root's base."""

    customers: list[np.ndarray]
    tables: list[np.ndarray]
    discount: tuple[float, float, float] = (0.5, 0.7, 0.8)
    tokens: int = 0
    vocabulary: int = 0
    unknown: float = 0.1
    #: Natural log-likelihood of the training tokens under each seating so far.
    trace: list[float] = field(default_factory=list)

    def base(self) -> float:
        return (1 - self.unknown) / max(1, self.vocabulary)


@dataclass
class State:
    """The dishes of one bucket: sorted words; pairs of word number and context with their customers; seatings as lists of tables by level.

    ``parent`` holds for each context the number of the one above it; without it
    that is the context's number less its last eight bits.  Where the root is
    shared a seating has the root's customers as a fourth list, and ``count``
    holds the words' training counts in all buckets.  ``split`` holds for each
    word before its number as a split word, from 1 on, or 0; the dishes of split
    words, at the places ``apart`` of ``coarse``, are shared as the root is, and
    their customers are a fifth list of a seating.
    """

    word: np.ndarray
    owner: np.ndarray
    context: np.ndarray
    customers: np.ndarray
    seatings: list[list[np.ndarray]]
    trace: list[float] = field(default_factory=list)
    parent: np.ndarray | None = None
    count: np.ndarray | None = None
    split: np.ndarray | None = None

    def __post_init__(self):
        key = self.above(self.context)
        key |= self.owner.astype(np.int64) << 32
        self.coarse, self.up = numbered(key)
        self.apart = np.flatnonzero(self.split[self.coarse & 0xFFFFFFFF]) if self.split is not None else np.zeros(0, np.int64)

    def numbers(self) -> np.ndarray:
        """Of the dishes apart: the numbers of their split words, from 0 on."""
        return self.split[self.coarse[self.apart] & 0xFFFFFFFF] - np.uint32(1)

    def above(self, context: np.ndarray) -> np.ndarray:
        return context.astype(np.int64) >> 8 if self.parent is None else self.parent[context].astype(np.int64)

    def levels(self, tables: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
        """For each level: customers, tables, restaurant, and the entry of the level above it."""
        c1 = np.bincount(self.up, tables[TWO], len(self.coarse))
        if len(tables) > 4:
            c1[self.apart] = tables[4]
        c0 = tables[3] if len(tables) > 3 else np.bincount(self.coarse >> 32, tables[LAST], len(self.word))
        return [(c0, tables[ROOT], np.zeros(len(self.word), np.int64), None), (c1, tables[LAST], self.coarse & 0xFFFFFFFF, self.coarse >> 32), (self.customers, tables[TWO], self.context, self.up)]

    def within(self, tables: list[np.ndarray], t: Totals) -> Totals:
        """The shared restaurants' totals with those of this bucket's own."""
        levels, n = self.levels(tables), (0, int(self.parent.max()) + 1, len(self.parent))
        own = [[np.bincount(levels[k][2], levels[k][i], n[k]) for k in (LAST, TWO)] for i in (0, 1)]
        if self.split is not None:
            at = np.flatnonzero(self.split)
            for mine, all_of in zip(own, (t.customers, t.tables), strict=True):
                mine[0][at] = all_of[LAST][self.split[at] - 1]
        return replace(t, customers=[t.customers[ROOT], *own[0]], tables=[t.tables[ROOT], *own[1]])

    def dump(self) -> bytes:
        shared = [np.array([self.parent is not None, len(self.seatings), self.split is not None])]
        if self.parent is not None:
            shared += [self.parent.astype(np.uint32), self.count.astype(np.int64)]
        if self.split is not None:
            shared += [self.split]
        return squeeze(self.word, self.owner.astype(np.uint32), self.context.astype(np.uint32), self.customers.astype(np.uint32), np.array(self.trace, float), *shared, *(t.astype(np.uint32) for s in self.seatings for t in s))

    @classmethod
    def load(cls, data: bytes) -> State:
        word, owner, context, customers, trace, (shared, n, apart), *rest = expand(data)
        parent, count = (rest.pop(0), rest.pop(0)) if shared else (None, None)
        split = rest.pop(0) if apart else None
        wide = len(rest) // n if n else 3
        return cls(word, owner, context, customers, [rest[k : k + wide] for k in range(0, len(rest), wide)], trace.tolist(), parent, count, split)


def probability(customers, tables, restaurant, parent, level: int, t: Totals) -> np.ndarray:
    """The predictive probability of dishes, given their parent's."""
    d = t.discount[level]
    return (np.maximum(customers - d * tables, 0) + (STRENGTH + d * t.tables[level][restaurant]) * parent) / (STRENGTH + t.customers[level][restaurant])


@functools.lru_cache(16)
def stirling(discount: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: at [c, t], of the summed weights of all ways in which c customers sit at t tables."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0
    with np.errstate(divide="ignore"):
        for c in range(1, EXACT):
            t = np.arange(1, c + 1)
            out[c + 1, 1 : c + 1] = out[c, 1 : c + 1] + np.log(c - discount * t)
            out[c + 1, 1 : c + 2] = np.logaddexp(out[c + 1, 1 : c + 2], out[c, 0 : c + 1])
    return out


def seat_exactly(customers: np.ndarray, elsewhere: np.ndarray, parent: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables of dishes with up to ``EXACT`` customers, drawn given the tables elsewhere in their restaurants and the parent's probability."""
    made = np.minimum(customers, 1).astype(np.int64)
    order = np.flatnonzero(customers > 1)
    order = order[np.argsort(customers[order], kind="stable")]
    counts = customers[order].astype(np.int64)
    edges = np.flatnonzero(np.r_[True, counts[1:] != counts[:-1], True]) if len(counts) else np.zeros(1, int)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        c = int(counts[a])
        for k in range(a, b, 1 << 15):
            own = order[k : min(k + (1 << 15), b)]
            # the weight of t tables: the ways to sit at them, and each table opened with the odds that it finds
            opened = np.log(STRENGTH + discount * (elsewhere[own, None] + np.arange(c))) + np.log(parent[own, None])
            weight = stirling(discount)[c, 1 : c + 1] + np.cumsum(opened, axis=1)
            chance = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            made[own] = 1 + (chance < rng.random((len(own), 1)) * chance[:, -1:]).sum(axis=1)
    return made


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function for x above 0, by Stirling's series eight steps further on."""
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_ways(customers: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """:func:`stirling` for any numbers, but for a part that hangs on the customers alone.

    The numbers are coefficients of a power of (1 - (1 - x)**d) / d; the point
    where its terms peak is found by Newton's method in log(1 - x), in which the
    equation is nearly straight.
    """
    ratio = np.log(np.maximum(customers / tables, 1 + 1e-9))
    u = -ratio / (1 - discount) - 1e-9
    for _ in range(8):
        power = np.exp(discount * u)
        slope = -np.exp(u) / -np.expm1(u) + discount - 1 + discount * power / -np.expm1(discount * u)
        value = np.log(discount) + np.log(-np.expm1(u)) + (discount - 1) * u - np.log(-np.expm1(discount * u)) - ratio
        u = np.minimum(u - value / slope, -1e-9)
    x = -np.expm1(u)
    slope = -np.exp(u) / x + discount - 1 + discount * np.exp(discount * u) / -np.expm1(discount * u)
    spread = customers * -slope * x / np.exp(u)
    return tables * np.log(-np.expm1(discount * u) / discount) - customers * np.log(x) - 0.5 * np.log(np.maximum(spread, 1e-12)) - log_gamma(tables + 1)


class Ways:
    """Logarithms of generalised Stirling numbers of given customers for any numbers of tables, but for a part that hangs on the customers alone.

    For few tables they are an alternating sum of gamma functions whose terms
    fall fast; for many, where its terms would cancel, the saddle point is good.
    """

    def __init__(self, customers: np.ndarray, discount: float):
        j = np.arange(1, TERMS + 1)
        self.customers, self.discount, self.j = customers, discount, j
        self.fixed = log_gamma(customers[:, None] - j * discount) + log_gamma(j * discount + 1) - log_gamma(j + 1.0) - log_gamma(customers + 1)[:, None]
        self.sign = np.where(j % 2 == 1, 1, -1) * np.sin(np.pi * j * discount)
        self.few = FEW * customers**discount

    def __call__(self, tables: np.ndarray) -> np.ndarray:
        out = log_ways(self.customers, tables, self.discount)
        own = np.flatnonzero(tables <= self.few)
        t = tables[own]
        # t! / (t - j)!, nothing for j above t
        chosen = np.cumsum(np.log(np.maximum(t[:, None] - self.j + 1, 1)), axis=1)
        power = np.where(self.j <= t[:, None], self.fixed[own] + chosen, -np.inf)
        most = power.max(axis=1, keepdims=True)
        total = np.exp(power - most) @ self.sign
        sound = total > 1e-9
        series = np.log(np.where(sound, total, 1.0)) + most[:, 0] - t * np.log(self.discount) - log_gamma(t + 1) + 0.5 * np.log(2 / np.pi)
        out[own] = np.where(sound, series, out[own])
        return out


def seat_by_steps(customers: np.ndarray, tables: np.ndarray, elsewhere: np.ndarray, parent: np.ndarray, discount: float, rng: np.random.Generator, steps: int) -> np.ndarray:
    """Numbers of tables of dishes with many customers after Metropolis steps from ``tables``, which leave their conditional as it is."""
    made = np.empty(len(customers))
    for k in range(0, len(customers), 4096):
        part = slice(k, k + 4096)
        made[part] = _steps(customers[part], tables[part], elsewhere[part], parent[part], discount, rng, steps)
    return made


def _steps(customers, tables, elsewhere, parent, discount: float, rng: np.random.Generator, steps: int) -> np.ndarray:
    start, ways = STRENGTH / discount + elsewhere, Ways(customers, discount)

    def weight(t: np.ndarray) -> np.ndarray:
        return ways(t) + t * np.log(discount * parent) + log_gamma(start + t)

    held = np.clip(tables, 1, customers).astype(float)
    own = weight(held)
    # how far a step goes hangs on what does not change, so that steps are as likely back as forth
    reach = np.maximum(1.0, 0.7 * np.sqrt(customers**discount))
    for k in range(steps):
        move = np.rint(rng.normal(size=len(held)) * reach / (1, 3, 10)[k % 3])
        asked = held + np.where(move == 0, rng.choice([-1.0, 1.0], len(held)), move)
        inside = (asked >= 1) & (asked <= customers)
        other = weight(np.where(inside, asked, held))
        taken = inside & (np.log(rng.random(len(held))) < other - own)
        held, own = np.where(taken, asked, held), np.where(taken, other, own)
    return held


def reseat(customers, tables, restaurant, parent, level: int, t: Totals, rng: np.random.Generator, steps: int = STEPS) -> np.ndarray:
    """New numbers of tables of all dishes, given everything else."""
    d = t.discount[level]
    elsewhere = lambda own: np.maximum(t.tables[level][restaurant[own]] - tables[own], 0)
    made = np.minimum(customers, 1.0)
    few = np.flatnonzero((customers > 1) & (customers <= EXACT))
    made[few] = seat_exactly(customers[few], elsewhere(few), parent[few], d, rng)
    many = np.flatnonzero(customers > EXACT)
    if len(many):
        first, others = np.array(tables[many], float), elsewhere(many)
        fresh = first <= 1
        first[fresh] = _quick_seating(customers[many][fresh], others[fresh], parent[many][fresh], d, rng)
        made[many] = seat_by_steps(customers[many], first, others, parent[many], d, rng, steps)
    return made


def _quick_seating(customers: np.ndarray, elsewhere: np.ndarray, parent: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """A number of tables to begin with: customers come in one after another, then by blocks of at most a sixteenth of those seated."""
    seated, made = np.ones(len(customers)), np.ones(len(customers))
    live = np.arange(len(customers))
    while len(live):
        s, m = seated[live], made[live]
        block = np.minimum(np.maximum(1, np.floor(s / 16)), customers[live] - s)
        fresh = (STRENGTH + d * (elsewhere[live] + m)) * parent[live]
        new = rng.binomial(block.astype(np.int64), np.minimum(1.0, fresh / (fresh + np.maximum(s - d * m, 1e-12))))
        seated[live], made[live] = s + block, m + new
        live = live[seated[live] < customers[live]]
    return made


def chances(levels: list[tuple], t: Totals) -> list[np.ndarray]:
    """The predictive probabilities of the root's dishes and of those of the word before."""
    p = [np.full(len(levels[ROOT][0]), t.base())]
    for level in (ROOT, LAST):
        c, n, r, up = levels[level]
        p.append(np.empty(len(c)))
        for k in pieces(len(c)):
            p[-1][k] = probability(c[k], n[k], r[k], p[level][k if up is None else up[k]], level, t)
    return p[1:]


def sweep(state: State, tables: list[np.ndarray], t: Totals, rng: np.random.Generator) -> list[np.ndarray]:
    """One Gibbs sweep over all dishes of a bucket, from the longest contexts to the root; what is shared (the root, dishes apart) stays as it is.  The likelihood of the seating it began with goes to the state's trace."""
    levels = state.levels(tables)
    p, likelihood = chances(levels, t), 0.0
    made: list[np.ndarray] = [np.array(x[1], np.uint32) for x in levels]
    for level in (TWO, LAST, ROOT):
        c, n, r, up = levels[level]
        if level == LAST:
            c = np.bincount(state.up, made[TWO], len(state.coarse))
        elif level == ROOT:
            if len(tables) > 3:
                break
            c = np.bincount(state.coarse >> 32, made[LAST], len(state.word))
        own = np.delete(np.arange(len(c)), state.apart) if level == LAST and len(state.apart) else None
        for k in pieces(len(c if own is None else own)):
            k = k if own is None else own[k]
            customers, above = c[k].astype(float), p[level - 1][up[k]] if up is not None else np.full(len(c[k]), t.base())
            if level == TWO:
                likelihood += float((customers * np.log(probability(customers, n[k], r[k], above, TWO, t))).sum())
            made[level][k] = reseat(customers, np.minimum(n[k], customers), r[k], above, level, t, rng)
    state.trace.append(likelihood)
    return [*made, *tables[3:]]


def build(blocks: list[bytes], shared: bool = False) -> State:
    """The training counts of a bucket, with one table for each dish; words without training rows stay in its list, and so do dishes of split words."""
    known, word, context, train, parent, split = [], [], [], [], None, None
    for data in blocks:
        distinct, per_word, c, n, *above = expand(data)
        parent, split = [*above, None][:2] if shared else (None, None)
        held = n > 0 if split is None else (n > 0) | (split[parent[c]] > 0)
        known.append(distinct)
        word.append(np.repeat(distinct, per_word)[held])
        context.append(c[held].astype(np.int64))
        train.append(n[held])
    word, context, train = np.concatenate(word), np.concatenate(context), np.concatenate(train)
    distinct, _ = numbered(np.concatenate(known))
    keys, at = numbered(np.searchsorted(distinct, word).astype(np.int64) << 32 | context)
    state = State(distinct, (keys >> 32).astype(np.uint32), (keys & 0xFFFFFFFF).astype(np.uint32), np.bincount(at, train, len(keys)).astype(np.uint32), [], parent=parent, split=split)
    two = np.minimum(state.customers, 1)
    last = np.minimum(np.bincount(state.up, two, len(state.coarse)), 1).astype(np.uint32)
    state.seatings = [[np.ones(len(distinct), np.uint32), last, two]]
    return state


def _totals(state: State, tables: list[np.ndarray]) -> list[tuple[int, int, float, float]]:
    """Level, restaurant, customers and tables of each restaurant of a bucket."""
    rows = []
    for level, (c, n, r, _) in enumerate(state.levels([x.astype(float) for x in tables])):
        customers, made = np.bincount(r, c), np.bincount(r, n)
        rows += [(level, int(k), float(customers[k]), float(made[k])) for k in np.flatnonzero(customers)]
    return rows


def _met(customers: np.ndarray) -> list[float]:
    """How many dishes have one customer, and how many two."""
    return [float((customers == 1).sum()), float((customers == 2).sum())]


def _discount(once: float, twice: float) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice) if once + twice else 0.5))


def to_root(state: State, n_buckets: int, first: bool = False) -> list[dict]:
    """Messages to the root's buckets: the tables that the words have one level below, and the customers of dishes apart; the first time with the words, their training counts, and of the dishes apart their words and numbers."""
    edge = np.searchsorted(dealt(state.word, n_buckets), np.arange(n_buckets + 1))
    below = np.array(state.seatings[-1][LAST])
    below[state.apart] = 0
    below = np.bincount(state.coarse >> 32, below, len(state.word)).astype(np.uint32)
    count = np.bincount(state.owner, state.customers, len(state.word)).astype(np.int64) if first else None
    if state.split is not None:
        part, of = np.bincount(state.up, state.seatings[-1][TWO], len(state.coarse))[state.apart].astype(np.uint32), state.coarse[state.apart] >> 32
        cut, number = np.searchsorted(of, edge), state.numbers()
    out = []
    for r in range(n_buckets):
        a, b = edge[r : r + 2]
        if a < b:
            told = [below[a:b], *((state.word[a:b], count[a:b]) if first else ())]
            if state.split is not None:
                k = slice(cut[r], cut[r + 1])
                told += [part[k], *(((of[k] - a).astype(np.uint32), number[k]) if first else ())]
            out.append({"bucket": r, "data": squeeze(*told)})
    return out


def from_root(state: State, messages: list[tuple[int, bytes]]) -> None:
    """Put the customers and tables of the root and of dishes apart, told by all the root's buckets, into the last seating."""
    customers, tables, count, *apart = (np.concatenate(x) for x in zip(*(expand(data) for _, data in sorted(messages)), strict=True))
    last, two = state.seatings[-1][1:3]
    if apart:
        last = np.array(last)
        last[state.apart] = apart[1]
    state.seatings[-1] = [tables, last, two, customers, *apart[:1]]
    state.count = count


def root_first(messages: list[tuple[int, bytes]]) -> bytes:
    """A bucket of the root: words, training counts, one table for each word that has customers; who sends how many words, and which they are.

    Where words are split, the same of the dishes apart follows: number of the split word and of the word, customers, tables, how many each sends, and which.
    """
    messages = sorted(messages)
    below, word, count, *apart = zip(*(expand(data) for _, data in messages), strict=True)
    distinct, at = numbered(np.concatenate(word))
    sizes, customers, more = np.array([len(x) for x in word]), np.bincount(at, np.concatenate(below), len(distinct)), []
    if apart:
        part, of, number = apart
        of = [own[x] for own, x in zip(np.split(at, np.cumsum(sizes)[:-1]), of, strict=True)]
        keys, which = numbered(np.concatenate(number).astype(np.int64) << 32 | np.concatenate(of))
        made = np.bincount(which, np.concatenate(part), len(keys))
        customers = customers + np.bincount(keys & 0xFFFFFFFF, np.minimum(made, 1), len(distinct))
        more = [keys, made.astype(np.uint32), np.minimum(made, 1).astype(np.uint32), np.array([len(x) for x in part]), which]
    return squeeze(distinct, np.bincount(at, np.concatenate(count), len(distinct)).astype(np.int64), customers.astype(np.uint32), np.minimum(customers, 1).astype(np.uint32), np.array([b for b, _ in messages]), sizes, at, *more)


def root_again(data: bytes, messages: list[tuple[int, bytes]], t: Totals, rng: np.random.Generator) -> bytes:
    """Seat the dishes apart and then the tables of the level below anew in a bucket of the root."""
    distinct, count, old, tables, senders, sizes, at, *more = expand(data)
    messages = sorted(messages)
    if [b for b, _ in messages] != senders.tolist():
        raise ValueError("a bucket of the root misses messages")
    below, *part = zip(*(expand(x) for _, x in messages), strict=True)
    customers, base, root = np.bincount(at, np.concatenate(below), len(distinct)), np.full(len(distinct), t.base()), np.zeros(len(distinct), np.int64)
    if more:
        keys, _, held, n, which = more
        p, fresh, made = probability(old, tables, root, base, ROOT, t), np.bincount(which, np.concatenate(part[0]), len(keys)), np.empty(len(keys))
        for k in pieces(len(keys)):
            made[k] = reseat(fresh[k], np.minimum(held[k], fresh[k]), keys[k] >> 32, p[keys[k] & 0xFFFFFFFF], LAST, t, rng)
        customers = customers + np.bincount(keys & 0xFFFFFFFF, made, len(distinct))
        more = [keys, fresh.astype(np.uint32), made.astype(np.uint32), n, which]
    made = reseat(customers, np.minimum(tables, customers).astype(float), root, base, ROOT, t, rng)
    return squeeze(distinct, count, customers.astype(np.uint32), made.astype(np.uint32), senders, sizes, at, *more)


def root_row(bucket: int, data: bytes, n_split: int = 0) -> tuple:
    """A row of _HELD of the root, with messages to the buckets: customers, tables and training counts of their words, customers and tables of their dishes apart."""
    _, count, customers, tables, senders, sizes, at, *more = expand(data)
    sums = [float(customers.sum()), float(tables.sum()), float((count > 0).sum()), float((count == 1).sum()), float(count.sum()), *_met(customers)]
    told = [[customers[k], tables[k], count[k]] for k in np.split(at, np.cumsum(sizes)[:-1])]
    if more:
        keys, c, n, sent, which = more
        sums += [*_met(c), *np.bincount(keys >> 32, c, n_split).tolist(), *np.bincount(keys >> 32, n, n_split).tolist()]
        told = [[*x, c[k], n[k]] for x, k in zip(told, np.split(which, np.cumsum(sent)[:-1]), strict=True)]
    return bucket, data, None, [{"bucket": int(b), "data": squeeze(*x)} for b, x in zip(senders, told, strict=True)], sums


def answer(state: State, totals: Iterable[Totals], data: bytes) -> bytes:
    """For a block of words and pairs: training counts of the words and log10 probabilities of the pairs, averaged over the seatings, which are taken one by one with their totals."""
    distinct, per_word, context = expand(data, slice(3))
    owner = np.repeat(np.arange(len(distinct), dtype=np.uint32), per_word)
    at = np.minimum(np.searchsorted(state.word, distinct), len(state.word) - 1)
    found = state.word[at] == distinct
    keys = state.owner.astype(np.int64) << 32
    keys |= state.context
    fine, rough = np.full(len(owner), -1, np.int32), np.full(len(owner), -1, np.int32)
    for k in pieces(len(owner)):
        below, own = context[k].astype(np.int64), at[owner[k]] << 32
        for known, wanted, out in ((keys, own | below, fine), (state.coarse, own | state.above(below), rough)):
            if len(known):
                i = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                out[k] = np.where(found[owner[k]] & (known[i] == wanted), i, -1)
    del keys
    total = np.zeros(len(owner))
    for tables, t in zip(state.seatings, totals, strict=True):
        levels = state.levels(tables)
        c0, n0 = (np.where(found, x[at], 0) for x in levels[ROOT][:2])
        p0 = probability(c0, n0, np.zeros(len(at), np.int64), np.where(c0 > 0, t.base(), t.unknown), ROOT, t)
        for k in pieces(len(owner)):
            p = p0[owner[k]]
            for level, i, restaurant in ((LAST, rough[k], state.above(context[k])), (TWO, fine[k], context[k])):
                c, n = (np.where(i >= 0, x[i], 0) if len(x) else np.zeros(len(i)) for x in levels[level][:2])
                p = probability(c, n, restaurant, p, level, t)
            total[k] += p
    logs = np.log10(total / len(state.seatings)).astype(np.float32)
    count = np.bincount(state.owner, state.customers, len(state.word)) if state.count is None else state.count
    return squeeze(np.where(found, count[at], 0).astype(np.int64), logs)


def sums_by_document(data: bytes, ask: bytes, logs: bytes, t: Totals) -> list[tuple[int, bytes]]:
    """For each chunk its documents that have tokens in this bucket: known tokens, and the logarithms of the base and of the model."""
    count, score = expand(logs)
    chunks, n_rows, row, each, pair = expand(ask)
    start = np.cumsum(each, dtype=np.int64) - each
    count = np.repeat(count, expand(data, slice(1, 2))[0])
    base = np.log10((count + 1) / (t.tokens + t.vocabulary + 1))
    known, base, score = (np.add.reduceat(x[pair], start, dtype=kind) for x, kind in ((count > 0, np.int64), (base, float), (score, float)))
    cut = np.cumsum(n_rows)[:-1]
    return [(int(c), squeeze(*x)) for c, *x in zip(chunks, *(np.split(x, cut) for x in (row, known.astype(np.uint32), base, score)), strict=True)]


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _keep(df: DataFrame, n_buckets: int) -> tuple[DataFrame, str]:
    """``df`` written by its buckets, so that two such tables meet without a shuffle; the name it needs in the catalogue is given up at once, the folder stays."""
    spark, path, name = df.sparkSession, shared_folder(df.sparkSession), f"loresmith_{uuid.uuid4().hex}"
    held = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # what was shuffled for the table is not needed once it is written
    try:
        df.write.bucketBy(n_buckets, "bucket").option("path", path).option("compression", "none").saveAsTable(name)
    finally:
        spark.conf.set(_CLEANUP, held)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out, until_exit(spark, path)


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", burn_in: int = BURN_IN, kept: int = KEPT, seed: int = 11) -> DataFrame:
    """Train on the rows where ``held_out`` is false and score every row.

    Returns the id, ``held_out``, ``n_tokens`` (words and the end), ``n_known``
    (those met in training), ``train_tokens``, ``base_score`` (add-one unigram,
    log10) and ``score`` (this model's log10 probability of the text; the
    unknown word is one event, as in the base).  Perplexity is
    10 ** (-score / n_tokens).  Null text counts as empty and holds the end
    alone; a null ``held_out`` counts as held out; null and repeated ids are
    carried through, each row scored on its own.  Without training rows every
    word is unknown.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(True)).alias("away"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    split, names_of = frequent_words(rows, size, n_buckets), labels(n_buckets)

    def messages(df: DataFrame) -> DataFrame:
        return df.select(F.col("bucket").alias("sender"), F.explode("out").alias("m")).select("m.bucket", "sender", "m.data")

    def pairs(frame: pd.DataFrame, column: str = "sender") -> list[tuple[int, bytes]]:
        return list(zip(frame[column].tolist(), frame["data"], strict=True))

    def summed(df: DataFrame) -> list[float]:
        found = df.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n")).collect()  # a handful of sums
        return [x.n for x in sorted(found, key=lambda x: x.pos)]

    def sent_to_root(state: State, first: bool = False) -> list[dict]:
        return [{"bucket": names_of[m["bucket"]], "data": m["data"]} for m in to_root(state, n_buckets, first)]

    def first(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return pd.DataFrame([(key[0], blocks["data"].iloc[0], None, [], [])], columns=_COLUMNS)
        release_memory()  # what the bucket before has left in this worker
        data, ask = gather(sorted(pairs(blocks, "chunk")), split)
        state = build([data], shared=True)
        levels = state.levels(state.seatings[-1])
        sums = [*_met(np.delete(levels[LAST][0], state.apart)), *_met(levels[TWO][0])]
        return pd.DataFrame([(key[0], data, ask, [], sums)], columns=_COLUMNS)

    def first_messages(frames):
        for frame in frames:
            for bucket, data in zip(frame["bucket"], frame["data"], strict=True):
                out = sent_to_root(build([data], shared=True), first=True)
                yield pd.DataFrame({"bucket": [m["bucket"] for m in out], "sender": bucket, "data": [m["data"] for m in out]})

    def open_root(key: tuple, sent: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([root_row(key[0], root_first(pairs(sent)), len(split))], columns=_COLUMNS)

    blocks = rows.mapInArrow(_blocks(n_buckets, split, names_of), "bucket long, chunk long, data binary").repartition(n_buckets, "bucket")
    begun, _ = _keep(blocks.groupBy("bucket").applyInPandas(first, _HELD), n_buckets)
    asked = begun.where("bucket >= 0")
    told = asked.select("bucket", "data").mapInPandas(first_messages, "bucket long, sender long, data binary")
    root, root_path = _keep(told.repartition(n_buckets, "bucket").groupBy("bucket").applyInPandas(open_root, _HELD), n_buckets)

    def totals_of(root: DataFrame, held: Totals | None) -> Totals:
        customers, tables, vocabulary, once, tokens, *met = summed(root) or [0.0] * (9 + 2 * len(split))
        met, apart, shared = met[:2], met[2:4], np.array(met[4:]).reshape(2, -1)
        t = Totals([np.array([customers]), shared[0]], [np.array([tables]), shared[1]], tokens=int(tokens), vocabulary=int(vocabulary))
        if held:
            t.discount, t.unknown = held.discount, held.unknown
        else:
            met += summed(begun) or [0.0] * 4
            met[2:4] = [x + y for x, y in zip(met[2:4], apart or [0.0, 0.0], strict=True)]
            t.discount = tuple(_discount(*met[k : k + 2]) for k in (0, 2, 4))
            fresh = (STRENGTH + t.discount[0] * tables) / (STRENGTH + customers)
            t.unknown = min(0.9, max(1e-6, (once / tokens if tokens else 1) / fresh))
        return t

    def again(k: int, t: Totals):
        def run(key: tuple, model: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
            release_memory()
            data = model["data"].iloc[0]
            state = State.load(data) if k else build([data], shared=True)
            from_root(state, pairs(sent))
            if k == burn_in + kept:
                return pd.DataFrame([(key[0], state.dump(), None, [], [])], columns=_COLUMNS)
            made = sweep(state, state.seatings[-1], state.within(state.seatings[-1], t), np.random.default_rng([seed, k, key[0]]))
            state.seatings = [*(state.seatings if k > burn_in else []), made]
            return pd.DataFrame([(key[0], state.dump(), None, sent_to_root(state), state.trace[-1:])], columns=_COLUMNS)

        return run

    def root_sweep(k: int, t: Totals):
        def run(key: tuple, model: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
            data = root_again(model["data"].iloc[0], pairs(sent), t, np.random.default_rng([seed, k, key[0], 1]))
            return pd.DataFrame([root_row(key[0], data, len(split))], columns=_COLUMNS)

        return run

    def meet(held: DataFrame, told: DataFrame, run) -> tuple[DataFrame, str]:
        return _keep(held.select("bucket", "data").groupBy("bucket").cogroup(messages(told).groupBy("bucket")).applyInPandas(run, _HELD), n_buckets)

    totals, trace, states, path = [totals_of(root, None)], [], asked, None
    for k in range(burn_in + kept + 1):
        t, old = totals[-1], path
        states, path = meet(states, root, again(k, t))
        if old:
            discard(old, spark)
        if k < burn_in + kept:
            old = root_path
            root, root_path = meet(root, states, root_sweep(k, t))
            discard(old, spark)
            trace += summed(states)
            totals = [*(totals if k > burn_in else []), totals_of(root, t)]
    discard(root_path, spark)
    totals[-1].trace = trace

    def reply(key: tuple, model: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        release_memory()
        state, data = State.load(model["data"].iloc[0]), own["data"].iloc[0]
        logs = answer(state, (state.within(s, t) for s, t in zip(state.seatings, totals, strict=True)), data)
        found = sums_by_document(data, own["ask"].iloc[0], logs, totals[-1])
        return pd.DataFrame({"chunk": [c for c, _ in found], "bucket": key[0], "data": [x for _, x in found]})

    replies = states.select("bucket", "data").groupBy("bucket").cogroup(asked.select("bucket", "data", "ask").groupBy("bucket")).applyInPandas(reply, "chunk long, bucket long, data binary")

    def finish(key: tuple, own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        ids, known, away, lengths = expand(own["data"].iloc[0])
        row, *parts = (np.concatenate(x) for x in zip(*(expand(x) for _, x in sorted(pairs(found, "bucket"))), strict=True))
        n_known, base, score = (np.bincount(row, x, len(ids)) for x in parts)
        out = pd.DataFrame({
            "id": pd.array(ids, "Int64"), "held_out": away.astype(bool), "n_tokens": lengths, "n_known": n_known.astype(np.int64), "train_tokens": totals[-1].tokens,
            "base_score": base, "score": score,
        })
        out.loc[known == 0, "id"] = pd.NA
        return out

    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    documents = begun.where("bucket < 0").select((-1 - F.col("bucket")).alias("chunk"), "data")
    return documents.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(finish, schema).withColumnRenamed("id", id_col)
