"""N-best segmentation of whole texts over the piece lattice of a SentencePiece model, and decoding.

A text is cut where no piece can lie across: before a blank that follows
another character, and around line feeds.  The lattice of a text is the chain
of the lattices of its runs, so its best path is the chain of theirs, and an
n-best path leaves the best one in at most n - 1 runs.  Forward Viterbi scores
are worked out for many runs side by side; they are exact heuristics for the
backward A* search, which is run on just the runs that an n-best path can leave.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import U, frugal, mix, ragged, slices, span_hashes, string_bytes

BLANK = "▁"
_MARK = BLANK.encode()
#: Runs remembered by a worker, and characters of runs whose lists of segmentations are; beyond these the memory starts anew, which changes nothing.
REMEMBERED, LIST_CHARACTERS = 1_000_000, 400_000
#: Bytes of text that are handled together, and of a run that is remembered.
GROUP_BYTES, LONGEST = 4 << 20, 64
_FACTOR = U(0x9FB21C651E98DF25)


class Pieces:
    """The pieces of a model with their scores.  A character in no piece is spelled in its bytes at ``lone``, below the score of any piece that is not all blanks."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.names = [model.id_to_piece(i) for i in range(n)]
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.scores = {p: float(model.get_score(i)) for p, i in self.ids.items()}
        self.lone = min(v for p, v in self.scores.items() if p.strip(BLANK)) - 10
        self.longest = max(map(len, self.ids))
        keys = np.array([_code(np.array([ord(c) for c in p])) for p in self.ids], U)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array([self.scores[p] for p in self.ids])[order]
        self.order = np.array(list(self.ids.values()))[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces have one hash")
        # two tables of slots by different bits of the hash; the few pieces that lose their slot in the first stand in the second
        self.slots = np.zeros((2, 1 << 20), np.int32)
        self.slots[0, (self.keys >> U(44)).astype(np.int64)] = np.arange(len(self.keys))
        lost = np.flatnonzero(self.slots[0, (self.keys >> U(44)).astype(np.int64)] != np.arange(len(self.keys)))
        self.slots[1, (self.keys[lost] & U(0xFFFFF)).astype(np.int64)] = lost
        if (self.keys[self.place(self.keys)] != self.keys).any():
            raise ValueError("two pieces have one slot in both tables")
        self.forget()
        self.lists: dict[tuple[str, int], list[tuple[float, tuple[str, ...]]]] = {}
        self.listed = 0

    def place(self, key: np.ndarray) -> np.ndarray:
        """Where in ``keys`` each key stands, if it is there at all."""
        at = self.slots[0, (key >> U(44)).astype(np.int64)]
        miss = np.flatnonzero(self.keys[at] != key)
        at[miss] = self.slots[1, (key[miss] & U(0xFFFFF)).astype(np.int64)]
        return at

    def score(self, piece: str) -> float | None:
        """The score of an arc; None if there is none."""
        found = self.scores.get(piece)
        return self.lone if found is None and len(piece) == 1 else found

    def forget(self) -> None:
        self.known = np.zeros(0, U)
        self.best, self.loss = np.zeros(0), np.zeros(0)
        self.at, self.count, self.same = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.flat = np.zeros(0, np.uint32)

    def work_out(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each run: the best score, what the second-best is below it, how many ids the best segmentation has and whether it decodes to the run; and all ids."""
        best, loss, same = np.zeros(len(runs)), np.full(len(runs), np.inf), np.zeros(len(runs), bool)
        ids: list = [None] * len(runs)
        order = sorted(range(len(runs)), key=lambda k: len(runs[k]))
        short = [k for k in order if len(runs[k]) <= LONGEST]
        alone = [k for k in order if len(runs[k]) > LONGEST]  # padding others to these would cost memory
        for k in range(0, len(short), 4096):
            part = short[k : k + 4096]
            first, second, made, counts = self._forward_all([runs[x] for x in part])
            best[part], loss[part] = first, first - second
            ends = np.cumsum(counts)
            listed = made.tolist()
            for x, a, b in zip(part, (ends - counts).tolist(), ends.tolist(), strict=True):
                if a == b:
                    alone.append(x)
                else:
                    ids[x] = made[a:b]
                    same[x] = "".join([self.names[i] for i in listed[a:b]]) == runs[x]
        for x in alone:
            found = self.n_best(runs[x], 2)
            best[x], loss[x] = found[0][0], found[0][0] - found[1][0] if len(found) > 1 else np.inf
            ids[x] = np.array(self.encode(list(found[0][1])), np.uint32)
            same[x] = self._plain(ids[x].tolist()) == runs[x]
        count = np.array([len(x) for x in ids], np.int64)
        return best, loss, count, same, np.concatenate(ids).astype(np.uint32) if ids else np.zeros(0, np.uint32)

    def _learn(self, key: np.ndarray, runs: list[str]) -> None:
        best, loss, count, same, ids = self.work_out(runs)
        where = np.searchsorted(self.known, key)
        self.known, self.best, self.loss = np.insert(self.known, where, key), np.insert(self.best, where, best), np.insert(self.loss, where, loss)
        self.at = np.insert(self.at, where, len(self.flat) + np.cumsum(count) - count)
        self.count, self.same = np.insert(self.count, where, count), np.insert(self.same, where, same)
        self.flat = np.r_[self.flat, ids]

    def _forward_all(self, part: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best and second-best scores, the ids of the best segmentations one after another, and how many each has (0: it holds a character in no piece)."""
        w, most = len(part), len(part[-1])
        sizes = np.array([len(x) for x in part])
        chars = np.zeros((w, most), np.int64)
        chars[np.arange(most) < sizes[:, None]] = np.frombuffer("".join(part).encode("utf-32-le"), "<u4")
        first, second = np.full((most + 1, w), -np.inf), np.full((most + 1, w), -np.inf)
        back, took = np.zeros((most + 1, w), np.int32), np.full((most + 1, w), -1, np.int32)
        first[0] = 0
        for i in range(most):
            code = np.zeros(w, U)
            for n in range(1, min(self.longest, most - i) + 1):
                code = code * _FACTOR + chars[:, i + n - 1].astype(U) + U(1)
                key = mix(code + U(n))
                at = self.place(key)
                is_piece = self.keys[at] == key
                if n > 1 and not is_piece.any():
                    continue
                value = np.where(is_piece, self.values[at], self.lone if n == 1 else -np.inf)
                to = i + n
                new = first[i] + value
                better = new > first[to]
                second[to] = np.maximum(np.where(better, first[to], np.maximum(second[to], new)), second[i] + value)
                first[to] = np.where(better, new, first[to])
                back[to] = np.where(better, n, back[to])
                took[to] = np.where(better, np.where(is_piece, self.order[at], -1), took[to])
        at, column, steps = sizes.copy(), np.arange(w), []
        while (at > 0).any():
            steps.append(np.where(at > 0, took[at, column], -2))
            at = at - np.where(at > 0, back[at, column], 0)
        path = np.stack(steps[::-1], axis=1) if steps else np.zeros((w, 0), np.int32)
        path[(path == -1).any(axis=1)] = -2
        return first[sizes, column], second[sizes, column], path[path >= 0], (path >= 0).sum(axis=1)

    def arcs(self, run: str) -> list[list[tuple[int, float]]]:
        """For each place in a run where the pieces that end there begin, and their scores; pieces of one length are looked up side by side."""
        chars = np.frombuffer(run.encode("utf-32-le", "surrogatepass"), "<u4").astype(U)
        into: list[list[tuple[int, float]]] = [[] for _ in range(len(run) + 1)]
        code = np.zeros(len(run), U)
        for n in range(1, min(self.longest, len(run)) + 1):
            code = code[: len(run) - n + 1] * _FACTOR + chars[n - 1 :] + U(1)
            key = mix(code + U(n))
            at = self.place(key)
            found = self.keys[at] == key
            if n == 1:
                for i, s in enumerate(np.where(found, self.values[at], self.lone).tolist()):
                    into[i + 1].append((i, s))
            else:
                where = np.flatnonzero(found)
                for i, s in zip(where.tolist(), self.values[at[where]].tolist(), strict=True):
                    into[i + n].append((i, s))
        return into

    def n_best(self, run: str, n: int) -> list[tuple[float, tuple[str, ...]]]:
        """The ``n`` best segmentations of a run, exactly: A* from its end, with the forward scores as what is still to come; of equals the one nearest to its end, then the one found last, goes on, so that ties are not walked side by side."""
        if (run, n) in self.lists:
            return self.lists[run, n]
        into, number = self.arcs(run), itertools.count()
        best = [0.0] * (len(run) + 1)
        for at in range(1, len(run) + 1):
            best[at] = max(best[i] + s for i, s in into[at])
        heap: list[tuple] = [(-best[-1], len(run), 0, 0.0, None)]
        found: list[tuple[float, tuple[str, ...]]] = []
        while heap and len(found) < n:
            _, at, _, held, path = heapq.heappop(heap)
            if at == 0:
                pieces = []
                while path:
                    piece, path = path
                    pieces.append(piece)
                found.append((held, tuple(pieces)))
                continue
            for i, s in into[at]:
                heapq.heappush(heap, (-(held + s + best[i]), i, -next(number), held + s, (run[i:at], path)))
        self.listed += len(run)
        if self.listed > LIST_CHARACTERS:
            self.lists.clear()
            self.listed = len(run)
        if len(run) <= LONGEST:
            self.lists[run, n] = found
        return found

    def segment(self, column: pa.Array, n: int):
        """For each text of a column its ``n`` best segmentations, best first: (score, ids as bytes, whether they decode to the text)."""
        data, bounds = string_bytes(column)
        for i, j in slices(bounds, GROUP_BYTES):
            if len(self.known) > REMEMBERED:
                self.forget()
            part, at = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            marked = np.insert(part, at[:-1], 32)  # a blank before each text
            at = at + np.arange(len(at))
            start, end = run_spans(marked, at)
            yield from self._group(marked, at, start, end, n)

    def _group(self, marked, at, start, end, n):
        key, size = span_hashes(marked, start, end), end - start
        strings = lambda which: [marked[a:b].tobytes().decode().replace(" ", BLANK) for a, b in zip(start[which].tolist(), end[which].tolist(), strict=True)]
        distinct, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        long = size > LONGEST
        where = np.searchsorted(self.known, distinct)
        known = where < len(self.known)
        known[known] = self.known[where[known]] == distinct[known]
        fresh = np.flatnonzero(~known & ~long[first])
        if len(fresh):
            self._learn(distinct[fresh], strings(first[fresh]))
        place = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))[inverse]
        flat, out_of = self.flat, np.zeros(len(key), np.int64)
        if len(self.known):
            best, loss, out_of, count, same = self.best[place], self.loss[place], self.at[place], self.count[place], self.same[place]
        else:
            best, loss, count, same = np.zeros(len(key)), np.zeros(len(key)), np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        if len(alone := np.flatnonzero(long)):
            best[alone], loss[alone], count[alone], same[alone], ids = self.work_out(strings(alone))
            out_of[alone] = len(flat) + np.cumsum(count[alone]) - count[alone]
            flat = np.r_[flat, ids]
        runs = np.searchsorted(start, at)
        ids = flat[ragged(out_of, count)].astype("<u4").tobytes()
        placed = 4 * np.r_[0, np.cumsum(count)]
        totals = np.add.reduceat(best, runs[:-1])
        marks = _MARK in marked.tobytes()
        for k in range(len(at) - 1):
            a, b = int(runs[k]), int(runs[k + 1])
            lost = loss[a:b]
            near = np.sort(np.argpartition(lost, n - 1)[: n - 1]) if len(lost) >= n else np.arange(len(lost))
            near = (a + near[np.isfinite(lost[near])]).tolist() if n > 1 else []
            options = [self.n_best(x, n) for x in strings(near)] if near else []
            spelled = [[np.array(self.encode(list(p)), "<u4").tobytes() for _, p in found] for found in options]
            decoded = [[self._plain(np.frombuffer(x, "<u4").tolist()) == run for x in found] for run, found in zip(strings(near), spelled, strict=True)] if near else []
            whole = bool(same[a:b].all()) and not (marks and _MARK in marked[at[k] : at[k + 1]].tobytes())
            texts: list[tuple[float, bytes, bool]] = []
            for lost_by, way in _least_sums([[(best[x] - s, i) for i, (s, _) in enumerate(found)] for x, found in zip(near, options, strict=True)], n):
                parts, last = [], int(placed[a])
                for x, i, found in zip(near, way, spelled, strict=True):
                    parts += [ids[last : placed[x]], found[i]]
                    last = int(placed[x + 1])
                parts.append(ids[last : placed[b]])
                texts.append((float(totals[k] - lost_by), b"".join(parts), whole and all(told[i] for told, i in zip(decoded, way, strict=True))))
            yield texts

    def encode(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            out += [self.ids[p]] if p in self.ids else [self.bytes[b] for b in p.encode()]
        return out

    def _plain(self, ids: list[int]) -> str:
        return b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.names[i].encode() for i in ids).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes are joined, the mark of blanks becomes a blank, and the one put before the text goes."""
        return self._plain(ids).replace(BLANK, " ")[1:]


def _code(chars: np.ndarray) -> np.uint64:
    code = np.zeros(1, U)
    for c in chars:
        code = code * _FACTOR + U(int(c) + 1)
    return mix(code + U(len(chars)))[0]


def run_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of texts that each begin with a blank: blanks and what follows them up to the next blank; a line feed is a run of its own."""
    blank, feed = data == 32, data == 10
    begins = np.zeros(len(data) + 1, bool)
    begins[1:-1] = (blank[1:] & ~blank[:-1]) | feed[1:] | feed[:-1]
    begins[bounds] = True
    start = np.flatnonzero(begins)
    return start[:-1], start[1:]


def _least_sums(options: list[list[tuple[float, int]]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` least sums of one choice from each ascending list, with the choices."""
    held: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for own in options:
        held = heapq.nsmallest(n, ((a + b, (*way, i)) for a, way in held for b, i in own))
    return held


@functools.lru_cache(1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def n_best_segmentations(docs: DataFrame, model_path: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and rank (from 0): the id, ``rank``, ``score``, ``n_ids``, ``ids_crc32`` and ``decodes``.

    Fewer than ``n`` rows come out where the lattice has fewer paths.
    ``ids_crc32`` is of the ids as little-endian unsigned 32-bit integers, and
    ``decodes`` tells whether they decode to the text, run by run.  Null text
    counts as empty: one blank.  The mark of blanks itself in a text counts as a
    blank, and the text does not decode.  Null and repeated ids are carried
    through.
    """

    @frugal
    def run(batches):
        model = pieces(model_path)
        kinds = (pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.bool_())
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                names = part.column(0).to_pylist()
                rows = [(name, rank, score, len(ids) // 4, zlib.crc32(ids), told) for name, found in zip(names, model.segment(part.column(1), n), strict=True) for rank, (score, ids, told) in enumerate(found)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "rank", "score", "n_ids", "ids_crc32", "decodes"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id long, rank int, score double, n_ids long, ids_crc32 long, decodes boolean").withColumnRenamed("id", id_col)
