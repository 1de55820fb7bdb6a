"""Ids of whole texts by a public tokenizer whose tokens never span white space.

The runs of a text between ASCII white space are found and hashed in numpy.
Each distinct run goes through the tokenizers library once and is remembered by
its 64-bit hash; the ids of a text are those of its runs, one after another.
Runs of more than 64 bytes are encoded every time, so that none can be made to
share the hash of another.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa

from .textkernel import U, mix, ragged, slices, string_bytes, words

#: Runs remembered by a worker (about 40 bytes each); beyond this those met only once are forgotten, which costs time and changes nothing.
REMEMBERED = 400_000
#: Bytes of text whose runs are made distinct together, and runs that go to the library in one string.
GROUP_BYTES, GROUP_RUNS = 2 << 20, 512
#: Strings that the library holds at a time; what it keeps of a token is many times the id.
STRINGS = 16
LONGEST = 64
#: The first of these that is one token stands between the runs of a string; a string with a run that holds it is encoded run by run.
_MARKS = "★♥→•§"


class WordIds:
    """Encodes columns of whole texts; the memory of runs lives as long as the worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        spelled = {x: self.tokenizer.encode(x, add_special_tokens=False).ids for x in _MARKS}
        self.mark, self.mark_id = next(((x, ids[0]) for x, ids in spelled.items() if len(ids) == 1), (_MARKS[0], -1))
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.count, self.ids = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.met = np.zeros(0, np.int32)

    def forget_rare(self) -> None:
        """Keep the runs that several groups of texts held, at most half of what may be remembered."""
        least = max(2, int(np.partition(self.met, -(REMEMBERED // 2))[-(REMEMBERED // 2)]) + 1 if len(self.met) > REMEMBERED // 2 else 2)
        kept = np.flatnonzero(self.met >= least)
        count = self.count[kept]
        self.ids = self.ids[ragged(self.at[kept], count)]
        self.keys, self.count, self.at, self.met = self.keys[kept], count, np.cumsum(count) - count, self.met[kept] // 2 + 1

    def _encode(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs, one after another, and how many each has."""
        gap = np.frombuffer(f" {self.mark} ".encode(), np.uint8)
        room = size + len(gap)
        ends = np.cumsum(room)
        out = np.empty(int(ends[-1]), np.uint8)
        out[ragged(ends - room, size)] = data[ragged(start, size)]
        for k, x in enumerate(gap.tolist()):
            out[ends - len(gap) + k] = x
        cuts = np.r_[0, ends[GROUP_RUNS - 1 :: GROUP_RUNS], ends[-1]]
        plain = out.tobytes()
        strings = [plain[a:b].decode() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if b > a]
        parts, counts = [], []
        coded = (np.array(x.ids, np.uint32) for k in range(0, len(strings), STRINGS) for x in self.tokenizer.encode_batch_fast(strings[k : k + STRINGS], add_special_tokens=False))
        for k, (text, ids) in enumerate(zip(strings, coded, strict=True)):
            n = min(GROUP_RUNS, len(size) - k * GROUP_RUNS)
            marks = np.flatnonzero(ids == self.mark_id)
            if len(marks) == n and text.count(self.mark) == n:
                counts.append(np.diff(np.r_[-1, marks]) - 1)
                parts.append(np.delete(ids, marks))
            else:
                own = [plain[a : a + s].decode() for a, s in zip((ends - room)[k * GROUP_RUNS :][:n].tolist(), size[k * GROUP_RUNS :][:n].tolist(), strict=True)]
                each = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(own, add_special_tokens=False)]
                counts.append(np.array([len(x) for x in each]))
                parts += each
        return np.concatenate(parts), np.concatenate(counts)

    def _learn(self, data: np.ndarray, key: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Remember runs that are not yet known; keys ascend."""
        ids, count = self._encode(data, start, size)
        at = np.cumsum(count) - count + len(self.ids)
        where = np.searchsorted(self.keys, key)
        self.keys, self.at, self.count = np.insert(self.keys, where, key), np.insert(self.at, where, at), np.insert(self.count, where, count)
        self.ids = np.r_[self.ids, ids]
        self.met = np.insert(self.met, where, 0)

    def encode(self, column: pa.Array, last: int):
        """Yields, for stretches of the column, the ids of all its texts, each followed by ``last``, and the bounds of the texts in them."""
        data, bounds = string_bytes(column)
        for i, j in slices(bounds, GROUP_BYTES):
            base = bounds[i]
            part, at = data[base : bounds[j]], bounds[i : j + 1] - base
            row, start, end, key = [], [], [], []
            for a, b in slices(at):
                r, s, e, h = words(part[at[a] : at[b]], at[a : b + 1] - at[a])
                for store, x in ((row, r + a), (start, s + at[a]), (end, e + at[a]), (key, h)):
                    store.append(x)
            row, start, end, key = (np.concatenate(x) for x in (row, start, end, key))
            size = end - start
            if len(long := np.flatnonzero(size > LONGEST)):
                key = key.copy()
                key[long] = mix(np.arange(len(long), dtype=U) + U(1 << 60)) | U(1)
            if len(self.keys) > REMEMBERED:
                self.forget_rare()
            distinct, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            found = np.searchsorted(self.keys, distinct)
            known = np.zeros(len(distinct), bool)
            inside = found < len(self.keys)
            known[inside] = self.keys[found[inside]] == distinct[inside]
            known &= size[first] <= LONGEST
            fresh = np.flatnonzero(~known & (size[first] <= LONGEST))
            if len(fresh):
                self._learn(part, distinct[fresh], start[first[fresh]], size[first[fresh]])
            ids = self.ids
            found = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
            place, count = (self.at[found], self.count[found]) if len(self.keys) else (np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64))
            if len(self.keys):
                self.met[found[size[first] <= LONGEST]] += 1
            alone = np.flatnonzero(size[first] > LONGEST)
            if len(alone):
                extra, each = self._encode(part, start[first[alone]], size[first[alone]])
                place[alone], count[alone] = len(ids) + np.cumsum(each) - each, each
                ids = np.r_[ids, extra]
            ids = np.r_[ids, np.uint32(last)]
            runs = np.bincount(row, minlength=j - i)
            closing = np.cumsum(runs)
            place = np.insert(place[inverse], closing, len(ids) - 1)
            count = np.insert(count[inverse], closing, 1)
            total = np.r_[0, np.cumsum(count)]
            yield ids[ragged(place, count)], total[np.r_[0, closing + np.arange(1, j - i + 1)]]


@functools.lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
