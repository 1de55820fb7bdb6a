"""BagMinHash signatures of shingle multisets."""

from __future__ import annotations

import numpy as np

from .textkernel import U, mix

BANDS, ROWS = 25, 5
SIZE = BANDS * ROWS
_STEP = U(0x9E3779B97F4A7C15)


def multiset(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs in that order, and how often each occurs."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])]) if len(row) else np.zeros(0, np.int64)
    return row[first], value[first], np.diff(np.r_[first, len(row)])


def _unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers above 0 and up to 1."""
    return ((x >> U(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(row: np.ndarray, value: np.ndarray, times: np.ndarray, n_rows: int, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """For each row of distinct shingles with weights: ``size`` 64-bit components, and whether the row has any shingle.

    The weights are discretised into octaves [0,1), [1,2), [2,4), [4,8), ...;
    each octave of an element carries a Poisson process of its own, whose rate
    is its width times ``size``.  Every point has a time, a component and a
    place inside the octave, all drawn from the hash of the element, octave and
    number alone; halving the octave again and again follows the bits of the
    place.  Octaves that the weight covers count in full; in the one that it
    ends in, the points of the halves beyond it are thinned out.  A component
    is the first point that reaches it, so two multisets agree in a component
    with the probability of their weighted Jaccard similarity.  Points later
    than the last component's first point are never drawn.
    """
    element, octave, weight, owner = [value], [np.zeros(len(value), np.int64)], [times], [row]
    k = 1
    while len(more := np.flatnonzero(times > 1 << k - 1)):
        element.append(value[more])
        octave.append(np.full(len(more), k))
        weight.append(times[more])
        owner.append(row[more])
        k += 1
    element, octave, weight, owner = (np.concatenate(x) for x in (element, octave, weight, owner))
    low = np.where(octave > 0, 1 << np.maximum(octave - 1, 0), 0)
    width = np.maximum(1, low)
    code = mix(element + (octave.astype(U) + U(1)) * U(0xA0761D6478BD642F))
    total = np.bincount(owner, np.minimum(weight - low, width), n_rows)

    first = np.full(n_rows * size, np.inf)
    name = np.zeros(n_rows * size, U)
    limit = np.divide(np.log(size) + 3, total * size, out=np.zeros(n_rows), where=total > 0) * size
    time = np.zeros(len(code))
    number = np.zeros(len(code), U)
    live = np.arange(len(code))
    rate = (width * size).astype(float)
    pending_time = -np.log(_unit(mix(code + _STEP))) / rate
    number += U(1)
    while True:
        while len(live):
            own = owner[live]
            live = live[pending_time[live] <= limit[own]]
            if not len(live):
                break
            time[live] = pending_time[live]
            draw = mix(code[live] ^ mix(number[live] * _STEP))
            component = (draw % U(size)).astype(np.int64)
            place = mix(draw + U(1))
            inside = low[live] + ((place >> U(32)).astype(np.int64) * width[live] >> 32) < weight[live]
            hit = live[inside]
            at = owner[hit] * size + component[inside]
            order = np.lexsort((time[hit], at))
            at, hit, made = at[order], hit[order], draw[inside][order]
            lead = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
            at, hit, made = at[lead], hit[lead], made[lead]
            sooner = time[hit] < first[at]
            first[at[sooner]] = time[hit[sooner]]
            name[at[sooner]] = made[sooner]
            number[live] += U(1)
            pending_time[live] = time[live] - np.log(_unit(mix(code[live] + number[live] * _STEP))) / rate[live]
        last = first.reshape(n_rows, size).max(axis=1, initial=0)
        short = (total > 0) & (last > limit)
        if not short.any():
            break
        limit[short] *= 1.5
        live = np.flatnonzero(short[owner])
    return name.reshape(n_rows, size), total > 0


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    out = np.zeros((len(signature), bands), U)
    for k in range(rows):
        out = mix(out * U(3) + signature[:, k : bands * rows : rows])
    return out
