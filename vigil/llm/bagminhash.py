"""BagMinHash: signatures of multisets whose registers agree with the probability of the weighted Jaccard similarity.

Every element owns, for each block of weight levels [0,1), [1,2), [2,4), [4,8) ..., a Poisson process whose rate is the
block's length. A point of it has a time, a register, and a level inside the block, all drawn from the element, the block and
the point's number alone. A multiset with count c of the element takes the points whose level is below c, and a register
keeps its earliest point. Two multisets so share a register's point exactly when the earliest of their union lies in their
intersection. Points are drawn in order of time, and a process ends once it is past the latest register of its multiset, so
that a large multiset needs little more than one point an element.
"""

from __future__ import annotations

import numpy as np

from vigil.llm.wordhash import mix


def signatures(owner: np.ndarray, element: np.ndarray, count: np.ndarray, n: int, registers: int) -> np.ndarray:
    """owner: the multiset (0..n-1) of each different element; element: its 64-bit hash; count: its multiplicity. Returns n x registers 64-bit values; those of an empty multiset are 0."""
    size = n * registers
    time, point = np.full(size, np.inf), np.zeros(size, np.uint64)
    if len(owner):
        blocks = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 2))).astype(np.int64) + 1, 1)
        item = np.repeat(np.arange(len(owner)), blocks)
        block = np.arange(len(item)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        length = np.where(block > 0, np.exp2(np.maximum(block - 1, 0)), 1.0)
        low = np.where(block > 0, length, 0.0)
        seed = mix(element[item] ^ mix(block.astype(np.uint64), 21), 22)
        _draw(owner[item], seed, low, length, count[item].astype(np.float64), registers, time, point)
    return point.reshape(n, registers)


def _draw(owner, seed, low, length, count, registers, time, point) -> None:
    n = len(time) // registers
    at, number = np.zeros(len(owner)), 0
    live = np.arange(len(owner))
    while len(live):
        burst = 1 if number < 3 else int(np.clip(200_000 // len(live), 1, 64))
        step = mix(seed[live][:, None] + mix(np.arange(number, number + burst, dtype=np.uint64), 23)[None, :], 24)
        number += burst
        gap = -np.log(((step >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / length[live][:, None]
        when = at[live][:, None] + np.cumsum(gap, axis=1)
        at[live] = when[:, -1]
        place = mix(step, 25)
        register = ((place >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)
        level = low[live][:, None] + (place & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * length[live][:, None]
        slot = owner[live][:, None] * registers + register.astype(np.int64)
        take = (level < count[live][:, None]) & (when < time[slot])
        slot, when, place = slot[take], when[take], place[take]
        order = np.argsort(-when, kind="stable")  # of several points in one register the earliest is written last
        slot, when, place = slot[order], when[order], place[order]
        time[slot] = when
        point[slot] = mix(place, 26) | np.uint64(1)
        latest = time.reshape(n, registers).max(axis=1)
        live = live[at[live] < latest[owner[live]]]


def similarity(a_owner, a_element, b_owner, b_element, n: int) -> np.ndarray:
    """Exact weighted Jaccard similarity of n pairs of multisets; an element is given as often as it occurs. Two empty ones have 0."""
    owner = np.concatenate([a_owner, b_owner])
    element = np.concatenate([a_element, b_element])
    side = np.concatenate([np.ones(len(a_owner), np.int64), np.zeros(len(b_owner), np.int64)])
    order = np.lexsort((element, owner))
    owner, element, side = owner[order], element[order], side[order]
    if not len(owner):
        return np.zeros(n)
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (element[1:] != element[:-1])]))
    ones = np.add.reduceat(side, first)
    zeros = np.diff(np.append(first, len(owner))) - ones
    common = np.bincount(owner[first], np.minimum(ones, zeros), minlength=n)
    either = np.bincount(owner[first], np.maximum(ones, zeros), minlength=n)
    return common / np.maximum(either, 1)
