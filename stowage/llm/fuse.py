"""Static 3-wise binary fuse filters over 64-bit keys, built and probed with numpy arrays.

A filter holds 8 bits per slot and about 1.13 slots per key. A key owns three slots in three
consecutive segments; the exclusive or of the three equals the key's check byte. A key that was
put in is always found; another one is found with a chance of 1 in 256.
"""

from __future__ import annotations

import math

import numpy as np

_U = np.uint64
_ODD = (_U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53))


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + _U(seed * 0x9E3779B97F4A7C15 % 2**64)
    for odd in _ODD:
        h = (h ^ (h >> _U(33))) * odd
    return h ^ (h >> _U(33))


def _slots(keys: np.ndarray, seed: int, length: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots per key (one row each) and the check bytes."""
    h = _mixed(keys, seed)
    first = ((h >> _U(32)) * _U(segments) >> _U(32)).astype("i8") * length
    g = _mixed(h, seed + 1)
    within = np.stack([(g >> _U(shift)).astype("i8") & (length - 1) for shift in (0, 20, 40)])
    return first + within + np.array([[0], [length], [2 * length]]), (h & _U(255)).astype("u1")


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, slot that only this key still uses); None if some keys never come free."""
    n = slots.shape[1]
    count = np.zeros(size, "i8")
    owners = np.zeros(size, "i8")  # exclusive or of the keys that use a slot
    index = np.arange(n)
    for row in slots:
        np.add.at(count, row, 1)
        np.bitwise_xor.at(owners, row, index)
    left, rounds = n, []
    free = np.flatnonzero(count == 1)
    while free.size:
        keys, place = np.unique(owners[free], return_index=True)
        rounds.append((keys, free[place]))
        left -= keys.size
        touched = slots[:, keys]
        for row in touched:
            np.subtract.at(count, row, 1)
            np.bitwise_xor.at(owners, row, keys)
        near = np.unique(touched)
        free = near[count[near] == 1]
    return rounds if left == 0 else None


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, slots) of a filter of the distinct `keys`."""
    keys = np.unique(keys.astype(_U))
    n = max(keys.size, 2)
    length = min(1 << 18, 1 << max(2, int(math.log(n) / math.log(3.33) + 2.25)))
    room = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    segments = max(1, math.ceil(room / length) - 2)
    size = (segments + 2) * length
    for seed in range(1, 1000):
        slots, check = _slots(keys, seed, length, segments)
        rounds = _peel(slots, size)
        if rounds is None:
            if seed % 20 == 0:  # not met at the usual load; more room always ends it
                segments += segments // 4 + 1
                size = (segments + 2) * length
            continue
        table = np.zeros(size, "u1")
        for freed, own in reversed(rounds):
            a, b, c = slots[:, freed]
            table[own] = check[freed] ^ table[a] ^ table[b] ^ table[c] ^ table[own]
        return seed, length, segments, table.tobytes()
    raise ValueError("no filter found")


def contains(keys: np.ndarray, seed: int, length: int, segments: int, table: bytes) -> np.ndarray:
    slots, check = _slots(keys.astype(_U), seed, length, segments)
    held = np.frombuffer(table, "u1")
    return (held[slots[0]] ^ held[slots[1]] ^ held[slots[2]]) == check
