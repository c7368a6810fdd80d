"""Recompression: a run-length grammar of many sequences at once, and longest common extensions on it.

Block compression (equal neighbours become one symbol) and pair compression (a symbol of one half of the alphabet and a
following one of the other half become one symbol) alternate until every sequence has a few symbols. Names depend on what
they stand for only, so equal stretches are cut alike but for their ends. A query climbs from level to level while both
places start a symbol, takes at most one step a level to get there, and at the first difference goes down again; all
queries of an array move together. Barriers lie around the sequences; each is a symbol of its own and is never joined.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FLAT = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)  # 2^64 divided by the golden ratio


@dataclass
class Level:
    """Symbols of one level, and how they hang together with the level above (set once that exists)."""

    symbols: np.ndarray
    barrier: np.ndarray
    parent: np.ndarray | None = None
    blocks: bool = False
    low: np.ndarray | None = None  # first and last child of every symbol of the level above
    high: np.ndarray | None = None


def _coins(symbols: np.ndarray, turn: int) -> np.ndarray:
    x = (symbols.astype(np.uint64) + np.uint64(1)) * _MIX + np.uint64(turn * 0xD1342543DE82EF95 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(32)) * _MIX
    return (x >> np.uint64(47) & np.uint64(1)).astype(bool)


class Grammar:
    """Levels over ``symbols`` (whole numbers from 0), where ``barrier`` marks those that part the sequences."""

    def __init__(self, symbols: np.ndarray, barrier: np.ndarray):
        at = np.flatnonzero(barrier)
        names = int(symbols.max(initial=0)) + 1
        symbols = symbols.astype(np.int64)
        symbols[at] = names + np.arange(len(at))
        self.levels = [Level(symbols, barrier)]
        self.names, turn = names + len(at), 0
        while np.diff(np.flatnonzero(self.levels[-1].barrier)).max(initial=0) > FLAT + 1:
            self._blocks()
            self._pairs(turn)
            turn += 1

    def _add(self, head: np.ndarray, joined: np.ndarray, key: np.ndarray, blocks: bool) -> None:
        """A level above: its symbols start at ``head``; those that are ``joined`` are named by ``key``."""
        below = self.levels[-1]
        if not joined.any():
            return
        low = np.flatnonzero(head)
        symbols = below.symbols[low]
        kinds, which = np.unique(key, return_inverse=True)
        symbols[joined] = self.names + which
        self.names += len(kinds)
        below.parent, below.blocks, below.low = np.cumsum(head) - 1, blocks, low
        below.high = np.append(low[1:], len(head)) - 1
        self.levels.append(Level(symbols, below.barrier[low]))

    def _blocks(self) -> None:
        s = self.levels[-1].symbols
        head = np.append(True, s[1:] != s[:-1])
        low = np.flatnonzero(head)
        size = np.diff(np.append(low, len(s)))
        joined = size > 1
        self._add(head, joined, s[low[joined]] * (len(s) + 1) + size[joined], True)

    def _pairs(self, turn: int) -> None:
        s, open_ = self.levels[-1].symbols, ~self.levels[-1].barrier
        coin = _coins(s, turn)
        left, right = coin & open_, ~coin & open_
        ways = [left[:-1] & right[1:], right[:-1] & left[1:]]
        first = max(ways, key=np.count_nonzero)
        head = np.append(True, ~first)
        at = np.flatnonzero(first)
        joined = np.append(first, False)[head]
        self._add(head, joined, s[at] * self.names + s[at + 1], False)

    def extend(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """How many symbols agree from places ``a`` < ``b`` on, or up to and with them if ``back``."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        step, origin = -1 if back else 1, a.copy()
        stopped = np.full(len(a), -1)
        active = np.arange(len(a))
        for h, level in enumerate(self.levels[:-1]):
            s, edge = level.symbols, level.low if not back else level.high
            x, y = a[active], b[active]
            px, py = level.parent[x], level.parent[y]
            inside = (edge[px] != x) | (edge[py] != y)
            same = s[x] == s[y]
            go = inside & same
            if level.blocks:
                rest = (level.high[px] - x, level.high[py] - y) if not back else (x - level.low[px], y - level.low[py])
                move = np.where(go, np.minimum(*rest) + 1, 0)
                halt = inside & (~same | (rest[0] != rest[1]))
            else:
                move, halt = go.astype(np.int64), inside & ~same
            x, y = x + step * move, y + step * move
            up = ~halt
            a[active], b[active] = np.where(up, level.parent[x], x), np.where(up, level.parent[y], y)
            stopped[active[halt]] = h
            active = active[up]
        top = len(self.levels) - 1
        stopped[active] = top
        s = self.levels[-1].symbols
        while len(active := active[s[a[active]] == s[b[active]]]):
            a[active] += step
            b[active] += step
        for h in range(top - 1, -1, -1):
            level, down = self.levels[h], np.flatnonzero(stopped > h)
            edge, other = (level.low, level.high) if not back else (level.high, level.low)
            pa, pb = a[down], b[down]
            x, y = edge[pa], edge[pb]
            size = np.minimum(abs(other[pa] - x), abs(other[pb] - y)) + 1
            # what the two symbols share: the shorter of two blocks of one kind, or the first of a pair
            move = np.where(level.symbols[x] == level.symbols[y], size if level.blocks else 1, 0)
            a[down], b[down] = x + step * move, y + step * move
        return abs(a - origin)
