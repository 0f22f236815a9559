"""Greedy pair merging, shared by the tokenisers: of all adjacent pairs that the
vocabulary knows, the one of least rank is merged first, the leftmost on ties."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Hashable, Mapping, Sequence

import numpy as np

#: Pieces of more parts than this are merged with a heap instead of repeated scans.
SCAN = 48


INF = float("inf")


def merge(parts: Sequence[Hashable], ranks: Mapping) -> list:
    """The parts after all merges; ``ranks`` has the joined pairs that may merge."""
    return _by_scan(list(parts), ranks.get) if len(parts) <= SCAN else _by_heap(list(parts), ranks.get)


def _by_scan(parts: list, rank: Callable) -> list:
    ranks = [rank(a + b, INF) for a, b in zip(parts, parts[1:])]  # noqa: B905
    while ranks and (best := min(ranks)) < INF:
        at = ranks.index(best)
        parts[at] += parts.pop(at + 1)
        del ranks[at]
        if at < len(ranks):
            ranks[at] = rank(parts[at] + parts[at + 1], INF)
        if at:
            ranks[at - 1] = rank(parts[at - 1] + parts[at], INF)
    return parts


def _by_heap(parts: list, rank: Callable) -> list:
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[float, int, Hashable]] = []

    def offer(k: int) -> None:
        if 0 <= k and after[k] < n:
            pair = parts[k] + parts[after[k]]
            r = rank(pair)
            if r is not None:
                heapq.heappush(heap, (r, k, pair))

    for k in range(n - 1):
        offer(k)
    while heap:
        _, k, pair = heapq.heappop(heap)
        if parts[k] is None or after[k] >= n or parts[k] + parts[after[k]] != pair:
            continue
        gone = after[k]
        parts[k], parts[gone] = pair, None
        after[k] = after[gone]
        if after[k] < n:
            before[after[k]] = k
        offer(k)
        offer(before[k])
    return [p for p in parts if p is not None]


class PairMerger:
    """Pair merging of many byte strings side by side, over arrays of ids.

    The vocabulary gives a table of id pairs that may merge: all splits of a token into two tokens. In each round
    every string merges its pair of least rank, the leftmost on ties; strings that are done leave the arrays. Strings
    of more than LONG bytes, which would take as many rounds, are merged one by one with a heap.
    """

    LONG = 48
    _NONE = np.iinfo(np.int64).max

    def __init__(self, ranks: Mapping[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        found = [(ranks[t[:k]] << 32 | ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        # A last entry that no pair has, so that a search always ends on one.
        self.keys, self.values = np.append(pairs[:, 0], self._NONE), np.append(pairs[:, 1], self._NONE)

    def _of_pairs(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that start at places ``at``."""
        key = ids[at] << 32 | ids[at + 1]
        found = np.searchsorted(self.keys, key)
        return np.where(self.keys[found] == key, self.values[found], self._NONE)

    def merge(self, pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces end to end, ids of each piece)."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        done_ids, done_own = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in np.flatnonzero(sizes > self.LONG).tolist():
            parts = merge([pieces[k][i : i + 1] for i in range(len(pieces[k]))], self.ranks)
            done_ids.append(np.array([self.ranks[p] for p in parts], np.int64))
            done_own.append(np.full(len(parts), k))
        short = np.flatnonzero(sizes <= self.LONG)
        ids = self.single[np.frombuffer(b"".join(pieces[k] for k in short.tolist()), np.uint8)]
        own = np.repeat(short, sizes[short])
        rank = np.full(len(ids), self._NONE)
        inner = np.flatnonzero(own[:-1] == own[1:])
        rank[inner] = self._of_pairs(ids, inner)
        while len(ids):
            first = np.flatnonzero(np.diff(own, prepend=-1))
            least = np.minimum.reduceat(rank, first)
            counts = np.diff(np.append(first, len(own)))
            open_ = np.repeat(least < self._NONE, counts)
            if not open_.all():
                done_ids.append(ids[~open_])
                done_own.append(own[~open_])
                ids, own, rank = ids[open_], own[open_], rank[open_]
                some = least < self._NONE
                least, counts = least[some], counts[some]
                if not len(ids):
                    break
            hits = np.flatnonzero(rank == np.repeat(least, counts))
            at = hits[np.flatnonzero(np.diff(own[hits], prepend=-1))]
            ids[at] = rank[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, own, rank = ids[keep], own[keep], rank[keep]
            at -= np.arange(len(at))
            rank[at] = self._NONE
            for near in (at, at - 1):
                inside = near[(near >= 0) & (near + 1 < len(own))]
                inside = inside[own[inside] == own[inside + 1]]
                rank[inside] = self._of_pairs(ids, inside)
        ids, own = np.concatenate(done_ids), np.concatenate(done_own)
        return ids[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(pieces))
