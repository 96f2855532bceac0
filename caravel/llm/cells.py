"""Vectors that lie close together, found in memory: splits by projection and the search within one cell.

A split has some vectors of the data as pivots; a vector belongs to the pivot it projects on furthest. How far it
is from the boundary to another pivot decides whether it is held there too.
"""

from __future__ import annotations

import numpy as np

from caravel.llm.components import roots

ROWS, COLUMNS, PAIRS = 512, 8192, 1 << 17
SPARSE = 32
LEAST_PIVOTS, MOST_PIVOTS, MEMBERS = 8, 512, 256
INNER = 1.6  # margin of the split within a cell: a vector is kept at one pivot and looked for at several
WORTH = 0.25  # a split whose vectors are looked for in more than this part of a cell saves too little
EDGES = 1 << 20


def units_of(flat: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision."""
    flat = flat.astype(np.float64)
    flat /= np.abs(flat).max(axis=1, keepdims=True)  # no overflow of the squares
    return flat / np.sqrt(np.einsum("ij,ij->i", flat, flat))[:, None]


def apart(vectors: np.ndarray, least: float, most: int) -> np.ndarray:
    """Some of the vectors, in their order, no two of them linked: a dense group gets one pivot."""
    near = vectors @ vectors.T >= least
    kept: list[int] = []
    free = np.ones(len(vectors), bool)
    for i in range(len(vectors)):
        if free[i]:
            kept.append(i)
            free &= ~near[i]
            if len(kept) == most:
                break
    return vectors[kept]


def share(pivots: np.ndarray) -> float:
    """Part of a squared distance that lies along one direction between pivots: 1 / size if all directions are alike, more if few matter."""
    k, size = pivots.shape
    if k < 2:
        return 1 / size
    away = pivots - pivots.mean(axis=0)
    spread = away @ away.T if k < size else away.T @ away
    found = float((spread.astype(np.float64) ** 2).sum()) / max(float(np.trace(spread)) ** 2, 1e-300)
    return min(max(found - 1 / (k - 1), 1 / size), 1.0)


def margins(pivots: np.ndarray, least: float, spill: float) -> np.ndarray:
    """By how much a projection may fall short of the furthest one; linked vectors lie sqrt(2 - 2 least) apart at most."""
    overlap = spill * np.sqrt(max(2 - 2 * least, 0) * share(pivots))
    return (overlap * np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))).astype(np.float32)


def held(vectors: np.ndarray, pivots: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pivot of each vector, and all pivots that it is held at."""
    along = vectors @ pivots.T
    home = along.argmax(axis=1)
    furthest = along[np.arange(len(along)), home]
    at = along >= furthest[:, None] - within[home]
    at[np.arange(len(along)), home] = True
    return home, at


class Cell:
    """Links within a cell: ``degree`` (with multiplicity ``count``) and ``label`` (an index that linked members share).

    ``homes`` are the cells that each member is in, padded with the largest number. A pair counts in the first
    cell that both are in, and with ``block`` only if the blocks differ.
    """

    def __init__(self, flat: np.ndarray, count: np.ndarray, homes: np.ndarray, cell: int, least: float, block: np.ndarray | None = None):
        self.flat, self.count, self.block, self.least = flat, count, block, least
        self.units = np.empty(flat.shape, np.float32)
        for at in range(0, len(flat), COLUMNS):
            self.units[at : at + COLUMNS] = units_of(flat[at : at + COLUMNS])
        self.slack = 4 * np.finfo(np.float32).eps * (flat.shape[1] + 8)
        self.plain = bool((count == 1).all())
        self.degree = np.zeros(len(flat), np.int64)
        self.label = np.arange(len(flat))
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self.early = self._bits(homes, cell)
        self.kind = None

    @staticmethod
    def _bits(homes: np.ndarray, cell: int) -> np.ndarray | None:
        """A bit for each earlier cell that a member is in."""
        row, column = np.nonzero(homes < cell)
        if not len(row):
            return None
        known, number = np.unique(homes[row, column], return_inverse=True)
        bits = np.zeros((len(homes), (len(known) + 63) // 64), np.uint64)
        np.bitwise_or.at(bits, (row, number >> 6), np.uint64(1) << (number & 63).astype(np.uint64))
        return bits

    def search(self) -> Cell:
        n = len(self.flat)
        self.home, self.at = np.zeros(n, np.int32), np.zeros((n, 1), np.uint8)
        if n // MEMBERS >= LEAST_PIVOTS:
            self._split(min(n // MEMBERS, MOST_PIVOTS))
        order = np.argsort(self.home, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(self.home[order])) + 1, n)
        for start, end in zip(np.append(0, ends[:-1]), ends) if n else []:
            kept = order[start:end]
            there = self.units[kept]
            for at in range(0, len(kept), ROWS):
                for low in range(at, len(kept), COLUMNS):
                    self._meet(kept[at : at + ROWS], kept[low : low + COLUMNS], there[low : low + COLUMNS], low == at, True)
            leaf = int(self.home[kept[0]])
            also = np.flatnonzero((self.at[:, leaf >> 3] >> (7 - (leaf & 7)) & 1).astype(bool) & (self.home != leaf))
            for at in range(0, len(also), ROWS):
                for low in range(0, len(kept), COLUMNS):
                    self._meet(also[at : at + ROWS], kept[low : low + COLUMNS], there[low : low + COLUMNS], False, False)
        self._join()
        return self

    def _split(self, wanted: int) -> None:
        n, random = len(self.units), np.random.default_rng([7, len(self.units)])
        pivots = apart(self.units[random.choice(n, min(n, 2 * wanted), replace=False)], self.least, wanted)
        if len(pivots) < LEAST_PIVOTS:
            return
        within = margins(pivots, self.least, INNER)
        if held(self.units[random.choice(n, min(n, 2048), replace=False)], pivots, within)[1].mean() > WORTH:
            return
        self.at = np.empty((n, (len(pivots) + 7) // 8), np.uint8)
        for at in range(0, n, COLUMNS):
            self.home[at : at + COLUMNS], there = held(self.units[at : at + COLUMNS], pivots, within)
            self.at[at : at + COLUMNS] = np.packbits(there, axis=1)

    def _looks(self, members: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Whether the members are looked for at these pivots."""
        return (self.at[members, home >> 3] >> (7 - (home & 7)) & 1).astype(bool)

    def _exact(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), bool)
        for at in range(0, len(a), PAIRS):
            left, right = (units_of(self.flat[x[at : at + PAIRS]]) for x in (a, b))
            out[at : at + PAIRS] = np.einsum("ij,ij->i", left, right) >= self.least
        return out

    def _meet(self, i: np.ndarray, j: np.ndarray, there: np.ndarray, same: bool, inside: bool) -> None:
        """Compare members i with members j, kept at one pivot. ``same``: j begins with i. ``inside``: i are kept there too."""
        along = self.units[i] @ there.T
        hit = along >= self.least - self.slack
        if same:
            hit[:, : len(i)] &= ~np.tri(len(i), dtype=bool)
        flat = hit.reshape(-1)
        whole = flat[: len(flat) & ~7].view(np.uint64)
        full = np.flatnonzero(whole)
        if not len(full) and not flat[len(flat) & ~7 :].any():
            return
        if len(full) * SPARSE < len(whole):
            places = np.append((full[:, None] * 8 + np.arange(8)).reshape(-1), np.arange(len(flat) & ~7, len(flat)))
            places = places[flat[places]]
            for at in range(0, len(places), PAIRS):
                some = places[at : at + PAIRS]
                self._few(i[some // len(j)], j[some % len(j)], along.reshape(-1)[some], inside)
        else:
            self._many(i, j, along, hit, inside)

    def _few(self, a: np.ndarray, b: np.ndarray, along: np.ndarray, inside: bool) -> None:
        keep = np.ones(len(a), bool)
        if not inside:  # the pair is met at the pivot of a as well
            keep &= (a < b) | ~self._looks(b, self.home[a])
        if self.block is not None:
            keep &= self.block[a] != self.block[b]
        if self.early is not None:
            keep &= ~(self.early[a] & self.early[b]).any(axis=1)
        unsure = np.flatnonzero(keep & (along < self.least + self.slack))
        keep[unsure] = self._exact(a[unsure], b[unsure])
        a, b = a[keep], b[keep]
        np.add.at(self.degree, a, self.count[b])
        np.add.at(self.degree, b, self.count[a])
        self.edges.append((a, b))
        self.waiting += len(a)
        if self.waiting > EDGES:
            self._join()

    def _many(self, i: np.ndarray, j: np.ndarray, along: np.ndarray, hit: np.ndarray, inside: bool) -> None:
        if not inside:
            for home in np.unique(self.home[i]):
                rows = np.flatnonzero(self.home[i] == home)
                met = self._looks(j, np.full(len(j), home))
                hit[rows] &= ~met | (i[rows][:, None] < j)
        if self.block is not None:
            hit &= self.block[i][:, None] != self.block[j]
        if self.early is not None:
            if self.kind is None:
                self.kinds, self.kind = np.unique(self.early, axis=0, return_inverse=True)
                self.kind = self.kind.reshape(-1)
            (mine, of_i), (other, of_j) = (np.unique(self.kind[x], return_inverse=True) for x in (i, j))
            first = np.ones((len(mine), len(other)), bool)
            for word in range(self.kinds.shape[1]):
                first &= (self.kinds[mine, word][:, None] & self.kinds[other, word]) == 0
            if not first.all():
                hit &= first[of_i][:, of_j]
        row, column = np.nonzero(hit & (along < self.least + self.slack))
        hit[row, column] = self._exact(i[row], j[column])
        if self.plain:
            self.degree[i] += np.count_nonzero(hit, axis=1)
            self.degree[j] += np.count_nonzero(hit, axis=0)
        else:
            exactly = hit.astype(np.float64)
            self.degree[i] += (exactly @ self.count[j].astype(np.float64)).astype(np.int64)
            self.degree[j] += (self.count[i].astype(np.float64) @ exactly).astype(np.int64)
        while True:  # each row and each column is joined with the first one it is not yet joined with
            new = hit & (self.label[i][:, None] != self.label[j])
            rows, columns = np.flatnonzero(new.any(axis=1)), np.flatnonzero(new.any(axis=0))
            if not len(rows):
                break
            self.edges += [(i[rows], j[new[rows].argmax(axis=1)]), (i[new[:, columns].argmax(axis=0)], j[columns])]
            self._join()

    def _join(self) -> None:
        if self.edges:
            a, b = (self.label[np.concatenate(x)] for x in zip(*self.edges))
            nodes, root = roots(a, b)
            now = np.arange(len(self.label))
            now[nodes] = root
            self.label = now[self.label]
        self.edges, self.waiting = [], 0
