"""Signature trees: all pairs of sets that may reach a Jaccard similarity, by dual traversal.

A set's signature is a bitmap in which each member sets the bit of its hash. A node of the tree holds the bits that
any of its sets has (OR) and that all have (AND), and the range of their sizes. For sets x below A and y below B,
``|x & y| <= |x| - bits(AND_A & ~OR_B)``, so a pair of nodes whose largest possible overlap is too small for any of
its sizes is dropped with all below it, and so is a pair whose sets are all known to be linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SMALLEST, LARGEST, FAN, CHUNK = 6, 16, 8, 1 << 14


def width(n: int) -> int:
    """Bits of the signature of a set of ``n``, as a power of two."""
    return min(max(int(2 * n - 1).bit_length(), SMALLEST), LARGEST)


def signature(members: np.ndarray) -> bytes:
    bits = np.zeros(1 << width(len(members)), np.uint8)
    bits[(members >> np.uint64(40)).astype(np.int64) & (len(bits) - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(words: np.ndarray, power: int) -> np.ndarray:
    """Signatures (rows of 64-bit words) at a smaller width: bit i goes to bit i modulo the width."""
    n = (1 << power) // 64
    out = words[:, :n].copy()
    for at in range(n, words.shape[1], n):
        out |= words[:, at : at + n]
    return out


class Tree:
    """Levels of nodes over sets sorted by size; level 0 holds the sets themselves."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        self.levels = [(words, words, sizes, sizes, labels, labels)]
        while len(self.levels[-1][0]) > FAN:
            either, every, low, high, first, last = self.levels[-1]
            at = np.arange(0, len(either), FAN)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(either, at, axis=0),
                    np.bitwise_and.reduceat(every, at, axis=0),
                    np.minimum.reduceat(low, at),
                    np.maximum.reduceat(high, at),
                    np.minimum.reduceat(first, at),
                    np.maximum.reduceat(last, at),
                )
            )


def _possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), CHUNK):
        x, y = i[at : at + CHUNK], j[at : at + CHUNK]
        ok = (100 * a[3][x] >= percent * b[2][y]) & (100 * b[3][y] >= percent * a[2][x])
        ok &= ~((a[4][x] == a[5][x]) & (b[4][y] == b[5][y]) & (a[4][x] == b[4][y]))
        x, y, keep = x[ok], y[ok], np.flatnonzero(ok)
        lost_a = np.bitwise_count(a[1][x] & ~b[0][y]).sum(axis=1, dtype=np.int64)
        lost_b = np.bitwise_count(b[1][y] & ~a[0][x]).sum(axis=1, dtype=np.int64)
        overlap = np.minimum(a[3][x] - lost_a, b[3][y] - lost_b)
        out[at + keep[(100 + percent) * overlap >= percent * (a[2][x] + b[2][y])]] = True
    return out


def _traverse(a: Tree, b: Tree, same: bool, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    top = min(len(a.levels), len(b.levels)) - 1
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a.levels[top][0])), np.arange(len(b.levels[top][0])), indexing="ij"))
    work = [(top, i, j)]
    while work:
        level, i, j = work.pop()
        if same:
            i, j = i[i <= j], j[i <= j]
        if level == 0 and same:
            i, j = i[i < j], j[i < j]
        ok = _possible(a.levels[level], b.levels[level], i, j, percent)
        i, j = i[ok], j[ok]
        if not level:
            if len(i):
                yield i, j
            continue
        na, nb = len(a.levels[level - 1][0]), len(b.levels[level - 1][0])
        for at in range(0, len(i), 4 * CHUNK // FAN**2):
            x, y = i[at : at + 4 * CHUNK // FAN**2], j[at : at + 4 * CHUNK // FAN**2]
            x = (x[:, None, None] * FAN + np.arange(FAN)[None, :, None] + np.zeros((1, 1, FAN), np.int64)).ravel()
            y = (y[:, None, None] * FAN + np.arange(FAN)[None, None, :] + np.zeros((1, FAN, 1), np.int64)).ravel()
            ok = (x < na) & (y < nb)
            work.append((level - 1, x[ok], y[ok]))


def candidates(sizes: np.ndarray, signatures: list[bytes], labels: np.ndarray, percent: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of every two sets with different labels whose Jaccard similarity may reach ``percent``."""
    powers = np.array([width(int(n)) for n in sizes])
    trees: dict[tuple[int, int], tuple[np.ndarray, Tree]] = {}

    def tree(power: int, at: int) -> tuple[np.ndarray, Tree] | None:
        """Of the sets whose own width is ``power``, at width ``at``."""
        if (power, at) not in trees:
            own = np.flatnonzero(powers == power)
            if not len(own):
                return None
            own = own[np.argsort(sizes[own], kind="stable")]
            words = np.stack([np.frombuffer(signatures[x], np.uint64) for x in own])
            trees[power, at] = own, Tree(folded(words, at), sizes[own].astype(np.int64), labels[own])
        return trees[power, at]

    left, right = [], []
    for power in np.unique(powers).tolist():
        own = tree(power, power)
        for i, j in _traverse(own[1], own[1], True, percent):
            left.append(own[0][i])
            right.append(own[0][j])
        for wider in range(power + 1, power + (100 // percent).bit_length() + 2):  # sizes up to 100 / percent times as large
            if other := tree(wider, power):
                for i, j in _traverse(own[1], other[1], False, percent):
                    left.append(own[0][i])
                    right.append(other[0][j])
    none = np.zeros(0, np.int64)
    i, j = (np.concatenate(x) if x else none for x in (left, right))
    apart = labels[i] != labels[j]
    return i[apart], j[apart]
