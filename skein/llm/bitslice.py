"""Hamming links among 64-bit fingerprints by bit-sliced comparison.

Fingerprints are lanes, sorted so that those to be compared stand together. They
are stored vertically: plane b holds bit b of 64 lanes in each word. Comparing
all lanes with those s places on is an XOR of each plane with itself shifted by
s; the differing bits of 64 pairs at once are added by carry-save adders into
vertical counters. After every 8 planes, blocks of 64 pairs that have all passed
the radius are abandoned.
"""

from __future__ import annotations

import numpy as np

#: Blocks of 64 pairs that are compared in one go.
BLOCKS = 8192
ONE, LAST = np.uint64(1), np.uint64(63)


def planes_of(prints: np.ndarray) -> np.ndarray:
    """(64, words) of uint64: bit i of word w of plane b is bit b of fingerprint 64 w + i. Two words of zeros follow."""
    n = len(prints)
    words = -(-n // 64) + 2
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    out = np.zeros((64, words * 8), np.uint8)
    out[:, : -(-n // 8)] = np.packbits(bits.T, axis=1, bitorder="little")
    return out.view("<u8")


def add(a, b, c):
    """A full adder on every bit: sum and carry."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def beyond(ones, twos, fours, eights, radius: int):
    """Where the counter is over ``radius``, 7 at most; ``eights`` is sticky."""
    over, same = eights.copy(), np.full_like(eights, ~np.uint64(0))
    for bit, plane in ((4, fours), (2, twos), (1, ones)):
        if radius & bit:
            same &= plane
        else:
            over |= same & plane
            same &= ~plane
    return over


def compare(planes: np.ndarray, word: np.ndarray, shift: np.ndarray, valid: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For block (word, shift): which lanes are within the radius of the lane ``shift`` on. Blocks that have any, and their lanes."""
    block = np.arange(len(word))
    on, by = word + (shift >> 6), (shift & 63).astype(np.uint64)
    ones, twos, fours, eights = (np.zeros(len(word), np.uint64) for _ in range(4))
    for first in range(0, 64, 8):
        part = planes[first : first + 8]
        there = (part[:, on] >> by) | ((part[:, on + 1] << ONE) << (LAST - by))
        x = part[:, word] ^ there
        ones, a = add(ones, x[0], x[1])
        ones, b = add(ones, x[2], x[3])
        twos, c = add(twos, a, b)
        ones, a = add(ones, x[4], x[5])
        ones, b = add(ones, x[6], x[7])
        twos, d = add(twos, a, b)
        fours, e = add(fours, c, d)
        eights = eights | e
        alive = valid & ~beyond(ones, twos, fours, eights, radius)
        left = np.flatnonzero(alive)
        if not len(left):
            return block[:0], alive[:0]
        if len(left) < len(block):
            block, word, on, by, valid, ones, twos, fours, eights, alive = (v[left] for v in (block, word, on, by, valid, ones, twos, fours, eights, alive))
    return block, alive


class Forest:
    """Disjoint sets of lanes that remember which links joined them."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the links i - j that joined two sets."""
        kept = []
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            high, at = np.unique(high, return_index=True)
            self.root[high] = low[at]
            kept.append((i[at], j[at]))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up
        return (np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])) if kept else (i[:0], j[:0])


def spanning_links(keys: np.ndarray, prints: np.ndarray, radius: int, blocks: int = BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """Lanes i < j of one key within ``radius`` bits: enough of these links to join all lanes that links join.

    ``keys`` are sorted; all pairs of lanes of a key are compared.
    """
    n = len(keys)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.flatnonzero(np.append(keys[1:] != keys[:-1], True))
    sizes = np.diff(np.append(-1, ends))
    rest = np.repeat(ends, sizes) - np.arange(n)  # lanes of the key that follow
    words = -(-n // 64)
    padded = np.zeros(words * 64, np.int64)
    padded[:n] = rest
    padded = padded.reshape(words, 64)
    farthest = padded.max(axis=1)
    planes = planes_of(prints)
    upto = np.cumsum(farthest)
    forest, out = Forest(n), []
    for first in range(0, int(upto[-1]), blocks):
        task = np.arange(first, min(first + blocks, int(upto[-1])))
        word = np.searchsorted(upto, task, side="right")
        shift = task - (upto[word] - farthest[word]) + 1
        valid = np.packbits(padded[word] >= shift[:, None], axis=1, bitorder="little").view("<u8").ravel()
        block, alive = compare(planes, word, shift, valid, radius)
        if len(block):
            lanes = np.unpackbits(alive.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, lane = np.nonzero(lanes)
            i = word[block[at]] * 64 + lane
            out.append(forest.join(i, i + shift[block[at]]))
    return (np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])) if out else (np.empty(0, np.int64), np.empty(0, np.int64))
