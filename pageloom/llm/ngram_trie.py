"""A trigram trie in compact arrays, mapped from files.

A gram shard holds the pairs of words that hash to it. Level 1: sorted 40-bit keys of
the first words, with monotone Elias-Fano pointers into level 2. Level 2: per first
word the sorted 32-bit codes of its successors, the logarithm of each pair's count in 8
bits, and Elias-Fano pointers into level 3. Level 3: per pair the sorted codes of its
successors and the logarithm of each one's share of the smoothed total in 8 bits. A
successor is found by bisection between the two pointers of its context, so a trigram
costs five bytes. A word shard holds sorted 64-bit keys and exact counts.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"PLTRIE02"
HEAD = struct.Struct("<8s7Q4d")
#: Code of the successor that stands for none.
NONE = np.uint32(0)
_SELECT = np.array([[([b for b in range(8) if i >> b & 1] + [0] * 8)[k] for k in range(8)] for i in range(256)], np.uint8)
_B55, _B33, _B0F, _B01, _B80 = (np.uint64(int(x * 8, 16)) for x in ("55", "33", "0f", "01", "80"))


def code(keys: np.ndarray) -> np.ndarray:
    """32 bits of a successor's key, never NONE."""
    return np.maximum((keys >> np.uint64(32)) ^ (keys & np.uint64(0xFFFFFFFF)), np.uint64(1)).astype(np.uint32)


def short(keys: np.ndarray) -> np.ndarray:
    """40 bits of a first word's key."""
    return keys >> np.uint64(24)


class EliasFano:
    """Monotone integers: low bits packed, high bits in unary, with the rank of every 64."""

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, list[np.ndarray]]:
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, int(np.floor(np.log2(max(1, top) / max(1, n)))) if top > n else 0)
        values = values.astype("<u8")
        low = np.unpackbits(values.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :width]
        low = np.concatenate([np.packbits(low.ravel(), bitorder="little"), np.zeros(8, np.uint8)])
        high = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(high[-1]) // 64 + 1) * 64 if n else 64, np.uint8)
        bits[high] = 1
        upper = np.packbits(bits, bitorder="little").view("<u8")
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(upper), dtype=np.int64)[:-1]]).astype("<u4")
        return width, [low, upper, ranks]

    def __init__(self, width: int, low: np.ndarray, upper: np.ndarray, ranks: np.ndarray):
        self.width, self.low, self.upper, self.ranks = width, low, upper, ranks

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ranks, i.astype(np.uint32), "right") - 1
        x = self.upper[word]
        want = (i - self.ranks[word].astype(np.int64)).astype(np.uint64)
        # Ones up to and with each byte, in the bytes of one integer.
        sums = x - ((x >> np.uint64(1)) & _B55)
        sums = (sums & _B33) + ((sums >> np.uint64(2)) & _B33)
        with np.errstate(over="ignore"):
            sums = ((sums + (sums >> np.uint64(4))) & _B0F) * _B01
            byte = np.bitwise_count(((want * _B01 | _B80) - sums) & _B80).astype(np.uint64) * np.uint64(8)
        before = ((sums << np.uint64(8)) >> byte) & np.uint64(0xFF)
        pos = byte.astype(np.int64) + _SELECT[((x >> byte) & np.uint64(0xFF)).astype(np.int64), (want - before).astype(np.int64)]
        value = (word.astype(np.int64) * 64 + pos - i).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            bit = i.astype(np.int64) * self.width
            got = np.zeros(len(i), np.uint64)
            for k in range((self.width + 14) // 8):
                got |= self.low[(bit >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
            value |= (got >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)
        return value.astype(np.int64)


def _quantise(x: np.ndarray) -> tuple[float, float, np.ndarray]:
    lo, hi = (float(x.min()), float(x.max())) if len(x) else (0.0, 0.0)
    step = (hi - lo) / 255 or 1.0
    return lo, step, np.round((x - lo) / step).astype(np.uint8)


def _starts(owner: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(owner, np.arange(n + 1))


def write_grams(out, first: np.ndarray, second: np.ndarray, third: np.ndarray, n: np.ndarray, prior: float) -> None:
    """Rows (short key of the first, code of the second, code of the third or NONE, count) in any order;
    rows of equal grams are summed."""
    keys, a = np.unique(first, return_inverse=True)
    pair, b = np.unique(a.astype(np.uint64) << np.uint64(32) | second, return_inverse=True)
    gram, c = np.unique(b.astype(np.uint64) << np.uint64(32) | third, return_inverse=True)
    count = np.bincount(c, n, len(gram))
    owner = (gram >> np.uint64(32)).astype(np.int64)
    total = np.bincount(owner, count, len(pair))
    some = (gram & np.uint64(0xFFFFFFFF)) != NONE
    owner, count = owner[some], count[some]
    width1, one = EliasFano.encode(_starts((pair >> np.uint64(32)).astype(np.int64), len(keys)))
    width2, two = EliasFano.encode(_starts(owner, len(pair)))
    q2 = _quantise(np.log10(np.maximum(total, 1)))
    q3 = _quantise(np.log10(count / (total[owner] + prior)))
    out.write(HEAD.pack(MAGIC, len(keys), len(pair), len(count), width1, width2, len(one[0]), len(two[0]), *q2[:2], *q3[:2]))
    low32 = np.uint64(0xFFFFFFFF)
    halves = (keys & low32).astype("<u4"), (keys >> np.uint64(32)).astype(np.uint8)
    for x in (halves[0], one[1], two[1], one[2], two[2], (pair & low32).astype("<u4"), (gram[some] & low32).astype("<u4"), one[0], two[0], q2[2], q3[2], halves[1]):
        data = x.tobytes()
        out.write(data + bytes(-len(data) % 8))
    for upper in (one[1], two[1]):
        out.write(struct.pack("<Q", len(upper)))


class Grams:
    def __init__(self, data: np.ndarray):
        magic, n1, n2, n3, width1, width2, low1, low2, self.p0, self.ps, self.g0, self.gs = HEAD.unpack(data[: HEAD.size].tobytes())
        if magic != MAGIC:
            raise ValueError("not a trie file")
        up1, up2 = data[-16:].view("<u8").tolist()
        at, got = HEAD.size, []
        for kind, count in (("<u4", n1), ("<u8", up1), ("<u8", up2), ("<u4", up1), ("<u4", up2), ("<u4", n2), ("<u4", n3), ("u1", low1), ("u1", low2), ("u1", n2), ("u1", n3), ("u1", n1)):
            size = np.dtype(kind).itemsize * count
            got.append(data[at : at + size].view(kind))
            at += size + -size % 8
        self.keys = got[0] | got[11].astype(np.uint64) << np.uint64(32)
        self.second, self.third, self.pair, self.gram = got[5], got[6], got[9], got[10]
        self.one, self.two = EliasFano(width1, got[7], got[1], got[3]), EliasFano(width2, got[8], got[2], got[4])

    def pairs(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place (or -1) of each pair (key, code) and its count (0 where unseen)."""
        place, count = np.full(len(first), -1), np.zeros(len(first))
        if len(self.keys):
            first = short(first)
            at = np.minimum(np.searchsorted(self.keys, first), len(self.keys) - 1)
            here = np.flatnonzero(self.keys[at] == first)
            found = _find(self.second, self.one[at[here]], self.one[at[here] + 1], second[here])
            place[here] = found
            ok = found >= 0
            count[here[ok]] = 10 ** (self.p0 + self.ps * self.pair[found[ok]])
        return place, count

    def shares(self, place: np.ndarray, third: np.ndarray) -> np.ndarray:
        """Share, of its context's smoothed total, of each successor of the pairs at
        ``place``; 0 where unseen."""
        out = np.zeros(len(place))
        found = _find(self.third, self.two[place], self.two[place + 1], third)
        ok = found >= 0
        out[ok] = 10 ** (self.g0 + self.gs * self.gram[found[ok]])
        return out


def _find(codes: np.ndarray, lo: np.ndarray, end: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Places of ``want`` in the sorted runs codes[lo:end], or -1."""
    lo, hi = lo.copy(), end.copy()
    live = np.flatnonzero(lo < hi)
    while len(live):
        a, b = lo[live], hi[live]
        mid = (a + b) >> 1
        less = codes[mid] < want[live]
        lo[live], hi[live] = np.where(less, mid + 1, a), np.where(less, b, mid)
        live = live[lo[live] < hi[live]]
    out = np.full(len(lo), -1)
    ok = np.flatnonzero(lo < end)
    ok = ok[codes[lo[ok]] == want[ok]]
    out[ok] = lo[ok]
    return out
