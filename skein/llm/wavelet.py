"""Wavelet matrix: a sequence of integers as bit-planes with rank and select, in one compressed file.

Plane 0 holds the highest bits in sequence order; each further plane holds the next bits after a stable sort by
the bits above it (zeros first). Every plane has the number of ones before each block of 512 bits, so that rank
is a table entry and a few popcounts. Planes, tables and the documents' table are zstd frames of one file with a
footer that says where each of them is.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import zstandard

MAGIC = b"SKWAVE01"
#: 64-bit words of a rank block.
BLOCK = 8
#: Values sorted at once, few enough for a processor's cache; a multiple of 8.
STEP = 1 << 18


class WaveletMatrix:
    def __init__(self, n: int, bits: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.bits, self.zeros, self.planes, self.ranks = n, bits, zeros, planes, ranks

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        """Of values from 0 to 2 ** bits - 1."""
        now = values.astype(np.uint16 if bits <= 16 else np.uint32)
        after, zeros, planes, ranks = np.empty_like(now), [], [], []
        words = -(-len(now) // 64)
        words += -words % BLOCK
        for p in reversed(range(bits)):
            mask, packed = now.dtype.type(1 << p), np.zeros(words * 8, np.uint8)
            for k in range(0, len(now), STEP):
                packed[k // 8 : -(-min(k + STEP, len(now)) // 8)] = np.packbits((now[k : k + STEP] & mask).astype(bool), bitorder="little")
            plane = packed.view("<u8")
            ones = np.bitwise_count(plane).reshape(-1, BLOCK).sum(1, dtype=np.int64)
            planes.append(plane)
            ranks.append(np.concatenate(([0], np.cumsum(ones))).astype("<i8"))
            zero, one = 0, len(now) - int(ranks[-1][-1])
            zeros.append(one)
            for k in range(0, len(now), STEP):
                part = now[k : k + STEP]
                bit = (part & mask).astype(bool)
                n = int(np.count_nonzero(bit))
                np.compress(bit, part, out=after[one : one + n])
                np.compress(~bit, part, out=after[zero : zero + len(part) - n])
                one, zero = one + n, zero + len(part) - n
            now, after = after, now
        return cls(len(values), bits, zeros, planes, ranks)

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i >> 6]) >> (i & 63) & 1

    def rank1(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        word, block = i >> 6, i >> 9
        ones = int(self.ranks[k][block]) + sum(int(w).bit_count() for w in self.planes[k][block * BLOCK : word])
        return ones + (int(self.planes[k][word]) & ((1 << (i & 63)) - 1)).bit_count() if i & 63 else ones

    def _select(self, k: int, one: int, nth: int) -> int:
        """Position of the nth (from 0) one, or zero, of plane k."""
        low, high = 0, self.n
        while low < high:  # the least i with more than nth such bits among the first i + 1
            mid = (low + high) // 2
            ones = self.rank1(k, mid + 1)
            low, high = (low, mid) if (ones if one else mid + 1 - ones) > nth else (mid + 1, high)
        return low

    def access(self, i: int) -> int:
        """The value at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.bits):
            one, ones = self._bit(k, i), self.rank1(k, i)
            value = value << 1 | one
            i = self.zeros[k] + ones if one else i - ones
        return value

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        for k in range(self.bits):
            a, b = self.rank1(k, start), self.rank1(k, end)
            if value >> (self.bits - 1 - k) & 1:
                start, end = self.zeros[k] + a, self.zeros[k] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of the value from start to end (exclusive)."""
        if value >> self.bits:
            return 0
        a, b = self._range(value, start, self.n if end is None else end)
        return b - a

    def occurrences(self, value: int, start: int = 0, end: int | None = None, most: int | None = None) -> list[int]:
        """Positions of the value from start to end (exclusive), ascending; the first `most` of them."""
        if value >> self.bits:
            return []
        first, last = self._range(value, start, self.n if end is None else end)
        found = []
        for i in range(first, last if most is None else min(last, first + most)):
            for k in reversed(range(self.bits)):
                one = value >> (self.bits - 1 - k) & 1
                i = self._select(k, one, i - self.zeros[k] if one else i)
            found.append(i)
        return found

    def values(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        now = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        before = np.empty_like(now)
        for k in reversed(range(self.bits)):
            mask, zero, one = now.dtype.type(1 << (self.bits - 1 - k)), 0, self.zeros[k]
            packed = self.planes[k].view(np.uint8)
            for at in range(0, self.n, STEP):
                part = before[at : at + STEP]
                bit = np.unpackbits(packed[at // 8 : (at + STEP) // 8], count=len(part), bitorder="little").astype(bool)
                n = int(np.count_nonzero(bit))
                part[~bit] = now[zero : zero + len(part) - n]
                part[bit] = now[one : one + n] | mask
                one, zero = one + n, zero + len(part) - n
            now, before = before, now
        return now

    def to_bytes(self, **sections: bytes) -> bytes:
        """The file: magic, zstd frames of planes, rank tables and further sections, footer, its length, magic."""
        zstd, out, at = zstandard.ZstdCompressor(level=1), [MAGIC], len(MAGIC)
        where = {}
        named = [(f"plane{k}", p.tobytes()) for k, p in enumerate(self.planes)] + [(f"rank{k}", r.tobytes()) for k, r in enumerate(self.ranks)]
        for name, data in [*named, *sections.items()]:
            frame = zstd.compress(data)
            where[name] = [at, len(frame)]
            out.append(frame)
            at += len(frame)
        footer = json.dumps({"n": self.n, "bits": self.bits, "zeros": self.zeros, "sections": where}).encode()
        return b"".join([*out, footer, struct.pack("<I", len(footer)), MAGIC])

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[WaveletMatrix, dict[str, bytes]]:
        """The matrix and the further sections of a file."""
        if data[:8] != MAGIC or data[-8:] != MAGIC:
            raise ValueError("not a wavelet file, or cut short")
        (size,) = struct.unpack("<I", data[-12:-8])
        footer, zstd = json.loads(data[-12 - size : -12]), zstandard.ZstdDecompressor()
        part = {name: zstd.decompress(data[at : at + n]) for name, (at, n) in footer["sections"].items()}
        planes = [np.frombuffer(part.pop(f"plane{k}"), "<u8") for k in range(footer["bits"])]
        ranks = [np.frombuffer(part.pop(f"rank{k}"), "<i8") for k in range(footer["bits"])]
        return cls(footer["n"], footer["bits"], footer["zeros"], planes, ranks), part
