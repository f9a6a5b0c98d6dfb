"""Hashes of a text's word shingles, and SimHash fingerprints of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Seed of the hash, and hashes made at once.
SEED, BLOCK = 42, 1 << 16

_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def hashes(text: bytes, size: int) -> Iterator[np.ndarray]:
    """The hashes (uint64) of a text's shingles in order, in blocks: A-Z lower-cased, words between ASCII white space,
    `size` words a shingle. Fewer words are one shingle; no words give no hash."""
    words = text.lower().split()
    if not words:
        return
    body, size = memoryview(b" ".join(words)), min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1].tolist()
    ends = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(starts), BLOCK):
        yield np.array([digest(body[a:b], SEED) for a, b in zip(starts[k : k + BLOCK], ends[k : k + BLOCK], strict=True)], np.uint64)


def fingerprint(blocks: Iterator[np.ndarray]) -> int:
    """The unsigned fingerprint of 64 bits: a bit is set if it is in over half of the hashes, repeats included; zero if
    there are none."""
    counts, n = np.zeros(64, np.int64), 0
    for block in blocks:
        raw = block.astype(">u8").view(np.uint8).reshape(-1, 8)
        if len(raw) < 400:
            counts += np.unpackbits(raw, axis=1).sum(0, dtype=np.int64)
        else:
            counts += np.concatenate([np.bincount(raw[:, j], minlength=256) @ _BITS_OF for j in range(8)])
        n += len(raw)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")
