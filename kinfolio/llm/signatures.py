"""Shingle sets of texts and their b-bit minhash signatures, for many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from kinfolio.llm.hashing import mix, shingle_hashes, word_hashes

#: Words in a shingle.
SHINGLE = 3
#: Slots of a signature and bits kept of each.
SLOTS, SLOT_BITS = 256, 16

_MULTIPLIERS = np.random.default_rng(20).integers(1, 1 << 63, size=SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within it, and how many each has.

    Texts with fewer than ``k`` words, but not none, have one: the whole sequence.
    """
    words, counts = word_hashes(texts, lower=True)
    n = len(texts)
    owner = np.repeat(np.arange(n), counts)
    full = shingle_hashes(words, k) if len(words) else words
    ends = np.cumsum(counts)
    place = np.arange(len(words)) - np.repeat(ends - counts, counts)
    inside = place <= np.repeat(counts, counts) - k
    hashes, owners = full[inside], owner[inside]
    for m in range(1, k):
        short = np.flatnonzero(counts == m)
        if len(short):
            whole = mix(shingle_hashes(words, m)[(ends - counts)[short]] + np.uint64(m))
            hashes, owners = np.concatenate([hashes, whole]), np.concatenate([owners, short])
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return hashes[fresh], np.bincount(owners[fresh], minlength=n)


def signatures(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One row of SLOTS minima (b bits each, uint16) for each set; zeros for empty sets."""
    out = np.zeros((len(sizes), SLOTS), dtype=np.uint16)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    starts = (np.cumsum(sizes) - sizes)[some]
    for k in range(SLOTS):
        least = np.minimum.reduceat(hashes * _MULTIPLIERS[k], starts)
        out[some, k] = (mix(least) >> np.uint64(64 - SLOT_BITS)).astype(np.uint16)
    return out


def set_digests(hashes: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """A 128-bit digest of each (sorted) set."""
    ends = np.cumsum(sizes)
    return [hashlib.md5(hashes[e - n : e]).digest() for e, n in zip(ends, sizes, strict=True)]


def planes(sig: np.ndarray, bits: int = 8) -> np.ndarray:
    """The low ``bits`` of every slot as bit planes: ``bits`` signed 64-bit numbers for each 64 slots.

    The number of slots where two signatures differ is then, for each 64 slots, the
    bit count of the OR of the XORs of their planes.
    """
    n, out = len(sig), []
    for at in range(0, sig.shape[1], 64):
        part = sig[:, at : at + 64]
        for b in range(bits):
            plane = ((part >> np.uint16(b)) & np.uint16(1)).astype(np.uint8)
            out.append(np.packbits(plane, axis=1).view(">i8").astype(np.int64).reshape(n))
    return np.stack(out, axis=1)


def chunk_keys(sig: np.ndarray, chunks: int, slots: int = 64) -> np.ndarray:
    """One key for each slot: its chunk's place and values with that slot masked.

    Two signatures that differ in at most one slot of some chunk share a key. With
    ``chunks`` chunks, at most ``2 * chunks - 1`` differing slots leave one such chunk.
    """
    bounds = np.linspace(0, slots, chunks + 1).astype(int)
    weight = mix(np.arange(1, slots + 1, dtype=np.uint64)) | np.uint64(1)
    wide = mix(sig[:, :slots].astype(np.uint64) + np.arange(slots, dtype=np.uint64) * np.uint64(1 << 20)) * weight
    keys = np.empty((len(sig), slots), dtype=np.uint64)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        total = wide[:, a:b].sum(axis=1)
        for i in range(a, b):
            keys[:, i] = mix(total - wide[:, i] + mix(np.array([i + 1], dtype=np.uint64)))
    return keys.view(np.int64)
