"""Hashed character n-grams and words of whole texts as count matrices, by whole numpy arrays."""

from __future__ import annotations

import functools

import numpy as np

_A, _B, _C, _D = (np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263))


@functools.cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def code_points(texts: list[str], letters_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, two spaces between them, and the text that each belongs to."""
    low = [t.lower() for t in texts]
    flat = np.frombuffer(("  ".join(low) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(low)), [len(t) + 2 for t in low])
    if letters_only:
        flat = np.where(_letters()[flat], flat, np.uint32(32))
    return flat, doc


def gram_ids(cp: np.ndarray, size: int, buckets: int) -> np.ndarray:
    """A bucket (of a power of two) for each run of ``size`` code points."""
    n = max(0, len(cp) - size + 1)
    h = np.full(n, size * 97, np.uint32)
    for j, m in zip(range(size), (_A, _B, _C, _D)):
        h ^= cp[j : j + n] * m
        h = (h << np.uint32(13)) | (h >> np.uint32(19))
        h *= np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - int(buckets).bit_length() + 1)).astype(np.int64)


def gram_counts(texts: list[str], sizes: tuple[int, ...], buckets: int, letters_only: bool) -> np.ndarray:
    """Counts (texts x sizes * buckets) of character n-grams; those of white space alone or over two texts are left out."""
    out = np.zeros((len(texts), len(sizes) * buckets), np.float64)
    cp, doc = code_points(texts, letters_only)
    blank = cp == 32
    for k, size in enumerate(sizes):
        ids = gram_ids(cp, size, buckets)
        n = len(ids)
        keep = ~(blank[:n] & blank[1 : n + 1]) & (doc[:n] == doc[size - 1 : size - 1 + n])
        if size > 2:
            keep &= ~(blank[1 : n + 1] & blank[2 : n + 2])
        flat = doc[:n][keep] * buckets + ids[keep]
        out[:, k * buckets : (k + 1) * buckets] = np.bincount(flat, minlength=len(texts) * buckets).reshape(len(texts), buckets)
    return out


def word_ids(cp: np.ndarray, doc: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A bucket for each run of code points above the space, and its text."""
    solid = cp > 32
    first = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.zeros(len(cp), np.int64)
    start[first] = first
    place = (np.arange(len(cp)) - np.maximum.accumulate(start)).astype(np.uint32)
    mixed = np.where(solid, (cp + np.uint32(1)) * (place * np.uint32(2) + np.uint32(1)) * _A ^ (cp * _B + place * _C), np.uint32(0))
    h = np.add.reduceat(mixed.astype(np.uint64), first).astype(np.uint64)
    h = (h ^ (h >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - int(buckets).bit_length() + 1)).astype(np.int64), doc[first]
