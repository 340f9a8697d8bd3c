"""Simple-8b coding of id lists in 64-bit words, coded and decoded by whole numpy arrays.

A word's top four bits select how many ids the other 60 bits hold and how wide each is. Ids of more than 60 bits (only 64-bit ids
can be) stand in a list behind the words, and selector 0 marks a word whose 60 bits are the place in that list. Ids are cut into
blocks of ``BLOCK``; a word never holds ids of two blocks, and the header has each block's first word, so any run of blocks can be
decoded alone.

Layout, little-endian: magic ``S8B1``, u32 number of blocks, u64 number of ids, u64 number of words, u64 number of long ids, then
u64 first word of each block and of the end, u64 words, u64 long ids.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC, HEAD, BLOCK = b"S8B1", struct.Struct("<4sIQQQ"), 4096
# Ids in a word and bits of each, for selectors 1 to 14.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
_COUNT = np.array([1, *COUNTS, 1], np.int64)
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def _widths(v: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Bits of each id; 61 for one that no word can hold."""
    bits = np.frexp(v.astype(np.float64))[1].astype(np.uint8)
    big = v >= np.uint64(1 << 53)  # rounding may have added a bit
    if big.any():
        bits[big] = np.searchsorted(_POWERS, v[big], side="right")
    bits[long] = 61
    return bits


def encode(ids) -> bytes:
    """Bytes of a list of ids (any unsigned integers below 2**64); an empty list is a header alone."""
    v = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(v)
    if n == 0:
        return HEAD.pack(MAGIC, 0, 0, 0, 0) + struct.pack("<Q", 0)
    long = v >> np.uint64(60) != 0
    window, have, selector = _widths(v, long), 1, np.zeros(n, np.uint8)
    for c, width, s in zip(reversed(COUNTS), reversed(WIDTHS), range(14, 0, -1)):  # the last that fits holds most; a window ends with the list
        step = c - have
        if step >= n:
            break
        if step:
            window[:-step] = np.maximum(window[:-step], window[step:])
        have = c
        selector[window <= width] = s
    steps = _COUNT.astype(np.uint8)[selector].tobytes()
    starts: list[int] = []
    for block in range(0, n, BLOCK):
        i, end = block, min(n, block + BLOCK)
        while i < end:
            starts.append(i)
            i += steps[i]
    at = np.array(starts, np.int64)
    used = np.diff(at, append=n)
    sel = selector[at]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel).tolist():
        mine = np.flatnonzero(sel == s)
        p, u = at[mine], used[mine]
        if s == 0:
            words[mine] = np.arange(len(mine), dtype=np.uint64)
            continue
        count, width = COUNTS[s - 1], WIDTHS[s - 1]
        full = u == count
        held = np.zeros(len(mine), np.uint64)
        whole = p[full]
        part = np.zeros(len(whole), np.uint64)
        for j in range(count):
            part |= v[whole + j] << np.uint64(j * width)
        held[full] = part
        for k in np.flatnonzero(~full).tolist():  # the last word of a block
            ids_of = v[p[k] : p[k] + u[k]] << (np.arange(u[k], dtype=np.uint64) * np.uint64(width))
            held[k] = np.bitwise_or.reduce(ids_of)
        words[mine] |= held
    n_blocks = -(-n // BLOCK)
    firsts = np.searchsorted(at, np.arange(n_blocks + 1) * BLOCK).astype("<u8")
    firsts[-1] = len(at)
    return b"".join((HEAD.pack(MAGIC, n_blocks, n, len(at), int(long.sum())), firsts.tobytes(), words.astype("<u8").tobytes(), v[long].astype("<u8").tobytes()))


def decode(data: bytes, first_block: int = 0, n_blocks: int | None = None) -> np.ndarray:
    """Ids of the blocks asked for (all by default) as uint64."""
    magic, blocks, n, n_words, n_long = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b segment")
    last = blocks if n_blocks is None else min(blocks, first_block + n_blocks)
    if first_block >= last:
        return np.empty(0, np.uint64)
    firsts = np.frombuffer(data, "<u8", blocks + 1, HEAD.size).astype(np.int64)
    at = HEAD.size + 8 * (blocks + 1)
    a, b = firsts[first_block], firsts[last]
    words = np.frombuffer(data, "<u8", b - a, at + 8 * a)
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = _COUNT[sel]
    ends = np.cumsum(count)
    # a block's last word may have room beyond the block
    ids_to = np.minimum((np.arange(first_block, last) + 1) * BLOCK, n) - first_block * BLOCK
    last_words = firsts[first_block + 1 : last + 1] - a - 1
    over = np.diff(ends[last_words], prepend=0) - np.diff(ids_to, prepend=0)
    used = count.copy()
    used[last_words] -= over
    starts = np.cumsum(used) - used
    out = np.empty(int(ids_to[-1]), np.uint64)
    for s in np.unique(sel).tolist():
        mine = np.flatnonzero(sel == s)
        w, p, u = words[mine], starts[mine], used[mine]
        if s == 0:
            longs = np.frombuffer(data, "<u8", n_long, at + 8 * n_words)
            out[p] = longs[(w & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        mask = np.uint64((1 << WIDTHS[s - 1]) - 1)
        for j in range(min(COUNTS[s - 1], int(u.max()))):
            inside = j < u
            out[p[inside] + j] = (w[inside] >> np.uint64(j * WIDTHS[s - 1])) & mask
    return out
