"""Simple-8b packing of non-negative integers into 64-bit words, vectorised over blocks."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Ids of a block; every block starts a word of its own, so blocks decode independently.
BLOCK = 4096
#: Selector (the word's top four bits) -> (number of lanes, bits of a lane). Selector 0 is an escape: its only id needs
#: more than 60 bits and stands in the list of escapes. Selector 1 is reserved.
LANES = [(1, 0), (0, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_COUNT = np.array([c for c, _ in LANES], np.int64)


def _width(v: np.ndarray) -> np.ndarray:
    """Bits of each number."""
    if int(v.max(initial=0)) < 1 << 53:
        return np.frexp(v.astype(np.float64))[1].astype(np.uint8)
    high = v >> U64(32)
    return np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, np.frexp((v & U64(0xFFFFFFFF)).astype(np.float64))[1]).astype(np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids -> (words, first word of every block and the end, escapes, first escape of every block and the end).

    In each block the next word takes as many ids as fit, so the result depends on the ids alone. All blocks are
    walked side by side, one word of each per step.
    """
    ids = np.asarray(ids, U64)
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    # positions past the end hold zeros, so the last word of a block may leave lanes unused
    v = np.zeros(blocks * BLOCK, U64)
    v[:n] = ids
    grid = v.reshape(blocks, BLOCK)
    size = np.full(blocks, BLOCK, np.int64)
    if blocks:
        size[-1] = n - (blocks - 1) * BLOCK
    best = np.zeros((blocks, BLOCK), np.uint8)
    at, width = np.arange(BLOCK, dtype=np.int16), _width(grid)
    widest = int(width.max(initial=0))
    for s in range(len(LANES) - 1, 1, -1):
        count, bits = LANES[s]
        if bits >= widest:
            # nothing is too wide
            best[:] = s
            continue
        # a run of ``count`` ids covers a window of half as many that starts at a multiple of their number
        half = count // 2
        if half > 1 and not (width[:, : BLOCK // half * half].reshape(blocks, -1, half) <= bits).all(axis=2).any() and not (width[:, -count:] <= bits).all(axis=1).any():
            continue
        # how many ids from here on fit, by the next one that does not
        free = np.where(width > bits, at, np.int16(BLOCK + 60))[:, ::-1]
        np.minimum.accumulate(free, axis=1, out=free)
        np.copyto(best, np.uint8(s), where=free[:, ::-1] - at >= count)
    pos = np.zeros(blocks, np.int64)
    b_of, p_of, s_of = [], [], []
    live = np.arange(blocks)
    while len(live):
        p = pos[live]
        s = best[live, p]
        b_of.append(live)
        p_of.append(p)
        s_of.append(s)
        pos[live] = p + _COUNT[s]
        live = live[pos[live] < size[live]]
    b, p, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (b_of, p_of, s_of))
    # by block; a block's words are in order already
    order = np.argsort(b.astype(np.uint32), kind="stable")
    b, p, s = b[order], p[order], s[order].astype(np.uint8)
    words = s.astype(U64) << U64(60)
    flat = np.concatenate([grid, np.zeros((blocks, 60), U64)], axis=1).ravel()
    place = b * (BLOCK + 60) + p
    for k, (count, bits) in enumerate(LANES):
        here = np.flatnonzero(s == k)
        if k > 1 and len(here):
            first, word = place[here], words[here]
            for i in range(count):
                word |= flat[first + i] << U64(i * bits)
            words[here] = word
    out = np.flatnonzero(s == 0)
    edges = np.arange(blocks + 1)
    return words, np.searchsorted(b, edges), grid[b[out], p[out]], np.searchsorted(b[out], edges)


def unpack(words: np.ndarray, first: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of whole consecutive blocks; ``first`` has each block's first word and the end."""
    blocks = len(first) - 1
    sel = (words >> U64(60)).astype(np.int64)
    counts = _COUNT[sel]
    upto = np.cumsum(counts) - counts
    b = np.repeat(np.arange(blocks), np.diff(first))
    # the place of a word inside its block
    at = b * BLOCK + upto - (upto[first[:-1]][b] if blocks else 0)
    stop = np.minimum((b + 1) * BLOCK, n)
    out = np.zeros(n, U64)
    for k, (count, bits) in enumerate(LANES):
        here = np.flatnonzero(sel == k)
        if not len(here):
            continue
        if k == 0:
            out[at[here]] = escapes
            continue
        lanes = words[here][:, None] >> (np.arange(count, dtype=U64) * U64(bits)) & U64((1 << bits) - 1)
        to = at[here][:, None] + np.arange(count)
        inside = to < stop[here][:, None]
        out[to[inside]] = lanes[inside]
    return out
