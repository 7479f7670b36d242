"""A run-length index of a small collection of byte strings, and matching statistics streamed from it.

``repeats`` sorts the suffixes of the concatenated strings, takes the Burrows-Wheeler transform and keeps of it only its
runs: for the first row of each run the text position and its longest common prefix with the row above, for the last row
of each run the same with the row below. Inside a run, stepping one character back keeps neighbours together and makes
their common prefix one longer; so along the text, a position that has no sample of its own has the value of the last
sample before it less the distance. That gives, in one pass over the text, the longest match of every position with any
other position of the collection.
"""

from __future__ import annotations

import numpy as np

_SYMBOLS = 7  # 9-bit symbols in a 63-bit key


def suffix_array(sym: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by prefix doubling up to ``longest`` symbols, ties by position; and the packed keys of the
    first symbols. Symbol 0 ends a string; the ends are all different, in order of position, so nothing after an end
    counts and every suffix gets a place of its own."""
    n = len(sym)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([sym.astype(np.int64), np.zeros(_SYMBOLS, np.int64)])
    inside = np.ones(n, bool)
    for k in range(_SYMBOLS):
        key = (key << 9) | np.where(inside, padded[k: k + n], 0)
        inside &= padded[k: k + n] > 0
    sa = np.argsort(key, kind="stable")
    new = np.ones(n, np.int64)
    new[1:] = (key[sa][1:] != key[sa][:-1]) | ~inside[sa][1:]
    rank = np.empty(n, np.int64)
    rank[sa] = np.cumsum(new)
    h = _SYMBOLS
    while h < longest:
        # only rows that share their rank with a neighbour still need an order
        tied = np.zeros(n, bool)
        tied[1:] = new[1:] == 0
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        pos = sa[at]
        nxt = np.where(pos + h < n, rank[np.minimum(pos + h, n - 1)], 0)
        first = rank[pos]
        order = np.lexsort((pos, nxt, first)) if n >= 1 << 31 else np.argsort((first << 31) | nxt, kind="stable")
        sa[at] = pos[order]
        nxt, first = nxt[order], first[order]
        fresh = np.ones(len(at), np.int64)
        fresh[1:] = (first[1:] != first[:-1]) | (nxt[1:] != nxt[:-1])
        new[at] = np.where(fresh == 1, 1, 0)
        # ranks are row numbers of the first of equals, so that ranks of other rows stay
        head = np.maximum.accumulate(np.where(new == 1, np.arange(1, n + 1), 0))
        rank[sa] = head
        h *= 2
    return sa, key


def _common(sym: np.ndarray, key: np.ndarray, p: np.ndarray, q: np.ndarray, most: int) -> np.ndarray:
    """Common prefixes of the suffixes p and q, counted up to about ``most`` symbols."""
    n = len(sym)
    out = np.zeros(len(p), np.int64)
    live = np.arange(len(p))
    while len(live):
        a, b = p[live] + out[live], q[live] + out[live]
        ok = (a < n) & (b < n)
        same = ok & (key[np.minimum(a, n - 1)] == key[np.minimum(b, n - 1)])
        out[live[same]] += _SYMBOLS
        live = live[same & (out[live] < most)]
    live = np.flatnonzero(out < most)
    for _ in range(_SYMBOLS - 1):
        a, b = p[live] + out[live], q[live] + out[live]
        same = (a < n) & (b < n) & (sym[np.minimum(a, n - 1)] == sym[np.minimum(b, n - 1)])
        live = live[same]
        out[live] += 1
        if not len(live):
            break
    return out


def run_samples(sym: np.ndarray, longest: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The run-length index: (positions, common prefix with the row above) of the run starts and (positions, common
    prefix with the row below) of the run ends of the Burrows-Wheeler transform."""
    sa, key = suffix_array(sym, longest)
    bwt = sym[sa - 1]
    change = np.flatnonzero((bwt[1:] != bwt[:-1]) | (bwt[1:] == 0))  # each string's end is a symbol of its own
    above, below = change + 1, change
    up = _common(sym, key, sa[above], sa[above - 1], longest)
    down = _common(sym, key, sa[below], sa[below + 1], longest)
    starts = (np.append(sa[above], sa[0]), np.append(up, 0))
    ends = (np.append(sa[below], sa[-1]), np.append(down, 0))
    return starts, ends


def _streamed(n: int, samples: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    at, value = samples
    here = np.full(n, -1, np.int64)
    here[at] = value
    pos = np.arange(n)
    last = np.maximum.accumulate(np.where(here >= 0, pos, -1))
    return np.where(last >= 0, here[last] - (pos - last), 0)


def matching_statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For every byte of the strings data[bounds[k]:bounds[k + 1]], the length of the longest match that starts there,
    stays in its string, and also starts at some other position of the strings."""
    lens = np.diff(bounds)
    k = len(lens)
    n = int(bounds[-1]) + k
    if not n:
        return np.zeros(0, np.int64)
    sym = np.zeros(n, np.int16)
    to = np.arange(int(bounds[-1])) + np.repeat(np.arange(k), lens)
    sym[to] = data.astype(np.int16) + 1
    starts, ends = run_samples(sym, int(lens.max()) + 2)
    best = np.maximum(_streamed(n, starts), _streamed(n, ends))[to]
    return np.clip(np.minimum(best, np.repeat(bounds[1:], lens) - np.arange(int(bounds[-1]))), 0, None)
