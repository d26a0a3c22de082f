"""Order MinHash sketches: the k least occurrence-labelled shingles under a hash, kept in text order.

Two texts agree in a sketch with a chance that falls with edits and with moved passages alike. Texts of LONG words or
more have SKETCHES sketches of KEPT shingles of SHINGLE words, those of up to SHORT words have SHORT_SKETCHES of a single
shingle; the lengths between have both, so two texts of which one has at least 0.8 of the other's words always have a
kind in common. The chance to agree in one sketch is about J ** KEPT (J for short texts), where J is the share of equal
shingles. If words are replaced at random, with a chance p, J is q / (2 - q) for q = (1 - p) ** SHINGLE, and a pair
of long texts shares a sketch with a chance of 1 - (1 - J ** KEPT) ** SKETCHES: above 0.9999 up to p = 0.15 and 0.9996 at
0.19. The worst case of edit similarity 0.8, every fifth word replaced, has J = 0.43 and a chance of 0.995; short texts
have J of 1/3 or more there, and 0.9999. Moved passages lower it further.

All sketches of a batch are made together; a threshold for each document keeps the few shingles that can be among its least.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 2
KEPT = 3
SKETCHES = 64
SHORT, LONG, SHORT_SKETCHES = 40, 32, 24
SLICE_WORDS = 400_000
#: Bins of a bag of words.
BINS = 1024

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def shingles(words: np.ndarray, sizes: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all documents' shingles end to end, labelled by occurrence, and how many each has.

    A document of fewer than width words, but not none, is one shingle.
    """
    ends = np.cumsum(sizes)
    starts, n = ends - sizes, len(words)
    padded = np.append(words.astype(np.uint64), np.zeros(width, dtype=np.uint64))
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        rolled = rolled * _A + mix(padded[k : k + n] + np.uint64(k + 1))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(n) - starts[doc]
    keep = inside <= np.maximum(sizes[doc] - width, 0)
    for i in np.flatnonzero((sizes > 0) & (sizes < width)):
        h = np.uint64(sizes[i])
        for w in words[starts[i] : ends[i]].astype(np.uint64):
            h = mix(np.array([h ^ w], dtype=np.uint64) * _A + np.uint64(1))[0]
        rolled[starts[i]] = h
    rolled, doc = mix(rolled[keep]), doc[keep]
    order = np.argsort(rolled ^ mix(doc.astype(np.uint64) + np.uint64(1)), kind="stable")
    same = np.append(False, (rolled[order][1:] == rolled[order][:-1]) & (doc[order][1:] == doc[order][:-1]))
    at = np.arange(len(order))
    label = np.empty(len(order), dtype=np.uint64)
    label[order] = (at - np.maximum.accumulate(np.where(same, 0, at))).astype(np.uint64)
    return mix(rolled + label * _B), np.bincount(doc, minlength=len(sizes)).astype(np.int64)


def sketch(words: np.ndarray, sizes: np.ndarray, sketches: int = SKETCHES, kept: int = KEPT, width: int = SHINGLE) -> np.ndarray:
    """A row of sketches (int64) for each document; of documents without words the row means nothing."""
    labelled, counts = shingles(words, sizes, width)
    out = np.zeros((len(sizes), sketches), dtype=np.uint64)
    if not len(labelled):
        return out.view(np.int64)
    doc = np.repeat(np.arange(len(sizes)), counts)
    ends = np.cumsum(counts)
    top = float(2**64 - 2**12)
    limit = np.where(counts > 6 * kept, top * (4.0 * kept / np.maximum(counts, 1)), top).astype(np.uint64)[doc]
    wanted = np.minimum(counts, kept)
    for j in range(sketches):
        seed = mix(np.array([j + 1], dtype=np.uint64))[0] | np.uint64(1)
        value = labelled * seed
        value = (value ^ (value >> np.uint64(32))) * _B
        near = np.flatnonzero(value <= limit)
        short = np.flatnonzero(np.bincount(doc[near], minlength=len(sizes)) < wanted)
        if len(short):
            near = np.union1d(near, np.concatenate([np.arange(ends[i] - counts[i], ends[i]) for i in short]))
        near = near[np.lexsort((near, value[near], doc[near]))]
        own = doc[near]
        rank = np.arange(len(near)) - np.searchsorted(own, own)
        least = np.sort(near[rank < kept])  # text order
        first = np.cumsum(wanted) - wanted
        state = np.full(len(sizes), j + 1, dtype=np.uint64) * _A
        for r in range(kept):
            has = np.flatnonzero(wanted > r)
            state[has] = mix(state[has] + labelled[least[first[has] + r]])
        out[:, j] = state
    return out.view(np.int64)


def sketch_lists(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sketches of all documents end to end, and how many each has."""
    long, short = sizes >= LONG, (sizes > 0) & (sizes <= SHORT)
    counts = long * SKETCHES + short * SHORT_SKETCHES
    starts, out = np.cumsum(counts) - counts, np.zeros(counts.sum(), dtype=np.int64)
    for chosen, after, n, kept in ((long, 0, SKETCHES, KEPT), (short, long * SKETCHES, SHORT_SKETCHES, 1)):
        if chosen.any():
            found = sketch(words[np.repeat(chosen, sizes)], sizes[chosen], n, kept)
            out[(starts + after)[chosen][:, None] + np.arange(n)] = found
    return out, counts


def bags(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many words of each document fall into each of BINS bins, 255 at most."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = doc * BINS + (mix(words.astype(np.uint64)) % np.uint64(BINS)).astype(np.int64)
    return np.minimum(np.bincount(place, minlength=len(sizes) * BINS), 255).astype(np.uint8).reshape(len(sizes), BINS)


def bag_edits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A lower bound of the word edits between texts by their bags: an edit moves a word from one bin to another, adds
    or removes one."""
    common = np.minimum(x, y).sum(axis=-1, dtype=np.int64)
    return np.maximum(x.sum(axis=-1, dtype=np.int64), y.sum(axis=-1, dtype=np.int64)) - common


def edit_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """Word edits between two texts if there are at most limit, else None: alignment within the band of that many
    diagonals, furthest places first; a bound from the bags of words ends hopeless cases early."""
    if abs(len(a) - len(b)) > limit:
        return None
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[:n] != b[:n])
    head = int(differs[0]) if len(differs) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differs[0]) if len(differs) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return max(len(a), len(b)) if max(len(a), len(b)) <= limit else None
    both, sign = np.unique(np.concatenate([a, b]), return_inverse=True)
    ca, cb = np.bincount(sign[: len(a)], minlength=len(both)), np.bincount(sign[len(a) :], minlength=len(both))
    if max(len(a), len(b)) - int(np.minimum(ca, cb).sum()) > limit:
        return None
    n, m = len(a), len(b)
    a, b = np.append(sign[:n], np.full(33, -1)), np.append(sign[n:], np.full(33, -2))
    limit = min(limit, max(n, m))
    reach = np.full(2 * limit + 3, -2, dtype=np.int64)  # row reached on diagonal k - limit - 1
    mid = limit + 1
    reach[mid] = 0
    block = np.arange(32)
    for e in range(limit + 1):
        lo, hi = max(mid - e, mid - n), min(mid + e, mid + m)
        ks = np.arange(lo, hi + 1)
        if e:
            new = np.maximum(np.maximum(reach[lo : hi + 1] + 1, reach[lo + 1 : hi + 2] + 1), reach[lo - 1 : hi])
            reach[lo : hi + 1] = np.minimum(new, np.minimum(n, m - (ks - mid)))
        row = reach[lo : hi + 1]
        live = np.flatnonzero((row >= 0) & (row + ks - mid >= 0) & (row < n) & (row + ks - mid < m))
        live = live[a[row[live]] == b[row[live] + ks[live] - mid]]
        while len(live):
            i = row[live][:, None] + block
            j = i + (ks[live] - mid)[:, None]
            equal = a[np.minimum(i, n)] == b[np.minimum(j, m)]
            run = np.where(equal.all(axis=1), 32, equal.argmin(axis=1))
            row[live] += run
            live = live[run == 32]
        end = mid + m - n
        if lo <= end <= hi and reach[end] >= n:
            return e
    return None
