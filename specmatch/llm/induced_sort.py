"""External induced suffix sorting with common-prefix values, in blocks.

Suffixes are classed S (smaller than the next) or L. The leftmost S suffixes of each run are sorted first: their
substrings are ordered by one induction and named, and the string of names is sorted in turn, recursively while its alphabet is
small against its length, else by doubling names. From their order two induction passes give all others. Each pass
drains one first-in-first-out queue per first character in the order of characters, a monotone priority queue: whatever a drained suffix
induces belongs at the end of its own character's queue. Queues carry (suffix, common-prefix) tuples; the common prefix of two
neighbours is one more than the least among what was drained between the suffixes that induced them. Queues are flat
arrays, written and read front to back a block at a time; beyond ``MEMORY`` bytes they lie in unlinked files.
"""

from __future__ import annotations

import tempfile

import numpy as np

from specmatch.llm.textvec import U64, mix

BLOCK = 1 << 15
#: Bytes above which a queue is backed by disk.
MEMORY = 64 << 20
#: A string of names is sorted by recursion if it is so many times as long as its alphabet, else by doubling: a pass
#: over the queues costs a step for each character of the alphabet.
RECUR = 100
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def array(n: int, kind) -> np.ndarray:
    size = n * np.dtype(kind).itemsize
    if size <= MEMORY:
        return np.zeros(n, kind)
    with tempfile.TemporaryFile() as f:
        f.truncate(size)
        return np.memmap(f, kind, "r+", shape=(n,))


class _Hash:
    """Prefix hashes of a string of whole numbers: equality and common prefixes of substrings."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        power = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(n, _BASE, U64)]))
        self.inverse = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(n, _INVERSE, U64)]))
        self.sums = array(n + 1, U64)
        np.cumsum(mix(text.astype(U64) + U64(1)) * power[:n], out=self.sums[1:])
        self.n = n

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def common(self, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
        """Length of the common prefix of suffixes a and b, up to ``cap``."""
        low = np.zeros(len(a), np.int64)
        high = np.minimum(cap, self.n - np.maximum(a, b))
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            same = self.of(a, a + mid) == self.of(b, b + mid)
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)
        return low


def _is_small(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last counts as small."""
    n = len(text)
    less = np.empty(n, bool)
    less[:-1], less[-1] = text[:-1] < text[1:], True
    at = np.arange(n)
    at[:-1][text[:-1] == text[1:]] = n - 1
    return less[np.minimum.accumulate(at[::-1])[::-1]]


class _Queues:
    """A queue for each first character, end to end in one array."""

    def __init__(self, sizes: np.ndarray, lcp: bool):
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.fill = self.start[:-1].copy()
        self.pos = array(int(self.start[-1]), np.int64)
        self.lcp = array(int(self.start[-1]), np.int16) if lcp else None

    def push(self, chars: np.ndarray, pos: np.ndarray, lcp: np.ndarray | None) -> None:
        """Append; ``chars`` are in order."""
        first = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
        sizes = np.diff(np.concatenate([first, [len(chars)]]))
        which = chars[first]
        to = np.repeat(self.fill[which] - first, sizes) + np.arange(len(chars))
        self.pos[to] = pos
        if lcp is not None:
            self.lcp[to] = lcp
        self.fill[which] += sizes


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low..high]) for each pair, low <= high."""
    width = high - low + 1
    level = (np.frexp(width.astype(float))[1] - 1).astype(np.int64)
    out = np.empty(len(low), values.dtype)
    table, k = values, 0
    top = int(level.max()) if len(level) else -1
    while k <= top:
        rows = np.flatnonzero(level == k)
        if len(rows):
            out[rows] = np.minimum(table[low[rows]], table[high[rows] - (1 << k) + 1])
        if k < top:
            table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
        k += 1
    return out


def _induce(text: np.ndarray, small: np.ndarray, queues: _Queues, seeds, wanted: bool, down: bool, cap: int) -> None:
    """Drain the queues in the order of characters (``down``: descending); each character's own queue, then its seeds.
    ``wanted`` is the class (small or not) of the suffixes that are induced."""
    lcp = queues.lcp is not None
    size = len(queues.fill)
    since = np.full(size, -1, np.int16)  # least common prefix drained since a character's last induction
    chars = np.arange(size)

    def drain(pos: np.ndarray, pre: np.ndarray | None) -> None:
        for low in range(0, len(pos), BLOCK):
            p = pos[low : low + BLOCK] - 1
            rows = np.flatnonzero(p >= 0)
            rows = rows[small[p[rows]] == wanted]
            c = text[p[rows]].astype(np.int64)
            order = np.argsort(c.astype(np.uint16) if size <= 65_536 else c, kind="stable")
            rows, c = rows[order], c[order]
            got = None
            if lcp:
                values = pre[low : low + BLOCK]
                whole = values.min()
                if len(rows):
                    new = np.concatenate([[True], c[1:] != c[:-1]])
                    before = np.where(new, 0, np.concatenate([[0], rows[:-1] + 1]))
                    got = _range_min(values, before, rows)
                    got[new] = np.minimum(got[new], since[c[new]])
                    got = np.minimum(got + 1, cap).astype(np.int16)
                    last = np.concatenate([c[1:] != c[:-1], [True]])
                    after = np.full(int(last.sum()), cap, np.int16)
                    inside = rows[last] + 1 < len(values)
                    if inside.any():
                        after[inside] = _range_min(values, rows[last][inside] + 1, np.full(int(inside.sum()), len(values) - 1))
                np.minimum(since, whole, out=since)
                if len(rows):
                    since[c[last]] = after
            if len(rows):
                queues.push(c, p[rows], got)

    for c in chars[::-1] if down else chars:
        c = int(c)
        at = int(queues.start[c])
        while at < queues.fill[c]:
            to = min(int(queues.fill[c]), at + BLOCK)
            drain(queues.pos[at:to], queues.lcp[at:to] if lcp else None)
            at = to
        pos, pre = seeds(c)
        if len(pos):
            drain(pos, pre)


def _by_doubling(names: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes of a string of names by their first ``depth`` names (ties by place)."""
    n = len(names)
    rank, k = names.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while k < depth:
        then = np.full(n, -1, np.int64)
        then[: n - k] = rank[k:] if k < n else then[: n - k]
        key = rank * (n + 1) + then + 1
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[False], key[order][1:] != key[order][:-1]]))
        if rank[order[-1]] == n - 1:
            break
        k *= 2
    return order


def suffix_order(text: np.ndarray, cap: int, lcp: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """The suffixes of ``text`` in the order of their first ``cap`` symbols, and each one's common prefix with the
    one before it, up to ``cap``. The last symbol must be 0 and occur once."""
    n = len(text)
    if n < 3:
        order = np.argsort(text, kind="stable")
        return order, np.zeros(n, np.int16) if lcp else None
    size = int(text.max()) + 1
    small = _is_small(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    count = np.bincount(text, minlength=size)
    count_small = np.bincount(text[small], minlength=size)
    digest = _Hash(text)

    def sort_from(seed: np.ndarray, pre: np.ndarray | None) -> tuple[_Queues, _Queues]:
        """Large and small queues induced from the seeds in their order."""
        large, little = _Queues(count - count_small, pre is not None), _Queues(count_small, pre is not None)
        edges = np.searchsorted(text[seed], np.arange(size + 1))

        def leftmost(c: int):
            low, high = edges[c], edges[c + 1]
            if pre is None or low == high:
                return seed[low:high], None
            own = pre[low:high].copy()
            own[0] = 0
            if large.fill[c] > large.start[c]:
                own[0] = digest.common(large.pos[large.fill[c] - 1 : large.fill[c]], seed[low : low + 1], cap)[0]
            return seed[low:high], own

        _induce(text, small, large, leftmost, False, False, cap)

        def larger(c: int):
            low, high = large.start[c], large.fill[c]
            pos = large.pos[low:high][::-1]
            if pre is None or low == high:
                return pos, None
            own = np.empty(len(pos), np.int16)
            own[1:] = large.lcp[low + 1 : high][::-1]
            own[0] = 0
            if little.fill[c] > little.start[c]:
                own[0] = digest.common(little.pos[little.fill[c] - 1 : little.fill[c]], pos[:1], cap)[0]
            return pos, own

        _induce(text, small, little, larger, True, True, cap)
        return large, little

    if len(lms) > 1:
        # order and name the substrings between leftmost small suffixes
        rough = lms[np.argsort(text[lms], kind="stable")]
        _, little = sort_from(rough, None)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        found = [np.array([n - 1])]
        for c in range(size):
            own = little.pos[little.start[c] : little.fill[c]][::-1]
            found.append(own[is_lms[own]])
        ordered = np.concatenate(found)
        del little
        end = np.minimum(np.append(lms[1:], n - 1) + 1, n)
        place = np.empty(n, np.int64)
        place[lms] = np.arange(len(lms))
        stop = end[place[ordered]]
        code = digest.of(ordered, stop)
        same = (code[1:] == code[:-1]) & (stop[1:] - ordered[1:] == stop[:-1] - ordered[:-1])
        name = np.cumsum(np.concatenate([[False], ~same]))
        if name[-1] + 1 < len(lms):
            names = np.empty(len(lms), np.int64)
            names[place[ordered]] = name
            if (int(name[-1]) + 1) * RECUR < len(lms):
                seed = lms[suffix_order(names, cap, False)[0]]
            else:
                seed = lms[_by_doubling(names, cap)]
        else:
            seed = ordered
    else:
        seed = lms
    pre = None
    if lcp:
        pre = np.zeros(len(seed), np.int16)
        for low in range(1, len(seed), 1 << 20):
            high = min(len(seed), low + (1 << 20))
            pre[low:high] = digest.common(seed[low - 1 : high - 1], seed[low:high], cap)
    large, little = sort_from(seed, pre)
    order, common, at = array(n, np.int64), array(n, np.int16) if lcp else None, 0
    for c in range(size):
        pos = large.pos[large.start[c] : large.fill[c]]
        order[at : at + len(pos)] = pos
        if lcp and len(pos):
            common[at : at + len(pos)] = large.lcp[large.start[c] : large.fill[c]]
            common[at] = 0
        at += len(pos)
        rest = little.pos[little.start[c] : little.fill[c]][::-1] if c else np.array([n - 1])
        order[at : at + len(rest)] = rest
        if lcp and len(rest) and c:
            own = little.lcp[little.start[c] : little.fill[c]][::-1]
            common[at + 1 : at + len(rest)] = own[:-1]
            common[at] = digest.common(pos[-1:], rest[:1], cap)[0] if len(pos) else 0
        at += len(rest)
    return order, common
