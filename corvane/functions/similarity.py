"""The ratio of two texts that ``difflib.SequenceMatcher`` gives without its heuristic, found faster."""

from __future__ import annotations

import difflib

import numpy as np

#: Runs of fewer characters are left to difflib, in what lies between the longer ones.
_LEAST = 3
#: Places where runs may begin that are held for one pair; with more of them, only longer runs are looked for here.
_PLACES = 2_000_000


def _runs(a: str, b: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """A length, and start in ``a``, start in ``b`` and length of each maximal common run of at least that length."""
    codes = np.frombuffer((a + b).encode("utf-32-le", "surrogatepass"), "<u4")
    code = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    x, y, q = code[: len(a)], code[len(a) :], 1
    while True:
        order = np.argsort(y, kind="stable")
        low, high = np.searchsorted(y[order], x, "left"), np.searchsorted(y[order], x, "right")
        n = high - low
        if q >= _LEAST and n.sum() <= _PLACES or min(len(x), len(y)) < 2:
            break
        # names of windows one longer: that of the window and the character after it
        q += 1
        wide = [w[:-1] * (int(code.max()) + 1) + own[q - 1 :] for w, own in ((x, code[: len(a)]), (y, code[len(a) :]))]
        names = np.unique(np.concatenate(wide), return_inverse=True)[1].astype(np.int64)
        x, y = names[: len(wide[0])], names[len(wide[0]) :]
    i = np.repeat(np.arange(len(x)), n)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
    width = len(a) + len(b) + 2
    place = np.sort((j - i + len(a)) * width + i)
    first = np.flatnonzero(np.diff(place, prepend=-2) != 1)
    size = np.diff(np.append(first, len(place))) + q - 1
    i = place[first] % width
    return q, i, i + place[first] // width - len(a), size


def _matched(a: str, b: str) -> int:
    if min(len(a), len(b)) == 1:
        return int(a in b or b in a)
    return sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def ratio_at_least(a: str, b: str, least: float = 0.0) -> float | None:
    """The ratio, in either text's own case; none if it is below ``least``, which is mostly known before all is compared.

    The longest common run, of those the first in ``a`` and then in ``b``, splits both texts, and so on on either side of it. All runs are
    found once; each part of the texts takes those that lie in it, cut at its ends.
    """
    if a == b:
        return 1.0
    total = len(a) + len(b)
    found = lambda n: 2.0 * n / total if 2.0 * n / total >= least else None
    if min(len(a), len(b)) < _LEAST:
        return found(_matched(a, b) if a and b else 0)
    q, *runs = _runs(a, b)
    matched, possible = 0, min(len(a), len(b))
    parts = [(0, len(a), 0, len(b), *runs)]
    while parts:
        a0, a1, b0, b1, i, j, n = parts.pop()
        possible -= min(a1 - a0, b1 - b0)
        cut = np.maximum(np.maximum(a0 - i, b0 - j), 0)
        i, j, n = i + cut, j + cut, np.minimum(np.minimum(a1 - i, b1 - j), n) - cut
        long = n >= q
        if long.any():
            i, j, n = i[long], j[long], n[long]
            size = int(n.max())
            best = np.flatnonzero(n == size)
            at = best[np.lexsort((j[best], i[best]))[0]]
            x, y = int(i[at]), int(j[at])
            matched += size
            possible += size
            for p in ((a0, x, b0, y), (x + size, a1, y + size, b1)):
                if p[0] < p[1] and p[2] < p[3]:
                    inside = (i < p[1]) & (j < p[3]) & (i + n > p[0]) & (j + n > p[2])
                    parts.append((*p, i[inside], j[inside], n[inside]))
                    possible += min(p[1] - p[0], p[3] - p[2])
        else:
            size = _matched(a[a0:a1], b[b0:b1])
            matched += size
            possible += size
        if 2.0 * possible / total < least:
            return None
    return found(matched)
