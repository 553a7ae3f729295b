"""Edit distance within a threshold: furthest places reached on each diagonal, many pairs at a time."""

from __future__ import annotations

#: Cells of the texts of one batch, both sides laid side by side.
CELLS = 500_000


def within(lefts: list[str], rights: list[str], k: int):
    """For each pair whether its edit distance in code points is at most ``k``.

    Of each diagonal it is known how far e edits reach; one edit more goes one
    step on and then to the next mismatch, which is looked up in the sorted
    mismatches of that diagonal. Mismatches are found for all pairs of a batch
    at once, so the work is 2k+1 comparisons of a whole batch, however long or
    uneven its texts are.
    """
    import numpy as np

    n = np.array([len(s) for s in rights], np.int64)
    m = np.array([len(s) for s in lefts], np.int64)
    out = np.zeros(len(lefts), bool)
    fits = np.flatnonzero(np.abs(m - n) <= k)
    cells = np.cumsum(np.maximum(m, n)[fits] + k + 1)
    at = 0
    while at < len(fits):
        end = max(at + 1, int(np.searchsorted(cells, (cells[at - 1] if at else 0) + CELLS, "right")))
        rows = fits[at:end]
        out[rows] = _reached([lefts[i] for i in rows], [rights[i] for i in rows], m[rows], n[rows], k)
        at = end
    return out


def codes(texts: list[str]):
    """Code points of all texts, one after another."""
    import numpy as np

    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def _laid(texts: list[str], sizes, starts, width: int, fill: int):
    """Code points of texts, each from its start on; all other cells hold ``fill``."""
    import numpy as np

    out = np.full(width, fill, np.uint32)
    out[np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)] = codes(texts)
    return out


def _reached(lefts: list[str], rights: list[str], m, n, k: int):
    """Whether k edits reach both ends; lengths differ by at most k."""
    import numpy as np

    room = np.maximum(m, n) + k + 1
    starts = np.cumsum(room) - room + k
    width = int(room.sum()) + 2 * k
    # the fillings differ, so a diagonal has a mismatch where either text ends
    left, right = _laid(lefts, m, starts, width, 0xFFFFFFFF), _laid(rights, n, starts, width, 0xFFFFFFFE)
    missed = {}
    for d in range(-k, k + 1):
        first, stop = max(0, -d), width - max(0, d)
        missed[d] = np.flatnonzero(left[first:stop] != right[first + d : stop + d]) + first
    never = np.full(len(m), -(1 << 40), np.int64)
    reach = {}
    for e in range(k + 1):
        further = {}
        for d in range(-e, e + 1):
            if e == 0:
                row = np.zeros(len(m), np.int64)
            else:
                # a changed, an added or a left out character
                row = np.maximum(np.maximum(reach.get(d, never) + 1, reach.get(d - 1, never)), reach.get(d + 1, never) + 1)
                row = np.minimum(row, np.minimum(m, n - d))
            # before a text's first character nothing is reached
            real = row >= max(0, -d)
            next_miss = missed[d][np.searchsorted(missed[d], starts + np.where(real, row, m))] - starts
            further[d] = np.where(real, next_miss, never)
        reach = further
    return np.select([n - m == d for d in reach], [reach[d] >= m for d in reach], False)
