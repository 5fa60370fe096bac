"""Edit distances of many pairs of texts at once, for tasks that hold them in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

#: Lanes of 64 rows that are worked together, and entries of a table of letters by lane; beyond it entries are searched.
LANES, TABLE = 2048, 1 << 22
ONE = np.uint64(1)


def edit_distances(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """The edit distance by code points of each pair (a[k], b[k]), none of them empty.

    Myers' bit vectors as Hyyrö extends them: the differences down a column of the distance matrix
    are bits, 64 rows to a lane. A lane is one letter of ``b`` behind the lane above it, so all
    lanes of all pairs of a group take a step together. Memory is linear in the texts of a group,
    which is one pair at least.
    """
    out, group, lanes = np.zeros(len(a), np.int64), [], 0
    for k in sorted(range(len(a)), key=lambda k: len(b[k])):
        need = -(-len(a[k]) // 64)
        if group and lanes + need > LANES:
            out[group] = _together([a[g] for g in group], [b[g] for g in group])
            group, lanes = [], 0
        group.append(k)
        lanes += need
    if group:
        out[group] = _together([a[g] for g in group], [b[g] for g in group])
    return out


def _together(a: list[str], b: list[str]) -> np.ndarray:
    m, n = (np.array([len(x) for x in side]) for side in (a, b))
    x, y = (np.frombuffer("".join(side).encode("utf-32-le"), np.uint32) for side in (a, b))
    used = np.zeros(max(x.max(), y.max()) + 1, np.int64)
    used[x] = 1
    letter = np.cumsum(used) * used  # 0: in no text of a
    kinds = int(letter.max()) + 1
    lanes = -(-m // 64)
    first = np.cumsum(lanes) - lanes
    last, steps, count = first + lanes - 1, n + lanes - 1, int(lanes.sum())
    down = np.arange(count) - np.repeat(first, lanes)
    place = np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m)
    find = _finder((np.repeat(first, m) + place // 64) * kinds + letter[x], ONE << (place % 64).astype(np.uint64), count * kinds)
    # each text of b behind as many blanks as its pair has lanes: a lane reads them until it is its turn, which changes nothing
    start = np.cumsum(n + lanes) - n
    text = np.zeros(int((n + lanes).sum() + steps.max()), np.int64)
    text[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(len(y))] = letter[y]
    at, row = np.repeat(start, lanes) - down, np.arange(count) * kinds
    top = np.full(count, 63, np.uint64)
    top[last] = (m - 1) % 64
    more, less = np.full(count, ~np.uint64(0)), np.zeros(count, np.uint64)  # rows that are one more or less than the row above
    more_in, less_in = np.zeros(count, np.uint64), np.zeros(count, np.uint64)  # the same along the row above the lane
    more_in[first] = 1
    distance = m.copy()
    for t in range(int(steps.max())):
        eq = find(row + text[at + t])
        xv = eq | less
        eq |= less_in
        xh = (((eq & more) + more) ^ more) | eq
        ph, mh = less | ~(xh | more), more & xh
        more_out, less_out = ph >> top & ONE, mh >> top & ONE
        distance += np.where(t < steps, more_out[last].astype(np.int64) - less_out[last].astype(np.int64), 0)
        ph, mh = ph << ONE | more_in, mh << ONE | less_in
        more, less = mh | ~(xv | ph), ph & xv
        more_in[1:], less_in[1:] = more_out[:-1], less_out[:-1]
        more_in[first], less_in[first] = 1, 0
    return distance


def _finder(keys: np.ndarray, bits: np.ndarray, size: int) -> Callable[[np.ndarray], np.ndarray]:
    """What gives the united bits of each key asked, 0 for unknown ones."""
    if size <= TABLE:
        table = np.zeros(size, np.uint64)
        np.bitwise_or.at(table, keys, bits)
        return table.take
    order = np.argsort(keys, kind="stable")
    known, begin = np.unique(keys[order], return_index=True)
    united = np.bitwise_or.reduceat(bits[order], begin)

    def find(asked: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        return np.where(known[at] == asked, united[at], np.uint64(0))

    return find
