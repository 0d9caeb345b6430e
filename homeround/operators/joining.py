"""Unions of the nearest zones that fit, square by square: each is one that the whole organization would make, in the same order.

The plain rule (``zoning.merge_nearest``) joins the nearest two zones again and again. When a pair is joined is known from the pair alone: at its
distance, or once both zones are there if that is later. A square makes the unions that nothing outside it can come before, and leaves zones alone from the
distance on at which something unknown could reach them; with other squares, they go on.
"""

from __future__ import annotations

import numpy as np

#: Numbers of one union in a zone's history: when, by which pair, the how manyth at that time, the two zones.
EVENT = 5


def reach(n: np.ndarray, cap: int) -> np.ndarray:
    """Square of how many times t away a zone must be from all that is unknown, so that no union at distances up to t brings anything of it within t.

    Of m members joined at up to t, the mean square distance to their centroid is at most t^2 log2(m) / 4; so one of them is as near as that.
    """
    return (1 + np.log2(np.maximum(cap - n, 1)) / 4) * (1 + 1e-9)


def unions(num: np.ndarray, n: np.ndarray, xy: np.ndarray, born: np.ndarray, code: np.ndarray, depth: np.ndarray, edge: np.ndarray, cap: int) -> list[tuple[int, int, list[int]]]:
    """The sure unions of a square's zones, which are in order of ``num``, as (place kept, place taken, event) in turn; the arrays then hold the zones that are left.

    ``born``, ``code``: when a zone was made, as squared distance and pair; ``edge``: how far it is from the end of its square.
    """
    m, events = len(num), []
    alive, held, held_at = np.ones(m, bool), [], []
    when, mate = np.full(m, np.inf), np.full(m, -1)
    wide = reach(n, cap)
    known = np.maximum(edge * edge / wide, born)  # up to when no unknown zone can matter

    def key(i: int, j: int) -> tuple:
        i, j = min(i, j), max(i, j)
        d, pair = float(((xy[i] - xy[j]) ** 2).sum()), int(num[i]) << 31 | int(num[j])
        at = max((d, pair), (float(born[i]), int(code[i])), (float(born[j]), int(code[j])))
        return *at, d, pair

    def look(i: int) -> None:
        k = np.flatnonzero(alive & (n + n[i] <= cap))
        k = k[k != i]
        if not len(k):
            when[i], mate[i] = np.inf, -1
            return
        v = np.maximum(np.maximum(((xy[k] - xy[i]) ** 2).sum(axis=1), born[k]), born[i])
        when[i] = v.min()
        k = k[v == when[i]]
        mate[i] = k[0] if len(k) == 1 else min(k, key=lambda j: key(i, j))

    def gone(*places: int) -> None:
        for p in np.flatnonzero(alive & np.isin(mate, places)):
            look(p)

    for i in range(m):
        look(i)
    while True:
        first = when.min(initial=np.inf)
        if first == np.inf:
            return events
        there = np.where(alive, known, np.inf)
        z = int(there.argmin())
        if there[z] <= first:  # from now on its fate is open
            alive[z], when[z] = False, np.inf
            held.append(z)
            held_at.append(known[z])
            y = np.flatnonzero(alive & (n + n[z] <= cap))
            near = np.maximum(np.maximum(((xy[y] - xy[z]) ** 2).sum(axis=1) / wide[y], known[z]), born[y])
            known[y] = np.minimum(known[y], near)
            gone(z)
            continue
        ties = np.flatnonzero(when == first)
        i = int(ties[0]) if len(ties) == 1 else int(min(ties, key=lambda p: key(p, mate[p])))
        i, j = sorted((i, int(mate[i])))
        v, pair, d, own = key(i, j)
        nth = 0 if (v, pair) == (d, own) else 1 + max(int(depth[p]) for p in (i, j) if (born[p], code[p]) == (v, pair))
        events.append((i, j, [int(np.float64(v).view(np.int64)), pair, nth, int(num[i]), int(num[j])]))
        edge[i] = (n[i] * edge[i] + n[j] * edge[j]) / (n[i] + n[j])  # or more
        xy[i] = (n[i] * xy[i] + n[j] * xy[j]) / (n[i] + n[j])
        n[i] += n[j]
        born[i], code[i], depth[i] = v, pair, nth
        alive[j], when[j] = False, np.inf
        wide[i] = reach(n[i], cap)
        known[i] = max(edge[i] * edge[i] / wide[i], v)
        if held:
            h = np.array(held)
            fits = n[h] + n[i] <= cap
            near = np.maximum(((xy[h] - xy[i]) ** 2).sum(axis=1) / wide[i], np.array(held_at))[fits]
            known[i] = min(known[i], max(near.min(initial=np.inf), v))
        gone(i, j)
        look(i)
        y = np.flatnonzero(alive & (n + n[i] <= cap))
        y = y[y != i]
        at = np.maximum(np.maximum(((xy[y] - xy[i]) ** 2).sum(axis=1), born[y]), v)
        for p in y[at == when[y]]:
            if mate[p] != i and key(p, i) < key(p, mate[p]):
                mate[p] = i
        nearer = at < when[y]
        when[y[nearer]], mate[y[nearer]] = at[nearer], i


def landed(root: int, history: np.ndarray, until: tuple) -> tuple[list[int], list[int]]:
    """Zones of a history, and the zone each of them ends in if only unions up to ``until`` are made."""
    into = {root: root}
    for v, pair, nth, i, j in sorted(tuple(map(int, e)) for e in np.asarray(history, np.int64).reshape(-1, EVENT)):
        into.setdefault(i, i)
        into.setdefault(j, j)
        if (v, pair, nth) <= until:
            into = {k: i if to == j else to for k, to in into.items()}
    return list(into), list(into.values())
