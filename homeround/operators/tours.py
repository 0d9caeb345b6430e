"""Tours of many routes of one size at once: the steps of ``routing.tour`` and ``routing.timed_tour`` on arrays with a row a route, with the same outcome."""

from __future__ import annotations

import numpy as np

#: Elements that one array of a step may hold.
ROOM = 1 << 21


def _chunks(rows: int, each: int):
    step = max(1, ROOM // max(each, 1))
    return (slice(a, a + step) for a in range(0, rows, step))


def _next(order: np.ndarray) -> np.ndarray:
    return np.concatenate([order[:, 1:], order[:, :1]], axis=1)


def _turned(order: np.ndarray, i: int, j: int) -> np.ndarray:
    return np.concatenate([order[:, :i], order[:, i : j + 1][:, ::-1], order[:, j + 1 :]], axis=1)


def turn(cost: np.ndarray, order: np.ndarray) -> np.ndarray:
    """2-opt as ``routing._turn``; ``cost`` holds a flat matrix a row."""
    n, order = order.shape[1], order.copy()
    at = np.arange(len(order))
    while len(at):
        now, c, better = order[at], at[:, None] * n * n, np.zeros(len(at), bool)
        arc = lambda a, b, w=slice(None): cost.take(c[w] + a * n + b)
        after = _next(now)
        ahead = np.cumsum(arc(now, after) - arc(after, now), axis=1)
        for i in range(1, n - 1):
            for j in range(i + 1, n):
                a, b, e, f = now[:, i - 1], now[:, i], now[:, j], after[:, j]
                one = lambda x, y: cost.take(c[:, 0] + x * n + y)
                change = one(a, e) - one(a, b) + one(b, f) - one(e, f) - (ahead[:, j - 1] - ahead[:, i - 1])
                w = np.flatnonzero(change < -1e-9)
                if len(w):
                    better[w] = True
                    now[w] = _turned(now[w], i, j)
                    after[w] = _next(now[w])
                    ahead[w] = np.cumsum(arc(now[w], after[w], w) - arc(after[w], now[w], w), axis=1)
        order[at] = now
        at = at[better]
    return order


def shift(cost: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of up to three nodes move as in ``routing._shift``; also which routes changed."""
    n, order, moved = order.shape[1], order.copy(), np.zeros(len(order), bool)
    for size in (1, 2, 3):
        at, i = np.arange(len(order)), np.ones(len(order), int)
        while 1 + size <= n and len(at):
            now, c = order[at], (at * n * n)[:, None]
            arc = lambda a, b: cost.take(c + a * n + b)
            line, keep = np.arange(n)[None], np.arange(n - size)[None]
            part = np.take_along_axis(now, i[:, None] + np.arange(size)[None], 1)
            rest = np.take_along_axis(now, keep + size * (keep >= i[:, None]), 1)
            to = _next(rest)
            before, behind = np.take_along_axis(now, i[:, None] - 1, 1), np.take_along_axis(now, (i[:, None] + size) % n, 1)
            first, last = part[:, :1], part[:, -1:]
            gain = (arc(before, first) + arc(last, behind) - arc(before, behind))[:, 0]
            inner = arc(part[:, :-1], part[:, 1:]).sum(axis=1) - arc(part[:, 1:], part[:, :-1]).sum(axis=1)
            straight = arc(rest, first) + arc(last, to) - arc(rest, to)
            turned = arc(rest, last) + arc(first, to) - arc(rest, to) - inner[:, None]
            least = np.minimum(straight, turned)
            k = least.argmin(axis=1)
            row = np.arange(len(at))
            s, t = straight[row, k], turned[row, k]
            helps = np.where(t < s, t, s) - gain < -1e-9
            w = np.flatnonzero(helps)
            if len(w):
                put, kw = np.where((s <= t)[w, None], part[w], part[w, ::-1]), k[w, None]
                spot = line - kw - 1
                order[at[w]] = np.where(
                    line <= kw, np.take_along_axis(rest[w], np.minimum(line, n - size - 1) + 0 * kw, 1),
                    np.where(spot < size, np.take_along_axis(put, np.clip(spot, 0, size - 1), 1), np.take_along_axis(rest[w], np.maximum(line - size, 0) + 0 * kw, 1)),
                )
                moved[at[w]] = True
            i = np.where(helps, i, i + 1)
            go = i + size <= n
            at, i = at[go], i[go]
    return order, moved


def settle(cost: np.ndarray, order: np.ndarray) -> np.ndarray:
    order, at, n = order.copy(), np.arange(len(order)), order.shape[1]
    while len(at):
        own = cost.reshape(-1, n * n)[at].ravel()
        order[at], moved = shift(own, turn(own, order[at]))
        at = at[moved]
    return order


def tours(cost: np.ndarray, orders, kicks: int) -> np.ndarray:
    """``routing.tour`` of each of the matrices ``cost`` [route, from, to]; ``orders(n)`` lists all orders of few nodes."""
    rows, n = cost.shape[:2]
    if n <= 2:
        return np.tile(np.arange(n), (rows, 1))
    if n <= 7:
        every = orders(n)
        out = np.empty((rows, n), int)
        for part in _chunks(rows, len(every)):
            sums = 0.0
            for a, b in zip(every.T, np.roll(every, -1, axis=1).T):
                sums = sums + cost[part].reshape(-1, n * n).take(a * n + b, axis=1)
            out[part] = every[sums.argmin(axis=1)]
        return out
    flat, c, row = np.ascontiguousarray(cost).ravel(), np.arange(rows)[:, None] * n * n, np.arange(rows)
    order, left = np.zeros((rows, n), int), np.ones((rows, n), bool)
    left[:, 0] = False
    for p in range(1, n):
        order[:, p] = np.where(left, cost[row, order[:, p - 1]], np.inf).argmin(axis=1)
        left[row, order[:, p]] = False
    total = lambda o: flat.take(c + o * n + _next(o)).sum(axis=1)
    best = settle(flat, order)
    rng = np.random.default_rng(n)
    for _ in range(kicks):
        x, y, z = np.sort(rng.choice(np.arange(1, n), 3, replace=False))
        new = settle(flat, np.concatenate([best[:, :x], best[:, y:z], best[:, x:y], best[:, z:]], axis=1))
        best = np.where((total(new) < total(best) - 1e-9)[:, None], new, best)
    return best


class Timed:
    """Routes of one size under windows and shifts; orders hold nodes 1.. of the routes ``who``."""

    def __init__(self, seconds, cost, start, end, service, shift):
        self.rows, self.n = start.shape
        self.seconds, self.cost = np.ascontiguousarray(seconds).ravel(), np.ascontiguousarray(cost).ravel()
        self.start, self.end, self.service, self.shift = start.ravel(), end.ravel(), service.ravel(), shift

    def kept(self, order: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Which orders keep all windows and the shift."""
        n, t, at, ok = self.n, np.zeros(len(who)), np.zeros(len(who), int), np.ones(len(who), bool)
        for k in order.T:
            t = np.maximum(t + self.seconds.take((who * n + at) * n + k), self.start.take(who * n + k))
            ok &= ~(t > self.end.take(who * n + k))
            t, at = t + self.service.take(who * n + k), k
        return ok & (t + self.seconds.take((who * n + at) * n) <= self.shift[who])

    def total(self, order: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Costs, rounded as Python's ``sum`` does."""
        n, at = self.n, np.zeros(len(who), int)
        high, low = None, np.zeros(len(who))
        with np.errstate(invalid="ignore"):
            for k in [*order.T, np.zeros(len(who), int)]:
                x = self.cost.take((who * n + at) * n + k)
                if high is None:
                    high = x
                else:
                    t = high + x
                    low += np.where(np.abs(high) >= np.abs(x), (high - t) + x, (x - t) + high)
                    high = t
                at = k
            return np.where(np.isfinite(low), high + low, high)

    def entered(self, urgency: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stops enter in order of urgency at their cheapest place: routes where all found one, and their orders."""
        turns = urgency[:, 1:].argsort(axis=1, kind="stable") + 1
        who = np.arange(self.rows)
        order = np.zeros((self.rows, 0), int)
        for step in range(self.n - 1):
            k = turns[who, step][:, None]
            best, place = np.full(len(who), np.inf), np.full(len(who), -1)
            for p in range(step + 1):
                new = np.concatenate([order[:, :p], k, order[:, p:]], axis=1)
                w = np.flatnonzero(self.kept(new, who))
                cost = self.total(new[w], who[w])
                less = (cost < best[w]) | (place[w] < 0)
                best[w[less]], place[w[less]] = cost[less], p
            w = np.flatnonzero(place >= 0)
            who, order, k, place = who[w], order[w], k[w], place[w][:, None]
            line = np.arange(step + 1)[None] + 0 * place
            old = np.concatenate([order, k], axis=1)
            order = np.where(line < place, old, np.where(line == place, k, np.take_along_axis(old, np.maximum(line - 1, 0), 1)))
        return who, order

    def possible(self, who: np.ndarray) -> np.ndarray:
        """Those of the routes for which some order keeps all windows and the shift: the earliest time after each (set served, last node)."""
        n, m, found = self.n, self.n - 1, []
        for part in _chunks(len(who), (1 << m) * m):
            w = who[part]
            seconds = self.seconds.reshape(-1, n, n)[w]
            of = lambda a: a.reshape(-1, n)[w, 1:]
            start, end, service = of(self.start), of(self.end), of(self.service)
            reach = np.full((1 << m, len(w), m), np.inf)
            for served in range((1 << m) - 1):
                if served:
                    if not np.isfinite(reach[served]).any():
                        continue
                    last = [k for k in range(m) if served >> k & 1]
                    t = (reach[served][:, last, None] + seconds[:, [k + 1 for k in last], 1:]).min(axis=1)
                else:
                    t = seconds[:, 0, 1:]
                t = np.maximum(t, start)
                t = np.where(t <= end, t + service, np.inf)
                for k in range(m):
                    if not served >> k & 1:
                        reach[served | 1 << k, :, k] = t[:, k]
            done = reach[-1]
            found.append(w[(np.isfinite(done) & (done + seconds[:, 1:, 0] <= self.shift[w][:, None])).any(axis=1)])
        return np.concatenate(found) if found else who[:0]

    def improved(self, order: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Stops and reversed stretches move while that lowers the cost."""
        order, best, m = order.copy(), self.total(order, who), self.n - 1
        at = np.arange(len(who))
        while len(at):
            now, own, low, better = order[at], who[at], best[at], np.zeros(len(at), bool)
            for i in range(m):
                for j in range(m):
                    if i == j:
                        continue
                    line = [p for p in range(m) if p != i]
                    line.insert(j, i)
                    ways = [now[:, line]]
                    if j > i + 1:
                        ways.append(_turned(now, i, j))
                    for new in ways:
                        cost = self.total(new, own)
                        w = np.flatnonzero(cost < low - 1e-9)
                        w = w[self.kept(new[w], own[w])]
                        now[w], low[w], better[w] = new[w], cost[w], True
            order[at], best[at] = now, low
            at = at[better]
        return order


def timed_tours(seconds, cost, start, end, service, shift, exact: int, complete) -> tuple[np.ndarray, np.ndarray]:
    """``routing.timed_tour`` of routes of one size: orders, and which routes have one; ``complete`` is the full search for an order of a single route."""
    r = Timed(seconds, cost, start, end, service, shift)
    order, best, has = np.zeros((r.rows, r.n - 1), int), np.full(r.rows, np.inf), np.zeros(r.rows, bool)
    for urgency in (end, start, end - start):
        who, new = r.entered(urgency)
        cost_ = r.total(new, who)
        less = (cost_ < best[who]) | ~has[who]
        order[who[less]], best[who[less]] = new[less], cost_[less]
        has[who] = True
    if r.n - 1 <= exact:
        for w in r.possible(np.flatnonzero(~has)):
            order[w] = complete(seconds[w].tolist(), start[w].tolist(), end[w].tolist(), service[w].tolist(), float(shift[w]))
            has[w] = True
    who = np.flatnonzero(has)
    order[who] = r.improved(order[who], who)
    return order, has
