"""The cutting-stock linear program over patterns of lengths, by column generation.

A pattern says how often each length stands in one sequence, which it fills exactly.  A
piece that no pattern takes must be cut up, and the program uses every length as often as
it is there with the fewest tokens cut up, which is also the fewest sequences.  The
revised simplex starts from a filling by the longest lengths that fit; a knapsack over
exact fillings prices new patterns.  It stops where the share of tokens cut up, or what it
may lie over the least possible one, is at most `gap`, whatever number of pivots that takes.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np

GAP = 5e-4
#: Rounding leaves up to a sequence a pattern, so for few sequences the gap is this share of it.
ROUNDED = 2e-3
SMOOTH = 0.8
#: With fewer usable patterns than this from a knapsack without bounds, bounds on the counts are kept from then on.
FEW = 8
#: Pivots after which the basis is inverted anew, against rounding errors.
REFRESH = 200


def knapsack(lengths: np.ndarray, values: np.ndarray, most: np.ndarray, capacity: int, lack: int) -> np.ndarray | None:
    """The filling of greatest value, less a token's worth for each token that it lacks, that
    takes at most most[i] of each length and lacks at most `lack`; None if there is none."""
    best = np.full(capacity + 1, -np.inf)
    best[0] = 0
    steps: list[tuple[int, int, np.ndarray]] = []
    for i, length in enumerate(lengths.tolist()):
        left, size = min(int(most[i]), capacity // length), 1
        while left > 0:
            size = min(size, left)
            left -= size
            weight = size * length
            candidate = best[: capacity + 1 - weight] + size * values[i]
            better = candidate > best[weight:] + 1e-9
            best[weight:][better] = candidate[better]
            steps.append((i, size, better))
            size *= 2
    at = _best_fill(best, capacity, lack)
    if not np.isfinite(best[at]):
        return None
    out = np.zeros(len(lengths), np.int64)
    for i, size, better in reversed(steps):
        weight = size * int(lengths[i])
        if at >= weight and better[at - weight]:
            out[i] += size
            at -= weight
    return out


def _best_fill(best: np.ndarray, capacity: int, lack: int) -> int:
    return capacity - int(np.argmax(best[capacity - lack :][::-1] - np.arange(lack + 1)))


def fillings(lengths: np.ndarray, values: np.ndarray, capacity: int, lack: int) -> list[np.ndarray]:
    """The best filling, as knapsack values it, through each length, as positions, best
    first, with no bound on how often a length is taken; lengths descend."""
    up, worth = lengths[::-1], values[::-1]
    best, choice = np.full(capacity + 1, -np.inf), np.full(capacity + 1, -1)
    best[0] = 0
    known = np.searchsorted(up, np.arange(capacity + 1), "right").tolist()
    for c in range(1, capacity + 1):
        if n := known[c]:
            sums = worth[:n] + best[c - up[:n]]
            j = int(sums.argmax())
            best[c], choice[c] = sums[j], j
    rooms = [_best_fill(best[: r + 1], r, min(lack, r)) for r in (capacity - up).tolist()]
    through = worth + best[rooms] - (capacity - up - rooms)
    out = []
    for i in np.argsort(-through, kind="stable").tolist():
        if through[i] <= 0:
            break
        pattern, at = [i], rooms[i]
        while at > 0:
            pattern.append(int(choice[at]))
            at -= int(up[pattern[-1]])
        out.append(len(lengths) - 1 - np.array(pattern))
    return out


def _start(lengths: list[int], demand: np.ndarray, capacity: int, lack: int) -> tuple[np.ndarray, np.ndarray]:
    """A triangular basis and its costs: sequences filled by the longest lengths left that fit,
    each pattern used until one of its lengths runs out.  Lengths whose filling lacks more
    than `lack` are cut up."""
    left, alive, place = demand.copy(), sorted(lengths), {n: i for i, n in enumerate(lengths)}
    basis, cost = np.zeros((len(lengths), len(lengths)), np.int64), np.array(lengths, float)
    while alive:
        room, j, column = capacity, len(alive), {}
        while room and (j := bisect_right(alive, room, 0, j)) > 0:
            j -= 1
            i = place[alive[j]]
            column[i] = min(room // alive[j], math.ceil(left[i]))
            room -= column[i] * alive[j]
        if room > lack:
            out = [min(column)]
            basis[out[0], out[0]] = 1
        else:
            used = np.array(list(column))
            counts = np.array(list(column.values()))
            times = (left[used] / counts).min()
            left[used] -= times * counts
            out = [i for i in column if left[i] <= 1e-9 * demand[i]]
            basis[used, out[0]] = counts
            cost[out[0]] = room
            basis[out[1:], out[1:]] = 1
        for i in out:
            alive.remove(lengths[i])
    return basis, cost


def column_generation(lengths: list[int], demand: np.ndarray, capacity: int, lack: int, gap: float = GAP) -> tuple[list[tuple[np.ndarray, float]], float]:
    """(patterns in the basis with their values, share of the tokens that the solution lacks
    or leaves to be cut up); lengths descend."""
    sizes, m = np.array(lengths), len(lengths)
    # demands without ties make every pivot a step, so the simplex can't cycle
    rhs = demand * (1 + 1e-5 * np.random.default_rng(m).random(m))
    total = float(sizes @ rhs)
    gap = max(gap, ROUNDED * m * capacity / total)
    (basis, cost), since, bounded = _start(lengths, rhs, capacity, lack), REFRESH, False
    cut = basis.sum(axis=0) * sizes == cost
    bound, center = -np.inf, None
    worth = lambda new, duals: float(duals @ new) - capacity + int(sizes @ new)
    while True:
        if since >= REFRESH:
            inverse = np.linalg.inv(basis.astype(float))
            x, since = inverse @ rhs, 0
        duals = cost @ inverse
        if cost @ x - max(bound, 0) <= gap * total:
            break
        # prices half-way to the duals of the best bound settle sooner; the duals themselves decide
        for prices in ([SMOOTH * center + (1 - SMOOTH) * duals] if center is not None else []) + [duals.copy()]:
            found = []
            if not bounded:  # patterns with more of a length than there are don't count
                patterns = [np.bincount(p, minlength=m) for p in fillings(sizes, prices, capacity, lack)]
                top = worth(patterns[0], prices) if patterns else 0.0
                found = [p for p in patterns if (p <= demand).all()]
                bounded = bool(patterns) and len(found) < FEW
            if bounded:
                new = knapsack(sizes, prices, demand, capacity, lack)
                found = [new] if new is not None else []
                top = worth(new, prices) if found else 0.0
            if (least := float(prices @ rhs) - total / (capacity - lack) * max(top, 0)) > bound:
                bound, center = least, prices
            moved = sum(_pivot(p, capacity - int(sizes @ p), basis, cost, cut, inverse, x, duals) for p in found)
            if moved:
                break
        else:
            if since == 0:  # no pattern lowers the cost
                break
        since += moved or REFRESH
    return [(basis[:, i], float(x[i])) for i in range(m) if not cut[i]], float(cost @ x) / total


def _pivot(new: np.ndarray, price: int, basis: np.ndarray, cost: np.ndarray, cut: np.ndarray, inverse: np.ndarray, x: np.ndarray, duals: np.ndarray) -> bool:
    """Take a pattern into the basis, in place, if it lowers the cost."""
    used = np.flatnonzero(new)
    worth = float(duals[used] @ new[used]) - price
    if worth <= 1e-6:
        return False
    direction = inverse[:, used] @ new[used]
    up = np.flatnonzero(direction > 1e-9)
    if not len(up):
        return False
    ratios = np.maximum(x[up], 0) / direction[up]
    step = float(ratios.min())
    out = int(up[ratios.argmin()])
    row = inverse[out] / direction[out]
    direction[out] = 0
    inverse -= np.outer(direction, row)
    inverse[out] = row
    x -= step * direction
    x[out] = step
    duals -= worth * row
    basis[:, out], cost[out], cut[out] = new, price, False
    return True
