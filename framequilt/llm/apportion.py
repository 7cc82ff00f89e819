"""Integer apportionment, on the driver: lists as long as the targets table, never as the data."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence


def largest_remainder(shares: Sequence[float], total: int, floors: Sequence[int], caps: Sequence[int]) -> list[int]:
    """Quotas that add up to ``total`` where caps allow it, each at least min(floor, cap) and at most its cap.

    Whole parts first, then the largest remainders, ties to the earlier entry. What a cap cuts off goes to the others in
    proportion; what floors add is taken from those above their floor.
    """
    n = len(shares)
    low = [min(f, c) for f, c in zip(floors, caps, strict=True)]
    quota: list[float] = [0.0] * n
    fixed: dict[int, int] = {}
    while len(fixed) < n:
        rest = total - sum(fixed.values())
        weight = sum(shares[i] for i in range(n) if i not in fixed)
        for i in range(n):
            if i not in fixed:
                quota[i] = max(0.0, rest) * shares[i] / weight if weight > 0 else 0.0
        over = {i: caps[i] - quota[i] for i in range(n) if i not in fixed and quota[i] > caps[i]}
        under = {i: low[i] - quota[i] for i in range(n) if i not in fixed and quota[i] < low[i]}
        if not over and not under:
            break
        # as in apportionment with bounds on both sides: settle the side that binds more
        if -sum(over.values()) >= sum(under.values()):
            fixed.update({i: caps[i] for i in over})
        else:
            fixed.update({i: low[i] for i in under})
    out = [fixed.get(i, math.floor(quota[i] + 1e-9)) for i in range(n)]
    order = sorted((i for i in range(n) if i not in fixed), key=lambda i: (-(quota[i] - out[i]), i))
    missing = total - sum(out)
    for i in order:
        if missing <= 0:
            break
        if out[i] < caps[i]:
            out[i] += 1
            missing -= 1
    for i in sorted(range(n), key=lambda i: (-shares[i], i)):  # rounding against caps
        if missing <= 0:
            break
        more = min(missing, caps[i] - out[i])
        out[i] += more
        missing -= more
    return out


def sainte_lague(weights: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Seats by the highest quotients weight / (2 s + 1), no entry above its cap; fewer seats in all where caps are too low.

    A multiplier found by bisection gives all but the last few seats (the method's divisor form), then the quotients are
    compared one by one; ties go to the earlier entry. The work doesn't depend on the number of seats.
    """
    n = len(weights)
    seats = min(seats, sum(c for w, c in zip(weights, caps, strict=True) if w > 0))
    if seats <= 0:
        return [0] * n

    def at(m: float) -> list[int]:
        return [min(c, math.floor(w * m + 0.5)) if w > 0 else 0 for w, c in zip(weights, caps, strict=True)]

    lo, hi = 0.0, 1.0
    while sum(at(hi)) < seats:
        lo, hi = hi, hi * 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(at(mid)) <= seats:
            lo = mid
        else:
            hi = mid
    out = at(lo)
    heap = [(-weights[i] / (2 * out[i] + 1), i) for i in range(n) if weights[i] > 0 and out[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * out[i] + 1), i))
    return out
