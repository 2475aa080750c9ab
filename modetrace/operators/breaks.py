"""Breaks of the speed profile by optimal change points.

A trip's speeds (whole mm/s) are cut where the sum of squared deviations from the
means of the parts, plus ``break_penalty`` a part, is least. Optimal partitioning finds
that exactly: the best cut of the points up to j comes from the best cuts up to some i
before, whose costs are differences of prefix sums; an i that was once so much worse
that no later part can make up for it is pruned. Costs are whole numbers, and of equal
cuts the one with the earliest last part wins. Points without a speed cost nothing.

A trip is searched in pieces of ``break_points`` points. Where two pieces meet there is a
break unless the parts on both sides are cheaper as one; a trip of one piece has its
optimum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modetrace.config import DEFAULTS, Settings
from modetrace.functions.grouped import whole_groups
from modetrace.functions.motion import by_time, with_motion

TRIP = ("user_id", "trip_id")
#: Points of a profile that is searched together with others.
SHORT = 1024


def cost(n, total, squares):
    """Squared deviations from the mean, in whole numbers."""
    return np.where(n > 0, np.rint(squares - total * total / np.maximum(n, 1)), 0.0)


def partition(speeds: np.ndarray, penalty: int) -> list[int]:
    """Where the parts of the best cut begin, 0 first; NaN is no speed."""
    known = ~np.isnan(speeds)
    x = np.where(known, speeds, 0.0)
    n, total, squares = (np.concatenate([[0.0], np.cumsum(v)]) for v in (known, x, x * x))
    size = len(x)
    best, back = np.zeros(size + 1), np.zeros(size + 1, dtype=np.int64)
    left = np.array([0])  # beginnings that may still be best
    for j in range(1, size + 1):
        whole = best[left] + cost(n[j] - n[left], total[j] - total[left], squares[j] - squares[left])
        k = int(np.argmin(whole))
        best[j], back[j] = whole[k] + penalty, left[k]
        left = np.append(left[whole <= best[j] + 2], j)  # costs are rounded, so add up within 2
    starts, j = [], size
    while j:
        j = int(back[j])
        starts.append(j)
    return starts[::-1]


def partitions(profiles: list[np.ndarray], penalty: int) -> list[np.ndarray]:
    """``partition`` of each. Profiles of up to SHORT points go through the same steps
    side by side, the longest first, so that a step is one operation for all that are as
    long; nothing is pruned there."""
    found = [np.array(partition(x, penalty)) if len(x) > SHORT else None for x in profiles]
    order = sorted((k for k, f in enumerate(found) if f is None), key=lambda k: -len(profiles[k]))
    if not order:
        return found
    sizes = np.array([len(profiles[k]) for k in order])
    x = np.full((len(order), sizes[0]), np.nan)
    for row, k in enumerate(order):
        x[row, : sizes[row]] = profiles[k]
    known = ~np.isnan(x)
    x = np.where(known, x, 0.0)
    n, total, squares = (np.pad(np.cumsum(v, axis=1, dtype=float), ((0, 0), (1, 0))) for v in (known, x, x * x))
    best, back = np.zeros(n.shape), np.zeros(n.shape, dtype=np.int64)
    for j in range(1, sizes[0] + 1):
        a = int(np.count_nonzero(sizes >= j))
        whole = best[:a, :j] + cost(*(v[:a, j : j + 1] - v[:a, :j] for v in (n, total, squares)))
        back[:a, j] = whole.argmin(axis=1)
        best[:a, j] = whole.min(axis=1) + penalty
    for row, k in enumerate(order):
        starts, j = [], int(sizes[row])
        while j:
            j = int(back[row, j])
            starts.append(j)
        found[k] = np.array(starts[::-1])
    return found


def optimal_breaks(trips: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Points with motion columns and seg_id. Trips come to Python in order, many at a
    time; the rest of their columns stays as it is."""
    w, penalty = by_time(*TRIP), s.break_penalty
    moved = with_motion(trips, *TRIP)
    number = F.row_number().over(w)
    pieces = moved.withColumns({"mmps": F.round(F.col("v") * 1000), "begins": number == 1, "starts": number % s.break_points == (1 % s.break_points)})
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in moved.schema)
    columns = moved.columns

    def cut_all(batches):
        seg, before = 0, None  # the trip's last segment, and (n, total, squares) of its last part
        for rows in whole_groups(batches, "starts"):
            x, begins, starts = (rows.column(c).to_numpy() for c in ("mmps", "begins", "starts"))
            known = np.where(np.isnan(x), 0.0, x)
            ids = np.empty(len(x), dtype=np.int64)
            bounds = [*np.flatnonzero(starts).tolist(), len(x)]
            cuts = partitions([x[a:b] for a, b in zip(bounds, bounds[1:])], penalty)
            for a, b, parts in zip(bounds, bounds[1:], cuts):
                have, total, squares = (np.add.reduceat(v[a:b], parts) for v in ((~np.isnan(x)).astype(float), known, known * known))
                if begins[a]:
                    seg = 0
                else:  # a break, unless the parts that meet are cheaper as one
                    here = have[0], total[0], squares[0]
                    both = cost(*(p + q for p, q in zip(here, before)))
                    seg += int(both > cost(*here) + cost(*before) + penalty)
                ids[a:b] = seg + np.searchsorted(parts, np.arange(b - a), side="right") - 1
                seg, before = int(ids[b - 1]), (have[-1], total[-1], squares[-1])
            yield from rows.select(columns).append_column("seg_id", pa.array(ids)).to_batches()

    return pieces.sortWithinPartitions(*TRIP, "t", "event_id").mapInArrow(cut_all, f"{fields}, seg_id long")
