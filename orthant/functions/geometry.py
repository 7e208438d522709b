"""Column expressions over 3-D integer points: exact distances, boxes, octants and frames.

Coordinates lie in [-2^62, 2^62). Differences and squares are taken in DECIMAL, so nothing wraps; a sphere's box is
tested first, which bounds the squares (for radii up to MAX_RADIUS the sum fits DECIMAL(38)).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF = 1 << 62
MAX_RADIUS = 5_773_502_691_896_257_644
AXES = ("x", "y", "z")


def point(x, y, z) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(*(as_column(v).cast("long").alias(a) for a, v in zip(AXES, (x, y, z))))


def wide(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def dist2(p: Column, q: Column) -> Column:
    """Squared distance as DECIMAL(38,0)."""
    return reduce(lambda a, b: a + b, ((d := wide(p[a]) - wide(q[a])) * d for a in AXES)).cast("decimal(38,0)")


def in_box(p: Column, low: Column, high: Column) -> Column:
    """Half-open box."""
    return reduce(lambda a, b: a & b, ((p[a] >= low[a]) & (p[a] < high[a]) for a in AXES))


def near_box(p: Column, q: Column, r) -> Column:
    """All axes within r: the conjuncts that scans can push down when q and r are literals."""
    r = r if isinstance(r, Column) else F.lit(r)
    return reduce(lambda a, b: a & b, (F.abs(wide(p[a]) - wide(q[a])) <= r.cast("decimal(20,0)") for a in AXES))


def within(p: Column, q: Column, r) -> Column:
    """Inclusive sphere test, exact."""
    r = r if isinstance(r, Column) else F.lit(r)
    return F.when(near_box(p, q, r), dist2(p, q) <= (r.cast("decimal(19,0)") * r.cast("decimal(19,0)"))).otherwise(False)


def sphere_meets_box(center: Column, r, low: Column, high: Column) -> Column:
    """Whether a sphere meets a closed box: the centre clamped to it is within r."""
    clamped = F.struct(*(F.greatest(low[a], F.least(high[a], center[a])).alias(a) for a in AXES))
    return within(clamped, center, r)


def octant(p: Column, mid: Column) -> Column:
    return reduce(lambda a, b: a + b, ((p[a] >= mid[a]).cast("int") * w for a, w in zip(AXES, (4, 2, 1))))


def midpoint(a: Column, b: Column) -> Column:
    """Floor of the mean, without overflow."""
    return a.bitwiseAND(b) + F.shiftright(a.bitwiseXOR(b), 1)


def child_bounds(low: Column, high: Column) -> Column:
    """octant, low, high of the eight children of a box, in order of octant."""
    mid = {a: midpoint(low[a], high[a]) for a in AXES}
    children = []
    for i in range(8):
        upper = dict(zip(AXES, (i & 4, i & 2, i & 1)))
        from_, to = (F.struct(*((mid[a] if bool(upper[a]) == near else end[a]).alias(a) for a in AXES)) for near, end in ((True, low), (False, high)))
        children.append(F.struct(F.lit(i).alias("octant"), from_.alias("low"), to.alias("high")))
    return F.array(*children)


def distance_to(p: Column, q: Column) -> Column:
    """Distance cut to a whole number."""
    return F.sqrt(dist2(p, q).cast("double")).cast("int")


def cell_axis(c: Column, depth) -> Column:
    """Number of the cell along an axis at a depth (root cube: depth 0, one cell)."""
    shift = F.lit(63) - (depth if isinstance(depth, Column) else F.lit(depth))
    return F.call_function("shiftright", c + F.lit(HALF), shift.cast("int"))


def cell_key(p: Column, depth) -> Column:
    """depth:x:y:z of the cell that holds a point."""
    depth = depth if isinstance(depth, Column) else F.lit(depth)
    return F.concat_ws(":", depth.cast("string"), *(cell_axis(p[a], depth).cast("string") for a in AXES))


def outer_to_inner(c: Column, outer_low, outer_high, inner_low, inner_high) -> Column:
    """innerLow + (c - outerLow) * (innerSize div outerSize); null outside the outer box."""
    ratio = (inner_high - inner_low) // (outer_high - outer_low)
    return F.when((c >= outer_low) & (c < outer_high), F.lit(inner_low) + (c - outer_low) * F.lit(ratio))


def inner_to_outer(c: Column, outer_low, outer_high, inner_low, inner_high) -> Column:
    ratio = (inner_high - inner_low) // (outer_high - outer_low)
    offset = c - inner_low
    return (F.lit(outer_low) + (offset - F.pmod(offset, F.lit(ratio))) / F.lit(ratio)).cast("long")


def effective_velocity(v: Column, least_axis: int = 10, least_sum: int = 20) -> Column:
    """v where its largest component and its sum reach the thresholds, else zero."""
    size = [F.abs(v[a]) for a in AXES]
    moves = (F.greatest(*size) >= least_axis) & (reduce(lambda a, b: a + b, size) >= least_sum)
    return F.when(moves, v).otherwise(F.struct(*(F.lit(0).cast("int").alias(a) for a in AXES)))
