"""Planar geometry as column expressions: angles, box corners, field-of-view bins."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi


def wrap(angle: Column) -> Column:
    """The angle in [-pi, pi); the remainder follows the divisor's sign, so +pi becomes -pi."""
    return angle + math.pi - TWO_PI * F.floor((angle + math.pi) / TWO_PI) - math.pi


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def sensor_position(x: Column, y: Column, heading: Column, forward: float, left: float) -> tuple[Column, Column]:
    """The sensor's place on an ego at x, y, by its offsets forward and to the left."""
    return (
        x + forward * F.cos(heading) - left * F.sin(heading),
        y + forward * F.sin(heading) + left * F.cos(heading),
    )


#: Signs of half length and half width at the four corners, clockwise from the front left.
CORNERS = ((1, 1), (1, -1), (-1, -1), (-1, 1))


def box_corners(x: Column, y: Column, dx: Column, dy: Column, yaw: Column) -> list[tuple[Column, Column]]:
    """The corners of a box with length dx and width dy, turned by yaw about its centre."""
    out = []
    for a, b in CORNERS:
        u, v = dx / 2.0 * a, dy / 2.0 * b
        out.append((u * F.cos(yaw) - v * F.sin(yaw) + x, u * F.sin(yaw) + v * F.cos(yaw) + y))
    return out


def fov_bin(bearing: Column, half_fov: Column, bins: int) -> Column:
    """The bin of a relative bearing inside the field of view; bins span the field of view, not the circle."""
    width = half_fov * 2.0 / bins
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((bearing + half_fov) / width).cast("int")))


def fills_round_the_back(half_fov: Column, lo: Column, hi: Column, bins: int) -> Column:
    """At a full circle, corners more than half the bins apart belong to an object behind the ego."""
    return (half_fov * 2.0 >= TWO_PI - 1e-6) & (hi - lo > bins // 2)


def angular_span(bearings: Column) -> Column:
    """Start and end of the smallest arc that covers an array of bearings: what the largest gap between neighbours leaves."""
    a = F.array_sort(F.transform(bearings, wrap))
    gaps = F.transform(a, lambda x, i: F.struct((F.coalesce(F.try_element_at(a, i + 2), F.element_at(a, 1) + TWO_PI) - x).alias("gap"), (-i).alias("first"), x.alias("stop"), F.coalesce(F.try_element_at(a, i + 2), F.element_at(a, 1)).alias("start")))
    best = F.array_max(gaps)
    none = F.struct(F.lit(0.0).alias("start"), F.lit(0.0).alias("stop"))
    return F.when(F.size(a) == 0, none).otherwise(F.struct(best["start"].alias("start"), best["stop"].alias("stop")))


def span_of_four(r0: Column, r1: Column, r2: Column, r3: Column) -> Column:
    """`angular_span` of four bearings in [-pi, pi), such as a box's corners: in order by comparing, without an array."""
    a, b, c, d = F.least(r0, r1), F.greatest(r0, r1), F.least(r2, r3), F.greatest(r2, r3)
    first, last = F.least(a, c), F.greatest(b, d)
    m, n = F.greatest(a, c), F.least(b, d)
    second, third = F.least(m, n), F.greatest(m, n)
    gaps = (second - first, third - second, last - third, first + TWO_PI - last)
    ends = ((first, second), (second, third), (third, last), (last, first))
    widest = F.greatest(*gaps)
    out = None
    for gap, (stop, start) in zip(gaps, ends, strict=True):
        found = F.struct(start.alias("start"), stop.alias("stop"))
        out = F.when(gap == widest, found) if out is None else out.when(gap == widest, found)
    return out
