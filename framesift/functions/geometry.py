"""Boxes, points and directions as columns. A box is array<double> [x1, y1, x2, y2]; a point is struct<x, y>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framesift.config import Trajectory


def center(box: Column) -> Column:
    return F.struct(((box[0] + box[2]) / 2).alias("x"), ((box[1] + box[3]) / 2).alias("y"))


def corner(box: Column) -> Column:
    """The upper left corner: among boxes of one size it moves as the centre does, without the rounding of the centre."""
    return F.struct(box[0].alias("x"), box[1].alias("y"))


def area(box: Column) -> Column:
    """Zero for a box that is turned inside out."""
    zero = F.lit(0.0)
    return F.greatest(zero, box[2] - box[0]) * F.greatest(zero, box[3] - box[1])


def iou(a: Column, b: Column) -> Column:
    both = F.array(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))
    union = area(a) + area(b) - area(both)
    return F.when(union <= 1e-8, F.lit(0.0)).otherwise(area(both) / union)


def distance(p: Column, q: Column) -> Column:
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    return F.sqrt(dx * dx + dy * dy)


def displacement(a: Column, b: Column) -> Column:
    return distance(center(a), center(b))


def direction(p: Column, q: Column) -> Column:
    """Degrees, by atan2; 0 for equal points."""
    return F.degrees(F.atan2(q["y"] - p["y"], q["x"] - p["x"]))


def angle_difference(a: Column, b: Column) -> Column:
    d = F.abs(a - b) % 360.0
    return F.least(d, 360.0 - d)


#: The eight names by sector, counter-clockwise from the right; y grows downwards.
COMPASS = ("right", "up-right", "up", "up-left", "left", "down-left", "down", "down-right")


def compass(p: Column, q: Column) -> Column:
    """The name of the 45-degree sector from p to q; 'stationary' if both axes move less than 1."""
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    sector = F.floor((F.degrees(F.atan2(-dy, dx)) + 382.5) / 45.0).cast("int") % 8
    return F.when((F.abs(dx) < 1) & (F.abs(dy) < 1), "stationary").otherwise(F.element_at(F.array(*map(F.lit, COMPASS)), sector + 1))


def motion_mode(dx: Column, dy: Column, turns: Column, t: Trajectory | None = None) -> Column:
    """The dominant mode of a trajectory, first rule that holds."""
    t = t or Trajectory()
    still = (F.abs(dx) < t.static_threshold) & (F.abs(dy) < t.static_threshold)
    up = (F.abs(dy) > F.abs(dx)) & (dy < -t.jump_vertical_threshold)
    level = F.abs(dx) >= F.abs(dy)
    return (
        F.when(still, "stationary").when(turns >= 1, "direction_change").when(up, "jumping_up")
        .when(level & (dx >= 0), "moving_right").when(level, "moving_left").when(dy >= 0, "moving_down").otherwise("moving_up")
    )


def compact(box: Column) -> Column:
    """'[x1, y1, x2, y2]', each rounded half to even."""
    return F.format_string("[%d, %d, %d, %d]", *(F.rint(box[i]).cast("long") for i in range(4)))
