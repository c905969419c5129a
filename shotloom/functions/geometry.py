"""Shot geometry on a pitch of 120 by 80 yards, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTH, WIDTH = 120.0, 80.0
POSTS = (36.0, 44.0)


def is_valid_location(x: Column, y: Column) -> Column:
    """Both coordinates finite and on the pitch; false for nulls."""
    inside = x.between(0, LENGTH) & y.between(0, WIDTH) & ~F.isnan(x) & ~F.isnan(y)
    return F.coalesce(inside, F.lit(False))


def shot_distance(x: Column, y: Column) -> Column:
    """Yards to the middle of the goal."""
    return F.sqrt((LENGTH - x) * (LENGTH - x) + (WIDTH / 2 - y) * (WIDTH / 2 - y))


def shot_angle(x: Column, y: Column) -> Column:
    """Radians between the lines to the posts: 0 to pi."""
    return F.atan2((POSTS[1] - POSTS[0]) * F.abs(LENGTH - x), (LENGTH - x) * (LENGTH - x) + (y - POSTS[0]) * (y - POSTS[1]))


def marker_radius(xg: Column) -> Column:
    """A shot's radius on a pitch map; fixed where no probability is known."""
    return F.coalesce(1.05 + 4.2 * F.least(F.greatest(xg, F.lit(0.0)), F.lit(1.0)), F.lit(1.35))
