"""Shapes of components as column expressions: areas, convex hulls and the score of bubble candidates. Points are structs of whole x and y."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import bound

# What a bubble's outline has to be like.
BORDER, ASPECT, FILL, WHITE, TEXT, DARK_ROW, SOLIDITY = 3, (0.25, 5.0), 0.45, 0.55, (0.008, 0.35), 0.12, 0.78


def _cross(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def polygon_area2(points: Column) -> Column:
    """Twice the area of a polygon given by its corners in order."""

    def area(of: Column) -> Column:
        parts = F.transform(of, lambda p, i: p["x"] * F.get(of, (i + 1) % F.size(of))["y"] - p["y"] * F.get(of, (i + 1) % F.size(of))["x"])
        return F.abs(F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x))

    return bound(points, area)


def _half_hull(points: Column) -> Column:
    """One side of the hull of sorted points: a point takes those from the end of the side that do not turn left towards it."""

    def add(side: Column, p: Column) -> Column:
        # How many of the side stay: looked at from its end until one turns left.
        kept = F.aggregate(
            F.sequence(F.size(side), F.lit(2), F.lit(-1)),
            F.struct(F.size(side).alias("n"), F.lit(False).alias("left")),
            lambda a, k: F.when(a["left"] | (_cross(F.element_at(side, k - 1), F.element_at(side, k), p) > 0), F.struct(a["n"].alias("n"), F.lit(True).alias("left"))).otherwise(F.struct((a["n"] - 1).alias("n"), F.lit(False).alias("left"))),
        )["n"]
        return F.when(F.size(side) < 2, F.array_append(side, p)).otherwise(F.array_append(F.slice(side, F.lit(1), kept), p))

    return F.aggregate(points, F.array().cast("array<struct<x:bigint,y:bigint>>"), add)


def hull(points: Column) -> Column:
    """The corners of the convex hull, in order; fewer than three points are their own."""
    whole = F.array_sort(F.array_distinct(F.transform(points, lambda p: F.struct(p["x"].cast("long").alias("x"), p["y"].cast("long").alias("y")))))
    ends = lambda side: bound(side, lambda s: F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))))
    return bound(whole, lambda w: F.when(F.size(w) < 3, w).otherwise(F.concat(ends(_half_hull(w)), ends(_half_hull(F.reverse(w))))))


def solidity(points: Column) -> Column:
    """The share of a contour's area in its hull's; null if that has none."""
    return bound(polygon_area2(hull(points)), lambda of: F.when(of > 0, polygon_area2(points) / of))


def is_bubble(x: Column, y: Column, w: Column, h: Column, area: Column, white: Column, text: Column, peak: Column, contour: Column, page_w: Column, page_h: Column, least: Column | int) -> Column:
    """Whether a component may be a bubble: away from the page's border, neither long nor small, filling its box, white inside with some dark text,

    nearly convex, and with a row of text: peak is the most dark pixels of a row. The cheap conditions come first, as the hull is made only for what passes them.
    """
    inside = (x > BORDER) & (y > BORDER) & (x + w < page_w - BORDER) & (y + h < page_h - BORDER)
    shaped = (w > 0) & (h > 0) & (w / F.nullif(h, F.lit(0))).between(*ASPECT) & (area >= least) & (area > 0) & (area / F.nullif(w * h, F.lit(0)) >= FILL)
    inked = (white / F.nullif(area, F.lit(0)) >= WHITE) & (text / F.nullif(area, F.lit(0))).between(*TEXT) & (peak / F.nullif(w, F.lit(0)) >= DARK_ROW)
    cheap = F.coalesce(inside & shaped & inked, F.lit(False))
    return F.when(cheap, F.coalesce(solidity(contour) >= SOLIDITY, F.lit(False))).otherwise(F.lit(False))
