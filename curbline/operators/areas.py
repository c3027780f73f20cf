"""Which area a point lies in: shapes on a grid, then an exact test.

Shapes go to every grid cell that their bounding box touches, points to the one they lie in, and
both meet in an equi-join on the cell. What meets is tested exactly by counting the edges that a line
from the point crosses. No point meets a shape of another part of the map, and a cell with very
many points spreads as any join key does. Everything is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Edge of a grid cell in degrees.
CELL = 0.01


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(size)).cast("bigint")


def inside(ring: Column, lat: Column, lng: Column) -> Column:
    """Whether the point lies in the closed ring of ``(lat, lng)`` structs, by the even-odd rule.

    An edge counts from its lower end up to, and without, its upper one, so a point on a border that two
    areas share lies in exactly one of them. Rings of fewer than three points hold nothing.
    """
    n = F.size(ring)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, (i + 1) % n).alias("b")))

    def crosses(e: Column) -> Column:
        a_lat, a_lng, b_lat, b_lng = e["a"]["lat"], e["a"]["lng"], e["b"]["lat"], e["b"]["lng"]
        spans = (a_lat > lat) != (b_lat > lat)
        at = F.try_divide((b_lng - a_lng) * (lat - a_lat), b_lat - a_lat) + a_lng
        return spans & (lng < at)

    odd = F.size(F.filter(edges, crosses)) % 2 == 1
    return F.when(n >= 3, odd).otherwise(F.lit(False))


def area_join(
    points: DataFrame, areas: DataFrame, area: str, ring: str = "ring", lat: str = "latitude", lng: str = "longitude", size: float = CELL
) -> DataFrame:
    """``points`` with the smallest ``area`` whose ring holds them, NULL for none or without a place.

    ``areas``: ``area`` and ``ring`` (array of ``lat``, ``lng`` structs). ``points`` need no key.
    """
    shapes = areas.filter(F.size(ring) >= 3).select(F.col(area).alias("_area"), F.col(ring).alias("_ring"))

    def span(part: str) -> Column:
        values = F.transform("_ring", lambda p: p[part])
        return F.explode(F.sequence(_cell(F.array_min(values), size), _cell(F.array_max(values), size)))

    covered = shapes.withColumn("_row", span("lat")).withColumn("_column", span("lng"))
    # Per cell the shapes as one array: as many as overlap there, so every point meets one row.
    cells = covered.groupBy("_row", "_column").agg(F.array_sort(F.collect_list(F.struct("_area", "_ring"))).alias("_shapes"))
    placed = points.withColumns({"_row": _cell(F.col(lat), size), "_column": _cell(F.col(lng), size)})
    held = F.filter("_shapes", lambda s: inside(s["_ring"], F.col(lat), F.col(lng)))
    found = placed.join(cells, ["_row", "_column"], "left")
    return found.withColumn(area, F.get(held, F.lit(0))["_area"]).select(*points.columns, area)
