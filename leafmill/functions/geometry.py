"""Geometry over spans: ends, leader clustering, nearest columns, matrices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def span_end(x: Column, end_x: Column, text: Column, size: Column) -> Column:
    """Where a span ends; estimated as half the size a character where it does not say."""
    return F.when(end_x > x, end_x).otherwise(x + F.length(text) * size * 0.5)


def leader_clusters(values: Column, tolerance: float) -> Column:
    """Of an array of numbers in order: (leaders, which). A number joins the first leader nearer than the tolerance,
    or becomes a leader; which has each number's leader, from 1. Put the result through explode(array(...)) before
    another lambda uses it, or it is computed anew for every element."""
    start = F.struct(F.array().cast("array<double>").alias("leaders"), F.array().cast("array<int>").alias("which"))

    def step(acc: Column, v: Column) -> Column:
        at = F.array_position(F.transform(acc["leaders"], lambda x: F.abs(v - x) < tolerance), True).cast("int")
        fresh = at == 0
        leaders = F.when(fresh, F.array_append(acc["leaders"], v)).otherwise(acc["leaders"])
        return F.struct(leaders.alias("leaders"), F.array_append(acc["which"], F.when(fresh, F.size(leaders)).otherwise(at)).alias("which"))

    return F.aggregate(values, start, step)


def top_down_lines(ys: Column, tolerance: float) -> Column:
    """Of heights in falling order, the number of each one's line from 0: a line ends where a height is further than
    the tolerance from the line's first."""
    start = F.struct(F.lit(None).cast("double").alias("top"), F.lit(-1).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, y: Column) -> Column:
        fresh = acc["top"].isNull() | (F.abs(y - acc["top"]) > tolerance)
        n = acc["n"] + F.when(fresh, 1).otherwise(0)
        return F.struct(F.when(fresh, y).otherwise(acc["top"]).alias("top"), n.alias("n"), F.array_append(acc["out"], n).alias("out"))

    return F.aggregate(ys, start, step, lambda acc: acc["out"])


def spaced(sorted_structs: Column, spacing: float) -> Column:
    """Of structs with x in order, those that stand at least spacing from the last one kept."""

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)["x"]
        return F.when((F.size(acc) > 0) & (s["x"] - last < spacing), acc).otherwise(F.array_append(acc, s))

    return F.aggregate(sorted_structs, F.slice(sorted_structs, 1, 0), step)


def nearest(x: Column, columns: Column) -> Column:
    """The number, from 0, of the column whose x is nearest; the left one of two as near."""
    return F.array_min(F.transform(columns, lambda c, i: F.struct(F.abs(x - c["x"]).alias("d"), i.alias("i"))))["i"]


def multiply(a: Column, b: Column) -> Column:
    """Affine matrices [a b c d e f], a applied first."""
    g = lambda m, i: F.get(m, F.lit(i))
    return F.array(
        g(a, 0) * g(b, 0) + g(a, 1) * g(b, 2), g(a, 0) * g(b, 1) + g(a, 1) * g(b, 3),
        g(a, 2) * g(b, 0) + g(a, 3) * g(b, 2), g(a, 2) * g(b, 1) + g(a, 3) * g(b, 3),
        g(a, 4) * g(b, 0) + g(a, 5) * g(b, 2) + g(b, 4), g(a, 4) * g(b, 1) + g(a, 5) * g(b, 3) + g(b, 5),
    )


def overlay_matrix(turn: Column, box: Column) -> Column:
    """The map from displayed space to a turned page's own."""
    x, y = F.get(box, F.lit(0)), F.get(box, F.lit(1))
    wide, high = F.get(box, F.lit(2)) - x, F.get(box, F.lit(3)) - y
    m = lambda *v: F.array(*[F.lit(float(k)) for k in v[:4]], *v[4:])
    by = F.pmod(turn, F.lit(360))
    return F.when(by == 90, m(0, 1, -1, 0, wide + x + y, y - x)).when(by == 180, m(-1, 0, 0, -1, wide + 2 * x, high + 2 * y)).when(by == 270, m(0, -1, 1, 0, x - y, high + x + y)).otherwise(m(1, 0, 0, 1, F.lit(0.0), F.lit(0.0)))


def fit_rotated(width: Column, height: Column, page_width: Column, page_height: Column, angle: Column, scale: Column) -> Column:
    """(width, height) of the largest image whose bounding box, once turned, fits into a share of the page both ways."""
    aspect, t = height / width, F.radians(angle)
    c, s = F.abs(F.cos(t)), F.abs(F.sin(t))
    w = F.least(page_width * scale / (c + aspect * s), page_height * scale / (s + aspect * c))
    return F.struct(w.alias("width"), (w * aspect).alias("height"))
