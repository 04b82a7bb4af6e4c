"""Two-input rule inference (AND is min, OR is max, clipped triangles, centroid) and the starter signal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (left foot, top, right foot) of expected starts, of the experts' score and of the index.
STARTS = {"low": (0, 0, 10), "mid": (5, 14, 23), "high": (16, 26, 35)}
EXPERTS = {"low": (0, 0, 4), "mid": (2, 5, 8), "high": (6, 10, 10)}
INDEX = {"down": (-10, -10, -4), "level": (-5, 0, 5), "up": (4, 10, 10)}
#: Fixed values: (starts, experts) -> index.
RULES = {
    ("low", "high"): "up",
    ("low", "mid"): "level",
    ("low", "low"): "level",
    ("mid", "high"): "up",
    ("mid", "mid"): "level",
    ("mid", "low"): "down",
    ("high", "high"): "level",
    ("high", "mid"): "down",
    ("high", "low"): "down",
}
#: The highest value that expected starts are clamped to: at 35 itself no rule fires.
STARTS_TOP = 34.99


def triangle(x: Column, feet: Sequence[float]) -> Column:
    """Membership in a triangle; a foot at the top is a vertical edge."""
    a, b, c = (float(v) for v in feet)
    up = F.lit(1.0) if a == b else (x - a) / (b - a)
    down = F.lit(1.0) if b == c else (c - x) / (c - b)
    return F.when((x < a) | (x > c), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), up, down)))


def rule_index(x1: Column, x2: Column, first=STARTS, second=EXPERTS, out=INDEX, rules=RULES) -> Column:
    """M6. The centroid of the rules' clipped triangles; null for a null input or where no rule fires.

    The envelope is linear between the feet, the tops, the clip points and the crossings of two edges, so the centroid
    is summed exactly over those points in order.
    """
    p, q = {k: triangle(x1, v) for k, v in first.items()}, {k: triangle(x2, v) for k, v in second.items()}
    levels = {}
    for label in out:
        fires = [F.least(p[a], q[b]) for (a, b), to in rules.items() if to == label]
        levels[label] = fires[0] if len(fires) == 1 else F.greatest(*fires)
    state = F.struct(*[v.alias(k) for k, v in levels.items()])

    def centroid(h: Column) -> Column:
        points = {float(v) for feet in out.values() for v in feet}
        low, high = min(points), max(points)
        edges = [e for a, b, c in out.values() for e in ((a, b), (c, b)) if e[0] != e[1]]
        for i, (a, b) in enumerate(edges):  # crossings of two edges: 0 at a, 1 at b
            for c, d in edges[i + 1 :]:
                u, v = 1 / (b - a), 1 / (d - c)
                if u != v and low < (x := (a * u - c * v) / (u - v)) < high:
                    points.add(x)
        at = [F.lit(x) for x in sorted(points)]
        # Where an edge meets any clip level.
        at += [F.lit(float(a)) + (b - a) * h[k] for a, b in edges for k in out]
        xs = F.array_sort(F.transform(F.array(*at), lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high))))
        height = lambda x: F.greatest(*[F.least(h[k], triangle(x, v)) for k, v in out.items()])
        curve = F.transform(xs, lambda x: F.struct(x.alias("x"), height(x).alias("f")))
        n = len(at)

        def add(s: Column, pair: Column) -> Column:
            l, r = pair["l"], pair["r"]
            dx = r["x"] - l["x"]
            area = s["area"] + dx * (l["f"] + r["f"]) / 2
            moment = s["moment"] + dx * (l["x"] * (2 * l["f"] + r["f"]) + r["x"] * (l["f"] + 2 * r["f"])) / 6
            return F.struct(area.alias("area"), moment.alias("moment"))

        def summed(c: Column) -> Column:
            pairs = F.zip_with(F.slice(c, 1, n - 1), F.slice(c, 2, n - 1), lambda l, r: F.struct(l.alias("l"), r.alias("r")))
            return F.aggregate(pairs, F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("moment")), add, lambda s: F.when(s["area"] > 0, s["moment"] / s["area"]))

        return F.transform(F.array(curve), summed)[0]

    return F.when(x1.isNotNull() & x2.isNotNull(), F.transform(F.array(state), centroid)[0])


def starter_signal(unavailable: Column, pct: Column) -> Column:
    """M7. Unavailable is 0; a contest's percentage as a tenth; else unknown."""
    return F.when(F.coalesce(unavailable, F.lit(False)), 0.0).when(pct.isNotNull(), pct / 10.0)
