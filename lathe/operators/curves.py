"""Conic curves as column expressions; free curves as grouped pandas functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.functions.values import chord_segments

TURN = 2 * math.pi


def circle_points(circles: DataFrame, radius: str, tolerance: float, start: float = 0.0, sweep: float = TURN) -> DataFrame:
    """Points (i, x, y) of arcs in their own plane, chords within the tolerance."""
    n = chord_segments(F.col(radius), F.lit(sweep), tolerance)
    rows = circles.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    angle = F.lit(start) + F.lit(sweep) * F.col("i") / F.col("n")
    return rows.withColumns({"x": F.round(F.col(radius) * F.cos(angle), 4) + 0.0, "y": F.round(F.col(radius) * F.sin(angle), 4) + 0.0}).drop("n")


def conic_points(arcs: DataFrame, tolerance: float) -> DataFrame:
    """Points of arcs in space: columns center, axis_x, axis_y (arrays of 3), rx, ry, start, sweep; rx = ry for circles."""
    n = chord_segments(F.greatest("rx", "ry"), F.col("sweep"), tolerance)
    rows = arcs.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    angle = F.col("start") + F.col("sweep") * F.col("i") / F.col("n")
    at = lambda k: F.col("center")[k] + F.col("rx") * F.cos(angle) * F.col("axis_x")[k] + F.col("ry") * F.sin(angle) * F.col("axis_y")[k]
    return rows.select(*arcs.columns, "i", *(at(k).alias(x) for k, x in enumerate("xyz")))


def axis_extrema(center: Column, axis_x: Column, axis_y: Column, rx: Column, ry: Column, start: Column, sweep: Column) -> Column:
    """array of 3 (low, high): exact extent of an arc along each axis: its ends and the turning points inside."""
    out = []
    for k in range(3):
        p, q = rx * axis_x[k], ry * axis_y[k]
        at = lambda t, k=k, p=p, q=q: center[k] + p * F.cos(t) + q * F.sin(t)
        turn = F.atan2(q, p)
        tries = [at(start), at(start + sweep)]
        for shift in (0.0, math.pi):
            ahead = F.pmod(turn + shift - F.when(sweep >= 0, start).otherwise(start + sweep), F.lit(TURN))
            tries.append(F.when(ahead <= F.abs(sweep), at(turn + shift)))
        out.append(F.struct(F.least(*tries).alias("low"), F.greatest(*tries).alias("high")))
    return F.array(*out)


def conic_interval(start_angle: Column, end_angle: Column, forward: Column) -> Column:
    """Parameter interval of an arc between two points, in native direction; equal ends are a full turn."""
    span = F.pmod(F.when(forward, end_angle - start_angle).otherwise(start_angle - end_angle), F.lit(TURN))
    span = F.when(span < 1e-12, F.lit(TURN)).otherwise(span)
    low = F.pmod(F.when(forward, start_angle).otherwise(end_angle), F.lit(TURN))
    return F.struct(low.alias("low"), (low + span).alias("high"))


def effective_interval(source: Column, derived: Column) -> Column:
    """The stored interval is never overwritten."""
    return F.coalesce(source, derived)


def basis(degree: int, knots: np.ndarray, t: float) -> tuple[int, np.ndarray]:
    """Span and non-zero basis values of a B-spline, by the triangular recurrence."""
    last = len(knots) - degree - 2
    span = int(np.clip(np.searchsorted(knots, t, "right") - 1, degree, last))
    value = np.zeros(degree + 1)
    value[0] = 1.0
    for d in range(1, degree + 1):
        left = t - knots[span - d + 1 : span + 1]
        right = knots[span + 1 : span + d + 1] - t
        width = right + left
        share = np.where(width > 0, value[:d] / np.where(width > 0, width, 1), 0.0)
        grown = np.zeros(d + 1)
        grown[:d] += share * right
        grown[1:] += share * left
        value[: d + 1] = grown
    return span, value


def nurbs_point(degree: int, knots, poles, weights, t: float) -> np.ndarray:
    """A point of a rational B-spline curve."""
    knots, poles = np.asarray(knots, float), np.asarray(poles, float)
    weights = np.ones(len(poles)) if weights is None else np.asarray(weights, float)
    span, value = basis(degree, knots, t)
    own = slice(span - degree, span + 1)
    share = value * weights[own]
    return share @ poles[own] / share.sum()


def nurbs_derivative(degree: int, knots, poles, weights, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Point and first derivative of a rational B-spline curve.

    The derivative of a B-spline is one of a degree less over differences of its
    weighted poles; the quotient rule takes the weight back out.
    """
    knots, poles = np.asarray(knots, float), np.asarray(poles, float)
    weights = np.ones(len(poles)) if weights is None else np.asarray(weights, float)
    lifted = np.column_stack([poles * weights[:, None], weights])
    span, value = basis(degree, knots, t)
    whole = value @ lifted[span - degree : span + 1]
    point = whole[:-1] / whole[-1]
    if degree == 0:
        return point, np.zeros_like(point)
    width = knots[degree + 1 : degree + len(poles)] - knots[1 : len(poles)]
    steps = degree * np.diff(lifted, axis=0) / np.where(width > 0, width, 1)[:, None]
    steps[width <= 0] = 0.0
    low, slope = basis(degree - 1, knots[1:-1], t)
    change = slope @ steps[low - degree + 1 : low + 1]
    return point, (change[:-1] - point * change[-1]) / whole[-1]


def nurbs_surface(degrees, knots, poles, weights, u: float, v: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Point and both first derivatives of a rational surface; poles and weights by rows along u."""
    poles = np.asarray(poles, float)
    weights = np.ones(poles.shape[:2]) if weights is None else np.asarray(weights, float)
    lifted = np.concatenate([poles * weights[..., None], weights[..., None]], axis=2)
    across = [nurbs_derivative(degrees[1], knots[1], row, None, v) for row in lifted]
    whole, du = nurbs_derivative(degrees[0], knots[0], np.array([p for p, _ in across]), None, u)
    dv, _ = nurbs_derivative(degrees[0], knots[0], np.array([d for _, d in across]), None, u)
    point = whole[:-1] / whole[-1]
    return point, (du[:-1] - point * du[-1]) / whole[-1], (dv[:-1] - point * dv[-1]) / whole[-1]


def nurbs_normal(degrees, knots, poles, weights, u: float, v: float) -> np.ndarray | None:
    """Unit normal of a free surface; None where the derivatives are parallel."""
    _, du, dv = nurbs_surface(degrees, knots, poles, weights, u, v)
    normal = np.cross(du, dv)
    size = float(np.linalg.norm(normal))
    return normal / size if size > 0 else None


def derivatives(curves_: DataFrame) -> DataFrame:
    """Points and derivatives of curves (id, degree, knots, poles, weights, parameter)."""

    def run(batches):
        for frame in batches:
            rows = []
            for r in frame.itertuples():
                weights = None if r.weights is None else np.array(r.weights, float)
                point, change = nurbs_derivative(int(r.degree), r.knots, np.array([list(p) for p in r.poles], float), weights, r.parameter)
                rows.append((r.id, r.parameter, *point, *change))
            yield pd.DataFrame(rows, columns=["id", "parameter", "x", "y", "z", "dx", "dy", "dz"])

    return curves_.mapInPandas(run, "id string, parameter double, x double, y double, z double, dx double, dy double, dz double")


def adaptive(point, low: float, high: float, tolerance: float, most: int = 512) -> tuple[list[float], bool]:
    """Parameters whose chords stay within the tolerance of the curve's middle points.

    The segment that is furthest off is halved first, so a cap leaves the best
    polyline of that size. Returns parameters and whether the tolerance is met.
    """
    import heapq

    def off(a: float, b: float) -> float:
        p, q, m = point(a), point(b), point((a + b) / 2)
        d = q - p
        size = float(d @ d)
        u = min(1.0, max(0.0, float((m - p) @ d) / size)) if size else 0.0
        return float(np.linalg.norm(m - p - u * d))

    middle = (low + high) / 2
    heap = [(-off(a, b), a, b) for a, b in ((low, middle), (middle, high))]
    heapq.heapify(heap)
    while -heap[0][0] > tolerance and len(heap) < most:
        _, a, b = heapq.heappop(heap)
        m = (a + b) / 2
        heapq.heappush(heap, (-off(a, m), a, m))
        heapq.heappush(heap, (-off(m, b), m, b))
    return sorted({a for _, a, _ in heap} | {high}), -heap[0][0] <= tolerance


def sample_nurbs(curves: DataFrame, tolerance: float, most: int = 512) -> DataFrame:
    """Points of curves (id, degree, knots, poles array<array<double>>, weights, low, high); one task function for each batch."""

    def run(batches):
        for frame in batches:
            rows = []
            for r in frame.itertuples():
                poles = np.array([list(p) for p in r.poles], float)
                weights = None if r.weights is None else np.array(r.weights, float)
                point = lambda t, r=r, poles=poles, weights=weights: nurbs_point(int(r.degree), r.knots, poles, weights, t)
                found, exact = adaptive(point, r.low, r.high, tolerance, most)
                rows += [(r.id, i, *point(t), t, exact) for i, t in enumerate(found)]
            yield pd.DataFrame(rows, columns=["id", "i", "x", "y", "z", "parameter", "within_tolerance"])

    return curves.mapInPandas(run, "id string, i int, x double, y double, z double, parameter double, within_tolerance boolean")


def surface_normal(kind: Column, axis: Column, origin: Column, point: Column, half_angle: Column, major: Column) -> Column:
    """Unit normal of plane, cylinder, cone, sphere or torus at a point; null for others."""
    p = [point[k] - origin[k] for k in range(3)]
    along = sum((p[k] * axis[k] for k in range(1, 3)), p[0] * axis[0])
    out = [p[k] - along * axis[k] for k in range(3)]
    size = F.sqrt(sum((x * x for x in out[1:]), out[0] * out[0]))
    unit = [x / F.when(size > 0, size) for x in out]
    whole = F.sqrt(sum((x * x for x in p[1:]), p[0] * p[0]))
    ring = [p[k] - major * unit[k] for k in range(3)]
    thick = F.sqrt(sum((x * x for x in ring[1:]), ring[0] * ring[0]))
    cone = [F.cos(half_angle) * unit[k] - F.sin(half_angle) * axis[k] for k in range(3)]
    return (
        F.when(kind == "plane", axis).when(kind == "cylinder", F.array(*unit)).when(kind == "cone", F.array(*cone))
        .when(kind == "sphere", F.array(*(x / F.when(whole > 0, whole) for x in p))).when(kind == "torus", F.array(*(x / F.when(thick > 0, thick) for x in ring)))
    )


def dihedral(first: Column, second: Column) -> Column:
    """Degrees between two unit normals."""
    d = sum((first[k] * second[k] for k in range(1, 3)), first[0] * second[0])
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), d))))


def loop_roles(points: DataFrame) -> DataFrame:
    """Role of each loop of a planar face: outer, inner, or null where the loops aren't simple, disjoint and nested once.

    points: doc_id, face, loop, i, u, v in the face's plane, closed polygons.
    """

    def area(p: np.ndarray) -> float:
        q = np.roll(p, -1, axis=0)
        return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)

    def meets(p: np.ndarray, q: np.ndarray, same: bool) -> bool:
        a, b = p, np.roll(p, -1, axis=0)
        for i, (c, d) in enumerate(zip(q, np.roll(q, -1, axis=0), strict=True)):
            side = lambda x, y, z: (y[..., 0] - x[..., 0]) * (z[..., 1] - x[..., 1]) - (y[..., 1] - x[..., 1]) * (z[..., 0] - x[..., 0])
            cross = (side(a, b, c[None]) * side(a, b, d[None]) < 0) & (side(c[None], d[None], a) * side(c[None], d[None], b) < 0)
            if same:
                cross[[i, i - 1, (i + 1) % len(p)]] = False
            if cross.any():
                return True
        return False

    def inside(p: np.ndarray, at: np.ndarray) -> bool:
        q = np.roll(p, -1, axis=0)
        over = (p[:, 1] > at[1]) != (q[:, 1] > at[1])
        if not over.any():
            return False
        a, b = p[over], q[over]
        return bool((at[0] < a[:, 0] + (at[1] - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])).sum() % 2)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        loops = {k: g.sort_values("i")[["u", "v"]].to_numpy(float) for k, g in frame.groupby("loop")}
        names = sorted(loops, key=lambda k: -abs(area(loops[k])) if len(loops[k]) > 2 else 0.0)
        good = all(len(p) > 2 and abs(area(p)) > 0 and not meets(p, p, True) for p in loops.values())
        good = good and not any(meets(loops[a], loops[b], False) for i, a in enumerate(names) for b in names[:i])
        outer = names[0]
        good = good and all(inside(loops[outer], loops[k][0]) for k in names[1:])
        good = good and not any(inside(loops[a], loops[b][0]) for a in names[1:] for b in names[1:] if a != b)
        roles = [("outer" if k == outer else "inner") if good else None for k in names]
        return pd.DataFrame({"doc_id": frame["doc_id"].iloc[0], "face": frame["face"].iloc[0], "loop": names, "role": roles})

    return points.groupBy("doc_id", "face").applyInPandas(run, "doc_id string, face string, loop string, role string")


def unrolled(points: DataFrame, radius: Column) -> DataFrame:
    """Points of loops on a cylinder (angle, height) on its flat chart, angles continued across the seam."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id", "face", "loop").orderBy("i")
    step = F.col("angle") - F.lag("angle").over(order)
    wrapped = step - TURN * F.round(step / TURN)
    flat = points.withColumn("step", F.coalesce(wrapped, F.lit(0.0)))
    total = F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.first("angle").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return flat.withColumns({"u": radius * (first + total), "v": F.col("height")}).drop("step")


def cylinder_roles(points: DataFrame, radius: float | str = "radius") -> DataFrame:
    """Role of each loop of a cylindrical face, on its flat chart.

    points: doc_id, face, loop, i, angle, height and the radius column. One loop
    must run round the face the positive way (outer); the others the negative way,
    each strictly inside one copy of the outer chart. Else all roles are null.
    """
    flat = unrolled(points, F.col(radius) if isinstance(radius, str) else F.lit(radius))

    def area(p: np.ndarray) -> float:
        q = np.roll(p, -1, axis=0)
        return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)

    def inside(p: np.ndarray, at: np.ndarray) -> bool:
        q = np.roll(p, -1, axis=0)
        over = (p[:, 1] > at[1]) != (q[:, 1] > at[1])
        a, b = p[over], q[over]
        return bool((at[0] < a[:, 0] + (at[1] - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])).sum() % 2) if over.any() else False

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        turn = TURN * float(frame["r"].iloc[0])
        loops = {k: g.sort_values("i")[["u", "v"]].to_numpy(float) for k, g in frame.groupby("loop")}
        areas = {k: area(p) for k, p in loops.items()}
        outer = [k for k, a in areas.items() if a > 0]
        good = len(outer) == 1 and all(a != 0 for a in areas.values())
        if good:
            ring = loops[outer[0]]
            low, high = ring[:, 0].min(), ring[:, 0].max()
            holes = []
            for k, p in loops.items():
                if k == outer[0]:
                    continue
                shifted = p + [turn * round(((low + high) / 2 - (p[:, 0].min() + p[:, 0].max()) / 2) / turn), 0]
                good = good and shifted[:, 0].min() > low and shifted[:, 0].max() < high and all(inside(ring, x) for x in shifted)
                good = good and not any(inside(h, shifted[0]) or inside(shifted, h[0]) for h in holes)
                holes.append(shifted)
        roles = [("outer" if k in outer else "inner") if good else None for k in loops]
        return pd.DataFrame({"doc_id": frame["doc_id"].iloc[0], "face": frame["face"].iloc[0], "loop": list(loops), "role": roles})

    with_radius = flat.withColumn("r", F.col(radius) if isinstance(radius, str) else F.lit(radius))
    return with_radius.groupBy("doc_id", "face").applyInPandas(run, "doc_id string, face string, loop string, role string")


def nurbs_interval(degree: int, knots, poles, weights, point, tolerance: float = 1e-7, steps: int = 100) -> float | None:
    """Parameter of a point on a curve that runs one way along its chord: bisection on the projection, null if the point isn't on it."""
    knots, poles = np.asarray(knots, float), np.asarray(poles, float)
    low, high = float(knots[degree]), float(knots[-degree - 1])
    chord = poles[-1] - poles[0]
    size = float(chord @ chord)
    if not size or np.any(np.diff(poles @ chord) <= 0):
        return None
    goal = float((np.asarray(point, float) - poles[0]) @ chord)
    at = lambda t: nurbs_point(degree, knots, poles, weights, t)
    for _ in range(steps):
        middle = (low + high) / 2
        if float((at(middle) - poles[0]) @ chord) < goal:
            low = middle
        else:
            high = middle
    t = (low + high) / 2
    return t if float(np.linalg.norm(at(t) - np.asarray(point, float))) <= tolerance else None
