"""Solids as faces: footprints cut into triangles, and walls.

A footprint is made simple first (equal neighbours merged, counter-clockwise), then cut by ears: a convex corner whose
triangle holds no other corner comes off, until three are left. Rings that cross or touch themselves, or have no area, can't be
extruded. Rows go through Arrow batch by batch: rings with equally many corners are one array and are cut together, and faces
leave as columns, those of `CORNERS` corners or so at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.importing import SHORTEST_EDGE

#: SQL types of a corner and of a face.
POINT = "struct<x: double, y: double, z: double>"
FACE = f"side string, pos int, a {POINT}, b {POINT}, c {POINT}, fault string"
SIDES = ("top", "bottom", "wall")
#: What keeps a footprint from being extruded, by number.
FAULTS = (None, "fewer than three corners", "no area", "crosses or touches itself", "no base or no height")
FEWER, FLAT, CROSSES, NO_HEIGHT = 1, 2, 3, 4
#: Corners whose faces are held at a time; a longer ring is held whole.
CORNERS = 50_000


def _cross(o: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Twice the signed area of the triangles o, a, b."""
    return (a[..., 0] - o[..., 0]) * (b[..., 1] - o[..., 1]) - (a[..., 1] - o[..., 1]) * (b[..., 0] - o[..., 0])


def merged(points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rings, one after the other with `sizes` corners each, without sides of no length."""
    if not len(points):
        return points, sizes
    begins, ring = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    following = np.arange(1, len(points) + 1)
    some = sizes > 0
    following[(begins + sizes - 1)[some]] = begins[some]
    with np.errstate(invalid="ignore"):
        keep = np.hypot(*(points - points[following]).T) > SHORTEST_EDGE
    return points[keep], np.bincount(ring[keep], minlength=len(sizes))


def simple_rings(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rings of equally many corners (ring, corner, x or y), counter-clockwise from their first points, and each one's fault by number."""
    n = points.shape[1]
    if n < 3:
        return points, np.full(len(points), FEWER)
    x, y = points[..., 0] - points[:, :1, 0], points[..., 1] - points[:, :1, 1]
    area = np.sum(x * np.roll(y, -1, axis=1) - np.roll(x, -1, axis=1) * y, axis=1) / 2
    points, back = points.copy(), area < 0
    points[back, 1:] = points[back, :0:-1]
    a, b = points, np.roll(points, -1, axis=1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    crosses = np.zeros(len(points), bool)
    for step in range(2, n // 2 + 1):  # each side and the one so many sides on: all pairs that are no neighbours
        c, d, low2, high2 = (np.roll(v, -step, axis=1) for v in (a, b, low, high))
        boxes = np.all((low <= high2) & (low2 <= high), axis=2)
        apart = np.sign(_cross(a, b, c)) * np.sign(_cross(a, b, d)) <= 0
        crosses |= np.any(boxes & apart & (np.sign(_cross(c, d, a)) * np.sign(_cross(c, d, b)) <= 0), axis=1)
    return points, np.where(np.abs(area) <= SHORTEST_EDGE, FLAT, np.where(crosses, CROSSES, 0))


def cut_rings(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners of the triangles that simple counter-clockwise rings of equally many corners are cut into (ring, triangle, corner), and how many each ring has.

    All rings go step by step together: each looks at one corner, takes it off or goes on.
    """
    m, n = points.shape[:2]
    cut, made = np.zeros((m, n - 2, 3), np.intp), np.zeros(m, np.intp)
    before, after = (np.tile(np.roll(np.arange(n), k), (m, 1)) for k in (1, -1))
    left, size = np.ones((m, n), bool), np.full(m, n)
    at, stuck = np.zeros((2, m), np.intp)
    open_ = np.flatnonzero(size > 3)
    while len(open_):
        j = at[open_]
        i, k = before[open_, j], after[open_, j]
        p, q, r = (points[open_, v] for v in (i, j, k))
        turn = _cross(p, q, r)
        p, q, r, others = p[:, None], q[:, None], r[:, None], points[open_]
        inside = left[open_] & (_cross(p, q, others) >= 0) & (_cross(q, r, others) >= 0) & (_cross(r, p, others) >= 0)
        inside[np.arange(len(open_))[:, None], np.stack([i, j, k], axis=1)] = False
        off = (turn > 0) & ~inside.any(axis=1) | (turn == 0) & (stuck[open_] >= size[open_]) | (stuck[open_] >= 2 * size[open_])
        ear = off & (turn > 0)  # a corner on a straight line comes off without a triangle
        rows = open_[ear]
        cut[rows, made[rows]] = np.stack([i, j, k], axis=1)[ear]
        made[rows] += 1
        rows = open_[off]
        before[rows, k[off]], after[rows, i[off]], left[rows, j[off]] = i[off], k[off], False
        size[rows] -= 1
        at[open_], stuck[open_] = np.where(off, i, k), np.where(off, 0, stuck[open_] + 1)
        open_ = open_[size[open_] > 3]
    cut[np.arange(m), made] = np.nonzero(left)[1].reshape(m, 3)
    return cut, made + 1


def _faces(points: np.ndarray, base: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ring, side, pos and corners (face, a to c, x to z) of the triangles of solids with equally many corners: top, bottom and walls, each seen counter-clockwise from outside."""
    m, n = points.shape[:2]
    cut, made = cut_rings(points)
    one = np.arange(n)
    two = np.roll(one, -1)
    walls = np.stack([one, two, two, one, two, one], axis=1).reshape(2 * n, 3)
    corner = np.concatenate([cut, cut[..., ::-1], np.broadcast_to(walls, (m, *walls.shape))], axis=1)
    flat = np.zeros((n - 2, 3), bool)
    upper = np.concatenate([~flat, flat, np.tile([[False, False, True], [False, True, True]], (n, 1))])
    side, pos = np.repeat(np.arange(3), (n - 2, n - 2, 2 * n)), np.concatenate([np.arange(n - 2), np.arange(n - 2), np.arange(2 * n)])
    there = (side == 2) | (pos < made[:, None])
    ring, face = np.nonzero(there)
    z = np.where(upper[face], (base + height)[ring, None], base[ring, None])
    return ring, side[face], pos[face], np.concatenate([points[ring[:, None], corner[there]], z[..., None]], axis=2)


def simple_ring(points: np.ndarray) -> np.ndarray:
    """A ring without sides of no length, counter-clockwise from its first point. ValueError if it has no inside."""
    points, _ = merged(points.reshape(-1, 2), np.array([len(points)]))
    rings, fault = simple_rings(points[None])
    if fault[0]:
        raise ValueError(FAULTS[fault[0]])
    return rings[0]


def triangles(points: np.ndarray) -> list[tuple[int, int, int]]:
    """Corners of the triangles that a simple counter-clockwise ring is cut into."""
    cut, made = cut_rings(points[None])
    return [tuple(t) for t in cut[0, : made[0]].tolist()]


def faces_of(points: np.ndarray, base: float, height: float) -> Iterator[tuple]:
    """(side, pos, a, b, c) of one solid's triangles."""
    _, side, pos, corners = _faces(simple_ring(points)[None], np.array([base]), np.array([height]))
    for s, k, face in zip(side.tolist(), pos.tolist(), corners.tolist(), strict=True):
        yield SIDES[s], k, *(dict(zip("xyz", p, strict=True)) for p in face)


def _texts(codes: np.ndarray, texts: tuple[str | None, ...]) -> pa.Array:
    return pa.array(texts, pa.string()).take(pa.array(codes))


def _solids(points: np.ndarray, sizes: np.ndarray, base: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Faces of solids whose rings follow one another, as columns, and each face's solid; a solid that can't be extruded has a fault in place of faces."""
    points, sizes = merged(points, sizes)
    begins = np.cumsum(sizes) - sizes
    fault = np.zeros(len(sizes), np.intp)
    got = []
    for n in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == n)
        rings, fault[of] = simple_rings(points[begins[of, None] + np.arange(n)])
        fault[of] = np.where((fault[of] == 0) & np.isnan(base[of] + height[of]), NO_HEIGHT, fault[of])
        good = fault[of] == 0
        if good.any():
            ring, *rest = _faces(rings[good], base[of][good], height[of][good])
            got.append((of[good][ring], *rest))
    bad = np.flatnonzero(fault)
    got.append((bad, np.full(len(bad), len(SIDES)), np.zeros(len(bad), np.intp), np.zeros((len(bad), 3, 3))))
    solid, side, pos, corners = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.argsort(solid, kind="stable")
    solid, side, pos, corners = solid[order], side[order], pos[order], corners[order]
    none = side == len(SIDES)
    places = [pa.StructArray.from_arrays([pa.array(corners[:, v, k]) for k in range(3)], names=list("xyz"), mask=pa.array(none)) for v in range(3)]
    return solid, [_texts(side, (*SIDES, None)), pa.array(pos.astype(np.int32), mask=none), *places, _texts(fault[solid], FAULTS)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda x: x.cast(pa.float64()).to_numpy(zero_copy_only=False)
    for batch in batches:
        keys, (rings, base, height) = batch.columns[:-3], batch.columns[-3:]
        sizes = pc.fill_null(pc.list_value_length(rings), 0).to_numpy().astype(np.intp)
        flat, base, height = rings.flatten(), number(base), number(height)
        points = np.stack([number(pc.struct_field(flat, n)) for n in ("x_feet", "y_feet")], axis=1)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            first = ends[at] - sizes[at]
            to = max(at + 1, int(np.searchsorted(ends, first + CORNERS, side="right")))
            solid, faces = _solids(points[first : ends[to - 1]], sizes[at:to], base[at:to], height[at:to])
            names = [*batch.schema.names[:-3], "side", "pos", "a", "b", "c", "fault"]
            yield pa.RecordBatch.from_arrays([*(k.take(pa.array(at + solid)) for k in keys), *faces], names=names)
            at = to


def extruded(solids: DataFrame, *keys: str, strict: bool = True) -> DataFrame:
    """`keys`, side (top, bottom, wall), pos, a, b, c: the triangles of solids (footprint, base_feet, height_feet).

    A footprint that can't be extruded is an error, or if not `strict`, one row with its `fault`.
    """
    kept = ", ".join(f"`{c}` {k}" for c, k in solids.select(*keys).dtypes)
    faces = solids.select(*keys, "footprint", "base_feet", "height_feet").mapInArrow(_cut, f"{kept}, {FACE}")
    if not strict:
        return faces
    fault = F.when(F.col("fault").isNotNull(), F.raise_error(F.concat(F.lit("a footprint can't be extruded: "), "fault")).cast("string")).otherwise(F.col("side"))
    return faces.withColumn("side", fault).drop("fault")


def area(a: Column, b: Column, c: Column) -> Column:
    """A triangle's area in space."""
    u, v = ([q[n] - a[n] for n in "xyz"] for q in (b, c))
    x, y, z = u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]
    return F.sqrt(x * x + y * y + z * z) / 2
