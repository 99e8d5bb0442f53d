"""Numeric operators on meshes and point sets that are not relational: numpy on one group at a time, for ``applyInPandas`` and UDFs.

Groups are bodies or meshes: of bounded size by nature. Each function takes and returns plain arrays, so it can be tested alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def per_group(df: DataFrame, key: str, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order: list[str] | None = None) -> DataFrame:
    """``function`` on each group's rows, in ``order``; key first in the result."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return function(rows.sort_values(order, kind="stable").reset_index(drop=True) if order else rows)

    return df.groupBy(key).applyInPandas(run, schema)


def triangle_set(triangles: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Triangles, with labels if given, as sorted records: equal for equal sets of oriented triangles, wherever each starts."""
    starts = np.stack([triangles, triangles[:, [1, 2, 0]], triangles[:, [2, 0, 1]]])
    spelled = np.rec.fromarrays(list(starts.transpose(2, 0, 1)), names="a,b,c")
    spelled.sort(axis=0)  # of the three ways to write a triangle the least comes first
    best = spelled[0]
    table = np.rec.fromarrays([best.a, best.b, best.c, np.zeros(len(triangles), int) if labels is None else labels], names="a,b,c,label")
    table.sort()
    return table


def axis_turns() -> list[np.ndarray]:
    """The 48 ways to lay the three axes on each other: what two quarter turns generate from the identity, then the mirror images of these."""
    quarters = [np.array([[1, 0, 0], [0, 0, -1], [0, 1, 0]]), np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1]])]
    found = {np.eye(3, dtype=int).tobytes(): np.eye(3, dtype=int)}
    queue = list(found.values())
    for turn in queue:  # grows on the way
        for quarter in quarters:
            further = quarter @ turn
            if further.tobytes() not in found:
                found[further.tobytes()] = further
                queue.append(further)
    return [sign * turn.astype(float) for sign in (1, -1) for turn in queue]


def nearest(points: np.ndarray, among: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(index, distance) of the nearest of ``among``, in blocks of bounded size; ties: the first."""
    index, distance = np.empty(len(points), np.int64), np.empty(len(points))
    for at in range(0, len(points), block):
        d = ((points[at : at + block, None, :] - among[None]) ** 2).sum(axis=2)
        index[at : at + block] = d.argmin(axis=1)
        distance[at : at + block] = np.sqrt(d.min(axis=1))
    return index, distance


def congruent(points: np.ndarray, triangles: np.ndarray, labels: list, points2: np.ndarray, triangles2: np.ndarray, labels2: list, tolerance: float) -> dict | None:
    """Whether the second mesh is the first, turned by a signed permutation of the axes and moved; vertices and triangles in any order.

    {matrix (second to first), mirrored, deviation, same_labels}, or None. Mirrored meshes have the opposite winding.
    """
    p, inv = np.unique(points, axis=0, return_inverse=True)
    q, inv2 = np.unique(points2, axis=0, return_inverse=True)
    t, t2 = inv.ravel()[triangles], inv2.ravel()[triangles2]
    if len(p) != len(q) or len(t) != len(t2):
        return None
    centre, centre2 = (p.min(0) + p.max(0)) / 2, (q.min(0) + q.max(0)) / 2
    want = triangle_set(t)
    codes = {v: k for k, v in enumerate(sorted({*labels, *labels2}, key=str))}
    for turn in axis_turns():
        moved = (q - centre2) @ turn.T
        if np.abs(np.ptp(moved, axis=0) - np.ptp(p, axis=0)).max() > 2 * tolerance:
            continue
        to, off = nearest(moved, p - centre)
        if off.max() > tolerance or len(np.unique(to)) != len(to):
            continue
        mirrored = np.linalg.det(turn) < 0
        own = to[t2][:, ::-1] if mirrored else to[t2]
        if not np.array_equal(want, triangle_set(own)):
            continue
        same = np.array_equal(triangle_set(t, [codes[v] for v in labels]), triangle_set(own, [codes[v] for v in labels2]))
        matrix = np.eye(4)
        matrix[:3, :3], matrix[:3, 3] = turn, centre - turn @ centre2
        return {"matrix": matrix, "mirrored": bool(mirrored), "deviation": float(off.max()), "same_labels": bool(same)}
    return None


def first_congruent(meshes: list[tuple], tolerance: float) -> list[int]:
    """For each (points, triangles, labels) the index of the first earlier one that it is congruent to, else its own; only earlier
    originals are compared, in order. Meshes must be blocked by (vertices, triangles) before."""
    out: list[int] = []
    for k, mesh in enumerate(meshes):
        hit = next((j for j in range(k) if out[j] == j and congruent(*meshes[j], *mesh, tolerance)), k)
        out.append(hit)
    return out


def rigid_fit(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """(4x4 from ``b`` to ``a``, greatest residual) of the best proper rotation and shift between matched points."""
    ca, cb = a.mean(0), b.mean(0)
    u, _, vt = np.linalg.svd((b - cb).T @ (a - ca))
    turn = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T)) or 1]) @ u.T
    matrix = np.eye(4)
    matrix[:3, :3], matrix[:3, 3] = turn, ca - turn @ cb
    return matrix, float(np.linalg.norm(b @ turn.T + matrix[:3, 3] - a, axis=1).max())


def loop_key(points: np.ndarray, quantum: float) -> tuple:
    """A key of a closed loop that its place, turning and start don't change: squared distances to the next and to the one after, quantised;
    the least of all starts."""
    step = ((np.roll(points, -1, 0) - points) ** 2).sum(1)
    skip = ((np.roll(points, -2, 0) - points) ** 2).sum(1)
    pairs = [tuple(x) for x in np.rint(np.column_stack([step, skip]) / quantum).astype(np.int64).tolist()]
    return min(tuple(pairs[k:] + pairs[:k]) for k in range(len(pairs)))


def loops_match(a: np.ndarray, b: np.ndarray, tolerance: float) -> np.ndarray | None:
    """The matrix that carries loop ``b`` onto ``a`` from some start, within the tolerance; winding kept."""
    if len(a) != len(b):
        return None
    for k in range(len(b)):
        matrix, residual = rigid_fit(a, np.roll(b, -k, 0))
        if residual <= tolerance:
            return matrix
    return None


def even_samples(n: int, count: int) -> np.ndarray:
    return np.linspace(0, n - 1, min(count, n)).astype(int) if n else np.zeros(0, int)


def areas(points: np.ndarray, triangles: np.ndarray) -> np.ndarray:
    v = points[triangles]
    return np.linalg.norm(np.cross(v[:, 1] - v[:, 0], v[:, 2] - v[:, 0]), axis=1) / 2


def greedy_match(distance: np.ndarray, allowed: np.ndarray) -> np.ndarray | None:
    """One to one: each row, in order, takes its nearest allowed column that is still free; a row without one makes it None."""
    free = np.ones(distance.shape[1], bool)
    out = np.empty(len(distance), np.int64)
    for k, row in enumerate(distance):
        cost = np.where(allowed[k] & free, row, np.inf)
        out[k] = int(cost.argmin()) if cost.size else -1
        if not cost.size or not np.isfinite(cost[out[k]]):
            return None
        free[out[k]] = False
    return out


def orbits(expected: np.ndarray, candidates: np.ndarray, tolerance: float) -> np.ndarray | None:
    """The candidate of each expected place, if each has exactly one within the tolerance and no two share one."""
    near = np.linalg.norm(expected[:, None] - candidates[None], axis=2) <= tolerance
    if not (near.sum(1) == 1).all():
        return None
    chosen = near.argmax(1)
    return chosen if len(np.unique(chosen)) == len(chosen) else None


def vertex_chunks(triangles: np.ndarray, most: int = 65_535) -> np.ndarray:
    """Chunk number of each triangle: a new one begins where the running one would pass ``most`` different vertices."""
    out, seen, chunk = np.empty(len(triangles), np.int64), set(), 0
    for k, corners in enumerate(triangles.tolist()):
        fresh = seen.union(corners)
        if len(fresh) > most:
            chunk, fresh = chunk + 1, set(corners)
        seen, out[k] = fresh, chunk
    return out


def weld(points: np.ndarray, quantum: float = 0.0) -> np.ndarray:
    """Number of the first point at the same (quantised) position."""
    key = np.rint(points / quantum) if quantum else points
    _, first, inverse = np.unique(key, axis=0, return_index=True, return_inverse=True)
    return first[inverse.ravel()]


def triangle_components(triangles: np.ndarray, n_points: int) -> np.ndarray:
    """Component of each triangle, by shared points: the least point of the component."""
    label = np.arange(n_points)
    while True:
        least = label[triangles].min(axis=1)
        new = label.copy()
        for k in range(3):
            np.minimum.at(new, triangles[:, k], least)
        new = new[new]
        if np.array_equal(new, label):
            return label[triangles].min(axis=1)
        label = new


def orient(triangles: np.ndarray) -> np.ndarray | None:
    """Whether to flip each triangle so that neighbours run along their edge in opposite directions; None if the mesh has a boundary, an
    edge of over two triangles, several components, or no such orientation."""
    edges: dict[tuple[int, int], list[tuple[int, bool]]] = {}
    for k, t in enumerate(triangles.tolist()):
        for a, b in zip(t, t[1:] + t[:1]):
            edges.setdefault((min(a, b), max(a, b)), []).append((k, a < b))
    if any(len(e) != 2 for e in edges.values()):
        return None
    around: dict[int, list[tuple[int, bool]]] = {}
    for (k, up), (m, up2) in edges.values():
        around.setdefault(k, []).append((m, up == up2))
        around.setdefault(m, []).append((k, up == up2))
    flip = {0: False} if len(triangles) else {}
    queue = list(flip)
    for k in queue:
        for m, same in around[k]:
            if m not in flip:
                flip[m] = flip[k] ^ same
                queue.append(m)
            elif flip[m] != flip[k] ^ same:
                return None
    return np.array([flip[k] for k in range(len(triangles))]) if len(flip) == len(triangles) else None


def merge_coplanar(normals: np.ndarray, offsets: np.ndarray, neighbours: list[tuple[int, int]], angle: float, distance: float) -> np.ndarray:
    """Patch of each facet: facets join, in order of the neighbour pairs, if every member of both patches fits the other's first plane."""
    patch = {k: [k] for k in range(len(normals))}
    of = list(range(len(normals)))

    def fits(members: list[int], first: int) -> bool:
        return bool((normals[members] @ normals[first] >= np.cos(angle)).all() and (np.abs(offsets[members] - offsets[first]) <= distance).all())

    for a, b in neighbours:
        x, y = sorted((of[a], of[b]))
        if x != y and fits(patch[y], patch[x][0]) and fits(patch[x], patch[y][0]):
            patch[x] += patch.pop(y)
            for k in patch[x]:
                of[k] = x
    return np.array(of)


def pack_shelves(sizes: np.ndarray, width: int, height: int) -> np.ndarray:
    """(page, x, y) of each (w, h) tile, in order, on shelves from the left; a shelf is as high as its highest tile. A tile larger than a page
    is an error."""
    out = np.zeros((len(sizes), 3), np.int64)
    page = x = y = shelf = 0
    for k, (w, h) in enumerate(sizes.tolist()):
        if w > width or h > height:
            raise ValueError("tile larger than a page")
        if x + w > width:
            x, y, shelf = 0, y + shelf, 0
        if y + h > height:
            page, x, y, shelf = page + 1, 0, 0, 0
        out[k] = page, x, y
        x, shelf = x + w, max(shelf, h)
    return out


def blocked_rays(origins: np.ndarray, directions: np.ndarray, points: np.ndarray, triangles: np.ndarray) -> np.ndarray:
    """Whether each ray meets any triangle ahead of it."""
    a, b, c = (points[triangles[:, k]] for k in range(3))
    u, v = b - a, c - a
    out = np.zeros(len(origins), bool)
    for k, (o, d) in enumerate(zip(origins, directions)):
        h = np.cross(d, v)
        det = (u * h).sum(1)
        ok = np.abs(det) > 1e-12
        inv = np.where(ok, 1 / np.where(ok, det, 1), 0)
        s = o - a
        x = (s * h).sum(1) * inv
        q = np.cross(s, u)
        y = (q @ d) * inv
        t = (v * q).sum(1) * inv
        out[k] = bool((ok & (x >= 0) & (y >= 0) & (x + y <= 1) & (t > 1e-9)).any())
    return out


def bisect(holds: Callable[[float], bool], low: float, high: float, steps: int = 50) -> float:
    """The greatest value found for which ``holds``, which must be so at ``low`` and not at ``high``."""
    if not holds(low) or holds(high):
        raise ValueError("not a bracket")
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


def small_details(points: np.ndarray, triangles: np.ndarray, extent: float, reach: float) -> np.ndarray:
    """Triangles of pieces that are small on all axes and all of whose vertices lie near what stays; limits are strict, isolated pieces stay."""
    piece = triangle_components(triangles, len(points))
    names = np.unique(piece)
    size = {c: np.ptp(points[np.unique(triangles[piece == c])], axis=0) for c in names}
    small = [c for c in names if (size[c] < extent).all()]
    rest = np.unique(triangles[~np.isin(piece, small)])
    gone = []
    for c in small:
        if len(rest) and (nearest(points[np.unique(triangles[piece == c])], points[rest])[1] < reach).all():
            gone.append(c)
    return np.isin(piece, gone)


def retry_lost(piece: np.ndarray, simplify: Callable[[np.ndarray, float], np.ndarray], limit: float, most: int = 12) -> dict[int, float | None]:
    """Limit at which each component survives ``simplify`` (component triangles, limit) -> kept triangles; halved until it does, at most
    ``most`` times, else None: the source stays."""
    out: dict[int, float | None] = {}
    for c in np.unique(piece).tolist():
        own, now = np.flatnonzero(piece == c), limit
        for _ in range(most + 1):
            if len(simplify(own, now)):
                break
            now /= 2
        else:
            now = None
        out[c] = now
    return out


def register(items: list[np.ndarray], key: Callable[[np.ndarray], tuple], accept: Callable[[np.ndarray, np.ndarray], bool]) -> list[int]:
    """Index of the first earlier prototype in an item's bucket that accepts it, else its own (it becomes a prototype)."""
    buckets: dict[tuple, list[int]] = {}
    out = []
    for k, item in enumerate(items):
        held = buckets.setdefault(key(item), [])
        hit = next((j for j in held if accept(items[j], item)), k)
        if hit == k:
            held.append(k)
        out.append(hit)
    return out


def rectangle(points: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray] | None:
    """(centre, half sizes) of the axis-aligned rectangle whose four corners a planar loop has, within the tolerance."""
    low, high = points.min(0), points.max(0)
    corners = np.array([[x, y] for x in (low[0], high[0]) for y in (low[1], high[1])])
    if nearest(corners, points)[1].max() > tolerance or not ((np.abs(points - low) <= tolerance) | (np.abs(points - high) <= tolerance)).any(1).all():
        return None
    return (low + high) / 2, (high - low) / 2


def simplify_loop(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Kept corners of a polyline: the end points, and recursively the farthest one beyond the tolerance of the chord."""
    keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        chord = points[b] - points[a]
        length = np.linalg.norm(chord)
        off = points[a + 1 : b] - points[a]
        d = np.linalg.norm(off, axis=1) if length == 0 else np.linalg.norm(off - np.outer(off @ chord / length**2, chord), axis=1)
        k = int(d.argmax())
        if d[k] > tolerance:
            m = a + 1 + k
            keep.add(m)
            stack += [(a, m), (m, b)]
    return np.array(sorted(keep))
