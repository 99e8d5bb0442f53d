import numpy as np
import pytest
from refweave.operators import mesh

#: A wedge over a rectangle, on which no turn but the identity is a symmetry.
POINTS = np.array([[0.0, 0, 0], [6, 0, 0], [6, 4, 0], [0, 4, 0], [1, 1, 3], [4, 1, 2]])
TRIANGLES = np.array([[0, 3, 2], [0, 2, 1], [0, 1, 5], [0, 5, 4], [1, 2, 5], [2, 3, 4], [2, 4, 5], [3, 0, 4]])
LABELS = ["base", "base", "front", "front", "side", "back", "back", "side"]


def test_congruence():
    turn = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    order, tri = [2, 0, 5, 3, 1, 4], [3, 1, 7, 0, 5, 2, 6, 4]
    moved = (POINTS @ turn.T - [3, 0, 20])[order]
    at = np.argsort(order)
    found = mesh.congruent(POINTS, TRIANGLES, LABELS, moved, np.roll(at[TRIANGLES], 1, axis=1)[tri], [LABELS[k] for k in tri], 1e-6)
    assert found and not found["mirrored"] and found["same_labels"]
    assert np.allclose(moved @ found["matrix"][:3, :3].T + found["matrix"][:3, 3], POINTS[order])
    flipped = POINTS * [-1, 1, 1]
    mirrored = mesh.congruent(POINTS, TRIANGLES, LABELS, flipped, TRIANGLES[:, ::-1], LABELS, 1e-6)
    assert mirrored and mirrored["mirrored"]
    off = POINTS.copy()
    off[4, 1] += 0.02
    assert mesh.congruent(POINTS, TRIANGLES, LABELS, off, TRIANGLES, LABELS, 1e-6) is None
    assert mesh.congruent(POINTS, TRIANGLES, LABELS, POINTS, TRIANGLES[[0, 1, 2, 3, 4, 5, 6, 0]], LABELS, 1e-6) is None
    other = mesh.congruent(POINTS, TRIANGLES, LABELS, POINTS, TRIANGLES, LABELS[1:] + LABELS[:1], 1e-6)
    assert other and not other["same_labels"]
    assert mesh.first_congruent([(POINTS, TRIANGLES, LABELS), (off, TRIANGLES, LABELS), (moved, at[TRIANGLES], LABELS)], 1e-6) == [0, 1, 0]


def test_loops():
    rect = np.array([[0.0, 0], [4, 0], [4, 2], [0, 2]])
    a = np.pi / 5
    turned = np.roll(rect @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]).T + 3, 2, axis=0)
    assert mesh.loop_key(rect, 1e-6) == mesh.loop_key(turned, 1e-6)
    off = rect.copy()
    off[2, 0] += 0.001
    assert mesh.loop_key(rect, 1e-6) != mesh.loop_key(off, 1e-6) and mesh.loop_key(rect, 0.1) == mesh.loop_key(off, 0.1)
    flat = lambda p: np.column_stack([p, np.zeros(len(p))])
    assert mesh.loops_match(flat(rect), flat(turned), 1e-9) is not None and mesh.loops_match(flat(rect), flat(off), 1e-6) is None
    centre, half = mesh.rectangle(rect, 1e-9)
    assert centre.tolist() == [2, 1] and half.tolist() == [2, 1] and mesh.rectangle(off, 1e-6) is None
    line = np.array([[0.0, 0], [1, 0.01], [2, 0], [3, 2], [4, 0]])
    assert mesh.simplify_loop(line, 0.1).tolist() == [0, 2, 3, 4]


def test_matching():
    d = np.array([[1.0, 2], [1, 5]])
    assert mesh.greedy_match(d, d < 9).tolist() == [0, 1] and mesh.greedy_match(d, d < 3) is None
    assert mesh.orbits(np.eye(2), np.eye(2)[::-1] + 1e-9, 1e-6).tolist() == [1, 0]
    assert mesh.orbits(np.zeros((2, 2)), np.zeros((1, 2)), 1e-6) is None and mesh.orbits(np.eye(2), np.eye(2)[:1], 1e-6) is None


def test_topology():
    assert mesh.orient(TRIANGLES).tolist() == [False] * 8
    assert mesh.orient(np.vstack([TRIANGLES[:7], TRIANGLES[7:, ::-1]])).tolist() == [False] * 7 + [True]
    assert mesh.orient(TRIANGLES[:7]) is None
    two = np.vstack([TRIANGLES, TRIANGLES + 6])
    assert len(set(mesh.triangle_components(two, 12))) == 2 and mesh.orient(two) is None
    assert mesh.weld(np.array([[0.0, 0], [1, 0], [0, 1e-8]]), 1e-6).tolist() == [0, 1, 0] and mesh.weld(np.array([[0.0, 0], [0, 1e-8]])).tolist() == [0, 1]
    assert mesh.triangle_set(np.array([[9, 4, 6], [6, 4, 9], [4, 6, 9]]), [7, 8, 5]).tolist() == [(4, 6, 9, 5), (4, 6, 9, 7), (4, 9, 6, 8)]
    turns = mesh.axis_turns()
    assert len({t.tobytes() for t in turns}) == 48 and np.array_equal(turns[0], np.eye(3)) and all(abs(t).sum() == 3 and np.array_equal(t @ t.T, np.eye(3)) for t in turns)
    assert [round(np.linalg.det(t)) for t in turns] == [1] * 24 + [-1] * 24


def test_sequences():
    tri = np.array([[0, 1, 2], [2, 3, 0], [4, 5, 6], [0, 1, 3]])
    assert mesh.vertex_chunks(tri, 4).tolist() == [0, 0, 1, 2]
    assert mesh.pack_shelves(np.array([[6, 2], [6, 3], [4, 1]]), 10, 5).tolist() == [[0, 0, 0], [0, 0, 2], [0, 6, 2]]
    with pytest.raises(ValueError):
        mesh.pack_shelves(np.array([[11, 1]]), 10, 5)
    n = np.array([[0.0, 0, 1], [0, 0, 1], [0, 1, 0]])
    assert mesh.merge_coplanar(n, np.array([0.0, 0.001, 0]), [(0, 1), (1, 2)], 0.01, 0.01).tolist() == [0, 0, 2]
    assert abs(mesh.bisect(lambda x: x * x < 2, 0, 2) - 2**0.5) < 1e-12
    with pytest.raises(ValueError):
        mesh.bisect(lambda x: True, 0, 1)
    assert mesh.even_samples(1000, 5).tolist() == [0, 249, 499, 749, 999] and mesh.even_samples(3, 96).tolist() == [0, 1, 2]
    assert mesh.register([np.array([1.0]), np.array([1.2]), np.array([9.0])], lambda x: (round(float(x[0])),), lambda a, b: abs(a - b)[0] < 0.5) == [0, 0, 2]


def test_rays_and_details():
    hit = mesh.blocked_rays(np.array([[2.0, 1.5, -5], [7, 5, -5], [2.0, 1.5, 9.0]]), np.tile([0.0, 0, 1], (3, 1)), POINTS, TRIANGLES)
    assert hit.tolist() == [True, False, False]
    points = np.vstack([POINTS * 10, POINTS * 0.01 + 0.01, POINTS * 0.01 + 500])
    triangles = np.vstack([TRIANGLES + 6 * k for k in range(3)])
    assert mesh.small_details(points, triangles, 1.0, 1.0).tolist() == [False] * 8 + [True] * 8 + [False] * 8
    kept = mesh.retry_lost(np.array([0, 0, 1]), lambda own, limit: own if limit <= (0.3 if own[0] == 0 else 9) else own[:0], 1.0)
    assert kept == {0: 0.25, 1: 1.0} and mesh.retry_lost(np.array([0]), lambda own, limit: own[:0], 1.0) == {0: None}
    assert np.allclose(mesh.areas(POINTS, TRIANGLES)[0], 12)
