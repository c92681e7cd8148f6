"""Convex hull of points on the unit sphere, and the areas that its facets give to the points. Plain numpy, for the places
of one tile."""

from __future__ import annotations

import numpy as np

#: How far a distance from a facet is told from zero.
EPS = 4e-16


def unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    la, lo = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], 1)


def angle(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Between unit vectors, in radians."""
    return 2 * np.arcsin(np.minimum(1.0, np.sqrt(((x - y) ** 2).sum(-1)) / 2))


def stirred(x: np.ndarray, by: float = 1e-8) -> np.ndarray:
    """The points moved a little, by an amount that follows from their coordinates alone: of four or more on one circle the
    same facets are taken wherever they meet."""
    turn = np.array([[12.9898, 78.233, 37.719], [39.346, 11.135, 83.155], [73.156, 52.235, 9.151]])
    y = x + by * (np.modf(np.sin(x @ turn) * 43758.5453)[0])
    return y / np.linalg.norm(y, axis=1, keepdims=True)


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([a[:, 1] * b[:, 2] - a[:, 2] * b[:, 1], a[:, 2] * b[:, 0] - a[:, 0] * b[:, 2], a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]], 1)


def _normals(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    n = _cross(x[t[:, 1]] - x[t[:, 0]], x[t[:, 2]] - x[t[:, 0]])
    return n / np.maximum(np.sqrt((n * n).sum(1, keepdims=True)), 1e-300)


def facets(x: np.ndarray) -> np.ndarray | None:
    """Triangles of the hull, outward oriented; none if all points are in one plane. Points join one by one; what they see
    of the hull is replaced by a fan around the horizon."""
    n = len(x)
    a = 0
    b = int(np.argmax(((x - x[a]) ** 2).sum(1)))
    c = int(np.argmax((np.cross(x - x[a], x[b] - x[a]) ** 2).sum(1)))
    normal = np.cross(x[b] - x[a], x[c] - x[a])
    normal /= max(float(np.linalg.norm(normal)), 1e-300)
    d = int(np.argmax(np.abs((x - x[a]) @ normal)))
    if abs((x[d] - x[a]) @ normal) < 1e-13:
        return None
    if (x[d] - x[a]) @ normal > 0:
        b, c = c, b
    face = np.zeros((max(64, 6 * n), 3), int)
    norm, off, alive = np.zeros((len(face), 3)), np.zeros(len(face)), np.zeros(len(face), bool)
    used = dead = 0

    def put(t: np.ndarray) -> None:
        nonlocal used, face, norm, off, alive
        while used + len(t) > len(face):
            face, norm, off, alive = (np.concatenate([v, np.zeros_like(v)]) for v in (face, norm, off, alive))
        at = slice(used, used + len(t))
        face[at], norm[at] = t, _normals(x, t)
        off[at], alive[at] = (norm[at] * x[t[:, 0]]).sum(1), True
        used += len(t)

    put(np.array([(a, b, c), (a, d, b), (b, d, c), (c, d, a)]))
    order = np.random.default_rng(0).permutation(n)
    for k in order[~np.isin(order, [a, b, c, d])].tolist():
        seen = np.flatnonzero((norm[:used] @ x[k] - off[:used] > EPS) & alive[:used])
        if not len(seen):
            continue
        alive[seen] = False
        dead += len(seen)
        edges = {e for p, q, r in face[seen].tolist() for e in ((p, q), (q, r), (r, p))}
        put(np.array([(p, q, k) for p, q in edges if (q, p) not in edges]))
        if used > 256 and dead > 2 * (used - dead):
            keep = np.flatnonzero(alive[:used])
            for v in (face, norm, off):
                v[: len(keep)] = v[keep]
            used, dead = len(keep), 0
            alive[:] = False
            alive[:used] = True
    return face[:used][alive[:used]]


def centres(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The middle of each facet's circumscribed cap, on the outer side."""
    return _normals(x, t)


def areas(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Areas of spherical triangles, positive where a, b, c go around counter-clockwise as seen from outside."""
    triple = (a * np.cross(b, c)).sum(1)
    return 2 * np.arctan2(triple, 1 + (a * b).sum(1) + (b * c).sum(1) + (c * a).sum(1))


def delaunay_of(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Each point gets a third of its facets; facets that face away from the centre close the hull of a region and are
    left out."""
    t = t[(_normals(x, t) * x[t[:, 0]]).sum(1) > 1e-15]
    w = np.zeros(len(x))
    np.add.at(w, t.ravel(), np.repeat(np.abs(areas(x[t[:, 0]], x[t[:, 1]], x[t[:, 2]])) / 3, 3))
    return w


def voronoi_of(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Signed sums of the triangles point - edge midpoint - circumcentre over all facets."""
    w, centre = np.zeros(len(x)), centres(x, t)
    for p, q in ((0, 1), (1, 2), (2, 0)):
        a, b = x[t[:, p]], x[t[:, q]]
        mid = a + b
        mid /= np.linalg.norm(mid, axis=1, keepdims=True)
        np.add.at(w, t[:, p], areas(a, mid, centre))
        np.add.at(w, t[:, q], -areas(b, mid, centre))
    return w


def delaunay_areas(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    x = unit(lat, lon)
    return delaunay_of(x, _facets(x))


def voronoi_areas(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    x = unit(lat, lon)
    if len(np.unique(np.round(x, 12), axis=0)) < len(x):
        raise ValueError("coinciding points have no Voronoi cells")
    return voronoi_of(x, _facets(x))


def _facets(x: np.ndarray) -> np.ndarray:
    t = facets(stirred(x)) if len(x) >= 4 else None
    if t is None:
        raise ValueError("the points lie in one plane; they have no hull")
    return t
