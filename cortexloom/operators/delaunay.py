"""Delaunay triangles of the points of one section: incremental, with exact predicates."""

from __future__ import annotations

from fractions import Fraction

import numpy as np

#: The corner of a triangle beyond the hull that is no point.
OUTSIDE = -1


def _turn(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sign of the turn a, b, p for rows of points: in floating point where that is certain, else in fractions."""
    left, right = (b[:, 0] - a[:, 0]) * (p[:, 1] - a[:, 1]), (b[:, 1] - a[:, 1]) * (p[:, 0] - a[:, 0])
    sign = np.sign(left - right)
    for i in np.flatnonzero(np.abs(left - right) <= 1e-14 * (np.abs(left) + np.abs(right))):
        (ax, ay), (bx, by), (px, py) = ([Fraction(float(x)) for x in q[i]] for q in (a, b, p))
        det = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
        sign[i] = (det > 0) - (det < 0)
    return sign


def _in_circle(a: np.ndarray, b: np.ndarray, c: np.ndarray, p: np.ndarray) -> np.ndarray:
    """1 where p lies inside the circle through a, b, c (counterclockwise), 0 on it, -1 outside."""
    u, v, w = a - p, b - p, c - p
    square = [(q * q).sum(axis=1) for q in (u, v, w)]
    minor = [v[:, 0] * w[:, 1], v[:, 1] * w[:, 0], w[:, 0] * u[:, 1], w[:, 1] * u[:, 0], u[:, 0] * v[:, 1], u[:, 1] * v[:, 0]]
    det = square[0] * (minor[0] - minor[1]) + square[1] * (minor[2] - minor[3]) + square[2] * (minor[4] - minor[5])
    size = square[0] * (abs(minor[0]) + abs(minor[1])) + square[1] * (abs(minor[2]) + abs(minor[3])) + square[2] * (abs(minor[4]) + abs(minor[5]))
    sign = np.sign(det)
    for i in np.flatnonzero(np.abs(det) <= 1e-13 * size):
        (px, py), rows = (Fraction(float(x)) for x in p[i]), []
        for q in (a, b, c):
            x, y = Fraction(float(q[i, 0])) - px, Fraction(float(q[i, 1])) - py
            rows.append((x, y, x * x + y * y))
        (ux, uy, uu), (vx, vy, vv), (wx, wy, ww) = rows
        exact = uu * (vx * wy - vy * wx) + vv * (wx * uy - wy * ux) + ww * (ux * vy - uy * vx)
        sign[i] = (exact > 0) - (exact < 0)
    return sign


def triangulate(xy: np.ndarray) -> list[tuple[int, int, int]]:
    """(i, j, k) with i < j < k: triangles that tile the hull of the points, none with a point inside its circle.

    Points are put in one after the other: the triangles whose circle holds the new point make way for a fan around it. Beyond each
    edge of the hull stands a triangle with no third point, whose circle is the outer half plane. Points on one circle are
    triangulated in some way, without overlaps; a repeated point counts once; points on one line have no triangle.
    """
    n = len(xy)
    first = next((i for i in range(1, n) if (xy[i] != xy[0]).any()), None)
    if first is None:
        return []
    side = _turn(np.repeat(xy[:1], n, 0), np.repeat(xy[first : first + 1], n, 0), xy)
    third = next((i for i in range(n) if side[i]), None)
    if third is None:
        return []
    a, b, c = (0, first, third) if side[third] > 0 else (first, 0, third)
    t = np.array([(a, b, c), (b, a, OUTSIDE), (c, b, OUTSIDE), (a, c, OUTSIDE)])
    for q in range(n):
        if q in (a, b, c):
            continue
        ghost = t[:, 2] == OUTSIDE
        hit = np.zeros(len(t), bool)
        real = t[~ghost]
        p = xy[q]
        hit[~ghost] = _in_circle(xy[real[:, 0]], xy[real[:, 1]], xy[real[:, 2]], np.repeat(p[None], len(real), 0)) > 0
        u, v = xy[t[ghost, 0]], xy[t[ghost, 1]]
        turn = _turn(u, v, np.repeat(p[None], len(u), 0))
        between = ((u < p) & (p < v) | (v < p) & (p < u)).any(axis=1)
        hit[ghost] = (turn > 0) | ((turn == 0) & between)
        if not hit.any():
            continue  # the point is there already
        edges = {(int(x), int(y)) for tri in t[hit] for x, y in ((tri[0], tri[1]), (tri[1], tri[2]), (tri[2], tri[0]))}
        fan = []
        for x, y in sorted(edges):
            if (y, x) not in edges:
                fan.append((x, y, q) if OUTSIDE not in (x, y) else (y, q, OUTSIDE) if x == OUTSIDE else (q, x, OUTSIDE))
        t = np.concatenate([t[~hit], np.array(fan)])
    return sorted(tuple(sorted(int(x) for x in tri)) for tri in t[t[:, 2] != OUTSIDE])
