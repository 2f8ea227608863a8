"""Polygon kernels in numpy for shapes that are no boxes: clip, hull, simplify, inset, repair."""

from __future__ import annotations

import numpy as np


def signed_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def clip_convex(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Part of a polygon inside a convex window, half-plane by half-plane."""
    if signed_area(window) < 0:
        window = window[::-1]
    out = subject
    for a, b in zip(window, np.roll(window, -1, 0), strict=True):
        if not len(out):
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        nxt, nside = np.roll(out, -1, 0), np.roll(side, -1)
        points = []
        for p, q, s, t in zip(out, nxt, side, nside, strict=True):
            if s >= 0:
                points.append(p)
            if (s > 0 > t) or (s < 0 < t):
                points.append(p + (q - p) * (s / (s - t)))
        out = np.array(points).reshape(-1, 2)
    return out


def clip_area(a: np.ndarray, b: np.ndarray) -> float:
    c = clip_convex(a, b)
    return abs(signed_area(c)) if len(c) > 2 else 0.0


def hull(points: np.ndarray) -> np.ndarray:
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return np.array(pts)

    def chain(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(reversed(pts)))


def simplify(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Drop points nearer than the tolerance to the chord of what stays."""
    keep, todo = {0, len(line) - 1}, [(0, len(line) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        a, d = line[i], line[j] - line[i]
        n = np.hypot(*d)
        mid = line[i + 1 : j] - a
        far = np.abs(d[0] * mid[:, 1] - d[1] * mid[:, 0]) / n if n else np.hypot(mid[:, 0], mid[:, 1])
        k = int(far.argmax())
        if far[k] > tolerance:
            keep.add(i + 1 + k)
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return line[sorted(keep)]


def inset(ring: np.ndarray, by: float) -> np.ndarray:
    """A convex ring moved inwards by a distance."""
    if signed_area(ring) < 0:
        ring = ring[::-1]
    out = ring
    for a, b in zip(ring, np.roll(ring, -1, 0), strict=True):
        d = (b - a) / np.hypot(*(b - a))
        shift = a + by * np.array([-d[1], d[0]])
        far = 4 * np.abs(ring - ring.mean(0)).max() + 1
        n = np.array([-d[1], d[0]])
        out = clip_convex(out, np.array([shift - far * d, shift + far * d, shift + far * d + far * n, shift - far * d + far * n]))
        if len(out) < 3:
            return np.zeros((0, 2))
    return out


def tidy(ring: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Drop repeated vertices and close the ring; says what was done."""
    done = []
    keep = np.r_[True, np.any(ring[1:] != ring[:-1], axis=1)]
    if not keep.all():
        ring = ring[keep]
        done.append("removed_duplicate_vertices")
    if np.any(ring[0] != ring[-1]):
        ring = np.r_[ring, ring[:1]]
        done.append("closed_ring")
    return ring, done
