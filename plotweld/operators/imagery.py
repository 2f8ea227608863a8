"""Buildings and walls from ortho-imagery tiles, with numpy inside each tile.

A tile row is (tile_id, x0, y0, gsd, rows, cols, rgb) and optionally (dsm, dtm): row-major bytes,
three a pixel, and float32 heights; x0 and y0 are the world position of its first pixel. Tiles are
independent, so they should overlap by the largest building: what a border cuts is reported in
parts. Keep spark.sql.execution.arrow.maxRecordsPerBatch near 64 for tables of tiles; a task holds
one batch. Null or mis-sized pixels give no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import kernels

GREEN, GREY_SPREAD, GREY_RANGE, DIM = 15, 30, (80, 180), 40
LEAST_PIXELS, LEAST_AREA, DARK, EDGE_SHARE, LEAST_LENGTH = 64, 4.0, 80, 85, 3.0
FOUND = "tile_id string, part int, type string, wkt string, confidence double, uncertainty double, height double, area double, length double"


def to_world(row, col, x0: float, y0: float, gsd: float):
    return x0 + col * gsd, y0 - row * gsd


def to_pixel(x: float, y: float, x0: float, y0: float, gsd: float) -> tuple[int, int]:
    return int((y0 - y) / gsd), int((x - x0) / gsd)


def read_world_file(text: str) -> tuple[float, float, float]:
    """Pixel size and position of the first pixel of the six lines of a world file."""
    size, _, _, _, x, y = (float(v) for v in text.split())
    return size, x, y


def _grow(mask: np.ndarray, times: int) -> np.ndarray:
    for _ in range(times):
        p = np.pad(mask, 1)
        mask = p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]
    return mask


def _shrink(mask: np.ndarray, times: int) -> np.ndarray:
    """What lies outside the image counts as empty."""
    for _ in range(times):
        p = np.pad(mask, 1)
        mask = p[1:-1, 1:-1] & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    return mask


def components(mask: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of the pixels of each part joined by edges, by first pixel: runs, united by overlap."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    root = list(range(len(row)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    first = np.searchsorted(row, np.arange(mask.shape[0] + 1))
    for r in range(1, mask.shape[0]):
        i, j = int(first[r - 1]), int(first[r])
        while i < first[r] and j < first[r + 1]:
            if start[i] < end[j] and start[j] < end[i]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    parts: dict[int, list[int]] = {}
    for i in range(len(row)):
        parts.setdefault(find(i), []).append(i)
    return [(np.concatenate([np.full(end[i] - start[i], row[i]) for i in runs]), np.concatenate([np.arange(start[i], end[i]) for i in runs])) for runs in parts.values()]


def building_mask(rgb: np.ndarray) -> np.ndarray:
    """Work is done on the part of the tile that is not green, with a margin that growing and shrinking do not leave."""
    wide = rgb.astype(np.int16)
    found = 2 * wide[..., 1] - wide[..., 0] - wide[..., 2] < 2 * GREEN
    out = np.zeros(found.shape, bool)
    down, across = np.flatnonzero(found.any(1)), np.flatnonzero(found.any(0))
    if not len(down):
        return out
    part = slice(max(0, down[0] - 3), down[-1] + 4), slice(max(0, across[0] - 3), across[-1] + 4)
    out[part] = _buildings(rgb[part])
    return out


def _buildings(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., k].astype(float) for k in range(3))
    bright = (r + g + b) / 3
    spread = rgb.max(2).astype(float) - rgb.min(2)
    road = (spread < GREY_SPREAD) & (bright > GREY_RANGE[0]) & (bright < GREY_RANGE[1])
    mask = (g - (r + b) / 2 < GREEN) & ~road & (bright > DIM)
    if not mask.any():
        return mask
    mask = _shrink(_grow(mask, 2), 2)
    mask = _grow(_shrink(mask, 2), 2)
    out = np.zeros_like(mask)
    for rows, cols in components(mask):
        if len(rows) >= LEAST_PIXELS:
            out[rows, cols] = True
    return out


def _slope(grey: np.ndarray) -> np.ndarray:
    p = np.pad(grey, 1, mode="symmetric")
    across, down = p[:, 2:] - p[:, :-2], p[2:] - p[:-2]
    return np.hypot(across[:-2] + 2 * across[1:-1] + across[2:], down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:])


def wall_mask(rgb: np.ndarray) -> np.ndarray:
    grey = np.floor(rgb[..., :3].astype(float) @ np.array([0.299, 0.587, 0.114]))
    dark = grey < DARK
    if not dark.any():
        return dark
    steep = _slope(grey)
    if not steep.any():
        return np.zeros(grey.shape, bool)
    return dark & _grow(steep > np.percentile(steep[steep > 0], EDGE_SHARE), 1)


def outline(rows: np.ndarray, cols: np.ndarray, at: tuple[float, float, float], tolerance: float = 0.5) -> np.ndarray:
    """Hull of the outermost pixels of each row, simplified; the bounds where that has no area."""
    order = np.lexsort((cols, rows))
    first = np.r_[True, np.diff(rows[order]) > 0]
    ends = np.r_[order[first], order[np.r_[first[1:], True]]]
    x, y = to_world(rows[ends], cols[ends], *at)
    ring = kernels.hull(np.c_[x, y])
    if len(ring) < 3 or kernels.signed_area(ring) == 0:
        return np.array([[x.min(), y.min()], [x.max(), y.min()], [x.max(), y.max()], [x.min(), y.max()]])
    slim = kernels.simplify(np.r_[ring, ring[:1]], tolerance)[:-1]
    return slim if len(slim) > 2 and kernels.signed_area(slim) else ring


def axis(rows: np.ndarray, cols: np.ndarray, at: tuple[float, float, float]) -> np.ndarray:
    """Ends of the part along its main direction."""
    pts = np.c_[cols, rows].astype(float)
    mean = pts.mean(0)
    way = np.linalg.svd(pts - mean, full_matrices=False)[2][0]
    along = (pts - mean) @ way
    return np.array([to_world(int(e[1]), int(e[0]), *at) for e in (mean + way * along.min(), mean + way * along.max())])


def _wkt(kind: str, pts: np.ndarray) -> str:
    text = ", ".join(f"{x:.3f} {y:.3f}" for x, y in pts)
    return f"{kind} (({text}))" if kind == "POLYGON" else f"{kind} ({text})"


def _noise(tile: str, part: int, spread: float) -> float:
    return (zlib.crc32(f"{tile}:{part}".encode()) / 2**31 - 1) * spread


def extract_tile(tile: str, rgb: np.ndarray, at: tuple[float, float, float], rise: np.ndarray | None = None) -> list[tuple]:
    """Rows of FOUND; `rise` is surface less terrain."""
    out = []
    for rows, cols in components(building_mask(rgb)):
        ring = outline(rows, cols, at)
        area, around = abs(kernels.signed_area(ring)), float(np.hypot(*(np.roll(ring, -1, 0) - ring).T).sum())
        if area < LEAST_AREA:
            continue
        height = None
        if rise is not None:
            local = ring - ring[0]
            cross = local[:, 0] * np.roll(local[:, 1], -1) - np.roll(local[:, 0], -1) * local[:, 1]
            cx, cy = ring[0] + ((local + np.roll(local, -1, 0)) * cross[:, None]).sum(0) / (3 * cross.sum())
            r, c = to_pixel(cx, cy, *at)
            if 0 <= r < rise.shape[0] and 0 <= c < rise.shape[1]:
                height = round(max(0.0, float(rise[r, c])), 2)
        sure = min(0.98, 0.75 + 0.2 * 4 * math.pi * area / around**2 + _noise(tile, len(out), 0.02))
        out.append((tile, len(out), "BUILDING", _wkt("POLYGON", np.r_[ring, ring[:1]]), round(sure, 3), round(max(0.1, 0.3 - 0.01 * math.sqrt(area)), 3), height, round(area, 2), None))
    for rows, cols in components(wall_mask(rgb)):
        if len(rows) < 4:
            continue
        ends = axis(rows, cols, at)
        length = float(np.hypot(*(ends[1] - ends[0])))
        if length >= LEAST_LENGTH:
            sure = min(0.95, 0.70 + 0.05 * math.log1p(length) + _noise(tile, len(out), 0.03))
            out.append((tile, len(out), "WALL", _wkt("LINESTRING", ends), round(sure, 3), round(max(0.1, 0.25 - 0.005 * length), 3), None, None, round(length, 2)))
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])


def _floats(raw, shape) -> np.ndarray | None:
    return np.frombuffer(raw, np.float32).reshape(shape) if raw is not None and len(raw) == 4 * shape[0] * shape[1] else None


def extract(tiles: DataFrame) -> DataFrame:
    """Buildings and walls of every tile, as rows of FOUND."""
    heights = {"dsm", "dtm"} <= set(tiles.columns)

    def run(batches):
        for batch in batches:
            found: list[tuple] = []
            for t in batch.itertuples(index=False):
                shape = (int(t.rows), int(t.cols))
                if t.rgb is None or len(t.rgb) != 3 * shape[0] * shape[1]:
                    continue
                top, low = (_floats(t.dsm, shape), _floats(t.dtm, shape)) if heights else (None, None)
                rise = None if top is None or low is None else top - low
                found += extract_tile(t.tile_id, np.frombuffer(t.rgb, np.uint8).reshape(*shape, 3), (t.x0, t.y0, t.gsd), rise)
            yield _frame(found)

    keep = ["tile_id", "x0", "y0", "gsd", "rows", "cols", "rgb"] + ["dsm", "dtm"] * heights
    return tiles.where("rows > 0 AND cols > 0").select(keep).mapInPandas(run, FOUND)


def render(kind: str, box: tuple[float, float, float, float], at: tuple[float, float, float], shape: tuple[int, int], seed: int = 0) -> np.ndarray:
    """A synthetic tile: a red roof, or a dark wall along the south of the box, on uneven grass."""
    rgb = (np.array([60, 140, 60]) + np.random.default_rng(seed).integers(-6, 7, (*shape, 1))).astype(np.uint8)
    top, left = to_pixel(box[0], box[3], *at)
    bottom, right = to_pixel(box[2], box[1], *at)
    if kind.startswith("BUILDING"):
        rgb[max(0, top) : bottom + 1, max(0, left) : right + 1] = (170, 80, 70)
    elif kind == "WALL":
        rgb[max(0, bottom - 1) : bottom + 1, max(0, left) : right + 1] = (30, 30, 30)
    return rgb


def extract_rendered(observations: DataFrame, margin: float = 4.0, gsd: float = 0.25) -> DataFrame:
    """Each observed box (obs_id, type, xmin, ymin, xmax, ymax) drawn on a tile of its own and found again."""

    def run(batches):
        for batch in batches:
            found: list[tuple] = []
            for o in batch.itertuples(index=False):
                at = (o.xmin - margin, o.ymax + margin, gsd)
                shape = (int((o.ymax - o.ymin + 2 * margin) / gsd), int((o.xmax - o.xmin + 2 * margin) / gsd))
                found += extract_tile(o.obs_id, render(o.type, (o.xmin, o.ymin, o.xmax, o.ymax), at, shape, zlib.crc32(o.obs_id.encode())), at)
            yield _frame(found)

    # Dealt to a fixed number of tasks, as tiles cost far more than the few bytes of their boxes tell.
    tasks = int(observations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return observations.select("obs_id", "type", "xmin", "ymin", "xmax", "ymax").dropna().repartition(tasks, "obs_id").mapInPandas(run, FOUND)
