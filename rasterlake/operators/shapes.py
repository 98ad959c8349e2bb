"""Features of crops: glyph bitmaps with topology, and shape descriptors; resampling is a product with overlap matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterlake.operators.layout import parts

# Sides of a glyph's grid and of a shape's, orientation bins, and the weights of the two distances.
GRID, SIDE, BINS = 16, 24, 8
ASPECT, HOLES, COMPONENTS = 14.0, 6.0, 10.0
SHAPE_INK, SHAPE_ASPECT, SHAPE_FILL = 0.6, 40.0, 60.0
GLYPH = "bmp: array<int>, coarse: array<int>, log_aspect: double, euler: int, ncomp: int, holes: int"
SHAPE = "hog: array<int>, ink: array<int>, log_aspect: double, fill: double"


def overlaps(cells: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """cells x intervals: how much of each unit cell [k, k + 1) each interval covers."""
    k = np.arange(cells)[:, None]
    return np.maximum(0, np.minimum(k + 1, end[None, :]) - np.maximum(k, start[None, :]))


def resampled(image: np.ndarray, n: int) -> np.ndarray:
    """An image as n by n area means."""
    means = []
    for size in image.shape:
        edge = np.arange(n + 1) * (size / n)
        w = overlaps(size, edge[:-1], edge[1:]).T
        means.append(w / w.sum(1, keepdims=True))
    return means[0] @ image @ means[1].T


def smoothed(grid: np.ndarray) -> np.ndarray:
    """Weights 1 2 1 along both axes; nothing lies beyond the border."""
    for axis in (0, 1):
        padded = np.pad(grid, [(1, 1) if a == axis else (0, 0) for a in (0, 1)])
        low, high = (padded.take(range(k, k + grid.shape[axis]), axis) for k in (0, 2))
        grid = 2 * grid + low + high
    return grid


def component_boxes(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """x, y, w, h of each component of a mask, corners joining, in the order in which rows meet them."""
    left, boxes = np.pad(mask.astype(bool), 1), []
    while left.any():
        front = np.zeros_like(left)
        front[tuple(np.argwhere(left)[0])] = True
        whole = np.zeros_like(left)
        while front.any():
            whole |= front
            left &= ~front
            spread = np.pad(front, 1)
            front = left & np.any([spread[1 + i : spread.shape[0] - 1 + i, 1 + j : spread.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
        y, x = np.nonzero(whole)
        boxes.append((int(x.min()) - 1, int(y.min()) - 1, int(x.max() - x.min()) + 1, int(y.max() - y.min()) + 1))
    return boxes


def topology(mask: np.ndarray) -> tuple[int, int]:
    """Euler number and number of components, corners joining."""
    m = np.pad(mask.astype(int), 1)
    a, b, c, d = m[:-1, :-1], m[:-1, 1:], m[1:, :-1], m[1:, 1:]
    s = a + b + c + d
    euler = int((s == 1).sum() - (s == 3).sum() - 2 * ((s == 2) & (a == d)).sum()) // 4
    return euler, len(parts(mask.astype(bool)).box)


def border_level(image: np.ndarray) -> float:
    """The upper median of the outermost rows and columns, corners once."""
    edge = np.sort(np.concatenate([image[0], image[-1], image[1:-1, 0], image[1:-1, -1]]))
    return edge[len(edge) // 2]


def check_state(image: np.ndarray, delta: int = 40, inner: float = 0.6) -> tuple[str, float] | None:
    """Whether the control in a grey crop is checked, and how surely; None for a crop that is too small.

    The control is the component that stands out from the border and has the largest box, if that has a third of each
    side, or else the whole crop. It is checked if the middle of it spreads over more than delta levels.
    """
    h, w = image.shape
    if min(h, w) < 4:
        return None
    x, y, bw, bh = max(component_boxes(np.abs(image.astype(int) - int(border_level(image))) > delta), key=lambda b: b[2] * b[3], default=(0, 0, w, h))
    if bw < w // 3 or bh < h // 3:
        x, y, bw, bh = 0, 0, w, h
    iw, ih = max(1, int(bw * inner)), max(1, int(bh * inner))
    x, y = x + (bw - iw) // 2, y + (bh - ih) // 2
    values = np.sort(image[y : y + ih, x : x + iw].ravel()).astype(int)
    at = lambda q: values[-(-q * len(values) // 100) - 1]
    spread = at(95) - at(5)
    return ("checked" if spread > delta else "unchecked"), float(min(1.0, 0.5 + abs(spread - delta) / 120))


def glyph(ink: np.ndarray, mask: np.ndarray, smooth: bool = True) -> dict:
    """The feature of a glyph's ink (0 to 255) and mask, both just as large as the glyph."""
    if not ink.size:
        return {"bmp": [0] * GRID**2, "coarse": [0] * 16, "log_aspect": 0.0, "euler": 1, "ncomp": 1, "holes": 0}
    h, w = ink.shape
    s = GRID / max(w, h)
    along = []
    for size in (h, w):
        at = (GRID - size * s) / 2 + np.arange(size) * s
        along.append(overlaps(GRID, at, at + s))
    grid = along[0] @ ink.astype(float) @ along[1].T
    grid = smoothed(grid) if smooth else grid
    bmp = np.minimum(255, grid * (255 / grid.max()) + 0.5).astype(int) if grid.max() > 0 else np.zeros((GRID, GRID), int)
    euler, count = topology(mask)
    euler, count = max(-3, min(3, euler)), min(4, count)
    coarse = bmp.reshape(4, 4, 4, 4).sum((1, 3))
    return {"bmp": bmp.ravel().tolist(), "coarse": coarse.ravel().tolist(), "log_aspect": float(np.log2(w / h)), "euler": euler, "ncomp": count, "holes": max(0, min(3, count - euler))}


def shape(image: np.ndarray, delta: int = 32) -> dict:
    """Orientation histogram (4 by 4 cells), ink map (8 by 8), aspect and fill of a grey crop; zeros below 2 by 2."""
    if min(image.shape) < 2:
        return {"hog": [0] * 16 * BINS, "ink": [0] * 64, "log_aspect": 0.0, "fill": 0.0}
    image = image.astype(float)
    ground = border_level(image)
    p = resampled(image, SIDE)
    wide = np.pad(p, 1, mode="edge")
    gx, gy = wide[1:-1, 2:] - wide[1:-1, :-2], wide[2:, 1:-1] - wide[:-2, 1:-1]
    strength = np.hypot(gx, gy)
    angle = np.arctan2(gy, gx)
    bins = np.minimum(BINS - 1, (np.where(angle < 0, angle + np.pi, angle) / np.pi * BINS).astype(int))
    cell = np.arange(SIDE) // 6
    hog = np.bincount(((cell[:, None] * 4 + cell[None, :]) * BINS + bins).ravel(), strength.ravel(), minlength=16 * BINS)
    total = hog.sum()
    ink = np.abs(p - ground).reshape(8, 3, 8, 3).mean((1, 3))
    return {
        "hog": np.minimum(255, hog / total * 255 * 16).astype(int).tolist() if total > 0 else [0] * 16 * BINS,
        "ink": (ink / ink.max() * 255).astype(int).ravel().tolist() if ink.max() > 0 else [0] * 64,
        "log_aspect": float(np.log2(image.shape[1] / image.shape[0])), "fill": float((np.abs(image - ground) > delta).mean()),
    }


def _struct(rows: list[dict], schema: str) -> pa.StructArray:
    kinds = {"array<int>": pa.list_(pa.int32()), "double": pa.float64(), "int": pa.int32()}
    fields = [f.split(": ") for f in schema.split(", ")]
    return pa.StructArray.from_arrays([pa.array([r[n] for r in rows], kinds[t]) for n, t in fields], [n for n, _ in fields])


def shape_of(v: Column, width: Column) -> Column:
    """The shape descriptor of crops given by rows of brightness."""

    @F.arrow_udf(f"struct<{SHAPE}>")
    def run(values: pa.Array, widths: pa.Array) -> pa.Array:
        return _struct([shape(np.array(a).reshape(-1, w)) for a, w in zip(values.to_pylist(), widths.to_pylist())], SHAPE)

    return run(v, width)


def state_of(v: Column, width: Column) -> Column:
    """check_state() of crops given by rows: struct of value and score, null where there is none."""

    @F.arrow_udf("struct<value: string, score: double>")
    def run(values: pa.Array, widths: pa.Array) -> pa.Array:
        rows = [check_state(np.array(a).reshape(-1, w)) for a, w in zip(values.to_pylist(), widths.to_pylist())]
        none = pa.array([r is None for r in rows])
        columns = [pa.array([r and r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64()))]
        return pa.StructArray.from_arrays(columns, ["value", "score"], mask=none)

    return run(v, width)


def glyph_of(ink: Column, width: Column) -> Column:
    """The glyph feature of ink given by rows; its mask is where ink is 128 or more."""

    @F.arrow_udf(f"struct<{GLYPH}>")
    def run(values: pa.Array, widths: pa.Array) -> pa.Array:
        images = [np.array(a).reshape(-1, w) for a, w in zip(values.to_pylist(), widths.to_pylist())]
        return _struct([glyph(i, i >= 128) for i in images], GLYPH)

    return run(ink, width)


def _l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)


def _scalars(a: Column, b: Column) -> Column:
    gap = lambda n: F.abs(a[n] - b[n])
    return ASPECT * gap("log_aspect") + HOLES * gap("holes") + COMPONENTS * gap("ncomp")


def glyph_distance(a: Column, b: Column) -> Column:
    return _l1(a["bmp"], b["bmp"]) / 255 + _scalars(a, b)


def glyph_bound(a: Column, b: Column) -> Column:
    """Never above glyph_distance()."""
    return _l1(a["coarse"], b["coarse"]) / 255 + _scalars(a, b)


def shape_distance(a: Column, b: Column) -> Column:
    return _l1(a["hog"], b["hog"]) / 255 + SHAPE_INK * _l1(a["ink"], b["ink"]) / 255 + SHAPE_ASPECT * F.abs(a["log_aspect"] - b["log_aspect"]) + SHAPE_FILL * F.abs(a["fill"] - b["fill"])
