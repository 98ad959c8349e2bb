"""Reading lines of text: ink of a crop, glyph hypotheses, their nearest templates, and the cheapest way through them.

A crop's ink is cut into pieces; every run of a few neighbouring pieces may be a glyph and is measured against the
templates. Two passes of dynamic programming choose the runs: the first by shape alone, the second also by how glyphs stand
on the line that is fitted to the first. Templates are a dimension table of bounded size (an atlas, which grows with fonts
and sizes, not with frames); their matrix is broadcast, after a check of its size, and equal crops are read once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.functions import text as T
from rasterlake.operators.cut import cut
from rasterlake.operators.graph import rooted
from rasterlake.operators.knn import Metric, _best, _coarse
from rasterlake.operators.layout import ELEMENTS, LayoutRules, Page, Parts, over_frames, parts, percentile, united
from rasterlake.operators.raster import grey, planes
from rasterlake.operators.shapes import ASPECT, COMPONENTS, HOLES, glyph

#: Templates that may be broadcast: 400 bytes each.
MOST_TEMPLATES = 1_000_000


@dataclass(frozen=True)
class InkRules:
    """Fixed values of ink extraction."""

    trim: bool = False  # leave out outer rows and columns that are nearly of one class
    trim_share: float = 0.95
    trim_least: int = 4
    shadows: bool = True  # text with a shadow, or an outline, on a ground between the two
    shadow_step: int = 40
    shadow_sharper: float = 2.0
    local: bool = False  # a threshold around each pixel (Sauvola's)
    local_weight: float = 0.2
    local_height: float = 1.2
    local_floor: int = 64


@dataclass(frozen=True)
class ReadRules:
    """Fixed values of the recogniser: costs in units of distance, sizes as shares of the text height."""

    per_glyph: float = 10.0
    skip_speck: float = 18.0
    skip_glyph: float = 400.0
    speck: float = 0.3
    most_pieces: int = 5
    widest: float = 1.9
    cut_wide: float = 0.62
    cut_profile: float = 0.55
    cut_edge: float = 0.12
    cut_apart: float = 0.15
    bridge: int = 1
    bridge_ink: int = 64
    apart: float = 0.22
    stacked: float = 0.45
    enclosed: float = 1.5
    space: float = 0.38
    trim_border: bool = True
    sliver: float = 0.3
    by_line: bool = True
    harmonize: bool = True
    placement: float = 20.0
    height: float = 20.0
    height_slack: float = 0.25
    least_width: float = 0.35
    far_from_line: float = 0.35
    contrast: int = 28
    candidates: int = 4
    margin: float = 15.0
    ascii_marks: bool = False
    ink: InkRules = field(default_factory=InkRules)


@dataclass
class Ink:
    """mask and soft (0: ground, 255: text), the threshold, whether text is the darker, and both levels."""

    mask: np.ndarray
    soft: np.ndarray
    threshold: int
    dark: bool
    ground: int
    level: int


def otsu_level(hist: np.ndarray) -> int:
    """The lowest value up to which one class best parts from the rest; 127 where there is one value."""
    v = np.arange(256)
    n, s = hist.sum(), float((hist * v).sum())
    w0, s0 = np.cumsum(hist).astype(float), np.cumsum(hist * v).astype(float)
    able = (w0 > 0) & (w0 < n)
    if not able.any():
        return 127
    w0, s0, v = w0[able], s0[able], v[able]
    return int(v[np.argmax(w0 * (n - w0) * (s0 / w0 - (s - s0) / (n - w0)) ** 2)])


def _median(hist: np.ndarray, low: int, high: int) -> int:
    """The lower median of the values from low to high; low where there are none."""
    c = np.cumsum(hist[low : high + 1])
    return low + int(np.argmax(2 * c >= c[-1]))


def _inner(image: np.ndarray, threshold: int, r: InkRules) -> np.ndarray:
    """The image without outer rows and columns of which nearly all pixels are of one class, one side after the other."""
    up = image > threshold
    y0, x0 = 0, 0
    y1, x1 = image.shape
    calm = lambda v: not 1 - r.trim_share < v.mean() < r.trim_share
    while y1 - y0 > r.trim_least and calm(up[y0, x0:x1]):
        y0 += 1
    while y1 - y0 > r.trim_least and calm(up[y1 - 1, x0:x1]):
        y1 -= 1
    while x1 - x0 > r.trim_least and calm(up[y0:y1, x0]):
        x0 += 1
    while x1 - x0 > r.trim_least and calm(up[y0:y1, x1 - 1]):
        x1 -= 1
    return image[y0:y1, x0:x1]


def _strokes_dark(up: np.ndarray, default: bool) -> bool:
    """Whether the lower class has the shorter stretches inside rows; default where either has none."""
    wide = np.pad(up.astype(np.int8), ((0, 0), (1, 1)), constant_values=2)
    y, x = np.nonzero(np.diff(wide, axis=1))
    a, b = x[:-1][y[:-1] == y[1:]], x[1:][y[:-1] == y[1:]]
    row = y[:-1][y[:-1] == y[1:]]
    inside = (a > 0) & (b < up.shape[1])
    a, b, row = a[inside], b[inside], row[inside]
    light = up[row, a]
    n1, n0 = int(light.sum()), int((~light).sum())
    l1, l0 = int((b - a)[light].sum()), int((b - a)[~light].sum())
    return l0 * n1 < l1 * n0 if n0 and n1 else default


def extract_ink(image: np.ndarray, r: InkRules = InkRules()) -> Ink:
    """The ink of a grey crop: which class is text, and how far each pixel is on the way from the ground to it."""
    image = image.astype(int)
    if not image.size:
        return Ink(np.zeros(image.shape, bool), np.zeros(image.shape, int), 127, True, 255, 0)
    count = lambda v: np.bincount(v.ravel(), minlength=256)
    hist = count(image)
    t = otsu_level(hist)
    inner = image
    if r.trim:
        inner = _inner(image, t, r)
        if inner.shape != image.shape:
            hist = count(inner)
            t = otsu_level(hist)
    up = inner > t
    frame = np.concatenate([up[0], up[-1], up[1:-1, 0], up[1:-1, -1]])
    above, below = int(frame.sum()), int((~frame).sum())
    dark = above >= below
    if max(above, below) * 4 < (above + below) * 3:
        dark = _strokes_dark(image > t, dark)

    def softened(dark: bool, ground: int, level: int) -> np.ndarray:
        way = (ground - image if dark else image - ground) * 255
        return np.clip(way // max(1, abs(ground - level)), 0, 255)

    if r.shadows:
        ring = np.sort(np.concatenate([image[0], image[-1], image[1:-1, 0], image[1:-1, -1]]))
        ground = int(ring[len(ring) // 2])
        low, high = percentile(np.repeat(np.arange(256), hist), 2), percentile(np.repeat(np.arange(256), hist), 98)
        down, up_ = ground - low, high - ground
        if min(down, up_) >= r.shadow_step:  # both sides of the ground are there: the sharper is text, else the farther
            sharp = []
            for step, way in ((down, ground - image), (up_, image - ground)):
                some = int((4 * way >= step).sum())
                sharp.append(int((4 * way >= 3 * step).sum()) / some if some else 0.0)
            dark = True if sharp[0] > r.shadow_sharper * sharp[1] else False if sharp[1] > r.shadow_sharper * sharp[0] else down > up_
            level = low if dark else high
            soft = softened(dark, ground, level)
            return Ink(soft >= 128, soft, (ground + level) // 2, dark, ground, level)
    low, high = _median(hist, 0, t), _median(hist, t + 1, 255)
    ground, level = (high, low) if dark else (low, high)
    soft = softened(dark, ground, level)
    mask = soft >= 128
    if r.local:
        n = max(3, int(r.local_height * image.shape[0])) | 1
        mask = (255 - soft < _local_threshold(255 - soft, n // 2, r.local_weight)) & (soft >= r.local_floor)
    return Ink(mask, soft, t, dark, ground, level)


def _local_threshold(v: np.ndarray, reach: int, weight: float) -> np.ndarray:
    """Mean times (1 + weight * (deviation / 128 - 1)) of the window around each pixel, clipped to the image."""
    h, w = v.shape
    y, x = np.arange(h), np.arange(w)
    y0, y1, x0, x1 = np.maximum(0, y - reach), np.minimum(h, y + reach + 1), np.maximum(0, x - reach), np.minimum(w, x + reach + 1)

    def window(a: np.ndarray) -> np.ndarray:
        s = np.zeros((h + 1, w + 1))
        s[1:, 1:] = a.cumsum(0).cumsum(1)
        return s[y1][:, x1] - s[y0][:, x1] - s[y1][:, x0] + s[y0][:, x0]

    n = window(np.ones((h, w)))
    mean = window(v.astype(float)) / n
    spread = np.sqrt(np.maximum(0.0, window(v.astype(float) ** 2) / n - mean * mean))
    return mean * (1 + weight * (spread / 128 - 1))


# -- templates


class Templates:
    """The atlas as arrays: features, characters, and where their ink begins and ends against the baseline, in cap heights."""

    def __init__(self, rows: list[dict]) -> None:
        self.ch = [r["ch"] for r in rows]
        self.top, self.bottom = (np.array([r[c] for r in rows], float) for c in ("top_rel", "bot_rel"))
        v = np.array([r["bmp"] for r in rows], np.int64).reshape(len(rows), -1)
        s = np.array([[r["log_aspect"], r["holes"], r["ncomp"]] for r in rows], float).reshape(len(rows), 3)
        self.block = {"v": v, "c": _coarse(v) if len(v) else v, "s": s, "id": np.arange(len(rows)), "label": np.unique(self.ch, return_inverse=True)[1] if rows else np.zeros(0, int)}
        self.metric = Metric((ASPECT, HOLES, COMPONENTS), 255)
        self.known: dict[tuple, list] = {}

    def nearest(self, feature: dict, k: int, margin: float) -> list[tuple[float, int]]:
        """(distance, template) of the k nearest characters within margin of the best; equal features are searched once."""
        key = (*feature["bmp"], feature["log_aspect"], feature["holes"], feature["ncomp"], k)
        if key not in self.known:
            if len(self.known) >= 20_000:
                self.known.clear()
            q, s, b = np.array(feature["bmp"], np.int64), np.array([feature["log_aspect"], feature["holes"], feature["ncomp"]], float), self.block
            bound = np.abs(b["c"] - _coarse(q[None])[0]).sum(1) / self.metric.unit + self.metric.scalar(b["s"], s)
            most, first = float("inf"), np.argsort(bound, kind="stable")[: 16 * k]
            at, dist = self.metric.within(q, s, {n: x[first] for n, x in b.items()}, most)
            own = _best({n: x[first] for n, x in b.items()}, at, dist, k, True)
            if len(own):
                most = dist[own[0]] + margin if len(own) < k else min(dist[own[-1]], dist[own[0]] + margin)
            near = np.flatnonzero(bound <= most + 1e-9)
            part = {n: x[near] for n, x in b.items()}
            at, dist = self.metric.within(q, s, part, most)
            own = _best(part, at, dist, k, True)
            self.known[key] = [(float(dist[i]), int(near[at[i]])) for i in own if dist[i] <= dist[own[0]] + margin]
        return self.known[key]


TEMPLATE = "font string, ch string, px int, top_rel double, bot_rel double, bmp array<int>, coarse array<int>, log_aspect double, euler int, ncomp int, holes int"


def templates(glyphs: DataFrame) -> DataFrame:
    """TEMPLATE rows of an atlas (font, ch, px, top, w, h, cap_h, ink), each through the same pipeline as a crop.

    A glyph is drawn dark on light with two pixels around it; one without ink gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if not r["w"] or not r["h"]:
                    continue
                image = np.full((r["h"] + 4, r["w"] + 4), 255, int)
                image[2:-2, 2:-2] = 255 - np.frombuffer(r["ink"], np.uint8).reshape(r["h"], r["w"]).astype(int)
                crop = Crop(image)
                if not len(crop.parts.box):
                    continue
                feature, box = crop.feature(crop.parts.runs[:, :3])
                cap = float(max(1, r["cap_h"]))
                rows.append({"font": r["font"], "ch": chr(r["ch"]), "px": r["px"], "top_rel": (r["top"] + box[1] - 2) / cap, "bot_rel": (r["top"] + box[1] + box[3] - 2) / cap, **feature})
            yield _batch(rows, TEMPLATE)

    return glyphs.select("font", "ch", "px", "top", "w", "h", "cap_h", "ink").mapInArrow(run, TEMPLATE)


_TYPES = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _TYPES[t]) for n, t in fields], [n for n, _ in fields])


# -- a crop


@dataclass
class Piece:
    """A stretch of an atom: its pixels as runs (y, x0, x1), its box, and which atom it is of."""

    runs: np.ndarray
    box: np.ndarray
    atom: int


@dataclass
class Hypothesis:
    box: np.ndarray
    candidates: list[tuple[float, int]]
    chosen: int = 0


def _box(runs: np.ndarray) -> np.ndarray:
    x, y = runs[:, 1].min(), runs[:, 0].min()
    return np.array([x, y, runs[:, 2].max() - x, runs[:, 0].max() + 1 - y])


class Crop:
    """A grey crop with its ink and components."""

    def __init__(self, image: np.ndarray, rules: InkRules = InkRules()) -> None:
        self.ink = extract_ink(image, rules)
        self.parts: Parts = parts(self.ink.mask)
        self.height, self.width = image.shape

    def feature(self, runs: np.ndarray) -> tuple[dict, np.ndarray]:
        """The glyph feature of some of the ink, and its box: its own pixels, and the paler ones around that nobody claims."""
        box = _box(runs)
        x, y, w, h = box
        own = np.zeros((h + 2, w + 2), bool)
        for r, a, b in runs.tolist():
            own[r - y + 1, a - x + 1 : b - x + 1] = True
        near = np.any([own[1 + i : h + 1 + i, 1 + j : w + 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
        own = own[1:-1, 1:-1]
        at = slice(y, y + h), slice(x, x + w)
        return glyph(np.where(own | (near & ~self.ink.mask[at]), self.ink.soft[at], 0), own), box

    def text_height(self) -> float:
        """The middle of the tallest third of components that aren't specks; 0 if there are none."""
        h = np.sort(self.parts.box[self.parts.area >= 3][:, 3])
        return float(h[len(h) - 1 - len(h) // 3 // 2]) if len(h) else 0.0

    def atoms(self, size: float, r: ReadRules) -> list[list[int]]:
        """Components that belong together: one above the other closely, or one within another."""
        x, y, w, h = self.parts.box.T
        n = len(x)
        over = np.minimum((x + w)[:, None], x + w) - np.maximum(x[:, None], x)
        beside = np.minimum((y + h)[:, None], y + h) - np.maximum(y[:, None], y)
        stacked = (over >= np.maximum(1, np.minimum(w[:, None], w) // 2)) & (beside <= 0) & (-beside <= int(r.stacked * size))
        holds = (x[:, None] <= x) & (y[:, None] <= y) & ((x + w)[:, None] >= x + w) & ((y + h)[:, None] >= y + h) & (h[:, None] <= r.enclosed * size)
        groups: dict[int, list[int]] = {}
        for i, root in rooted(list(range(n)), np.argwhere(np.triu(stacked | holds | holds.T, 1)).tolist()).items():
            groups.setdefault(root, []).append(i)
        # a lone pixel is a speck unless it stands with something
        return [g for g in groups.values() if len(g) > 1 or self.parts.area[g[0]] >= 2]

    def without_fragments(self, atoms: list[list[int]], size: float, r: ReadRules) -> list[list[int]]:
        """atoms without what a loose crop has of its neighbours: at the border, above or below the line, or thin and apart."""
        box = np.array([united(self.parts.box[g]) for g in atoms]).reshape(-1, 4)
        whole = (box[:, 3] >= 0.5 * size) & (box[:, 1] > 0) & (box[:, 1] + box[:, 3] < self.height)
        if not whole.any():
            return atoms
        upper = lambda v: np.sort(v)[len(v) // 2]
        top, bottom = upper(box[whole][:, 1]), upper(box[whole][:, 1] + box[whole][:, 3])
        kept = []
        for k, (x, y, w, h) in enumerate(box):
            middle = y + h / 2
            if (y == 0 or y + h == self.height) and not top <= middle <= bottom:
                continue
            if (x == 0 or x + w == self.width) and w < r.sliver * size and h >= 0.5 * size:
                others = np.delete(box, k, 0)
                gap = others[:, 0] - x - w if x == 0 else x - others[:, 0] - others[:, 2]
                gap = gap[gap >= -1]
                if not len(gap) or gap.min() > r.sliver * size:
                    continue
            kept.append(atoms[k])
        return kept

    def cuts(self, runs: np.ndarray, box: np.ndarray, size: float, r: ReadRules) -> list[int]:
        """Columns of an atom at which its ink is least around and little at all; of near ones, the last of the least."""
        x, _, w, _ = box
        if w <= r.cut_wide * size or w < 4:
            return []
        profile = np.zeros(w + 1, int)
        np.add.at(profile, runs[:, 1] - x, 1)
        np.add.at(profile, runs[:, 2] - x, -1)
        profile = profile.cumsum()[:w]
        edge = max(1, int(r.cut_edge * size))
        at = np.arange(edge, w - edge)
        at = at[(profile[at] <= r.cut_profile * profile.max()) & (profile[at] <= profile[at - 1]) & (profile[at] <= profile[at + 1])] if len(at) else at
        found: list[int] = []
        for k in at.tolist():
            if found and k - found[-1] < max(2.0, r.cut_apart * size):
                if profile[k] <= profile[found[-1]]:
                    found[-1] = k
            else:
                found.append(k)
        return found

    def pieces(self, atoms: list[list[int]], size: float, r: ReadRules) -> list[Piece]:
        """The atoms, cut where they are wide, from left to right by their middles."""
        out = []
        for n, atom in enumerate(atoms):
            runs = np.concatenate([self.parts.of(c)[:, :3] for c in atom])
            box = united(self.parts.box[atom])
            ends = [box[0], *(box[0] + c for c in self.cuts(runs, box, size, r)), box[0] + box[2]]
            for a, b in zip(ends, ends[1:]):
                own = runs.copy()
                own[:, 1], own[:, 2] = np.maximum(own[:, 1], a), np.minimum(own[:, 2], b)
                own = own[own[:, 2] > own[:, 1]]
                if len(own):
                    out.append(Piece(own, _box(own), n))
        return sorted(out, key=lambda p: (2 * p.box[0] + p.box[2], p.box[1]))

    def hypotheses(self, own: list[Piece], size: float, r: ReadRules, atlas: Templates) -> list[dict[int, Hypothesis]]:
        """For each piece, by their number, the runs of pieces from it on that may be one glyph."""
        found: list[dict[int, Hypothesis]] = []
        for i, first in enumerate(own):
            here: dict[int, Hypothesis] = {}
            found.append(here)
            box, runs = first.box, [first.runs]
            for j in range(i, min(len(own), i + r.most_pieces)):
                if j > i:
                    nxt = own[j]
                    gap = int(nxt.box[0] - box[0] - box[2])
                    if gap > r.apart * size:
                        break
                    if nxt.atom != own[j - 1].atom and gap > 0 and (gap > r.bridge or not self._bridged(box, nxt.box, r.bridge_ink)):
                        break
                    box = united(np.stack([box, nxt.box]))
                    runs.append(nxt.runs)
                if box[2] > r.widest * size:
                    break
                feature, whole = self.feature(np.concatenate(runs))
                candidates = atlas.nearest(feature, min(r.candidates, 8), r.margin)
                if candidates:
                    here[j - i + 1] = Hypothesis(whole, candidates)
        return found

    def _bridged(self, a: np.ndarray, b: np.ndarray, least: int) -> bool:
        """Whether ink, pale ink too, lies between two boxes, in the rows that they share."""
        between = self.ink.soft[max(a[1], b[1]) : min(a[1] + a[3], b[1] + b[3]), a[0] + a[2] : b[0]]
        return bool((between >= least).any())


@dataclass
class Reading:
    """A text with its evidence; glyphs are boxes with characters and distances."""

    text: str = ""
    glyphs: list[tuple[np.ndarray, str, float]] = field(default_factory=list)
    baseline: float = 0.0
    cap_height: float = 0.0
    fitted: bool = False
    mean_dist: float = 0.0
    alnum: float = 0.0
    residual: float = 1.0


# Rarity costs and the characters whose height says nothing about the line are those of functions.text.
def _rarity(c: str) -> float:
    if c.isascii() and c.isalnum() or c == "ı":
        return 0.0
    return 1.5 if c in T.COMMON_MARKS else 2.5 if "À" <= c <= "ÿ" and c != "×" else 6.0


class Reader:
    """Reads crops by one set of templates."""

    def __init__(self, atlas: Templates, rules: ReadRules = ReadRules()) -> None:
        self.atlas, self.rules = atlas, rules

    def off_line(self, h: Hypothesis, k: int, base: float, size: float) -> float:
        """How far a candidate's top and bottom are from where its template has them, in cap heights."""
        t = h.candidates[k][1]
        return (abs(h.box[1] - (base + self.atlas.top[t] * size)) + abs(h.box[1] + h.box[3] - (base + self.atlas.bottom[t] * size))) / size

    def choose(self, h: Hypothesis, height: float, line: tuple[float, float] | None) -> float:
        """Set the best candidate, and say what it costs."""
        r, costs = self.rules, []
        width = max(r.least_width, h.box[2] / height)
        for k, (dist, t) in enumerate(h.candidates):
            cost = dist * width + _rarity(self.atlas.ch[t])
            if line:
                cost += r.placement * self.off_line(h, k, *line)
            else:
                cost += r.height * max(0.0, abs(h.box[3] / height - (self.atlas.bottom[t] - self.atlas.top[t])) - r.height_slack)
            costs.append(cost)
        h.chosen = int(np.argmin(costs))
        return costs[h.chosen]

    def path(self, own: list[Piece], hyps: list[dict[int, Hypothesis]], height: float, line: tuple[float, float] | None) -> list[Hypothesis]:
        """The cheapest sequence of hypotheses and skipped pieces; of equal ones, what was found first."""
        r, n = self.rules, len(own)
        best: list[tuple[float, int, Hypothesis | None]] = [(float("inf"), -1, None)] * (n + 1)
        best[0] = (0.0, -1, None)
        for i, here in enumerate(hyps):
            skip = r.skip_speck if min(1.0, own[i].box[3] / height) < r.speck else r.skip_glyph
            steps = [(1, skip, None)] + [(k, self.choose(h, height, line) + r.per_glyph, h) for k, h in sorted(here.items())]
            for k, cost, h in steps:
                if best[i][0] + cost < best[i + k][0]:
                    best[i + k] = (best[i][0] + cost, i, h)
        out, at = [], n
        while at > 0:
            _, before, h = best[at]
            if h:
                out.append(h)
            at = before
        return out[::-1]

    def fit(self, glyphs: list[Hypothesis]) -> tuple[float, float] | None:
        """Baseline and cap height by least squares over tops and bottoms, and again without glyphs far from the first."""
        told = [h for h in glyphs if self.atlas.ch[h.candidates[h.chosen][1]] not in T.NO_PLACEMENT]

        def line(of: list[Hypothesis]) -> tuple[float, float] | None:
            t = [h.candidates[h.chosen][1] for h in of]
            rel = np.concatenate([self.atlas.top[t], self.atlas.bottom[t]])
            seen = np.array([h.box[1] for h in of] + [h.box[1] + h.box[3] for h in of], float)
            det = len(rel) * (rel * rel).sum() - rel.sum() ** 2
            if len(rel) < 2 or abs(det) < 1e-6:
                return None
            size = (len(rel) * (rel * seen).sum() - rel.sum() * seen.sum()) / det
            return ((seen.sum() - size * rel.sum()) / len(rel), size) if size > 2 else None

        one = line(told)
        return one and (line([h for h in told if self.off_line(h, h.chosen, *one) < self.rules.far_from_line]) or one)

    def read(self, image: np.ndarray) -> Reading:
        """A grey crop's reading; empty where there is no ink of enough contrast."""
        r, out = self.rules, Reading()
        if image.shape[1] < 2 or image.shape[0] < 4:
            return out
        crop = Crop(image, r.ink)
        height = crop.text_height()
        if abs(crop.ink.ground - crop.ink.level) < r.contrast or not height:
            return out
        atoms = crop.atoms(height, r)
        own = crop.pieces(crop.without_fragments(atoms, height, r) if r.trim_border else atoms, height, r)
        hyps = crop.hypotheses(own, height, r, self.atlas)
        glyphs = self.path(own, hyps, height, None)
        if not glyphs:
            return out
        out.cap_height = height
        line = self.fit(glyphs) if r.by_line else None
        if line:
            glyphs = self.path(own, hyps, height, line)
            line = self.fit(glyphs) or line
            for h in glyphs:
                self.choose(h, height, line)
            (out.baseline, out.cap_height), out.fitted = line, True
        ch = [self.atlas.ch[h.candidates[h.chosen][1]] for h in glyphs]
        words, last = [[]], None
        for h, c in zip(glyphs, ch):
            if last is not None and h.box[0] - last > r.space * out.cap_height:
                words.append([])
            last = h.box[0] + h.box[2]
            words[-1].append("i" if c == "ı" else T.MARKS_TO_ASCII.get(c, c) if r.ascii_marks else c)
        whole = ["".join(w) for w in words]
        out.text = " ".join(T.harmonized(w) if r.harmonize else w for w in whole)
        out.glyphs = [(h.box, c, h.candidates[h.chosen][0]) for h, c in zip(glyphs, ch)]
        out.mean_dist = sum(g[2] for g in out.glyphs) / len(ch)
        out.alnum = sum(c.isascii() and c.isalnum() or "À" <= c <= "ſ" for c in ch) / len(ch)
        out.residual = sum(self.off_line(h, h.chosen, *line) for h in glyphs) / len(ch) if line else 1.0
        return out


READING = "text string, n_glyphs int, baseline double, cap_height double, fitted boolean, mean_dist double, alnum double, residual double"


def _checked(atlas: DataFrame) -> list[dict]:
    rows = atlas.orderBy("font", "ch", "px", "top_rel", "bot_rel").limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates can't be broadcast; prune the atlas")
    return [r.asDict() for r in rows]


def read_crops(crops: DataFrame, atlas: DataFrame, rules: ReadRules = ReadRules()) -> DataFrame:
    """crop, READING of crops (crop, width, v) given by rows of brightness; equal crops, each read once, read alike.

    atlas has the rows of templates(). A null crop and one of no pixels read as nothing.
    """
    keyed = crops.select("crop", F.md5(F.concat_ws(",", F.coalesce(F.col("width"), F.lit(0)).cast("string"), F.array_join(F.coalesce("v", F.array().cast("array<int>")), ",")).cast("binary")).alias("key"), "width", "v")
    return keyed.select("crop", "key").join(_read_once(keyed.select("key", "width", "v"), atlas, rules), "key").drop("key")


def _read_once(crops: DataFrame, atlas: DataFrame, rules: ReadRules) -> DataFrame:
    """key, READING of crops (key, width, v), one of each key; v is an array of brightness, or its bytes.

    Crops are small and reading isn't, so that keys are dealt over tasks by number, not by size.
    """
    spark = crops.sparkSession
    shared = spark.sparkContext.broadcast(_checked(atlas))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Templates(shared.value), rules)
        for b in batches:
            rows = []
            for key, width, v in zip(*(b.column(c).to_pylist() for c in ("key", "width", "v"))):
                image = np.frombuffer(v, np.uint8).astype(int) if isinstance(v, bytes) else np.array(v or [], int)
                own = reader.read(image.reshape(-1, width)) if image.size and width else Reading()
                rows.append({"key": key, "n_glyphs": len(own.glyphs), **{n: getattr(own, n) for n in ("text", "baseline", "cap_height", "fitted", "mean_dist", "alnum", "residual")}})
            yield _batch([{**r, "baseline": float(r["baseline"]), "cap_height": float(r["cap_height"])} for r in rows], f"key string, {READING}")

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    once = crops.groupBy("key").agg(F.first("width").alias("width"), F.first("v").alias("v"))
    return once.repartition(tasks, "key").mapInArrow(run, f"key string, {READING}")


@dataclass(frozen=True)
class VerifyRules:
    """Which boxes are read, how far they are widened."""

    tallest: int = 80
    kinds: tuple[str, ...] = ("Text", "Icon")
    around: int = 2
    verify: bool = True


def _widened(luma: np.ndarray, box: dict, around: int) -> np.ndarray:
    """A box of an image, widened and clipped to it."""
    x0, y0 = max(0, box["x"] - around), max(0, box["y"] - around)
    return luma[y0 : box["y"] + box["h"] + around, x0 : box["x"] + box["w"] + around]


def box_crops(frames: DataFrame, elements: DataFrame, rules: VerifyRules = VerifyRules()) -> DataFrame:
    """crop (frame, elem), width, v: the brightness of the boxes that are read, widened and clipped to their frame.

    A frame and its boxes meet by frame; both are bounded.
    """
    own = elements.where("level = 'element'").where(F.col("kind").isin(*rules.kinds) & (F.col("h") <= rules.tallest))
    boxes = own.groupBy("frame").agg(F.collect_list(F.struct("elem", "x", "y", "w", "h")).alias("boxes"))
    both = frames.select(F.col("frame").cast("long").alias("frame"), "width", "height", "format", "pixels").join(boxes, "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.to_pylist():
                luma = grey(planes(f["width"], f["height"], f["format"], f["pixels"]))
                rows = []
                for k in f["boxes"]:
                    part = _widened(luma, k, rules.around)
                    rows.append({"frame": f["frame"], "elem": k["elem"], "width": part.shape[1], "v": part.ravel().tolist()})
                yield _batch(rows, "frame long, elem long, width int, v array<int>")

    return both.mapInArrow(run, "frame long, elem long, width int, v array<int>").select(F.struct("frame", "elem").alias("crop"), "width", "v")


def read_screen(frames: DataFrame, elements: DataFrame, atlas: DataFrame, rules: ReadRules = ReadRules(), verify: VerifyRules = VerifyRules()) -> DataFrame:
    """The elements of layout() with text, confidence and is_text; boxes that aren't read have no text and confidence 0."""
    read = read_crops(box_crops(frames, elements, verify), atlas, rules).select("crop.*", *(f.split(" ")[0] for f in READING.split(", ")))
    return _told(elements.where("level = 'element'").join(read, ["frame", "elem"], "left"), verify)


def read_frames(frames: DataFrame, atlas: DataFrame, layout_rules: LayoutRules = LayoutRules(), rules: ReadRules = ReadRules(), verify: VerifyRules = VerifyRules()) -> DataFrame:
    """read_screen() of frames and their layout(), in one pass: crops are taken where a frame is laid out.

    So pixels of frames aren't shuffled to meet their boxes; an element has the digest of its crop, and of each digest a
    crop is read once.
    """
    schema = f"{ELEMENTS}, key string, width int, v binary"

    def make():
        def of(page: Page) -> tuple[list[dict], dict]:
            rows, crops = [e for e in page.elements() if e["level"] == "element"], {}
            for e in rows:
                if e["kind"] in verify.kinds and e["h"] <= verify.tallest:
                    part = _widened(page.luma, e, verify.around)
                    v, width = part.astype(np.uint8).tobytes(), part.shape[1]
                    e["key"] = hashlib.blake2b(v, digest_size=16, salt=width.to_bytes(8, "little")).hexdigest()
                    crops[e["key"]] = {"key": e["key"], "width": width, "v": v}
            return rows, crops

        return of

    found = cut(over_frames(frames, schema, make, layout_rules))
    read = _read_once(found.where("level is null").select("key", "width", "v"), atlas, rules)
    own = found.where("level is not null").drop("width", "v")
    return _told(own.join(read, "key", "left"), verify)


def _told(own: DataFrame, verify: VerifyRules) -> DataFrame:
    """Elements with the columns of READING, null where nothing was read, as read_screen() has them."""
    told = ("n_glyphs", "mean_dist", "alnum", "fitted", "residual")
    passed = T.verified(*map(F.col, told)) if verify.verify else (F.col("kind") == "Text") & F.col("n_glyphs").isNotNull()
    return own.select(
        "frame", "elem", "kind", "x", "y", "w", "h", "parent", "depth", F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(T.confidence(*map(F.col, told)), F.lit(0.0)).alias("confidence"), F.coalesce(passed, F.lit(False)).alias("is_text"),
        "n_glyphs", "fitted", "mean_dist", "residual",
    )


def text_tags(read: DataFrame) -> DataFrame:
    """Tags `text` of verified readings: what the text stage adds."""
    return read.where("is_text").select("frame", "elem", F.lit("text").alias("key"), F.col("text").alias("value"), F.col("confidence").alias("score"), F.lit("text").alias("source"), F.col("elem").alias("seq"))


def tightened(boxes: np.ndarray, edges: np.ndarray, least: tuple[int, int] = (2, 3)) -> list[np.ndarray | None]:
    """Each box drawn in to the edge pixels inside it; None if what is left is below `least`."""
    out: list[np.ndarray | None] = []
    for x, y, w, h in boxes:
        x0, y0 = max(0, x), max(0, y)
        at = np.argwhere(edges[y0 : max(y0, y + h), x0 : max(x0, x + w)])
        whole = np.array([x0 + at[:, 1].min(), y0 + at[:, 0].min(), np.ptp(at[:, 1]) + 1, np.ptp(at[:, 0]) + 1]) if len(at) else None
        out.append(whole if whole is not None and whole[2] >= least[0] and whole[3] >= least[1] else None)
    return out
