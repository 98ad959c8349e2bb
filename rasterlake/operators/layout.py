"""From frames to elements: images, containers, icons and lines of text, with words, paragraphs and the containment forest.

A frame's edge mask is cut into components. Components become containers, glyphs or marks by their shape; glyphs join
into words and words into lines by distance, unless their ink or a blank gutter parts them. Some steps depend on the order
in which boxes meet (marks that words take up, fragments that grow into icons), so a frame is settled in one kernel; frames
are independent, and each is read where it lies: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.operators.graph import least_linked, rooted
from rasterlake.operators.raster import FORMATS, grey, planes


@dataclass(frozen=True)
class LayoutRules:
    """Thresholds in brightness, sizes in pixels, shares of heights and areas."""

    edge: int = 28  # a step above this is structure
    weak_edge: int = 10  # and above this too, where it touches such a step; 0: no weak edges
    least_area: int = 3
    glyph_heights: tuple[int, int] = (5, 72)
    glyph_wide: float = 12.0  # width by height, at most
    glyph_tall: int = 12  # height by width, at most
    word_gap: float = 0.55  # of the height
    line_gap: float = 1.25
    height_ratio: float = 2.6
    shared_height: float = 0.55
    ink_step: int = 35  # ink that differs by more parts words and lines
    gutter_gap: float = 0.6  # gaps above this share of the height are looked through for a gutter
    gutter_reach: float = 2.0  # heights above and below that a gutter must be blank
    gutter_width: int = 3
    container_size: tuple[int, int] = (24, 14)
    container_fill: float = 0.22
    container_border: float = 0.70
    band: int = 3
    same_container: float = 0.9  # IoU above which a later container is an earlier one
    flat_fill: float = 0.55
    flat_spread: float = 6.0
    icon_sizes: tuple[int, int] = (9, 96)
    icon_aspects: tuple[float, float] = (0.6, 1.7)
    icon_fill: float = 0.18
    icon_colours: int = 8
    icon_taller: float = 1.2
    icon_gap: int = 3
    icon_contrast: int = 40
    icon_ring_spread: float = 12.0
    cell: int = 16
    cell_colours: int = 40
    cell_edges: float = 0.05
    image_cells: int = 6
    image_fill: float = 0.35
    image_side: float = 0.08  # edges along a side of an image, at least
    image_hides: int = 100  # images at least so long hide what lies in them
    leading: float = 0.9
    block_ratio: float = 1.5


@dataclass
class Parts:
    """Components of a mask, numbered as rows meet them: boxes (n, 4) as x, y, w, h, areas, and runs y, x0, x1, comp."""

    box: np.ndarray
    area: np.ndarray
    runs: np.ndarray

    def of(self, comp: int) -> np.ndarray:
        """The runs of a component."""
        a, b = np.searchsorted(self.runs[:, 3], [comp, comp + 1])
        return self.runs[a:b]

    def painted(self, comps: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        """A mask of some components."""
        out = np.zeros(shape, bool)
        out[pixels(self.runs[np.isin(self.runs[:, 3], comps)])] = True
        return out


def pixels(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the pixels of runs (y, x0, x1, ...), in order."""
    n = runs[:, 2] - runs[:, 1]
    ends = np.cumsum(n)
    return np.repeat(runs[:, 0], n), np.arange(int(n.sum())) + np.repeat(runs[:, 1] - ends + n, n)


def parts(mask: np.ndarray, corners: bool = True) -> Parts:
    """Components of a mask, from its runs; where corners count, runs that touch at one join too."""
    wide = np.zeros((mask.shape[0], mask.shape[1] + 2), bool)
    wide[:, 1:-1] = mask
    flat = wide.ravel()
    y, x = np.divmod(np.flatnonzero(flat[1:] != flat[:-1]), mask.shape[1] + 2)
    y, x0, x1 = y[::2], x[::2], x[1::2]
    n = len(y)
    if not n:
        return Parts(np.zeros((0, 4), int), np.zeros(0, int), np.zeros((0, 4), int))
    slack = int(corners)
    first = np.searchsorted(y, np.arange(mask.shape[0] + 1))
    # of the row above, the runs that end behind a run's start and begin before its end
    span = mask.shape[1] + 2
    above = y > 0
    low = np.searchsorted(y * span + x1, (y - 1) * span + x0 - slack, side="right")
    high = np.searchsorted(y * span + x0, (y - 1) * span + x1 + slack, side="left")
    low, high = np.maximum(low, first[np.maximum(y - 1, 0)]), np.minimum(high, first[y])
    count = np.where(above, np.maximum(0, high - low), 0)
    below = np.repeat(np.arange(n), count)
    over = np.arange(len(below)) + np.repeat(low - np.cumsum(count) + count, count)
    roots = least_linked(n, over, below)
    first = roots == np.arange(n)  # a root is the first run: already in order
    comp = (np.cumsum(first) - 1)[roots]
    order = np.argsort(comp, kind="stable")
    runs = np.stack([y, x0, x1, comp], 1)[order]
    at = np.searchsorted(runs[:, 3], np.arange(np.count_nonzero(first)))
    left, right = np.minimum.reduceat(runs[:, 1], at), np.maximum.reduceat(runs[:, 2], at)
    top, bottom = np.minimum.reduceat(runs[:, 0], at), np.maximum.reduceat(runs[:, 0], at) + 1
    return Parts(np.stack([left, top, right - left, bottom - top], 1), np.add.reduceat(runs[:, 2] - runs[:, 1], at), runs)


def strength(rgb: np.ndarray) -> np.ndarray:
    """Each pixel's largest step, in any colour, to one of its four neighbours."""
    out = np.zeros(rgb.shape[:2], np.uint8)
    down, across = np.zeros(out[1:].shape, np.uint8), np.zeros(out[:, 1:].shape, np.uint8)
    for k in range(3):
        v = np.ascontiguousarray(rgb[..., k])
        for a, b, step in ((v[:-1], v[1:], down), (v[:, :-1], v[:, 1:], across)):
            np.maximum(step, np.maximum(a, b) - np.minimum(a, b), out=step)
    for part, step in ((out[:-1], down), (out[1:], down), (out[:, :-1], across), (out[:, 1:], across)):
        np.maximum(part, step, out=part)
    return out.astype(np.int16)


def united(boxes: np.ndarray) -> np.ndarray:
    """The box around boxes; none of them may be empty."""
    x, y = boxes[:, 0].min(), boxes[:, 1].min()
    return np.array([x, y, (boxes[:, 0] + boxes[:, 2]).max() - x, (boxes[:, 1] + boxes[:, 3]).max() - y])


def colours(rgb: np.ndarray) -> np.ndarray:
    """The 12-bit colour of each pixel."""
    v = (rgb >> 4).astype(np.int32)
    return v[..., 0] << 8 | v[..., 1] << 4 | v[..., 2]


def percentile(values: np.ndarray, q: int) -> int:
    """The smallest value with q hundredths of all at or below it."""
    return int(np.sort(values, axis=None)[max(1, -(-q * values.size // 100)) - 1])


#: Pairs of boxes, and components, that are looked at together. Memory, not results.
PAIRS_AT_ONCE, INKS_AT_ONCE = 1 << 17, 1 << 12


class Page:
    """One frame while it is settled."""

    def __init__(self, rgb: np.ndarray, rules: LayoutRules = LayoutRules()) -> None:
        self.rgb, self.rules = rgb, rules
        self.luma = grey(rgb)
        self.steps = strength(rgb)
        self.mask = self.steps > rules.edge
        self.atoms = parts(self.mask)
        self.height, self.width = self.mask.shape
        self._ink: dict[int, int] = {}

    # -- what pixels say of boxes

    def ink(self, atom: int) -> int:
        """The brightness of a component's ink: the mean step from the level of its box's border, of the stronger pixels."""
        if atom not in self._ink:
            self.find_inks([atom])
        return self._ink[atom]

    def find_inks(self, atoms: list[int]) -> None:
        """ink() of components, many at once."""
        atoms = np.unique(np.array(atoms, int))
        for k in range(0, len(atoms), INKS_AT_ONCE):
            self._find_inks(atoms[k : k + INKS_AT_ONCE])

    def _find_inks(self, atoms: np.ndarray) -> None:
        x, y, w, h = self.atoms.box[atoms].T
        n = 2 * (w + h)  # the border's pixels: above, below, left, right; corners twice
        ends = np.cumsum(n)
        which = np.repeat(np.arange(len(atoms)), n)
        k = np.arange(int(ends[-1])) - (ends - n)[which]
        w_, h_ = w[which], h[which]
        flat, second = k < 2 * w_, np.where(k < 2 * w_, k >= w_, k >= 2 * w_ + h_)
        along = np.where(flat, k - w_ * second, k - 2 * w_ - h_ * second)
        ring = self.luma[y[which] + np.where(flat, (h_ - 1) * second, along), x[which] + np.where(flat, along, (w_ - 1) * second)]
        ground = np.sort(which << 8 | ring)[ends - n + n // 2] & 255
        a, b = np.searchsorted(self.atoms.runs[:, 3], [atoms[0], atoms[-1] + 1])
        runs = self.atoms.runs[a:b]
        runs = runs[np.isin(runs[:, 3], atoms)]
        of = np.repeat(np.searchsorted(atoms, runs[:, 3]), runs[:, 2] - runs[:, 1])
        at = np.searchsorted(of, np.arange(len(atoms)))
        step = self.luma[pixels(runs)].astype(int) - ground[of]
        strong = 2 * np.abs(step) >= np.maximum.reduceat(np.abs(step), at)[of]
        mean = np.trunc(np.add.reduceat(step * strong, at) / np.add.reduceat(strong.astype(int), at)).astype(int)  # towards zero
        self._ink.update(zip(atoms.tolist(), np.clip(ground + mean, 0, 255).tolist()))

    def gutter(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether a blank stretch of columns, above and below them too, lies between two boxes."""
        left, right = (a, b) if a[0] <= b[0] else (b, a)
        x0, x1 = left[0] + left[2], right[0]
        reach = int(self.rules.gutter_reach * max(a[3], b[3]))
        y0, y1 = max(0, min(a[1], b[1]) - reach), min(self.height, max(a[1] + a[3], b[1] + b[3]) + reach)
        blank = ~self.mask[y0:y1, x0:x1].any(0) if x1 > x0 else np.zeros(0, bool)
        n = self.rules.gutter_width
        return len(blank) >= n and bool(np.lib.stride_tricks.sliding_window_view(blank, n).all(1).any())

    def salient(self, box: np.ndarray) -> bool:
        """Whether a box has contrast in it and a calm ring around it."""
        x, y, w, h = box
        own = self.luma[y : y + h, x : x + w]
        if percentile(own, 98) - percentile(own, 2) < self.rules.icon_contrast:
            return False
        x0, y0, x1, y1 = max(0, x - 3), max(0, y - 3), min(self.width, x + w + 3), min(self.height, y + h + 3)
        ring = np.ones((y1 - y0, x1 - x0), bool)
        ring[y - y0 : y - y0 + h, x - x0 : x - x0 + w] = False
        around = self.rgb[y0:y1, x0:x1][ring]
        return not len(around) or float(around.astype(float).var(0).max()) ** 0.5 <= self.rules.icon_ring_spread

    def border_share(self, atom: int) -> float:
        """The share of a component within a band along its box; narrow ones count some pixels twice."""
        x, y, w, h = self.atoms.box[atom]
        r, band = self.atoms.of(atom), self.rules.band
        flat = (r[:, 0] < y + band) | (r[:, 0] >= y + h - band)
        ends = np.maximum(0, np.minimum(r[:, 2], x + band) - r[:, 1]) + np.maximum(0, r[:, 2] - np.maximum(r[:, 1], x + w - band))
        return float(np.where(flat, r[:, 2] - r[:, 1], ends).sum()) / float(self.atoms.area[atom])

    # -- regions

    def images(self) -> list[np.ndarray]:
        """Boxes of regions of cells with many colours and edges, drawn in while a side has hardly any edges."""
        r, c = self.rules, self.rules.cell
        down, across = -(-self.height // c), -(-self.width // c)
        key, busy = colours(self.rgb), np.zeros((down, across), bool)
        if np.count_nonzero(np.bincount(key.ravel())) < r.cell_colours:
            return []  # the whole frame has fewer colours than a cell needs
        edges = np.add.reduceat(np.add.reduceat(self.mask, np.arange(0, self.height, c), 0, int), np.arange(0, self.width, c), 1)
        sizes = np.minimum(c, self.height - c * np.arange(down))[:, None] * np.minimum(c, self.width - c * np.arange(across))
        for i, j in np.argwhere(edges >= r.cell_edges * sizes).tolist():
            busy[i, j] = len(np.unique(key[i * c : (i + 1) * c, j * c : (j + 1) * c])) >= r.cell_colours
        found, regions = [], parts(busy)
        for (x, y, w, h), area in zip(regions.box, regions.area):
            if area < r.image_cells or w < 2 or h < 2 or area < r.image_fill * w * h:
                continue
            x0, y0 = max(0, x * c - c // 2), max(0, y * c - c // 2)
            x1, y1 = min(self.width, (x + w) * c + c // 2), min(self.height, (y + h) * c + c // 2)
            calm = lambda v: v.mean() < r.image_side  # noqa: E731, B023
            while x1 - x0 > c and calm(self.mask[y0:y1, x0]):
                x0 += 1
            while x1 - x0 > c and calm(self.mask[y0:y1, x1 - 1]):
                x1 -= 1
            while y1 - y0 > c and calm(self.mask[y0, x0:x1]):
                y0 += 1
            while y1 - y0 > c and calm(self.mask[y1 - 1, x0:x1]):
                y1 -= 1
            found.append(np.array([x0, y0, x1 - x0, y1 - y0]))
        return found

    def edges(self) -> np.ndarray:
        """The edge mask with weak edges that touch it."""
        if not self.rules.weak_edge:
            return self.mask
        found = self.steps > self.rules.weak_edge
        if np.array_equal(found, self.mask):
            return self.mask  # there are no weak ones
        weak = parts(found)
        before = np.pad(self.mask.cumsum(1), ((0, 0), (1, 0)))
        y, x0, x1, comp = weak.runs.T
        return weak.painted(np.unique(comp[before[y, x1] > before[y, x0]]), self.mask.shape)

    def flat_regions(self) -> list[np.ndarray]:
        """Boxes of regions without edges that fill their box and are of one brightness."""
        r, regions, out = self.rules, parts(~self.edges(), corners=False), []
        w, h = regions.box[:, 2], regions.box[:, 3]
        large = (w >= r.container_size[0]) & (h >= r.container_size[1]) & (regions.area >= r.flat_fill * w * h)
        for k in np.flatnonzero(large).tolist():
            box = regions.box[k]
            own = self.luma[pixels(regions.of(k))].astype(float)
            if own.var() ** 0.5 <= r.flat_spread:
                out.append(box)
        return out

    # -- text

    def on_lines(self, boxes: np.ndarray, gap: float, veto: Callable[[int, int], bool]) -> list[list[int]]:
        """Groups of boxes that lie on one line, each in order of (x, y); how far a box reaches goes by its own height."""
        r = self.rules
        order = np.lexsort((boxes[:, 1], boxes[:, 0])) if len(boxes) else np.zeros(0, int)
        b = boxes[order]
        x, y, w, h = b.T if len(b) else np.zeros((4, 0), int)
        reach = x + w + (gap * h + 0.5).astype(int)
        later = np.searchsorted(x, reach, side="right") - np.arange(len(b)) - 1
        ends = np.cumsum(later)
        places, links, start = order.tolist(), [], 0
        while start < len(b):  # some boxes at a time, each with those that begin within its reach
            done = int(ends[start] - later[start])
            stop = max(start + 1, int(np.searchsorted(ends, done + PAIRS_AT_ONCE, side="right")))
            i = np.repeat(np.arange(start, stop), later[start:stop])
            j = np.arange(len(i)) + done - (ends - later)[i] + i + 1
            low, high = np.minimum(h[i], h[j]), np.maximum(h[i], h[j])
            shared = np.minimum(y[i] + h[i], y[j] + h[j]) - np.maximum(y[i], y[j])
            fits = (high <= r.height_ratio * low) & (shared >= r.shared_height * low) & (x[j] - x[i] - w[i] <= gap * high)
            links += [(p, q) for p, q in zip(i[fits].tolist(), j[fits].tolist()) if not veto(places[p], places[q])]
            start = stop
        groups: dict[int, list[int]] = {}
        for i, root in rooted(list(range(len(b))), links).items():
            groups.setdefault(root, []).append(int(order[i]))
        return list(groups.values())

    def words_of(self, glyphs: list[int], marks: list[int]) -> tuple[list[list[int]], list[int]]:
        """Words as lists of components from left to right, and the pictograms that are none."""
        r, box = self.rules, self.atoms.box
        self.find_inks(glyphs + marks)
        far = lambda i, j: abs(self.ink(glyphs[i]) - self.ink(glyphs[j])) > r.ink_step
        words = [[glyphs[i] for i in g] for g in self.on_lines(box[glyphs].reshape(-1, 4), r.word_gap, far)]
        around = np.array([united(box[w]) for w in words]).reshape(-1, 4)
        for m in marks:  # each goes to the nearest word in whose band it stands, which grows by it
            if not len(around):
                break
            (bx, by, bw, bh), (x, y, w, h) = box[m], around.T
            gap = np.where(bx >= x + w, bx - x - w, np.where(bx + bw <= x, x - bx - bw, 0))
            able = (by >= y - 1) & (by + bh <= y + h + h // 3) & (gap <= (r.word_gap * h).astype(int))
            if able.any():
                k = int(np.where(able, gap, 1 << 30).argmin())
                words[k].append(m)
                around[k] = united(np.stack([around[k], box[m]]))
        pictograms, kept = [], []
        like_icon = lambda b: r.icon_aspects[0] < b[2] / b[3] < r.icon_aspects[1]
        for word in words:
            word.sort(key=lambda a: box[a][0])
            for end in (0, -1):  # a taller atom of several colours at either end is a pictogram before or after a label
                if len(word) < 2:
                    break
                b = box[word[end]]
                heights = sorted(box[a][3] for a in (word[1:] if end == 0 else word[:-1]))
                tall = b[3] >= r.icon_taller * heights[len(heights) // 2] and b[3] >= r.icon_sizes[0]
                if tall and like_icon(b) and len(np.unique(colours(self.rgb[b[1] : b[1] + b[3], b[0] : b[0] + b[2]]))) >= r.icon_colours:
                    pictograms.append(word.pop(end))
            whole = united(box[word])
            alone = len(word) == 1 and r.icon_sizes[0] <= whole[3] <= r.icon_sizes[1] and like_icon(whole)
            if alone and self.atoms.area[word[0]] / (whole[2] * whole[3]) > r.icon_fill:
                pictograms.append(word[0])
            else:
                kept.append(word)
        return kept, pictograms

    def icons(self, pictograms: list[int]) -> list[tuple[np.ndarray, list[int]]]:
        """Fragments that are near each other, grown together while the whole stays small; those that stand out."""
        r, box = self.rules, self.atoms.box
        up, whole = list(range(len(pictograms))), [box[p].copy() for p in pictograms]

        def root(i: int) -> int:
            while up[i] != i:
                i = up[i]
            return i

        for i in range(len(pictograms)):
            for j in range(i + 1, len(pictograms)):
                a, b = sorted((root(i), root(j)))
                if a != b and near(whole[a], whole[b], r.icon_gap):
                    both = united(np.stack([whole[a], whole[b]]))
                    if max(both[2:]) <= r.icon_sizes[1]:
                        up[b], whole[a] = a, both
        groups: dict[int, list[int]] = {}
        for i, p in enumerate(pictograms):
            groups.setdefault(root(i), []).append(p)
        found = [(united(box[g]), g) for g in groups.values()]
        return [(b, g) for b, g in found if self.salient(b)]

    # -- everything

    def elements(self) -> list[dict]:
        """Rows of level `element` (images, containers, icons, lines), `word` and `block`, each level numbered from 0."""
        r, a = self.rules, self.atoms
        pictures = self.images()
        found: list[tuple[str, np.ndarray, list[int]]] = [("Image", b, []) for b in pictures]
        hiding = np.array([b for b in pictures if max(b[2:]) >= r.image_hides]).reshape(-1, 4)

        def hidden(b: np.ndarray) -> bool:
            if not len(hiding):
                return False
            cx, cy = b[0] + b[2] // 2, b[1] + b[3] // 2
            x, y, w, h = hiding.T
            return bool(((x <= cx) & (cx < x + w) & (y <= cy) & (cy < y + h) & (w * h > 2 * b[2] * b[3])).any())

        held: list[np.ndarray] = []

        def add_container(b: np.ndarray, atoms: list[int]) -> None:
            if held:
                x, y, w, h = np.array(held).T
                shared = np.maximum(0, np.minimum(x + w, b[0] + b[2]) - np.maximum(x, b[0])) * np.maximum(0, np.minimum(y + h, b[1] + b[3]) - np.maximum(y, b[1]))
                if (shared > r.same_container * (w * h + b[2] * b[3] - shared)).any():
                    return
            held.append(b)
            found.append(("Container", b, atoms))

        glyphs, marks = [], []
        for k in np.flatnonzero(a.area >= r.least_area).tolist():
            b = a.box[k]
            w, h = int(b[2]), int(b[3])
            large = w >= r.container_size[0] and h >= r.container_size[1]
            if large and a.area[k] <= r.container_fill * w * h and self.border_share(k) >= r.container_border:
                add_container(b, [k])
            elif hidden(b):
                continue
            elif r.glyph_heights[0] <= h <= r.glyph_heights[1] and w <= r.glyph_wide * h and h <= r.glyph_tall * w:
                glyphs.append(k)
            elif h < r.glyph_heights[0] and w <= 3 * r.glyph_heights[0]:
                marks.append(k)
        for b in self.flat_regions():
            if not hidden(b):
                add_container(b, [])
        words, pictograms = self.words_of(glyphs, marks)
        found += [("Icon", b, g) for b, g in self.icons(pictograms)]
        boxes = np.array([united(a.box[w]) for w in words]).reshape(-1, 4)
        inks = [sorted(self.ink(k) for k in w)[len(w) // 2] for w in words]

        def apart(i: int, j: int) -> bool:
            if abs(inks[i] - inks[j]) > r.ink_step:
                return True
            p, q = boxes[i], boxes[j]
            gap = max(p[0], q[0]) - min(p[0] + p[2], q[0] + q[2])
            return gap > r.gutter_gap * max(p[3], q[3]) and self.gutter(p, q)

        by_x = lambda atoms: sorted(atoms, key=lambda k: a.box[k][0])
        for line in self.on_lines(boxes, r.line_gap, apart):
            found.append(("Text", united(boxes[line]), by_x([k for w in line for k in words[w]])))
        rows = [_row("element", n, kind, b, atoms) for n, (kind, b, atoms) in enumerate(found)]
        for row, parent, depth in zip(rows, *nested(np.array([b for _, b, _ in found]).reshape(-1, 4))):
            row.update(parent=parent, depth=depth)
        rows += [_row("word", n, "Text", b, w) for n, (b, w) in enumerate(zip(boxes, words))]
        rows += [_row("block", n, "Text", b, atoms) for n, (b, atoms) in enumerate(self.blocks([(b, atoms) for kind, b, atoms in found if kind == "Text"]))]
        return rows

    def blocks(self, lines: list[tuple[np.ndarray, list[int]]]) -> list[tuple[np.ndarray, list[int]]]:
        """Paragraphs of lines that are stacked closely, of like height, and aligned or mostly above each other."""
        r = self.rules
        lines = sorted(lines, key=lambda e: (e[0][1], e[0][0]))
        links = []
        for i, (a, _) in enumerate(lines):
            for j in range(i + 1, len(lines)):
                b = lines[j][0]
                if b[1] - a[1] - a[3] > r.leading * a[3]:
                    break  # and so are all below
                low, high = min(a[3], b[3]), max(a[3], b[3])
                over = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]) >= min(a[2], b[2]) * 3 // 4
                if b[1] >= a[1] + a[3] - a[3] // 3 and high <= r.block_ratio * low and (abs(a[0] - b[0]) <= low or over):
                    links.append((i, j))
        groups: dict[int, list[int]] = {}
        for i, root in rooted(list(range(len(lines))), links).items():
            groups.setdefault(root, []).append(i)
        return [(united(np.array([lines[i][0] for i in g])), [k for i in g for k in lines[i][1]]) for g in groups.values()]


def near(a: np.ndarray, b: np.ndarray, gap: int) -> bool:
    """Whether two boxes share area once one of them, no matter which, is widened by gap on all sides."""
    return bool((np.minimum(a[:2] + a[2:] + gap, b[:2] + b[2:]) > np.maximum(a[:2] - gap, b[:2])).all())


def nested(boxes: np.ndarray) -> tuple[list[int], list[int]]:
    """Parent (-1: none) and depth of each box: the smallest box that holds it, of equal ones the latest."""
    n = len(boxes)
    parent, depth = [-1] * n, [0] * n
    if not n:
        return parent, depth
    x, y, w, h = boxes.T
    area = w * h
    order = np.lexsort((np.arange(n), -area))
    for place, i in enumerate(order.tolist()):
        o = order[:place]
        holds = o[(area[o] > 0) & (x[o] <= x[i]) & (y[o] <= y[i]) & (x[o] + w[o] >= x[i] + w[i]) & (y[o] + h[o] >= y[i] + h[i])]
        if len(holds):
            parent[i] = int(holds[-1])  # the last in order is the smallest, and the latest of equal ones
            depth[i] = depth[parent[i]] + 1
    return parent, depth


def _row(level: str, n: int, kind: str, box: np.ndarray, atoms: list[int]) -> dict:
    x, y, w, h = (int(v) for v in box)
    return {"level": level, "elem": n, "kind": kind, "x": x, "y": y, "w": w, "h": h, "parent": -1, "depth": 0, "atoms": [int(k) for k in atoms]}


LEVELS = ("element", "word", "block")
ELEMENTS = "frame long, level string, elem long, kind string, x int, y int, w int, h int, parent int, depth int, atoms array<int>"
_TYPES = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


#: Rows that a task passes on at once, and that a worker keeps of frames that it has seen. Speed, not results.
HANDED, KEPT = 2_000, 20_000

_kept: dict[str, tuple] = {}


def _own(name: str, make: Callable[[], tuple]) -> tuple:
    """What a worker keeps from one task to the next of the query of this name; of one query at a time."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def over_frames(
    frames: DataFrame, schema: str, make: Callable[[], Callable[[Page], tuple[list[dict], dict]]], rules: LayoutRules = LayoutRules(), paint: Callable[..., np.ndarray] | None = None
) -> DataFrame:
    """Rows of schema (frame long first) of frames (frame, width, height, format, pixels), each read where it lies.

    make() gives a function from a page to its rows, and to more rows by a key, of which each task passes on those whose
    key it hasn't had yet. Frames of equal pixels have equal rows, and a worker settles them once. Frames without pixels,
    or undecoded, have none.

    Where paint is given, the columns of frames after the first (plain values) are all that it paints a frame's planes
    from: frames are painted where they are settled, so that pixels don't leave the worker, and those of equal values once.
    """
    fields = [f.split(" ") for f in schema.split(", ")]
    name = uuid.uuid4().hex

    def columns(rows: list[dict]) -> list[list]:
        return [[e.get(n) for e in rows] for n, _ in fields]

    def batch(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, _TYPES[t]) for v, (_, t) in zip(out, fields)], [n for n, _ in fields])

    def stored(b: pa.RecordBatch) -> Iterator[tuple]:
        """Each frame, a key that tells its pixels, and how to have its planes."""
        for frame, width, height, form, pixels in zip(*(b.column(c) for c in ("frame", "width", "height", "format", "pixels"))):
            width, height, form, pixels = width.as_py(), height.as_py(), form.as_py(), pixels.as_py()
            if width and height:
                yield frame.as_py(), (width, height, form, hashlib.blake2b(pixels, digest_size=16).digest()), partial(planes, width, height, form, pixels)

    def painted(b: pa.RecordBatch) -> Iterator[tuple]:
        for frame, *told in zip(*(c.to_pylist() for c in b.columns)):
            yield frame, tuple(told), partial(paint, *told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, known, held = _own(name, lambda: (make(), {}, [0]))
        out = columns([])
        given: set = set()
        for b in batches:
            for frame, key, pixels in painted(b) if paint else stored(b):
                if key not in known:
                    if held[0] >= KEPT:
                        known.clear()
                        held[0] = 0
                    rows, once = of(Page(pixels(), rules))
                    known[key] = columns(rows)[1:], len(rows), once
                    held[0] += 1 + len(rows) + len(once)
                rows, n, once = known[key]
                out[0] += [frame] * n
                for v, own in zip(out[1:], rows):
                    v += own
                for k, e in once.items():
                    if k not in given:
                        if len(given) >= KEPT:
                            given.clear()
                        given.add(k)
                        for v, own in zip(out, columns([e])):
                            v += own
                if len(out[0]) >= HANDED:
                    yield batch(out)
                    out = columns([])
        if out[0]:
            yield batch(out)

    own = frames.columns[1:] if paint else ["width", "height", "format", "pixels"]
    return frames.select(F.col("frame").cast("long").alias("frame"), *own).mapInArrow(run, schema)


def layout(frames: DataFrame, rules: LayoutRules = LayoutRules(), levels: tuple[str, ...] = LEVELS, schema: str = ELEMENTS, paint: Callable[..., np.ndarray] | None = None) -> DataFrame:
    """ELEMENTS of frames (frame, width, height, format, pixels), or some of their columns (frame first), of some levels.

    Frames without pixels, or undecoded, have none. Where paint is given, frames are what it paints them from, as in
    over_frames().
    """
    return over_frames(frames, schema, lambda: lambda page: ([e for e in page.elements() if e["level"] in levels], {}), rules, paint)


def kind_tags(elements: DataFrame) -> DataFrame:
    """Tags `kind` of the elements' own level, with score 1: what the layout stage adds."""
    own = elements.where("level = 'element'")
    return own.select("frame", "elem", F.lit("kind").alias("key"), F.col("kind").alias("value"), F.lit(1.0).alias("score"), F.lit("layout").alias("source"), F.col("elem").alias("seq"))


def drawn(boxes: DataFrame, width: int, height: int, ground: int = 245, outline: bool = False) -> DataFrame:
    """frame, width, height, format, pixels: boxes (frame, id, x, y, w, h, r, g, b) painted in order of id; frames with a box.

    Filled, or as outlines one pixel wide (an overlay); boxes are clipped to the frame. A frame's boxes are bounded.
    """
    own = boxes.select("frame", F.struct("id", "x", "y", "w", "h", "r", "g", "b").alias("box")).groupBy("frame").agg(F.array_sort(F.collect_list("box")).alias("boxes"))

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for own in b.column("boxes").to_pylist():
                page = np.full((height, width, 3), ground, np.uint8)
                for k in own:
                    x0, y0, x1, y1 = max(0, k["x"]), max(0, k["y"]), max(0, k["x"] + k["w"]), max(0, k["y"] + k["h"])
                    inside = page[y0 + 1 : y1 - 1, x0 + 1 : x1 - 1].copy() if outline else None
                    page[y0:y1, x0:x1] = k["r"], k["g"], k["b"]
                    if inside is not None and inside.size:
                        page[y0 + 1 : y1 - 1, x0 + 1 : x1 - 1] = inside
                out.append(page.tobytes())
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("frame"), pa.array([width] * n, pa.int32()), pa.array([height] * n, pa.int32()), pa.array(["RGB24"] * n), pa.array(out, pa.binary())], ["frame", "width", "height", "format", "pixels"])

    return own.mapInArrow(paint, "frame long, width int, height int, format string, pixels binary")


def inpainted(frames: DataFrame, spots: DataFrame) -> DataFrame:
    """frames with a box (frame, x, y, w, h) of each painted over, row by row and colour by colour.

    From the pixel left of the box to the one right of it, in equal steps; at the frame's edge, the box's own outermost
    pixel stands in. A frame with two boxes in spots would be there twice; one without stays as it is.
    """
    schema = "frame long, width int, height int, format string, pixels binary"
    own = frames.select(F.col("frame").cast("long").alias("frame"), "width", "height", "format", "pixels")
    both = own.join(spots.select("frame", F.struct("x", "y", "w", "h").alias("spot")), "frame", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for f in b.to_pylist():
                s, pixels = f["spot"], f["pixels"]
                if s and f["width"] and f["height"]:
                    size = FORMATS[f["format"]][0]
                    page = np.frombuffer(pixels, np.uint8).reshape(f["height"], f["width"], size).astype(int)
                    x0, x1 = max(0, s["x"]), min(f["width"], s["x"] + s["w"])
                    y0, y1 = max(0, s["y"]), min(f["height"], s["y"] + s["h"])
                    if x1 > x0 and y1 > y0:
                        left, right = max(0, x0 - 1), min(f["width"] - 1, x1)
                        at, span = np.arange(x0, x1) - left, max(1, right - left)
                        a, z = page[y0:y1, left, None], page[y0:y1, right, None]
                        page[y0:y1, x0:x1] = (a * (span - at)[None, :, None] + z * at[None, :, None]) // span
                        pixels = page.astype(np.uint8).tobytes()
                out.append(pixels)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("frame", "width", "height", "format")] + [pa.array(out, pa.binary())], ["frame", "width", "height", "format", "pixels"])

    return both.mapInArrow(run, schema)
