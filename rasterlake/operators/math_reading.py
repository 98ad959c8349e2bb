"""Reading formulas: the ink of a crop as rules, roots and glyphs, settled by the sizes and the line of the whole formula."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.functions.latex import CLASS
from rasterlake.operators.fits import FREE, TWO, formula_regions, regions_of
from rasterlake.operators.formulas import formula
from rasterlake.operators.graph import rooted
from rasterlake.operators.layout import LayoutRules, Page, over_frames, united
from rasterlake.operators.raster import grey, planes
from rasterlake.operators.reading import Crop, InkRules, Templates, _batch, _checked

# Marks whose place tells more than their size.
PLACED = ",.'⋅·′`"


@dataclass(frozen=True)
class MathRules:
    """Shares of the median height where nothing else is said."""

    least_area: int = 2
    rule_aspect: float = 3.0
    rule_fill: float = 0.7
    rule_width: int = 4
    overlap: float = 0.5  # of the narrower width, for parts above each other
    rules_apart: float = 0.6  # two rules of one sign
    rules_alike: float = 1.25
    sign_apart: float = 0.35  # a rule and the rest of its sign
    sign_wider: float = 1.15
    sign_taller: float = 1.2
    dot_apart: float = 0.45  # a dot and its stem
    dot_share: float = 0.3
    dot_height: float = 0.4
    root_least: int = 8
    root_fill: float = 0.35
    root_roof: float = 0.55  # of its width
    candidates: int = 4
    margin: float = 15.0
    minus: float = 1.14  # width of a minus in cap heights
    axis: float = 0.37
    flattest: float = 0.15  # cap heights that a template's height counts at least
    full: float = 0.84
    on_line: float = 0.15
    levels: tuple[float, float] = (0.71, 0.5)  # sizes of scripts, and of scripts of scripts
    size_weight: float = 14.0
    place_weight: float = 10.0
    prior_weight: float = 10.0
    ink: InkRules = field(default_factory=InkRules)


def static_prior(c: str) -> float:
    """What a character of a formula costs where no counts are known."""
    if c.isascii() and c.isalnum() or c in FREE:
        return 0.0
    return 1.0 if "α" <= c <= "ω" or "Γ" <= c <= "Ω" else 2.0 if c in TWO else 5.0


class MathReader:
    """Symbols of formula crops by one set of templates; prior: penalty from 0 to 1 by character, unseen ones 1."""

    def __init__(self, atlas: Templates, rules: MathRules = MathRules(), prior: dict[str, float] | None = None) -> None:
        self.atlas, self.rules, self.prior = atlas, rules, prior

    def roof(self, crop: Crop, k: int) -> int:
        """Where the roof of a root begins, if the component is one: a low hook to the left and a long top; else -1."""
        r, (x, y, w, h) = self.rules, crop.parts.box[k].tolist()
        if h < r.root_least or w < h // 2 or crop.parts.area[k] > r.root_fill * w * h:
            return -1
        runs = crop.parts.of(k)
        low = (runs[:, 0] >= y + h - h // 4) & (runs[:, 1] < x + w * 2 // 5)
        top = runs[runs[:, 0] < y + max(1, h // 8)]
        length = top[:, 2] - top[:, 1]
        if not low.any() or not len(top) or length.max() < r.root_roof * w:
            return -1
        start = int(top[length.argmax(), 1])
        return start if start > x else -1

    def joined(self, crop: Crop, kept: list[int], roofs: dict[int, int]) -> list[list[int]]:
        """Components that are one symbol: two rules, a rule and the rest of its sign, or a dot and its stem."""
        r, box, area = self.rules, crop.parts.box, crop.parts.area
        heights = sorted(int(box[k][3]) for k in kept)
        tall = max(1, heights[len(heights) // 2])
        links = []
        for i, a in enumerate(kept):
            for j in range(i + 1, len(kept)):
                b = kept[j]
                if a in roofs or b in roofs:
                    continue
                (ax, ay, aw, ah), (bx, by, bw, bh) = box[a].tolist(), box[b].tolist()
                narrow, wide = min(aw, bw), max(aw, bw)
                gap = max(ay, by) - min(ay + ah, by + bh)
                if min(ax + aw, bx + bw) - max(ax, bx) < r.overlap * narrow:
                    continue
                flat = self.is_rule(crop, a), self.is_rule(crop, b)
                if all(flat):
                    one = 0 <= gap <= r.rules_apart * tall and wide <= r.rules_alike * narrow
                elif any(flat):
                    rule, rest = ((aw, ah), (bw, bh)) if flat[0] else ((bw, bh), (aw, ah))
                    one = 0 <= gap <= r.sign_apart * tall and rule[0] <= r.sign_wider * rest[0] and rest[1] <= r.sign_taller * tall
                else:
                    small = min(area[a], area[b]) <= r.dot_share * max(area[a], area[b]) or max(ah, bh) <= r.dot_height * tall
                    one = -1 <= gap <= r.dot_apart * tall and small
                if one:
                    links.append((i, j))
        groups: dict[int, list[int]] = {}
        for i, root in rooted(list(range(len(kept))), links).items():
            groups.setdefault(root, []).append(kept[i])
        return list(groups.values())

    def is_rule(self, crop: Crop, k: int) -> bool:
        _, _, w, h = crop.parts.box[k]
        return bool(w >= self.rules.rule_aspect * h and w >= self.rules.rule_width and crop.parts.area[k] >= self.rules.rule_fill * w * h)

    def placed(self, box: np.ndarray, t: int) -> tuple[float, float]:
        """The cap height and baseline that a template says a box has."""
        size = box[3] / max(self.rules.flattest, self.atlas.bottom[t] - self.atlas.top[t])
        return float(size), float(box[1] + box[3] - self.atlas.bottom[t] * size)

    def symbols(self, image: np.ndarray) -> list[dict]:
        """Symbols of a grey crop, by left and top: kind, ch, box, dist, scale, baseline and where a root's roof begins."""
        r = self.rules
        if min(image.shape) < 3:
            return []
        crop = Crop(image, r.ink)
        box = crop.parts.box
        kept = np.flatnonzero(crop.parts.area >= r.least_area).tolist()
        middle = box[:, :2] + box[:, 2:] // 2
        roofs = {}
        for k in kept:
            x = self.roof(crop, k)
            inside = (middle >= box[k][:2]).all(1) & (middle < box[k][:2] + box[k][2:]).all(1) & (middle[:, 0] >= x)
            inside[k] = False
            if x >= 0 and inside[kept].any():  # a root has something under its roof
                roofs[k] = x
        out = []
        for group in self.joined(crop, kept, roofs) if kept else []:
            own = united(box[group])
            alone = group[0] if len(group) == 1 else -1
            s = {"kind": "Glyph", "ch": "", "box": own, "dist": 0.0, "scale": 0.0, "baseline": 0.0, "radicand_x": 0, "found": []}
            if alone in roofs:
                s |= {"kind": "Radical", "ch": "√", "radicand_x": roofs[alone]}
            elif alone >= 0 and self.is_rule(crop, alone):
                size = own[2] / r.minus
                s |= {"kind": "Bar", "ch": "-", "scale": float(size), "baseline": float(own[1] + 0.5 * own[3] + r.axis * size)}
            else:
                feature, own = crop.feature(np.concatenate([crop.parts.of(k)[:, :3] for k in group]))
                s |= {"box": own, "found": self.atlas.nearest(feature, min(r.candidates, 4), r.margin)}
                if not s["found"]:
                    continue
                self.settle(s, 0)
            out.append(s)
        self.rescore(out)
        return sorted(out, key=lambda s: (int(s["box"][0]), int(s["box"][1])))

    def settle(self, s: dict, k: int) -> None:
        dist, t = s["found"][k]
        s["ch"], s["dist"] = self.atlas.ch[t], dist
        s["scale"], s["baseline"] = self.placed(s["box"], t)

    def rescore(self, symbols: list[dict]) -> None:
        """Choose glyphs again by how their sizes and places fit the formula's, and by how rare they are."""
        r = self.rules
        glyphs = [s for s in symbols if s["kind"] == "Glyph"]
        sizes = sorted((s["scale"] for s in glyphs if s["scale"] > 0), reverse=True)
        if len(sizes) < 2:
            return
        size = sizes[(max(1, (6 * len(sizes) + 9) // 10) - 1) // 2]
        lines = sorted(s["baseline"] for s in glyphs if s["scale"] >= r.full * size)
        if not lines:
            return
        base = lines[len(lines) // 2]

        def cost(s: dict, dist: float, t: int) -> float:
            c, own = self.atlas.ch[t], s["box"]
            scale, line = self.placed(own, t)
            if c in PLACED:
                off = abs(own[1] - (base + self.atlas.top[t] * size)) + abs(own[1] + own[3] - (base + self.atlas.bottom[t] * size))
                misfit = off / size * r.place_weight / r.size_weight
            elif abs(line - base) <= r.on_line * size:
                misfit = abs(np.log(scale / size))
            else:
                misfit = min(abs(np.log(scale / (level * size))) for level in r.levels)
            rare = r.prior_weight * self.prior.get(c, 1.0) if self.prior else static_prior(c)
            return dist + rare + r.size_weight * float(misfit)

        for s in glyphs:
            best = int(np.argmin([cost(s, *f) for f in s["found"]]))
            if best:
                self.settle(s, best)


@dataclass(frozen=True)
class Evidence:
    """What speaks for a crop being a formula."""

    symbols: int = 0
    mean_dist: float = 0.0
    rare: float = 0.0
    marks: int = 0
    tex: str = ""


def evidence(symbols: list[dict]) -> Evidence:
    """Counts of symbols and of marks of mathematics among them and in their LaTeX; rarity by the static prior."""
    if not symbols:
        return Evidence()
    glyphs = [s for s in symbols if s["kind"] == "Glyph"]
    marks = sum(s["kind"] == "Radical" for s in symbols) + sum("Α" <= s["ch"] <= "ϵ" or CLASS.get(s["ch"]) in ("BigOp", "Relation") for s in glyphs)
    rows = [{"x": int(s["box"][0]), "y": int(s["box"][1]), "w": int(s["box"][2]), "h": int(s["box"][3]), **{k: s[k] for k in ("ch", "kind", "scale", "baseline", "radicand_x")}} for s in symbols]
    tex = formula(rows)
    marks += sum(tex.count(m) for m in ("^ {", "_ {", "\\frac", "\\sqrt"))
    n = len(glyphs)
    return Evidence(len(symbols), sum(s["dist"] for s in glyphs) / n if n else 99.0, sum(static_prior(s["ch"]) >= 5 for s in glyphs) / n if n else 1.0, marks, tex)


@dataclass(frozen=True)
class FormulaRules:
    """Fixed values of what counts as a formula."""

    all_text: bool = False  # every text box may be one, and two symbols are enough
    least_symbols: int = 8
    most_dist: float = 20.0
    most_rare: float = 0.1
    least_marks: int = 3
    tallest: int = 400
    one_line: float = 0.25  # verified text that fits its line better isn't a formula


REGION = "frame long, region long, members array<long>, x int, y int, w int, h int, symbols int, mean_dist double, rare double, marks int, tex string"


def formulas_of(frames: DataFrame, read: DataFrame, atlas: DataFrame, prior: dict[str, float] | None = None, rules: FormulaRules = FormulaRules(), math: MathRules = MathRules()) -> DataFrame:
    """REGION of the accepted formulas of frames; read: elements (frame, elem, kind, x, y, w, h, is_text, fitted, residual).

    Text boxes that overlap once grown are a region; one that is verified text on one line only joins others. Where no
    reading is known (is_text is null), any text box may be a formula. Regions are numbered in order of their boxes.
    """
    shared = frames.sparkSession.sparkContext.broadcast((_checked(atlas), prior))
    texts = read.where((F.col("kind") == "Text") & (F.col("h") <= rules.tallest)).withColumn("id", F.col("elem").cast("int"))
    plain = F.coalesce(F.col("is_text") & F.col("fitted") & (F.col("residual") < rules.one_line), F.lit(False))
    regions = formula_regions(texts.withColumn("candidate", F.lit(rules.all_text) | ~plain), rules.tallest, members=True)
    boxes = regions.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("grp", "members", "x", "y", "w", "h"))).alias("regions"))
    both = frames.select(F.col("frame").cast("long").alias("frame"), "width", "height", "format", "pixels").join(boxes, "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, known = shared.value
        reader = RegionReader(MathReader(Templates(rows), math, known), rules)
        for b in batches:
            out = []
            for f in b.to_pylist():
                luma = grey(planes(f["width"], f["height"], f["format"], f["pixels"]))
                out += [{"frame": f["frame"], **e} for e in reader.accepted(luma, f["regions"])]
            yield _batch(out, REGION)

    return both.mapInArrow(run, REGION)


class RegionReader:
    """Accepted formulas of frames; equal crops are read once."""

    def __init__(self, reader: MathReader, rules: FormulaRules) -> None:
        self.reader, self.rules = reader, rules
        self.known: dict[tuple, Evidence] = {}

    def evidence(self, crop: np.ndarray) -> Evidence:
        key = crop.shape, hashlib.blake2b(np.ascontiguousarray(crop), digest_size=16).digest()
        if key not in self.known:
            if len(self.known) >= 20_000:
                self.known.clear()
            self.known[key] = evidence(self.reader.symbols(crop))
        return self.known[key]

    def accepted(self, luma: np.ndarray, regions: list[dict]) -> list[dict]:
        """Rows of REGION without the frame, of regions (members, x, y, w, h) of a frame in order."""
        rules, out = self.rules, []
        for g in regions:
            x0, y0 = max(0, g["x"]), max(0, g["y"])
            x1, y1 = min(luma.shape[1], g["x"] + g["w"]), min(luma.shape[0], g["y"] + g["h"])
            e = self.evidence(luma[y0:y1, x0:x1])
            good = e.symbols >= rules.least_symbols and e.mean_dist <= rules.most_dist and e.rare <= rules.most_rare and e.marks >= rules.least_marks
            if e.symbols >= 2 if rules.all_text else good:
                own = {"x": x0, "y": y0, "w": x1 - x0, "h": y1 - y0}
                out.append({"region": len(out), "members": g["members"], **own, "symbols": e.symbols, "mean_dist": float(e.mean_dist), "rare": float(e.rare), "marks": int(e.marks), "tex": e.tex})
        return out


def formulas_in(frames: DataFrame, atlas: DataFrame, prior: dict[str, float] | None = None, rules: FormulaRules = FormulaRules(), math: MathRules = MathRules(), layout_rules: LayoutRules = LayoutRules()) -> DataFrame:
    """formulas_of() the layout() of frames whose texts nobody has read, in one pass: each frame where it lies.

    Any text box may be a formula, and neither boxes nor pixels are shuffled.
    """
    shared = frames.sparkSession.sparkContext.broadcast((_checked(atlas), prior))

    def make():
        rows, known = shared.value
        reader = RegionReader(MathReader(Templates(rows), math, known), rules)

        def of(page: Page) -> tuple[list[dict], dict]:
            texts = [e for e in page.elements() if e["level"] == "element" and e["kind"] == "Text"]
            return reader.accepted(page.luma, regions_of(texts, rules.tallest)), {}

        return of

    return over_frames(frames, REGION, make, layout_rules)


def formula_tags(regions: DataFrame, rules: FormulaRules = FormulaRules()) -> DataFrame:
    """Tags `latex.region` of the members of accepted regions: the region's number as text."""
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("mean_dist") / (2 * rules.most_dist)))
    return regions.select("frame", F.explode("members").alias("elem"), F.lit("latex.region").alias("key"), F.col("region").cast("string").alias("value"), score.alias("score"), F.lit("latex").alias("source"), F.col("region").alias("seq"))
