"""Formulas from placed symbols: pieces are folded into larger ones until one line with scripts is left."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterlake.functions.latex import TEX

# Glyphs that stand for an accent over another, those that a thin 1 is taken for, operators with limits.
ACCENTS = {"~": "\\tilde", "∼": "\\tilde", "^": "\\hat", "ˆ": "\\hat", "∧": "\\hat", "→": "\\vec", "⇀": "\\vec", "⋅": "\\dot", "·": "\\dot", ".": "\\dot"}
ONE_LIKE, WITH_LIMITS, ON_LINE = "lIJı", "∑∏", ".,;"
SYMBOL = "struct<x: int, y: int, w: int, h: int, ch: string, kind: string, scale: double, baseline: double, radicand_x: int>"


@dataclass(frozen=True)
class Rules:
    """Fixed values, as shares of the main size where nothing else is said."""

    script_scale: float = 0.84  # a piece below this scale may be a script
    raised: float = 0.22  # a script's baseline above the line's, at least
    dropped: float = 0.12  # or below it
    reach: float = 2.2  # how far what is stacked over or under a piece may be
    deepest: int = 12  # levels of groups within groups
    accent_height: float = 0.45  # an accent's height at most,
    accent_gap: float = 0.35  # its distance to the glyph below,
    accent_width: float = 1.6  # and its width, as a share of that glyph's
    one_gap: float = 0.35  # how near a thin stem must be to a digit to be a 1
    axis: float = 0.37  # how far the line on which rules lie is above the baseline
    root_foot: float = 0.1  # how far a root's baseline is above its bottom


@dataclass(frozen=True)
class Piece:
    x: int
    y: int
    w: int
    h: int
    tex: str
    ch: str = ""
    kind: str = "Glyph"
    scale: float = 0.0
    baseline: float = 0.0
    radicand_x: int = 0
    folded: bool = False

    @property
    def right(self) -> int:
        return self.x + self.w

    @property
    def bottom(self) -> int:
        return self.y + self.h

    def over(self, o: Piece, slack: int) -> bool:
        """Whether this piece's centre lies in the span of another."""
        return o.x - slack <= self.x + self.w // 2 < o.right + slack

    def around(self, others: list[Piece]) -> Piece:
        """The piece with a box that holds the others', too."""
        every = [p for p in (self, *others) if p.w > 0 and p.h > 0] or [self]
        x, y = min(p.x for p in every), min(p.y for p in every)
        return replace(self, x=x, y=y, w=max(p.right for p in every) - x, h=max(p.bottom for p in every) - y)

    @property
    def thin(self) -> bool:
        return not self.folded and self.kind == "Glyph" and bool(self.ch) and self.ch in ONE_LIKE


def main_size(pieces: list[Piece]) -> float:
    """The median of the larger three fifths of the glyphs' scales (of any scales, if no glyph has one); 10 if none."""
    for glyphs_only in (True, False):
        s = sorted((p.scale for p in pieces if p.scale > 0 and (p.kind == "Glyph" or not glyphs_only)), reverse=True)
        if s:
            return s[(max(1, (6 * len(s) + 9) // 10) - 1) // 2]
    return 10.0


class Parser:
    def __init__(self, rules: Rules = Rules()) -> None:
        self.rules = rules

    def __call__(self, pieces: list[Piece], depth: int = 0) -> str:
        if not pieces or depth > self.rules.deepest:
            return ""
        if depth and len(pieces) == 1 and pieces[0].thin:
            return "1"
        size = main_size(pieces)
        inner = lambda own: self(own, depth + 1)
        for fold in (self.roots, self.accents, self.bars, self.limits):
            pieces = fold(pieces, size, inner)
        return self.line(pieces, inner)

    def roots(self, pieces: list[Piece], size: float, inner) -> list[Piece]:
        """Radicals take what lies in their box right of the hook, smallest first."""
        pending = sorted((p for p in pieces if p.kind == "Radical" and not p.folded), key=lambda p: p.w * p.h)
        for root in pending:
            holds = lambda p: p is not root and p.x + p.w // 2 >= root.radicand_x and root.x <= p.x + p.w // 2 < root.right and root.y <= p.y + p.h // 2 < root.bottom  # noqa: E731, B023
            own = [p for p in pieces if holds(p)]
            whole = replace(root, tex=f"\\sqrt {{ {inner(own)} }}", folded=True, scale=size, baseline=root.bottom - self.rules.root_foot * size).around(own)
            pieces = [p for p in pieces if p is not root and not any(p is q for q in own)] + [whole]
            if any(p is q for q in own for p in pending):
                return self.roots(pieces, size, inner)
        return pieces

    def accents(self, pieces: list[Piece], size: float, inner) -> list[Piece]:
        """A flat mark close above just one glyph, with nothing stacked on it, is the glyph's accent."""
        for mark in pieces:
            command = "\\bar" if mark.kind == "Bar" else ACCENTS.get(mark.ch)
            if mark.folded or not command or mark.h > self.rules.accent_height * size:
                continue
            near = lambda p: p.y >= mark.bottom - 1 and p.y - mark.bottom <= self.rules.accent_gap * size and mark.w <= self.rules.accent_width * p.w + 2  # noqa: E731, B023
            below = [p for p in pieces if p is not mark and p.kind == "Glyph" and not p.folded and mark.over(p, 1) and near(p)]
            stacked = any(p is not mark and p.over(mark, 1) and p.bottom <= mark.y + 1 and mark.y - p.bottom <= self.rules.reach * size for p in pieces)
            if len(below) == 1 and not stacked:
                base = below[0]
                whole = replace(base, tex=f"{command} {{ {base.tex} }}").around([mark])
                return self.accents([p for p in pieces if p is not mark and p is not base] + [whole], size, inner)
        return pieces

    def bars(self, pieces: list[Piece], size: float, inner) -> list[Piece]:
        """Rules with something over or under them are fractions or lines, narrowest first."""
        reach = int(self.rules.reach * size)

        def meets(bar: Piece, p: Piece) -> bool:
            beside = p.bottom <= bar.y + 1 or p.y >= bar.bottom - 1
            return p is not bar and p.over(bar, 1) and p.w <= bar.w + 2 and beside and min(abs(p.bottom - bar.y), abs(p.y - bar.bottom)) <= reach

        able = [p for p in pieces if p.kind == "Bar" and not p.folded and any(meets(p, q) for q in pieces)]
        if not able:
            return pieces
        bar = min(able, key=lambda p: p.w)
        span = [p for p in pieces if p is not bar and p.x >= bar.x - 2 and p.right <= bar.right + 2]
        far = int(self.rules.reach * size * 2)
        upper = [p for p in span if p.bottom <= bar.y + 1 and bar.y - p.bottom <= far]
        lower = [p for p in span if not any(p is q for q in upper) and p.y >= bar.bottom - 1 and p.y - bar.bottom <= far]
        if upper and lower:
            tex = f"\\frac {{ {inner(upper)} }} {{ {inner(lower)} }}"
        else:
            tex = f"\\overline {{ {inner(upper)} }}" if upper else f"\\underline {{ {inner(lower)} }}"
        whole = replace(bar, tex=tex, folded=True, scale=size, baseline=bar.y + 0.5 * bar.h + self.rules.axis * size).around(upper + lower)
        rest = [p for p in pieces if p is not bar and not any(p is q for q in upper + lower)]
        return self.bars([*rest, whole], size, inner)

    def limits(self, pieces: list[Piece], size: float, inner) -> list[Piece]:
        """What stands over or under a large operator are its limits."""
        reach = int(self.rules.reach * size)
        for op in pieces:
            if op.folded or not op.ch or op.ch not in WITH_LIMITS:
                continue
            near = [p for p in pieces if p is not op and p.over(op, 2)]
            upper = [p for p in near if p.bottom <= op.y + 1 and op.y - p.bottom <= reach]
            lower = [p for p in near if not any(p is q for q in upper) and p.y >= op.bottom - 1 and p.y - op.bottom <= reach]
            if upper or lower:
                tex = op.tex + (f" _ {{ {inner(lower)} }}" if lower else "") + (f" ^ {{ {inner(upper)} }}" if upper else "")
                whole = replace(op, tex=tex, folded=True).around(upper + lower)
                return self.limits([p for p in pieces if p is not op and not any(p is q for q in upper + lower)] + [whole], size, inner)
        return pieces

    def line(self, pieces: list[Piece], inner) -> str:
        """Pieces from left to right, with those of script size above or below the line as scripts of what is before them."""
        pieces = sorted(pieces, key=lambda p: (p.x, p.y))
        size = main_size(pieces)
        full = lambda p: p.folded or p.scale >= self.rules.script_scale * size
        base = sorted(p.baseline for p in pieces if full(p))
        level = base[len(base) // 2] if base else 0.0

        def place(p: Piece) -> str:
            if full(p) or p.scale <= 0 or (p.ch and p.ch in ON_LINE):
                return ""
            if p.baseline < level - self.rules.raised * size:
                return "^"
            return "_" if p.baseline > level + self.rules.dropped * size else ""

        places = [place(p) for p in pieces]
        texts = [p.tex for p in pieces]
        number = lambda k: not pieces[k].folded and (pieces[k].ch.isdecimal() and pieces[k].ch.isascii() or texts[k] == "1")
        for k, p in enumerate(pieces):
            if p.thin and not places[k]:
                for j in (k - 1, k + 1):
                    if 0 <= j < len(pieces) and not places[j] and number(j):
                        a, b = (pieces[j], p) if j < k else (p, pieces[j])
                        if b.x - a.right <= self.rules.one_gap * size:
                            texts[k] = "1"
        out: list[str] = []
        k = 0
        while k < len(pieces):
            if places[k]:
                out += [] if out else ["{ }"]
            else:
                out += [texts[k]] if texts[k] else []
                k += 1
            scripts: dict[str, list[Piece]] = {"_": [], "^": []}
            while k < len(pieces) and places[k]:
                scripts[places[k]].append(pieces[k])
                k += 1
            out += [f"{mark} {{ {inner(own)} }}" for mark, own in scripts.items() if own]
        return " ".join(out)


def formula(symbols: list[dict], rules: Rules = Rules()) -> str:
    """LaTeX of symbols with the fields of SYMBOL; kind is Glyph, Bar or Radical."""
    pieces = []
    for s in symbols:
        own = {k: v for k, v in dict(s).items() if v is not None}
        tex = {"Bar": "-", "Radical": "\\sqrt"}.get(own.get("kind", "Glyph")) or TEX.get(own["ch"], own["ch"])
        pieces.append(Piece(**{**own, "tex": tex}))
    return Parser(rules)(pieces)


def parsed(symbols: Column) -> Column:
    """LaTeX of an array of SYMBOL structs; null for a null array."""

    @F.arrow_udf("string")
    def run(rows):
        import pyarrow as pa

        return pa.array([None if r is None else formula(r) for r in rows.to_pylist()], pa.string())

    return run(symbols)
