"""Boxes as columns: half-open integer rectangles, areas as longs, empty results at the origin."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """Four integer columns: [x, x + w) by [y, y + h)."""

    x: Column
    y: Column
    w: Column
    h: Column

    @staticmethod
    def named(prefix: str = "") -> Box:
        """The box in columns x, y, w, h, with a prefix."""
        return Box(*(F.col(f"{prefix}{c}") for c in "xywh"))

    @staticmethod
    def from_ltrb(left: Column, top: Column, right: Column, bottom: Column) -> Box:
        return Box(left, top, right - left, bottom - top)

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h

    @property
    def area(self) -> Column:
        return self.w.cast("long") * self.h.cast("long")

    @property
    def empty(self) -> Column:
        return (self.w <= 0) | (self.h <= 0)

    @property
    def centre_x2(self) -> Column:
        """Twice the centre: stays integral."""
        return 2 * self.x + self.w

    @property
    def centre_y2(self) -> Column:
        return 2 * self.y + self.h

    def contains(self, o: Box) -> Column:
        return (o.x >= self.x) & (o.y >= self.y) & (o.right <= self.right) & (o.bottom <= self.bottom)

    def contains_point(self, px: Column, py: Column) -> Column:
        return (px >= self.x) & (py >= self.y) & (px < self.right) & (py < self.bottom)

    def x_overlap(self, o: Box) -> Column:
        """Shared length on the x axis; the negated gap where there is none."""
        return F.least(self.right, o.right) - F.greatest(self.x, o.x)

    def y_overlap(self, o: Box) -> Column:
        return F.least(self.bottom, o.bottom) - F.greatest(self.y, o.y)

    def intersect(self, o: Box) -> Box:
        """The shared box; the zero box at the origin if nothing is shared."""
        some = (self.x_overlap(o) > 0) & (self.y_overlap(o) > 0)
        pick = lambda c: F.when(some, c).otherwise(F.lit(0))
        return Box(pick(F.greatest(self.x, o.x)), pick(F.greatest(self.y, o.y)), pick(self.x_overlap(o)), pick(self.y_overlap(o)))

    def shared_area(self, o: Box) -> Column:
        return F.greatest(self.x_overlap(o), F.lit(0)).cast("long") * F.greatest(self.y_overlap(o), F.lit(0)).cast("long")

    def unite(self, o: Box) -> Box:
        """The least box around both; an empty box adds nothing."""
        left, top = F.least(self.x, o.x), F.least(self.y, o.y)
        both = Box(left, top, F.greatest(self.right, o.right) - left, F.greatest(self.bottom, o.bottom) - top)
        pick = lambda c: F.when(o.empty, getattr(self, c)).when(self.empty, getattr(o, c)).otherwise(getattr(both, c))
        return Box(*map(pick, "xywh"))

    def inflate(self, d: Column | int) -> Box:
        return Box(self.x - d, self.y - d, self.w + 2 * d, self.h + 2 * d)

    def clip(self, width: Column, height: Column) -> Box:
        return self.intersect(Box(F.lit(0), F.lit(0), width, height))

    def iou(self, o: Box) -> Column:
        """Shared over joint area as a double; 0 where nothing is shared."""
        shared = self.shared_area(o)
        return F.when(shared > 0, shared / (self.area + o.area - shared)).otherwise(F.lit(0.0))

    def iou_at_least(self, o: Box, num: int, den: int) -> Column:
        """Whether IoU >= num / den, in integers."""
        shared = self.shared_area(o)
        return (shared > 0) & (den * shared >= num * (self.area + o.area - shared))

    def columns(self, prefix: str = "") -> list[Column]:
        return [getattr(self, c).cast("int").alias(f"{prefix}{c}") for c in "xywh"]


def centre_within(r: Box, span: Box, slack: Column | int) -> Column:
    """Whether a box's integer centre lies in another's x span, give or take slack."""
    c = r.x + F.floor(r.w / 2).cast("int")
    return (c >= span.x - slack) & (c <= span.right + slack)


def effective_kind(kind: Column, is_text: Column) -> Column:
    """The kind of an element after its text was verified: text that isn't is null, an icon that is text is text."""
    return F.when((kind == "Text") & ~is_text, F.lit(None)).when((kind == "Icon") & is_text, F.lit("Text")).otherwise(kind)


def union_of(prefix: str = "") -> list[Column]:
    """Aggregates x, y, w, h: the least box around a group's boxes that aren't empty."""
    b = Box.named(prefix)
    some = lambda c: F.when(~b.empty, c)
    x, y = F.coalesce(F.min(some(b.x)), F.lit(0)), F.coalesce(F.min(some(b.y)), F.lit(0))
    right, bottom = F.coalesce(F.max(some(b.right)), F.lit(0)), F.coalesce(F.max(some(b.bottom)), F.lit(0))
    return [x.alias("x"), y.alias("y"), (right - x).alias("w"), (bottom - y).alias("h")]


def truth_group(label: Column, web: bool = False) -> Column:
    """The kind that a ground-truth label counts as; in web data, a generic label counts as none (empty)."""
    widget = F.when(label == "generic", F.lit("")).otherwise(F.lit("Container")) if web else F.lit("Container")
    return F.when(label.isin("Text", "Image"), label).when(label.isin("Icon", "WebIcon"), F.lit("Icon")).otherwise(widget)
