"""Line fits, formula evidence and formula regions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.functions.geometry import union_of
from rasterlake.functions.latex import CLASS
from rasterlake.operators.graph import frame_components, least_linked
from rasterlake.operators.ranges import overlap_join

# Characters of a formula that cost nothing, and those that cost 2; Greek costs 1, all others 5.
FREE, TWO = "()[]+-=,.|/'", "∑∏∫∂∞±×≤≥→∈≡≈∼⋅′<>{};:!*"


def math_prior(ch: Column) -> Column:
    greek = ch.between("α", "ω") | ch.between("Γ", "Ω")
    return F.when(ch.rlike("^[a-zA-Z0-9]$") | (F.instr(F.lit(FREE), ch) > 0), 0.0).when(greek, 1.0).when(F.instr(F.lit(TWO), ch) > 0, 2.0).otherwise(5.0)


def math_evidence(symbols: DataFrame, formulas: DataFrame) -> DataFrame:
    """region, symbols, mean_dist, rare, marks: from symbols (region, kind, ch, dist) and their LaTeX (region, tex).

    Marks are radicals, Greek letters, large operators and relations, and the scripts, fractions and roots of the LaTeX.
    """
    telling = [c for c, k in CLASS.items() if k in ("BigOp", "Relation")]
    glyph = F.col("kind") == "Glyph"
    mark = (F.col("kind") == "Radical") | (glyph & (F.col("ch").between("Α", "ϵ") | F.col("ch").isin(*telling)))
    n = F.count_if(glyph)
    each = symbols.groupBy("region").agg(
        F.count(F.lit(1)).alias("symbols"), F.when(n > 0, F.avg(F.when(glyph, F.col("dist")))).otherwise(99.0).alias("mean_dist"),
        F.when(n > 0, F.count_if(glyph & (math_prior(F.col("ch")) >= 5)) / n).otherwise(1.0).alias("rare"), F.count_if(mark).alias("own"),
    )
    parts = sum((F.regexp_count("tex", F.lit(p)) for p in (r"_ \{", r"\\frac", r"\\sqrt")), F.regexp_count("tex", F.lit(r"\^ \{")))
    return each.join(formulas.select("region", parts.alias("parts")), "region", "left").select("region", "symbols", "mean_dist", "rare", (F.col("own") + F.coalesce("parts", F.lit(0))).alias("marks"))


def line_fits(rows: DataFrame, far: float = 0.35) -> DataFrame:
    """grp, baseline, size: least squares of obs = baseline + rel * size, and again without rows off by far * size or more.

    A fit needs two rows and a size above 2; where the second fails, the first stands, and where the first fails, none.
    """
    fit = lambda r: r.groupBy("grp").agg(F.regr_intercept("obs", "rel").alias("b"), F.regr_slope("obs", "rel").alias("s")).where("s > 2")
    one = fit(rows)
    near = rows.join(one, "grp").where(F.abs(F.col("obs") - F.col("b") - F.col("rel") * F.col("s")) < far * F.col("s")).select("grp", "rel", "obs")
    two = fit(near).select("grp", F.col("b").alias("b2"), F.col("s").alias("s2"))
    return one.join(two, "grp", "left").select("grp", F.coalesce("b2", "b").alias("baseline"), F.coalesce("s2", "s").alias("size"))


def formula_regions(texts: DataFrame, tallest: int, most: int = 24, members: bool = False) -> DataFrame:
    """frame, grp, n, x, y, w, h: regions of text boxes (candidate says which may be formulas) that overlap once grown.

    With members, the sorted ids of a region's boxes too.
    Boxes grow by 8 tenths of their height sideways and 5 tenths up and down. A region has a candidate and `most` boxes
    at most, and its box is widened by 3 tenths of its tallest box, by 2 at least.
    """
    own = texts.where(F.col("h") <= tallest)
    gx, gy = F.expr("h * 8 div 10"), F.expr("h * 5 div 10")
    grown = own.select("frame", "id", (F.col("x") - gx).alias("l"), (F.col("x") + F.col("w") + gx).alias("r"), (F.col("y") - gy).alias("t"), (F.col("y") + F.col("h") + gy).alias("b"))
    side = lambda p: grown.select("frame", *(F.col(c).alias(f"{p}{c}") for c in ("id", "l", "r", "t", "b")))
    links = overlap_join(side("u"), side("v"), ["frame"], ("ut", "ub"), ("vt", "vb")).where("uid < vid and ul < vr and vl < ur").select("frame", F.col("uid").alias("u"), F.col("vid").alias("v"))
    groups = own.join(frame_components(own.select("frame", "id"), links), ["frame", "id"]).groupBy("frame", "grp").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("candidate").alias("any"), F.max("h").alias("tall"), *([F.array_sort(F.collect_list(F.col("id").cast("long"))).alias("members")] if members else []), *union_of()
    )
    d = F.greatest(F.lit(2), F.expr("tall * 3 div 10"))
    return groups.where((F.col("n") <= most) & F.col("any")).select("frame", "grp", "n", *(["members"] if members else []), (F.col("x") - d).alias("x"), (F.col("y") - d).alias("y"), (F.col("w") + 2 * d).alias("w"), (F.col("h") + 2 * d).alias("h"))


def regions_of(texts: list[dict], tallest: int, most: int = 24) -> list[dict]:
    """formula_regions() of one frame's text boxes (elem, x, y, w, h), all of them candidates, in order of their groups."""
    own = sorted((e for e in texts if e["h"] <= tallest), key=lambda e: e["elem"])
    if not own:
        return []
    box = np.array([[e[c] for c in "xywh"] for e in own])
    x, y, w, h = box.T
    left, right, top, bottom = x - h * 8 // 10, x + w + h * 8 // 10, y - h * 5 // 10, y + h + h * 5 // 10
    meet = lambda low, high: (low[:, None] < high) & (low < high[:, None])
    a, b = np.nonzero(np.triu(meet(left, right) & meet(top, bottom), 1))
    root, out = least_linked(len(own), a, b), []
    for k in np.unique(root).tolist():
        at = np.flatnonzero(root == k)
        if len(at) <= most:
            d = max(2, int(h[at].max()) * 3 // 10)
            x0, y0 = int(x[at].min()), int(y[at].min())
            x1, y1 = int((x + w)[at].max()), int((y + h)[at].max())
            out.append({"members": [own[i]["elem"] for i in at.tolist()], "x": x0 - d, "y": y0 - d, "w": x1 - x0 + 2 * d, "h": y1 - y0 + 2 * d})
    return out
