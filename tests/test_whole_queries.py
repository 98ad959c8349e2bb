"""Queries over whole tables against brute force: no box is left out."""

import os

import pytest

from rasterlake.plans import catalog
from rasterlake.plans.adapters import text_lines

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def regions(boxes):
    """Regions of one frame's (id, x, y, w, h) by comparing every two boxes."""
    grown = [(x - h * 8 // 10, x + w + h * 8 // 10, y - h * 5 // 10, y + h + h * 5 // 10) for _, x, y, w, h in boxes]
    left, out = set(range(len(boxes))), []
    while left:
        found = todo = [left.pop()]
        while todo:
            l, r, t, b = grown[todo[-1]]
            todo = todo[:-1] + [j for j in left if grown[j][0] < r and l < grown[j][1] and grown[j][2] < b and t < grown[j][3]]
            found = found + [j for j in todo if j in left]
            left -= set(found)
        own = [boxes[j] for j in found]
        if len(own) <= 24 and any(b[0] % 3 == 0 for b in own):
            d = max(2, max(b[4] for b in own) * 3 // 10)
            x, y = min(b[1] for b in own), min(b[2] for b in own)
            w, h = max(b[1] + b[3] for b in own) - x, max(b[2] + b[4] for b in own) - y
            out.append((min(b[0] for b in own), len(own), x - d, y - d, w + 2 * d, h + 2 * d))
    return out


def test_formula_regions_of_all_boxes(spark):
    frames = {}
    for r in text_lines(spark, SF).collect():
        frames.setdefault(r["frame"], []).append((r["id"], r["x"], r["y"], r["w"], r["h"]))
    want = sorted((f, *g) for f, boxes in frames.items() for g in regions(boxes))
    got = catalog.QUERIES["formula_regions"](spark, SF).select("frame", "grp", "n", "x", "y", "w", "h").collect()
    assert sorted(map(tuple, got)) == want


def test_checksum_sees_texts(spark):
    from rasterlake.plans.text_queries import text_checksum_of

    of = lambda *rows: tuple(text_checksum_of(spark.createDataFrame(list(rows), "doc_id long, text string, source string")).first())
    a, b = (1, "one", "s"), (2, None, "t")
    assert of(a, b) == of(b, a)
    assert len({of(a, b), of((1, "two", "s"), b), of((1, "one", "t"), b), of(a, (2, "", "t")), of(a, a), of(b, b)}) == 6
