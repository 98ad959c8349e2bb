"""Features of crops against plain loops, and formula evidence."""

import numpy as np
import pytest

from rasterlake.operators import fits, shapes
from rasterlake.plans import catalog

RING = np.array([[0, 1, 1, 0], [1, 0, 0, 1], [1, 0, 0, 1], [1, 0, 0, 1], [0, 1, 1, 0]]) * 255


def loop_resample(image, n):
    out = np.zeros((n, n))
    h, w = image.shape
    for oy in range(n):
        for ox in range(n):
            total = weight = 0.0
            for y in range(h):
                for x in range(w):
                    a = max(0, min((oy + 1) * h / n, y + 1) - max(oy * h / n, y)) * max(0, min((ox + 1) * w / n, x + 1) - max(ox * w / n, x))
                    total, weight = total + a * image[y, x], weight + a
            out[oy, ox] = total / weight
    return out


@pytest.mark.parametrize("size", [(5, 7), (30, 9), (24, 24), (2, 3)])
def test_resampling(size):
    image = np.random.default_rng(1).integers(0, 255, size)
    assert np.allclose(shapes.resampled(image, 24), loop_resample(image, 24))


def test_glyphs_and_shapes():
    f = shapes.glyph(RING, RING > 0)
    assert (f["holes"], f["ncomp"], f["euler"]) == (1, 1, 0) and max(f["bmp"]) == 255 and sum(f["coarse"]) == sum(f["bmp"])
    assert shapes.topology(np.array([[1], [0], [0], [1]])) == (2, 2) and shapes.topology(np.eye(3)) == (1, 1)
    assert shapes.glyph(np.zeros((0, 0)), np.zeros((0, 0)))["ncomp"] == 1
    s = shapes.shape(np.pad(RING, 3))
    assert len(s["hog"]) == 128 and max(s["ink"]) == 255 and s["fill"] == pytest.approx((RING > 0).sum() / 110)
    assert shapes.shape(np.full((5, 5), 9))["hog"] == [0] * 128 and shapes.shape(np.zeros((1, 5)))["fill"] == 0
    up = np.zeros((12, 12))
    up[:, 6:] = 200
    hog = np.array(shapes.shape(up)["hog"]).reshape(16, 8)
    assert hog[:, 1:].sum() == 0 and hog[:, 0].sum() > 0


def test_bounds_hold(spark):
    rows = catalog.QUERIES["glyph_bounds"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r["bound"] <= r["dist"] + 1e-9 for r in rows)


def test_formula_evidence(spark):
    symbols = spark.createDataFrame([(1, "Glyph", "x", 4.0), (1, "Glyph", "≤", 8.0), (1, "Glyph", "α", 6.0), (1, "Radical", "", 0.0), (2, "Bar", "-", 0.0), (3, "Glyph", "@", 1.0)], "region int, kind string, ch string, dist double")
    tex = spark.createDataFrame([(1, "\\sqrt { x ^ { 2 } } \\leq \\alpha _ { 1 }"), (2, "-")], "region int, tex string")
    got = {r["region"]: tuple(r)[1:] for r in fits.math_evidence(symbols, tex).collect()}
    assert got == {1: (4, 6.0, 0.0, 6), 2: (1, 99.0, 1.0, 0), 3: (1, 1.0, 1.0, 0)}


def test_check_states(spark):
    box = np.full((20, 20), 250)
    box[4:16, 4:16] = 0
    box[5:15, 5:15] = 250
    ticked = box.copy()
    ticked[8:12, 8:12] = 0
    assert shapes.check_state(box) == ("unchecked", pytest.approx(0.5 + 40 / 120)) and shapes.check_state(ticked) == ("checked", 1.0)
    assert shapes.check_state(np.zeros((3, 9))) is None
    assert shapes.component_boxes(np.array([[1, 0, 0], [0, 1, 0], [0, 0, 0], [1, 1, 0]])) == [(0, 0, 2, 2), (0, 3, 2, 1)]
    df = spark.createDataFrame([(ticked.ravel().tolist(), 20), ([1, 2, 3, 4], 2)], "v array<int>, w int")
    rows = [r["s"] for r in df.select(shapes.state_of(df["v"], df["w"]).alias("s")).collect()]
    assert rows[0]["value"] == "checked" and rows[1] is None
