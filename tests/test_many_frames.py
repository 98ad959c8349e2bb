"""Queries over frames do their work on all cores, and once for equal frames, with the results of single frames."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.operators import fits, layout, math_reading, reading
from rasterlake.operators.graph import least_linked, rooted
from rasterlake.plans import font, screen_queries

SF = "/root/testdata/sf0.001"
FRAME = "frame long, width int, height int, format string, pixels binary"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def frame_rows(pages):
    return [(k, p.shape[1], p.shape[0], "RGB24", bytearray(p.tobytes())) for k, p in enumerate(pages)]


def tasks_with_frames(df):
    return df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()


@tables
def test_elements_are_found_in_many_tasks(spark):
    """The lines come in one split, which one task would paint and lay out alone."""
    assert spark.read.parquet(f"{SF}/part.parquet").rdd.getNumPartitions() == 1
    found = tasks_with_frames(screen_queries.layout_elements(spark, SF))
    assert len(found) > 8 and max(r["n"] for r in found) < sum(r["n"] for r in found) / 4


def test_links_of_many_are_those_of_few():
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 60):
        for links in (0, n // 2, n, 4 * n):
            a, b = np.sort(rng.integers(0, n, (links, 2)), 1).T
            a, b = a[a < b], b[a < b]
            want = rooted(list(range(n)), list(zip(a.tolist(), b.tolist())))
            assert least_linked(n, a, b).tolist() == [want[i] for i in range(n)]
    path = np.random.default_rng(4).permutation(300)
    a, b = np.minimum(path[:-1], path[1:]), np.maximum(path[:-1], path[1:])
    assert not least_linked(300, a, b).any()


@tables
def test_words_are_found_in_many_tasks(spark):
    """Frames are spread as they are painted; words and blocks are grouped only then."""
    found = tasks_with_frames(screen_queries.word_frames(spark, SF))
    assert len(found) > 8 and sum(r["n"] for r in found) == spark.read.parquet(f"{SF}/part.parquet").count()


def test_equal_frames_are_settled_once(spark, tmp_path):
    """40 frames of three kinds, two of which have the same bytes in another shape, and one that isn't decoded."""
    drawn = [font.page(["ONE"]), font.page(["TWO"])]
    turned = np.ascontiguousarray(drawn[0].reshape(drawn[0].shape[1], drawn[0].shape[0], 3))
    pages = [(*drawn, turned)[k % 3] for k in range(40)]
    frames = spark.createDataFrame([*frame_rows(pages), (99, None, None, None, None)], FRAME).coalesce(1)
    folder = str(tmp_path)

    def make():
        def of(page):
            os.close(os.open(f"{folder}/{len(os.listdir(folder))}", os.O_CREAT | os.O_EXCL))
            size = f"{page.width} {page.height} {int(page.luma.sum())}"
            return [{"kind": size}], {size: {"kind": f"once {size}"}}

        return of

    got = [(r["frame"], r["kind"]) for r in layout.over_frames(frames, "frame long, kind string", make).collect()]
    want = {k: f"{p.shape[1]} {p.shape[0]} {int(layout.grey(p).sum())}" for k, p in enumerate(pages)}
    assert sorted(r for r in got if r[0] is not None) == sorted(want.items())
    assert sorted(r[1] for r in got if r[0] is None) == sorted({f"once {v}" for v in want.values()})
    assert len(os.listdir(folder)) == 3
    alone = [[{k: e[k] for k in ("level", "elem", "kind", "x", "y", "w", "h", "parent", "depth", "atoms")} for e in layout.Page(p).elements()] for p in pages]
    rows = layout.layout(frames).collect()
    for k, own in enumerate(alone):
        assert [{c: r[c] for c in own[0]} for r in rows if r["frame"] == k] == own


def test_frames_are_read_in_one_pass(spark):
    """read_frames() has the rows of read_screen() over layout(): text, boxes that aren't read, and equal crops of other frames."""
    icon = np.full((80, 160, 3), 240, np.uint8)
    icon[12:40, 12:40], icon[18:34, 18:34] = 15, 240
    icon[50:62, 100:112] = 15
    pages = [font.page(["ORDER 66", "STATUS"]), font.page(["STATUS", "ORDER 66"], width=300), font.page(["ORDER 66", "STATUS"]), icon, font.page([" "])]
    frames = spark.createDataFrame([*frame_rows(pages), (99, None, None, None, None)], FRAME).repartition(3)
    atlas = screen_queries.dots_atlas(spark)
    for verify in (reading.VerifyRules(), reading.VerifyRules(around=0, tallest=20, verify=False)):
        got = reading.read_frames(frames, atlas, verify=verify)
        want = reading.read_screen(frames, layout.layout(frames), atlas, verify=verify)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert want.where("is_text").count() == (6 if verify.verify else 0) and want.count() > 8


@tables
def test_pixels_of_frames_are_not_shuffled_to_be_read(spark):
    plan = screen_queries.screen_text(spark, SF)._jdf.queryExecution().toString()
    assert "Join" in plan and "pixels" not in plan


@tables
def test_formulas_are_read_in_many_tasks(spark):
    """Before, one task laid out all frames, and their pixels were shuffled to meet their regions."""
    found = screen_queries.screen_formulas(spark, SF)
    assert "Join" not in found._jdf.queryExecution().toString()
    each = tasks_with_frames(found)
    assert len(each) > 8 and max(r["n"] for r in each) < sum(r["n"] for r in each) / 4


def test_formulas_are_read_in_one_pass(spark):
    """formulas_in() has the rows of formulas_of() over layout(), where no text was read."""
    pages = [font.page(["X2 Y", "A"]), font.page(["X2 Y", "AB", "AB 8"]), font.page(["X2 Y", "A"]), font.page([" "])]
    frames = spark.createDataFrame([*frame_rows(pages), (99, None, None, None, None)], FRAME).repartition(3)
    elements = layout.layout(frames).where("level = 'element'").selectExpr("*", "cast(null as boolean) is_text", "cast(null as boolean) fitted", "cast(null as double) residual")
    atlas = screen_queries.dots_atlas(spark)
    for rules in (math_reading.FormulaRules(all_text=True), math_reading.FormulaRules(least_symbols=1, most_rare=1.0, least_marks=0, most_dist=50.0)):
        got = math_reading.formulas_in(frames, atlas, rules=rules)
        want = math_reading.formulas_of(frames, elements, atlas, rules=rules)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert want.count() >= 5


def test_regions_of_a_frame_are_those_of_tables(spark):
    rng = np.random.default_rng(8)
    rows = []
    for frame, (n, side) in enumerate([(1, 50), (12, 300), (40, 900), (60, 300), (60, 2000)]):
        rows += [(frame, k, *(int(v) for v in (rng.integers(0, side), rng.integers(0, side), rng.integers(1, 60), rng.integers(1, 40)))) for k in range(n)]
    boxes = spark.createDataFrame(rows, "frame long, id int, x int, y int, w int, h int").withColumn("candidate", F.lit(True))
    found = fits.formula_regions(boxes, 30, members=True).orderBy("frame", "grp").collect()
    assert len(found) > 20
    for frame in range(5):
        own = fits.regions_of([dict(zip(("elem", "x", "y", "w", "h"), r[1:])) for r in rows if r[0] == frame], 30)
        assert own == [{c: r[c] for c in ("members", "x", "y", "w", "h")} for r in found if r["frame"] == frame]
    assert fits.regions_of([], 30) == []


@tables
def test_words_are_painted_where_they_are_laid_out(spark):
    """Before, pixels went from the painting worker to the JVM and back, and all columns of all levels came out."""
    found = screen_queries.layout_words(spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "pixels" not in plan and "atoms" not in plan
    want = layout.layout(screen_queries.word_frames(spark, SF)).where("level <> 'element'").groupBy("frame", "level").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x"), F.sum("w").alias("w"))
    assert found.dtypes == want.dtypes and sorted(found.collect()) == sorted(want.collect())


def test_equal_drawings_are_painted_once(spark, tmp_path):
    """Each frame has the rows of its own pixels, whatever the values that it is painted from."""
    texts = ["ONE", "TWO", None]
    drawings = [(k, texts[k % 3], 1 + k % 2) for k in range(60)]
    folder = str(tmp_path)

    def paint(text, scale):
        os.close(os.open(f"{folder}/{len(os.listdir(folder))}", os.O_CREAT | os.O_EXCL))
        return font.page([text or " "], scale)

    rows = layout.layout(spark.createDataFrame(drawings, "frame long, text string, scale int").coalesce(1), paint=paint).collect()
    assert len(os.listdir(folder)) == 6
    for k, text, scale in drawings:
        own = layout.Page(font.page([text or " "], scale)).elements()
        assert [{c: r[c] for c in own[0]} for r in rows if r["frame"] == k] == own
    some = layout.layout(spark.createDataFrame(drawings[:1], "frame long, text string, scale int"), levels=("word",), schema="frame long, x int", paint=lambda text, scale: font.page([text], scale))
    assert [tuple(r) for r in some.collect()] == [(0, e["x"]) for e in layout.Page(font.page(["ONE"], 1)).elements() if e["level"] == "word"]


def noisy(seed):
    rng = np.random.default_rng(seed)
    page = font.page(["AB CD 12", "EF"], 2, width=90, ground=tuple(rng.integers(120, 256, 3)), ink=tuple(rng.integers(0, 120, 3)))
    for _ in range(12):
        x, y = rng.integers(0, page.shape[1]), rng.integers(0, page.shape[0])
        page[y : y + rng.integers(1, 14), x : x + rng.integers(1, 30)] = rng.integers(0, 256, 3)
    return page


def test_inks_of_many_are_those_of_one(monkeypatch):
    """By the rule itself: the median of a box's border, and the mean step from it of the stronger pixels, towards zero."""
    monkeypatch.setattr(layout, "INKS_AT_ONCE", 5)
    seen = 0
    for seed in range(20):
        page = layout.Page(noisy(seed))
        n = len(page.atoms.box)
        page.find_inks(list(range(n)))
        for k, (x, y, w, h) in enumerate(page.atoms.box.tolist()):
            own = page.luma[y : y + h, x : x + w]
            border = sorted([*own[0], *own[-1], *own[:, 0], *own[:, -1]])
            ground = int(border[len(border) // 2])
            steps = [int(page.luma[p]) - ground for p in zip(*layout.pixels(page.atoms.of(k)))]
            strong = [s for s in steps if 2 * abs(s) >= max(map(abs, steps))]
            assert page._ink[k] == min(255, max(0, ground + int(sum(strong) / len(strong))))
        seen += n
    assert seen > 200


def test_lines_are_the_same_by_few_pairs_at_once(monkeypatch):
    whole = [layout.Page(noisy(seed)).elements() for seed in range(20)]
    monkeypatch.setattr(layout, "PAIRS_AT_ONCE", 3)
    assert whole == [layout.Page(noisy(seed)).elements() for seed in range(20)]
    boxes = np.stack(np.random.default_rng(2).integers([0, 0, 1, 1], [400, 60, 30, 20], (80, 4)), 0)
    page, rules = layout.Page(noisy(0)), layout.LayoutRules()

    def joined(i, j):
        (ax, ay, aw, ah), (bx, by, bw, bh) = sorted((boxes[i].tolist(), boxes[j].tolist()))
        low, high = sorted((ah, bh))
        shared = min(ay + ah, by + bh) - max(ay, by)
        return bx <= ax + aw + int(1.25 * ah + 0.5) and high <= rules.height_ratio * low and shared >= rules.shared_height * low and bx - ax - aw <= 1.25 * high

    groups = page.on_lines(boxes, 1.25, lambda i, j: False)
    want = rooted(list(range(80)), [(i, j) for i in range(80) for j in range(i + 1, 80) if joined(i, j)])
    assert sorted(sorted(g) for g in groups) == sorted(sorted(i for i in want if want[i] == r) for r in set(want.values()))
    assert 1 < len(groups) < 70
