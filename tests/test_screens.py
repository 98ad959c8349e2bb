"""Layout, ink, reading and formulas on drawn frames, and their parts against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.operators import layout, math_reading, packs, reading
from rasterlake.operators.layout import LayoutRules, Page, nested, parts
from rasterlake.operators.reading import InkRules, Reader, Templates, extract_ink
from rasterlake.plans import font
from rasterlake.plans.screen import cursor_stage, screen_pipeline
from rasterlake.sources.files import ATLAS_SCHEMA


def local_templates(rows):
    out = []
    for _, cp, _, top, w, h, cap, _, ink in rows:
        image = np.full((h + 4, w + 4), 255, int)
        image[2:-2, 2:-2] = 255 - np.frombuffer(ink, np.uint8).reshape(h, w).astype(int)
        crop = reading.Crop(image)
        feature, box = crop.feature(crop.parts.runs[:, :3])
        out.append({"ch": chr(cp), "top_rel": (top + box[1] - 2) / cap, "bot_rel": (top + box[1] + box[3] - 2) / cap, **feature})
    return out


@pytest.fixture(scope="module")
def reader():
    return Reader(Templates(local_templates(font.atlas())))


def frame_rows(*pages):
    return [(k, p.shape[1], p.shape[0], "RGB24", bytearray(p.tobytes())) for k, p in enumerate(pages)]


FRAME = "frame long, width int, height int, format string, pixels binary"


# ---- components, forests


def test_parts_are_brute_force():
    rng = np.random.default_rng(8)
    for corners in (True, False):
        for density in (0.3, 0.55, 0.8):
            m = rng.random((13, 17)) < density
            got, image = parts(m, corners), -np.ones(m.shape, int)
            for y, x0, x1, c in got.runs:
                image[y, x0:x1] = c
            want, n = -np.ones(m.shape, int), 0
            for y, x in np.argwhere(m):
                if want[y, x] < 0:
                    todo = [(y, x)]
                    while todo:
                        a, b = todo.pop()
                        if 0 <= a < 13 and 0 <= b < 17 and m[a, b] and want[a, b] < 0:
                            want[a, b] = n
                            todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if corners or abs(i) + abs(j) == 1]
                    n += 1
            assert (image == want).all() and got.area.tolist() == [(want == k).sum() for k in range(n)]
            assert (got.painted(np.array([0, 2]), m.shape) == np.isin(want, [0, 2])).all()
    assert len(parts(np.zeros((3, 4), bool)).box) == 0


def test_nesting_is_brute_force():
    rng = np.random.default_rng(1)
    boxes = np.concatenate([rng.integers(0, 30, (60, 4)) + [0, 0, 1, 1], np.repeat([[5, 5, 9, 9]], 3, 0)])
    parent, depth = nested(boxes)
    for i, (x, y, w, h) in enumerate(boxes):
        able = [(p * q, -j, j) for j, (u, v, p, q) in enumerate(boxes) if j != i and u <= x and v <= y and u + p >= x + w and v + q >= y + h and (p * q > w * h or p * q == w * h and j < i)]
        want = min(able)[2] if able else -1
        assert parent[i] == want and depth[i] == (depth[want] + 1 if want >= 0 else 0)


# ---- layout


def blank(h, w, level=240):
    return np.full((h, w, 3), level, np.uint8)


def put(page, text, x, y, scale=2, ink=(10, 10, 10)):
    m = font.line(text, scale)
    page[y : y + m.shape[0], x : x + m.shape[1]][m] = ink
    return page


def elements(page, rules=LayoutRules(), level="element"):
    return [(e["kind"], e["x"], e["y"], e["w"], e["h"], e["parent"], e["depth"]) for e in Page(page, rules).elements() if e["level"] == level]


def test_lines_words_and_blocks():
    page = blank(140, 400)
    put(page, "FIRST LINE", 20, 20)
    put(page, "SECOND", 20, 40)
    put(page, "FAR", 300, 20)  # another column
    put(page, "PALE", 20, 100, ink=(150, 150, 150))
    put(page, "DARK", 70, 100)  # near, but of other ink
    texts = [e[1:5] for e in elements(page) if e[0] == "Text"]
    assert (19, 19, 2 * 57 + 0, 16) in [(x, y, w, h) for x, y, w, h in texts] or any(x == 19 and y == 19 and w > 100 for x, y, w, h in texts)
    assert len(texts) == 5 and sum(x >= 290 for x, *_ in texts) == 1
    assert len([w for w in elements(page, level="word")]) == 5
    blocks = [e[1:5] for e in elements(page, level="block")]
    assert len(blocks) == 4 and any(y == 19 and h > 30 for _, y, _, h in blocks)
    one = Page(page, LayoutRules(ink_step=255)).elements()
    assert sum(e["level"] == "element" and e["kind"] == "Text" for e in one) == 4


def test_containers_icons_and_images():
    rng = np.random.default_rng(0)
    page = blank(300, 400)
    page[20:60, 20:120] = 20  # an outlined box with a label
    page[21:59, 21:119] = 240
    put(page, "SAVE", 40, 32)
    page[100:140, 20:140] = (60, 90, 200)  # a flat panel
    page[200:215, 30:45] = 30  # a mark on its own: an icon of two fragments
    page[203:212, 46:50] = 30
    page[80:240, 220:380] = rng.integers(0, 256, (160, 160, 3))  # a picture
    got = elements(page)
    kinds = [e[0] for e in got]
    assert kinds.count("Image") == 1 and kinds.count("Icon") == 1 and kinds.count("Text") == 1
    image = got[kinds.index("Image")]
    assert abs(image[1] - 220) <= 2 and abs(image[2] - 80) <= 2 and abs(image[3] - 160) <= 4
    icon = got[kinds.index("Icon")]
    assert icon[1:5] == (29, 199, 22, 17)
    boxes = [e[1:5] for e in got if e[0] == "Container"]
    assert (19, 19, 102, 42) in boxes and any(abs(x - 20) <= 2 and abs(y - 100) <= 2 and abs(w - 120) <= 4 for x, y, w, _ in boxes)
    label = got[kinds.index("Text")]
    assert label[6] >= 1 and got[label[5]][0] == "Container"
    assert [e for e in elements(page, LayoutRules(image_cells=10_000)) if e[0] == "Image"] == []


def test_marks_and_gutters():
    page = blank(60, 300)
    put(page, "AB", 20, 20, 4)
    page[46:48, 70:72] = 10  # a full stop behind the word
    words = [e for e in Page(page).elements() if e["level"] == "word"]
    assert [len(w["atoms"]) for w in words] == [3]
    two = put(put(blank(60, 300), "ABC", 20, 20), "DEF", 20 + 3 * 12 + 12, 20)
    wide = Page(two)
    a, b = (np.array([e[k] for k in "xywh"]) for e in wide.elements() if e["level"] == "word")
    assert wide.gutter(a, b) and wide.gutter(b, a)
    two[5, 40:90] = 10  # a rule across above it
    assert not Page(two).gutter(a, b)


def test_layout_in_spark(spark):
    pages = [put(blank(60, 200), t, 20, 20, 4) for t in ("ONE", "TWO")]
    df = spark.createDataFrame([*frame_rows(*pages), (9, 0, 0, "", bytearray())], FRAME).repartition(3)
    found = layout.layout(df)
    rows = [r for r in found.where("level = 'element' and kind = 'Text'").collect()]
    assert sorted(r["frame"] for r in rows) == [0, 1] and len(rows[0]["atoms"]) == 3
    assert layout.kind_tags(found).where("value = 'Text'").count() == 2
    assert layout.layout(df.limit(0)).count() == 0
    boxes = spark.createDataFrame([(1, 0, 2, 3, 4, 5, 9, 8, 7), (1, 1, 90, 0, 20, 2, 1, 2, 3)], "frame long, id int, x int, y int, w int, h int, r int, g int, b int")
    for outline in (False, True):
        r = layout.drawn(boxes, 100, 20, outline=outline).first()
        page = np.frombuffer(r["pixels"], np.uint8).reshape(20, 100, 3)
        assert tuple(page[3, 2]) == (9, 8, 7) and tuple(page[5, 4]) == ((245,) * 3 if outline else (9, 8, 7)) and tuple(page[0, 99]) == (1, 2, 3) and page[9, 9, 0] == 245


# ---- ink


def naive_ink(image, r):
    """Levels and thresholds by plain loops, without shadows."""
    h, w = image.shape
    best, t = 0.0, 127
    for k in range(256):
        low, high = image[image <= k], image[image > k]
        if len(low) and len(high):
            v = len(low) * len(high) * (low.mean() - high.mean()) ** 2
            if v > best * (1 + 1e-12):
                best, t = v, k
    border = [image[y, x] for y in range(h) for x in range(w) if y in (0, h - 1) or x in (0, w - 1)]
    above = sum(v > t for v in border)
    dark = 2 * above >= len(border)
    if max(above, len(border) - above) * 4 < len(border) * 3:
        runs = {False: [], True: []}
        for row in image > t:
            x = 0
            while x < w:
                e = x
                while e < w and row[e] == row[x]:
                    e += 1
                if x and e < w:
                    runs[bool(row[x])].append(e - x)
                x = e
        if runs[False] and runs[True]:
            dark = sum(runs[False]) * len(runs[True]) < sum(runs[True]) * len(runs[False])
    low, high = np.sort(image[image <= t]), np.sort(image[image > t])
    lo, hi = int(low[(len(low) - 1) // 2]), int(high[(len(high) - 1) // 2]) if len(high) else t + 1
    ground, level = (hi, lo) if dark else (lo, hi)
    soft = np.clip([[(ground - v if dark else v - ground) * 255 // max(1, abs(ground - level)) for v in row] for row in image.tolist()], 0, 255)
    mask = soft >= 128
    if r.local:
        n = max(3, int(r.local_height * h)) | 1
        for y in range(h):
            for x in range(w):
                win = 255 - soft[max(0, y - n // 2) : y + n // 2 + 1, max(0, x - n // 2) : x + n // 2 + 1]
                limit = win.mean() * (1 + r.local_weight * (win.std() / 128 - 1))
                mask[y, x] = 255 - soft[y, x] < limit and soft[y, x] >= r.local_floor
    return t, dark, ground, level, soft, mask


@pytest.mark.parametrize("local", [False, True])
def test_ink_is_brute_force(local):
    rng = np.random.default_rng(4)
    rules = InkRules(shadows=False, local=local)
    for k in range(25):
        image = rng.integers(0, 256, (9, 14)) if k % 2 else np.where(rng.random((9, 14)) < 0.3, 40, 200) + rng.integers(0, 30, (9, 14))
        got = extract_ink(image, rules)
        t, dark, ground, level, soft, mask = naive_ink(image, rules)
        assert (got.threshold, got.dark, got.ground, got.level) == (t, dark, ground, level)
        assert (got.soft == soft).all() and (got.mask == mask).mean() > 0.99


def test_shadows_and_margins():
    image = np.full((20, 40), 128)
    image[5:15, 10:14] = 250  # sharp light strokes
    image[5:15, 24:28] = 250
    for k, v in ((14, 60), (15, 95), (16, 115), (28, 60), (29, 95), (30, 115)):  # with a blurred dark shadow
        image[6:16, k] = v
    got = extract_ink(image)
    assert not got.dark and got.ground == 128 and got.level == 250 and got.mask[8, 11] and not got.mask[8, 14]
    framed = np.full((24, 44), 0)
    framed[2:-2, 2:-2] = 200
    framed[8:14, 10:34:4] = 90
    assert extract_ink(framed, InkRules(shadows=False, trim=True)).ground == 200
    flat = extract_ink(np.full((6, 6), 77))
    assert flat.threshold == 127 and not flat.mask.any()
    assert extract_ink(np.zeros((0, 4))).mask.shape == (0, 4)


# ---- reading


@pytest.mark.parametrize("text", ["HELLO WORLD", "QUICK 42 FOXES", "ZEBRA", "7 UP", "MINIMUM"])
def test_reads_what_is_drawn(reader, text):
    for scale, ink, ground in ((2, (0, 0, 0), 250), (3, (230, 230, 230), 40)):
        page = put(np.full((60, 400, 3), ground, np.uint8), text, 10, 12, scale, ink)
        w = font.line(text, scale).shape[1]
        got = reader.read(layout.grey(page[6 : 18 + 7 * scale, 4 : 16 + w]))
        assert got.text == text and got.fitted and got.mean_dist < 2 and got.residual < 0.1
        assert abs(got.baseline - (6 + 7 * scale)) < 1 and abs(got.cap_height - 7 * scale) < 1
        assert got.alnum == 1 and len(got.glyphs) == len(text.replace(" ", ""))


def test_joined_glyphs_are_cut(reader):
    page = put(blank(40, 200), "LINT", 10, 10, 3)
    for k, y in ((1, 29), (2, 29), (3, 11)):  # thin bridges between neighbours
        page[y, 10 + 18 * k - 3 : 10 + 18 * k] = 10
    crop = layout.grey(page[4:37, 4:86])
    assert len(parts(extract_ink(crop).mask).box) == 1
    assert reader.read(crop).text == "LINT"


def test_nothing_to_read(reader):
    for image in (np.full((20, 60), 200), np.zeros((3, 9)), np.zeros((20, 1))):
        assert reader.read(image).text == ""
    faint = put(blank(40, 120, 200), "AB", 10, 10, 3, (190, 190, 190))
    assert reader.read(layout.grey(faint)).text == ""  # below the least contrast


def test_fragments_of_neighbours_go(reader):
    page = put(put(blank(70, 200), "CENTRE", 10, 30, 2), "ABOVE", 10, 8, 2)
    got = reader.read(layout.grey(page[19:50, 4:90]))  # the feet of the line above are in the crop
    assert got.text == "CENTRE"


def test_paths_are_brute_force(reader):
    rng = np.random.default_rng(6)

    class Own(Reader):
        def choose(self, h, height, line):
            return h

    own = Own(reader.atlas)
    for _ in range(40):
        n = int(rng.integers(1, 7))
        pieces = [reading.Piece(np.zeros((0, 3), int), np.array([0, 0, 1, int(rng.integers(1, 12))]), 0) for _ in range(n)]
        hyps = [{k: float(rng.integers(0, 60)) for k in range(1, min(5, n - i) + 1) if rng.random() < 0.7} for i in range(n)]
        skip = [18.0 if p.box[3] / 10 < 0.3 else 400.0 for p in pieces]

        def least(i):
            if i == n:
                return 0.0
            return min([skip[i] + least(i + 1)] + [c + 10 + least(i + k) for k, c in hyps[i].items()])

        chosen = own.path(pieces, hyps, 10.0, None)
        # the path's cost: what it chose, and skips for the rest of a cheapest way
        total, costs = least(0), {id(c) for h in hyps for c in h.values()}
        assert all(id(c) in costs for c in chosen)
        assert sum(c + 10 for c in chosen) <= total + 1e-9


def test_nearest_templates_are_brute_force(reader):
    rows, t = local_templates(font.atlas()), reader.atlas
    rng = np.random.default_rng(2)
    for r in [rows[i] for i in rng.choice(len(rows), 12, replace=False)]:
        q = {**r, "bmp": np.clip(np.array(r["bmp"]) + rng.integers(-40, 40, 256), 0, 255).tolist()}
        best = {}
        for i, o in enumerate(rows):
            d = np.abs(np.array(q["bmp"]) - np.array(o["bmp"])).sum() / 255 + 14 * abs(q["log_aspect"] - o["log_aspect"]) + 6 * abs(q["holes"] - o["holes"]) + 10 * abs(q["ncomp"] - o["ncomp"])
            best[o["ch"]] = min(best.get(o["ch"], (1e9, 0)), (round(d, 9), i))
        want = sorted(best.values())[:4]
        assert t.nearest(q, 4, 15.0) == [w for w in want if w[0] <= want[0][0] + 15]


def test_screens_read_in_spark(spark):
    pages = [font.page(["ORDER 66", "STATUS"]), font.page(["ORDER 66", "STATUS"]), font.page(["EMPTY"])]
    frames = spark.createDataFrame(frame_rows(*pages), FRAME)
    atlas = reading.templates(spark.createDataFrame([(*r[:-1], bytearray(r[-1])) for r in font.atlas((3,))], ATLAS_SCHEMA))
    assert atlas.count() == 36
    tables = screen_pipeline(spark, atlas).run({"frames": frames})
    got = sorted((r["frame"], r["text"]) for r in tables["reads"].where("is_text").collect())
    assert got == [(0, "ORDER 66"), (0, "STATUS"), (1, "ORDER 66"), (1, "STATUS"), (2, "EMPTY")]
    container = tables["reads"].where("kind = 'Container'").first()
    assert (container["text"], container["confidence"], container["is_text"]) == ("", 0.0, False)
    assert tables["tags"].where("key = 'text' and value = 'STATUS'").count() == 2
    # stages equal the functions that they call
    direct = reading.read_screen(frames, layout.layout(frames), atlas)
    assert sorted(map(str, direct.collect())) == sorted(map(str, tables["reads"].collect()))
    assert screen_pipeline(spark, atlas).remove("layout")
    bare = screen_pipeline(spark, atlas)
    bare.enable("layout", False)
    assert set(bare.run({"frames": frames})) == {"frames"}


def test_packs_and_cursors_in_spark(spark):
    page = blank(80, 160)
    for x, y, w, h in ((12, 14, 28, 28), (70, 22, 44, 20)):
        page[y : y + h, x : x + w] = 15
        page[y + 2 : y + h - 2, x + 2 : x + w - 2] = 240
    frames = spark.createDataFrame(frame_rows(page), FRAME)
    atlas = reading.templates(spark.createDataFrame([(*r[:-1], bytearray(r[-1])) for r in font.atlas((3,))], ATLAS_SCHEMA))
    square = lambda e: e.select("frame", "elem", F.when(F.col("w") * 2 < F.col("h") * 3, "box").otherwise("switch").alias("value"), F.lit(0.9).alias("score"))
    state = lambda e: e.select("frame", "elem", F.lit("off").alias("value"), F.lit(0.8).alias("score"))
    reg = packs.Registry().add(packs.Pack("widget", "widget", square, packs.Scope(kinds=("Container", "Icon"), most_side=60)))
    reg.add(packs.Pack("state", "widget.state", state, packs.Scope(needs="widget", values=("box",))))
    tags = screen_pipeline(spark, atlas, registry=reg).run({"frames": frames})["tags"]
    assert sorted((r["key"], r["value"]) for r in tags.where("source in ('widget', 'state')").collect()) == [("widget", "box"), ("widget", "switch"), ("widget.state", "off")]
    spot = spark.createDataFrame([(0, 13, 15, 6, 6)], "frame long, x int, y int, w int, h int")
    out = cursor_stage(lambda tables: spot)({"frames": frames})
    after = np.frombuffer(out["frames"].first()["pixels"], np.uint8).reshape(80, 160, 3)
    assert out["exclusions"].count() == 1 and (page[15:21, 13:19] != after[15:21, 13:19]).any()
    same = np.ones((80, 160), bool)
    same[15:21, 13:19] = False
    assert (after[same] == page[same]).all() and np.frombuffer(frames.first()["pixels"], np.uint8).tolist() == page.ravel().tolist()
    row = page[15, 12:20, 0].astype(int)
    assert after[15, 13:19, 0].tolist() == [(row[0] * (7 - k) + row[7] * k) // 7 for k in range(1, 7)]


def test_packs_from_files_in_spark(spark, tmp_path):
    """Exemplars of two widgets drawn in other sizes, written and read as a pack file; states by the rule."""
    from rasterlake.operators import shapes
    from rasterlake.sources import files

    def widget(w, h, mark):
        page = np.full((h + 4, w + 4), 240)
        page[2 : h + 2, 2 : w + 2] = 15
        page[4:h, 4:w] = 240
        if mark:
            page[h // 2 - 2 : h // 2 + 6, w // 2 - 2 : w // 2 + 6] = 15
        return page

    rows = []
    for n, (label, w, h, mark) in enumerate([("ui.checkbox", 26, 26, False), ("ui.checkbox", 30, 30, True), ("ui.checkbox", 24, 24, True), ("ui.checkbox", 28, 28, False), ("ui.switch", 44, 20, False), ("ui.switch", 48, 22, False), ("ui.switch", 40, 18, False)]):
        f = shapes.shape(widget(w, h, mark))
        rows.append(("widgets", "widget", 3, n, label, f["log_aspect"], f["fill"], bytes(f["hog"]), bytes(f["ink"])))
    (tmp_path / "widgets.pack").write_bytes(files.build_pack(rows))
    registry = packs.registry_of(files.read_packs(spark, str(tmp_path)))
    assert list(registry.packs) == ["widgets", "check-state"]
    page = blank(80, 200)
    for x, y, w, h, mark in ((12, 14, 28, 28, True), (60, 14, 28, 28, False), (110, 22, 44, 20, False)):
        page[y - 2 : y + h + 2, x - 2 : x + w + 2] = widget(w, h, mark)[..., None]
    frames = spark.createDataFrame(frame_rows(page), FRAME)
    atlas = reading.templates(spark.createDataFrame([(*r[:-1], bytearray(r[-1])) for r in font.atlas((3,))], ATLAS_SCHEMA))
    out = screen_pipeline(spark, atlas, registry=registry).run({"frames": frames})
    where = {r["elem"]: r["x"] for r in out["elements"].where("level = 'element'").collect()}
    got = {(where[r["elem"]] // 50, r["key"]): r["value"] for r in out["tags"].where("key like 'widget%'").collect() if where[r["elem"]] > 0}
    assert got[0, "widget"] == got[1, "widget"] == "ui.checkbox" and got[2, "widget"] == "ui.switch"
    assert got[0, "widget.state"] == "checked" and got[1, "widget.state"] == "unchecked" and (2, "widget.state") not in got
    saved = packs.registry_of(files.read_packs(spark, str(tmp_path)).withColumn("pack", F.lit("my state")).withColumn("tag_key", F.lit("widget.state")))
    assert list(saved.packs) == ["my state"] and saved.packs["my state"].scope.needs == "widget"


# ---- formulas


MATH = local_templates(font.atlas((2, 3)))


def glyph_at(page, ch, x, y, scale):
    m = font.bitmap(ch, scale)
    page[y : y + m.shape[0], x : x + m.shape[1]][m] = 10


def test_formula_symbols():
    reader = math_reading.MathReader(Templates(MATH))
    page = blank(120, 260)
    glyph_at(page, "A", 20, 10, 3)
    page[44:47, 14:44] = 10  # a fraction's rule
    glyph_at(page, "B", 20, 60, 3)
    page[44:46, 60:76] = 10  # an equals sign of two rules
    page[50:52, 60:76] = 10
    glyph_at(page, "X", 90, 35, 3)
    glyph_at(page, "2", 110, 22, 2)  # a script
    s = reader.symbols(layout.grey(page))
    assert [(k["kind"], k["ch"]) for k in s if k["ch"] in "AB-X2"] == [("Bar", "-"), ("Glyph", "A"), ("Glyph", "B"), ("Glyph", "X"), ("Glyph", "2")]
    assert len(s) == 6  # the two rules are one symbol
    known = [k for k in s if k["ch"] in "AB-X2"]
    e = math_reading.evidence(known)
    assert e.tex == r"\frac { A } { B } X ^ { 2 }" and e.marks == 2 and e.symbols == 5
    assert abs(known[3]["scale"] - 21) < 1.5 and abs(known[3]["baseline"] - 56) < 1.5


def test_roots_have_something_under_them():
    reader = math_reading.MathReader(Templates(MATH))
    page = blank(80, 160)
    for k in range(20):  # a hook that falls and rises, and a roof
        page[30 + k, 10 + k // 2 : 12 + k // 2] = 10
    for k in range(42):
        page[50 - k : 52 - k, 20 + k // 4 : 22 + k // 4] = 10
    page[8:11, 30:110] = 10
    assert [s["kind"] for s in reader.symbols(layout.grey(page))] != ["Radical"]
    glyph_at(page, "K", 50, 20, 3)
    s = reader.symbols(layout.grey(page))
    assert [k["kind"] for k in s] == ["Radical", "Glyph"] and s[0]["radicand_x"] > 10
    assert math_reading.evidence(s).tex == r"\sqrt { K }"
    assert reader.symbols(np.zeros((2, 9))) == [] and math_reading.evidence([]).symbols == 0


def test_prior_settles_twins():
    rows = [r for r in MATH if r["ch"] in "AB"]
    twins = Templates([*rows, *[{**r, "ch": "α"} for r in rows if r["ch"] == "A"]])
    page = blank(60, 200)
    for k in range(4):
        glyph_at(page, "A", 20 + 30 * k, 15, 3)
    read = lambda prior: {s["ch"] for s in math_reading.MathReader(twins, prior=prior).symbols(layout.grey(page))}
    assert read(None) == {"A"} and read({"α": 0.0, "A": 0.9}) == {"α"}


def test_formulas_in_spark(spark):
    page = blank(120, 200)
    glyph_at(page, "A", 60, 30, 3)
    glyph_at(page, "B", 80, 30, 3)
    for k, c in enumerate("214"):
        glyph_at(page, c, 100 + 12 * k, 18, 2)
    frames = spark.createDataFrame(frame_rows(page), FRAME)
    atlas = reading.templates(spark.createDataFrame([(*r[:-1], bytearray(r[-1])) for r in font.atlas()], ATLAS_SCHEMA))
    rules = math_reading.FormulaRules(all_text=True)
    elements = layout.layout(frames).where("level = 'element'").selectExpr("*", "cast(null as boolean) is_text", "cast(null as boolean) fitted", "cast(null as double) residual")
    r = math_reading.formulas_of(frames, elements, atlas, rules=rules).collect()
    assert [x["tex"] for x in r] == ["A B ^ { 2 1 4 }"] and r[0]["symbols"] == 5 and r[0]["region"] == 0
    strict = math_reading.formulas_of(frames, elements, atlas)
    assert strict.count() == 0  # too few symbols for a formula
    tags = math_reading.formula_tags(math_reading.formulas_of(frames, elements, atlas, rules=rules), rules)
    assert {t["key"] for t in tags.collect()} == {"latex.region"} and tags.count() == len(r[0]["members"])


def test_tightened_boxes():
    edges = np.zeros((20, 20), bool)
    edges[4:9, 3:11] = True
    got = reading.tightened(np.array([[0, 0, 20, 20], [5, 5, 2, 2], [12, 12, 5, 5], [-3, -3, 9, 9]]), edges)
    assert got[0].tolist() == [3, 4, 8, 5] and got[1] is None and got[2] is None and got[3] is None
