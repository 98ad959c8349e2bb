"""Boxes, graphs, pixels, texts, packs, files, stages and streams on small inputs."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.functions import text
from rasterlake.functions.geometry import Box, effective_kind, truth_group
from rasterlake.operators import boxes as B
from rasterlake.operators import knn, packs, raster, scores
from rasterlake.operators.graph import frame_components
from rasterlake.plans.stages import Pipeline
from rasterlake.sources import files
from rasterlake.streaming import frames

BOXES = "frame long, id int, x int, y int, w int, h int"


def boxes(spark, rows):
    return spark.createDataFrame([(0, i, *r) for i, r in enumerate(rows)], BOXES)


def mask(spark, *rows, frame=0):
    return spark.createDataFrame([(frame, x, y, int(c == "#")) for y, r in enumerate(rows) for x, c in enumerate(r)], "frame long, x int, y int, v int")


def labelled(spark, m, connectivity):
    return raster.labelled_runs(raster.runs(m).where("v = 1"), connectivity)


def test_rectangles(spark):
    a, b, one = Box(*map(F.lit, (2, 3, 12, 8))), Box(*map(F.lit, (8, 7, 9, 10))), spark.range(1)
    far, big, small = Box(*map(F.lit, (40, 1, 6, 30))), Box(*map(F.lit, (-5, -5, 70, 60))), Box(*map(F.lit, (61, 50, 4, 5)))
    none = Box(*map(F.lit, (7, 7, 0, 3)))
    r = one.select(
        a.shared_area(b).alias("s"), a.iou(b).alias("i"), a.contains(b).alias("c"), big.contains(small).alias("d"), F.struct(*a.intersect(far).columns()).alias("e"),
        a.x_overlap(far).alias("g"), F.struct(*a.unite(none).columns()).alias("u"), F.struct(*none.unite(a).columns()).alias("v"), a.contains_point(F.lit(14), F.lit(3)).alias("p"),
    ).first()
    assert (r["s"], r["c"], r["d"], tuple(r["e"]), r["g"]) == (24, False, True, (0, 0, 0, 0), -26)
    assert r["i"] == pytest.approx(24 / 162) and tuple(r["u"]) == tuple(r["v"]) == (2, 3, 12, 8) and not r["p"]
    kinds = spark.createDataFrame([("Text", False), ("Text", True), ("Icon", True), ("Image", False)], "k string, t boolean").select(effective_kind(F.col("k"), F.col("t")).alias("k"))
    assert [x["k"] for x in kinds.collect()] == [None, "Text", "Text", "Image"]
    labels = spark.createDataFrame([("Text",), ("WebIcon",), ("generic",), ("Slider",)], "l string")
    assert [tuple(r) for r in labels.select(truth_group(F.col("l")), truth_group(F.col("l"), True)).collect()] == [("Text", "Text"), ("Icon", "Icon"), ("Container", ""), ("Container", "Container")]


def test_components_of_masks(spark):
    steps = mask(spark, "...##", "..#..", "##...", "....#")
    assert labelled(spark, steps, 8).agg(F.max("comp")).first()[0] == 1
    assert labelled(spark, steps, 4).agg(F.max("comp")).first()[0] == 3
    hook = raster.components(labelled(spark, mask(spark, "......", ".###..", ".#.#..", "...###"), 4)).collect()
    assert [tuple(r)[2:] for r in hook] == [(1, 1, 5, 3, 8)]
    rng = np.random.default_rng(0)
    for connectivity in (4, 8):
        m = rng.random((9, 12)) < 0.5
        got = labelled(spark, mask(spark, *("".join(".#"[int(v)] for v in r) for r in m)), connectivity).collect()
        image = -np.ones(m.shape, int)
        for r in got:
            image[r["y"], r["x0"] : r["x1"]] = r["comp"]
        seen, n = -np.ones(m.shape, int), 0
        for y, x in zip(*np.nonzero(m)):
            if seen[y, x] < 0:
                stack = [(y, x)]
                while stack:
                    a, b = stack.pop()
                    if 0 <= a < 9 and 0 <= b < 12 and m[a, b] and seen[a, b] < 0:
                        seen[a, b] = n
                        stack += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if connectivity == 8 or abs(i) + abs(j) == 1]
                n += 1
        assert (image == seen).all()


# pieces less holes: a frame, three windows, two bars and a dot, a chain that only touches at corners, a frame with a dot in it
@pytest.mark.parametrize(
    "rows,euler",
    [(("#####", "#...#", "#####"), 0), (("#######", "#.#.#.#", "#######"), -2), (("##.##", ".....", "..#.."), 3), (("#.#", ".#.", "#.#"), 1), (("#####", "#...#", "#.#.#", "#...#", "#####"), 1)],
)
def test_euler_numbers(spark, rows, euler):
    assert raster.euler_number(mask(spark, *rows)).first()["euler"] == euler


def test_forest_and_ties(spark):
    got = {r["id"]: (r["parent"], r["depth"]) for r in B.forest(boxes(spark, [(30, 30, 4, 4), (300, 5, 8, 8), (0, 0, 200, 90), (20, 20, 60, 60), (25, 25, 20, 30), (100, 10, 50, 50)])).collect()}
    assert got == {0: (4, 3), 1: (-1, 0), 2: (-1, 0), 3: (2, 1), 4: (3, 2), 5: (2, 1)}
    same = {r["id"]: r["parent"] for r in B.forest(boxes(spark, [(0, 0, 9, 9)] * 3)).collect()}
    assert same == {0: -1, 1: 0, 2: 1}


def test_greedy_matches_and_scores(spark):
    gt, pred = boxes(spark, [(0, 0, 10, 10), (20, 0, 10, 10), (50, 0, 8, 8)]), boxes(spark, [(1, 0, 10, 10), (0, 1, 10, 10), (20, 0, 10, 10), (90, 9, 3, 3)])
    pairs = B.overlapping(gt, pred)
    assert sorted((r["gid"], r["pid"]) for r in B.matches(pairs, 1, 2).collect()) == [(0, 0), (1, 2)]
    s = B.detection_score(gt, pred).first()
    assert (s["n_gt"], s["n_pred"], s["tp50"], s["tp75"]) == (3, 4, 2, 2) and s["f1_50"] == pytest.approx(4 / 7)
    g = B.grouping_counts(gt, pred).first()
    assert (g["one_to_one"], g["split"], g["miss"], g["merge"]) == (1, 1, 1, 0)
    empty = boxes(spark, [(0, 0, 1, 1)]).where("id > 0")
    assert B.detection_score(empty, empty).first()["f1_50"] == 0
    d = B.depth_score(gt, pred).first()
    assert (d["matched"], d["same_depth"], d["parent_ok"]) == (2, 2, 2)
    assert [r["id"] for r in B.deduped_greedily(boxes(spark, [(0, 0, 10, 10), (0, 0, 10, 10), (30, 0, 5, 5)])).orderBy("id").collect()] == [0, 2]


def test_frame_components_without_links(spark):
    nodes = spark.createDataFrame([(0, 1), (0, 2), (1, 5)], "frame long, id int")
    links = spark.createDataFrame([(0, 2, 1)], "frame long, u int, v int")
    assert sorted(map(tuple, frame_components(nodes, links).collect())) == [(0, 1, 1), (0, 2, 1), (1, 5, 5)]


def test_pixels(spark):
    frame = bytes([200, 100, 50, 255] * 2 + [0, 0, 0, 0] * 2)
    f = spark.createDataFrame([(7, 2, 2, "RGBA32", bytearray(frame)), (8, 2, 1, "Gray8", bytearray([9, 250]))], "frame long, width int, height int, format string, pixels binary")
    got = {(r["frame"], r["y"]): r["v"] for r in raster.scanlines(f).collect()}
    assert got == {(7, 0): [124, 124], (7, 1): [0, 0], (8, 0): [9, 250]}
    rows = spark.createDataFrame([(0, 0, [10, 10, 90]), (0, 1, [10, 40, 90])], "frame long, y int, v array<int>")
    edges = {r["y"]: r["v"] for r in raster.edge_strength(rows).collect()}
    assert edges == {0: [0, 80, 80], 1: [30, 50, 50]}
    assert [r["v"] for r in raster.above(raster.edge_strength(rows), 50).orderBy("y").collect()] == [[0, 1, 1], [0, 0, 0]]
    blended = raster.inpainted(spark.createDataFrame([(0, 0, [0, 9, 9, 9, 80])], "frame long, y int, v array<int>"), 1, 0, 3, 1).first()["v"]
    assert blended == [0, 20, 40, 60, 80]
    one = spark.createDataFrame([(0, 5, 9)], "frame long, v int, n long")
    assert raster.otsu(one).first()["threshold"] == 127
    values = spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "v int")
    assert values.agg(raster.upper_median(F.col("v"))).first()[0] == 3


def test_texts(spark):
    s = scores.text_score(spark.createDataFrame([("Menu Bar", "menu bar"), ("saddle", "paddles"), ("same", "same")], "gt string, pred string")).first()
    assert (s["edits"], s["edits_ci"], s["exact"], s["exact_ci"], s["chars"]) == (4, 2, 1, 2, 18)
    t = spark.createDataFrame([("ÀÞ×ßA\\t\t\n\\", "»’ı")], "a string, b string")
    r = t.select(text.fold_case(F.col("a")).alias("f"), (text.unescape(text.escape(F.col("a"))) == F.col("a")).alias("u"), text.ascii_marks(F.col("b")).alias("m")).first()
    assert r["f"].startswith("àþ×ßa") and r["u"] and r["m"] == ">'i"
    assert [text.harmonized(w) for w in ("1O5l", "he1lO", "5TART5", "Cat", "20S4", "HELl0", "", "Word5")] == ["1051", "hello", "5TART5", "Cat", "2054", "HELIO", "", "Words"]


@pytest.mark.parametrize("local", [True, False])
def test_templates_within_bounds(spark, monkeypatch, local):
    monkeypatch.setattr(knn, "LOCAL_BLOCK", 8)
    if not local:  # as for an atlas that is too large to be broadcast
        monkeypatch.setattr(knn, "LOCAL", 10)
        monkeypatch.setattr(knn, "BLOCK", 8)
    rng = np.random.default_rng(5)
    rows = [(i, i % 4, rng.integers(0, 255, 64).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label long, v array<int>")
    got = knn.nearest_labels(df.where("id < 8").select("id", "v"), df.where("id >= 8"), 3, 10_000).collect()
    for q in range(8):
        best = {}
        for i, label, v in rows[8:]:
            d = int(np.abs(np.array(v) - np.array(rows[q][2])).sum())
            best[label] = min(best.get(label, (1 << 30, 0)), (d, i))
        want = sorted((d, i, n) for n, (d, i) in best.items())[:3]
        assert [(r["dist"], r["tmpl"], r["label"]) for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rk"])] == want
    bounds = df.alias("a").join(df.alias("b"), F.expr("a.id = b.id + 1")).select(knn.l1_distance(F.col("a.v"), F.col("b.v")).alias("d"), knn.coarse_bound(F.col("a.v"), F.col("b.v")).alias("c"))
    assert all(r["c"] <= r["d"] for r in bounds.collect())


def test_packs_in_order(spark):
    elements = spark.createDataFrame([(0, 1, "Icon", 20, 20), (0, 2, "Icon", 4, 20), (0, 3, "Text", 20, 20)], "frame long, elem long, kind string, w int, h int")
    none = spark.createDataFrame([], packs.TAG_SCHEMA)
    say = lambda v, s: lambda e: e.select("frame", "elem", F.lit(v).alias("value"), F.lit(s).alias("score"))
    reg = packs.Registry().add(packs.Pack("state", "widget.state", say("on", 0.9), packs.Scope(needs="widget", values=("box",)))).add(packs.Pack("widget", "widget", say("box", 0.8), packs.Scope(kinds=("Icon",))))
    assert packs.detect(elements, none, reg).select("elem", "key").collect() == [(1, "widget")]
    first = reg.packs["state"]
    assert reg.remove("state") and not reg.remove("state")
    reg.add(first)
    assert sorted(map(tuple, packs.detect(elements, none, reg).select("elem", "key", "value").collect())) == [(1, "widget", "box"), (1, "widget.state", "on")]
    reg.add(packs.Pack("widget", "widget", say("box", 0.4)))
    assert packs.detect(elements, none, reg).count() == 0
    tags = spark.createDataFrame([(0, 1, "k", "a", 0.5, "s", 1), (0, 1, "k", "b", 0.5, "s", 2), (0, 1, "k", "c", 0.1, "s", 0)], packs.TAG_SCHEMA)
    assert packs.best_tag(tags).first()["value"] == "a"


def test_stage_order_and_switches(spark):
    df = spark.range(3)
    p = Pipeline().add("a", lambda t: {"x": df}).add("c", lambda t: {"z": t["x"]}).add("b", lambda t: {"y": t["x"]}, before="c")
    assert p.names == ["a", "b", "c"]
    start = {"s": df}
    assert set(p.run(start)) == {"s", "x", "y", "z"} and set(start) == {"s"} and set(p.timings) == {"a", "b", "c"}
    p.enable("b", False)
    assert set(p.run({})) == {"x", "z"}
    p.add("a", lambda t: {"x": df})
    assert p.names == ["b", "c", "a"] and p.remove("c") and not p.remove("c")


def test_files_round_trip(spark, tmp_path):
    rows = [("Sans", 65, 12, -3, 2, 3, 9, 5, bytes(range(6))), ("Serif", 0x3B1, 10, 0, 1, 1, 7, 4, b"\x07"), ("Sans", 66, 12, 1, 0, 0, 9, 5, b"")]
    (tmp_path / "a.bin").write_bytes(files.build_atlas(rows))
    assert [tuple(r) for r in files.read_atlas(spark, str(tmp_path / "a.bin")).collect()] == [(*r[:-1], bytearray(r[-1])) for r in rows]
    with pytest.raises(ValueError):
        files.parse_atlas(files.build_atlas(rows)[:-1] if rows[-1][-1] else files.build_atlas(rows)[:20])
    own = [("p", "widget", 5, i, "ab"[i % 2], 0.5, 0.25, bytes([i]) * 128, bytes([i]) * 64) for i in range(3)]
    data = files.build_pack(own)
    (tmp_path / "packs").mkdir()
    (tmp_path / "packs" / "one").write_bytes(data)
    (tmp_path / "packs" / "bad").write_bytes(data[:-1])
    assert sorted(r["ex_id"] for r in files.read_packs(spark, str(tmp_path / "packs")).collect()) == [0, 1, 2]
    assert files.parse_pack(data) == own and files.parse_pack(b"none") is None and files.parse_pack(data[:9]) is None
    truth = spark.createDataFrame([(1, 2, 3, 4, "Word", 'a\tb\n"q"\\n'), (5, 6, 7, 8, "Line", "")], "x int, y int, w int, h int, label string, text string")
    files.write_truth(truth, str(tmp_path / "gt"))
    assert sorted(map(tuple, files.read_truth(spark, str(tmp_path / "gt")).drop("file").collect())) == sorted(map(tuple, truth.collect()))
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "manifest.tsv").write_text("a.png\ta.gt.tsv\r\nalone\n")
    assert [r["gt"] for r in files.read_manifest(spark, str(tmp_path / "m")).collect()] == [f"{tmp_path}/m/a.gt.tsv"]
    (tmp_path / "prior").write_text("97 3\n98 1\nx y\n")
    assert {r["cp"]: round(r["penalty"], 6) for r in files.read_prior(spark, str(tmp_path / "prior")).collect()} == {97: 0.0, 98: 0.5}
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text(json.dumps({"imagePath": "a.png", "shapes": [{"label": "b", "points": [[3.5, 9], [1, 20]]}, {"label": "c", "points": [[0, 0]]}]}))
    assert [tuple(r) for r in files.read_labelme(spark, str(tmp_path / "j"), ["b"]).collect()] == [("a.png", 1, 9, 2, 11, "b")]
    (tmp_path / "l" / "cat").mkdir(parents=True)
    (tmp_path / "l" / "cat" / "x.ppm").write_bytes(b"P6 #c\n2 1\n255\n" + bytes(range(6)))
    (tmp_path / "l" / "cat" / "y.txt").write_bytes(b"text")
    assert [r["label"] for r in files.read_labelled(spark, str(tmp_path / "l")).collect()] == ["cat"]
    shots = {r["path"].rpartition("/")[2]: (r["width"], r["height"], r["format"]) for r in files.read_frames(spark, str(tmp_path / "l")).collect()}
    assert shots == {"x.ppm": (2, 1, "RGB24"), "y.txt": (0, 0, "")}
    assert files.decode_netpbm(b"P5 1 1 255\n") == (0, 0, "", b"") and struct.calcsize("<H") == 2
    el = spark.createDataFrame([(0, 1, 1, 2, 3, 4, "Text", 0, True, 0.5, "a\tb")], "frame long, elem long, x int, y int, w int, h int, kind string, depth int, is_text boolean, confidence double, text string")
    assert files.element_lines(el).first()["value"] == "1\t2\t3\t4\tText\t0\t1\t0.5\ta b"
    tags = spark.createDataFrame([(0, 1, "k2", "v", 1.0, "s", 2), (0, 1, "k1", "v\n", 1.0, "s", 1)], packs.TAG_SCHEMA)
    assert files.tagged_lines(el, tags).first()["value"] == "1\t2\t3\t4\tText\t0\tk1=v \tk2=v"
    made = files.synthetic_tokens(spark, 50)
    assert made.where("abs(fg - bg) <= 90 or fg < 0 or fg > 255").count() == 0 and made.collect() == files.synthetic_tokens(spark, 50).collect()


def test_streams_equal_batches(spark, tmp_path):
    crops = spark.createDataFrame([(i, bytearray([i % 3]), f"2024-01-01 00:0{i}:00") for i in range(9)], "id long, pixels binary, ts string").withColumn("ts", F.to_timestamp("ts"))
    crops.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = frames.stream_table(spark, str(tmp_path / "in"), "id long, pixels binary, ts timestamp")
    got = frames.run_to_end(frames.new_crops(stream), "crops", str(tmp_path / "c1"))
    assert {bytes(r["pixels"]) for r in got.collect()} == {b"\x00", b"\x01", b"\x02"} and got.count() == 3
    read = frames.read_distinct(crops, lambda c: c.withColumn("text", F.hex("pixels")))
    assert read.count() == 9 and all(r["text"] == bytes(r["pixels"]).hex() for r in read.collect())
    counts = frames.run_to_end(frames.changed_counts(stream.select("ts", F.hex("pixels").alias("key"))), "counts", str(tmp_path / "c2"), "complete")
    assert counts.agg(F.sum("n")).first()[0] == 9


def test_images_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    rgb, grey = rng.integers(0, 256, (5, 7, 3), np.uint8), rng.integers(0, 256, (4, 3), np.uint8)
    assert files.decode_image(files.encode_png(7, 5, "RGB24", rgb.tobytes())) == (7, 5, "RGB24", rgb.tobytes())
    assert files.decode_image(files.encode_png(7, 5, "BGR24", rgb[..., ::-1].tobytes())) == (7, 5, "RGB24", rgb.tobytes())
    assert files.decode_image(files.encode_png(3, 4, "Gray8", grey.tobytes())) == (3, 4, "Gray8", grey.tobytes())

    def png(w, h, colour, lines, extra=b""):
        chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
        return files.PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")

    # every filter, against what the format says of it byte by byte
    raw = rng.integers(0, 256, (5, 7 * 4)).tolist()
    for kind in range(5):
        lines, above = b"", [0] * 28
        for row in raw:
            left = lambda x: row[x - 4] if x >= 4 else 0  # noqa: E731, B023
            corner = lambda x: above[x - 4] if x >= 4 else 0  # noqa: E731, B023

            def paeth(a, b, c):
                p = a + b - c
                return a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c

            guess = [(0, left(x), above[x], (left(x) + above[x]) // 2, paeth(left(x), above[x], corner(x)))[kind] for x in range(28)]
            lines += bytes([kind, *((v - g) & 255 for v, g in zip(row, guess))])
            above = row
        assert files.decode_png(png(7, 5, 6, lines)) == (7, 5, "RGBA32", bytes(sum(raw, [])))
    palette = struct.pack(">I", 6) + b"PLTE" + bytes([1, 2, 3, 4, 5, 6]) + b"0000"
    assert files.decode_png(png(2, 1, 3, bytes([0, 1, 0]), palette)) == (2, 1, "RGB24", bytes([4, 5, 6, 1, 2, 3]))
    for bad in (b"", files.PNG_MAGIC, png(7, 5, 6, b"short"), png(7, 5, 6, bytes([9]) * 145), png(2, 1, 3, bytes([0, 1, 0])), b"BM" + bytes(60)):
        assert files.decode_image(bad) == (0, 0, "", b"")
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 0, 0, 54, 40, 3, 2, 1, 24, 0, 0, 0, 0, 0, 0) + bytes(range(9)) + b"000" + bytes(range(9, 18)) + b"000"
    assert files.decode_image(bmp) == (3, 2, "BGR24", bytes([*range(9, 18), *range(9)]))
    df = spark.createDataFrame([(1, 7, 5, "RGB24", bytearray(rgb.tobytes())), (2, 0, 0, "", bytearray())], "frame long, width int, height int, format string, pixels binary")
    out = {r["frame"]: r["png"] for r in files.encoded(df).collect()}
    assert out[2] is None and files.decode_png(bytes(out[1]))[3] == rgb.tobytes()
    files.report(df.select("frame", "width"), str(tmp_path / "report"), "A <title>", 1)
    page = spark.read.text(str(tmp_path / "report")).first()["value"]
    assert "A &lt;title&gt;" in page and page.count("<tr>") == 2


def test_broken_utf8():
    # a stray continuation byte and a bad lead are marks, a tail that is cut off is one and the end
    for data, want in ((b"a\xc3\xa9\xe6\xbc\xa2\xf0\x9f\x98\x80", "aé漢😀"), (b"\x80b\xffc", "\ufffdb\ufffdc"), (b"ok\xe6\xbc", "ok\ufffd"), (b"", "")):
        assert text.decoded_utf8(data) == want
    assert text.decoded_utf8("ümlaut €".encode()) == "ümlaut €"


def test_two_levels_of_means():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 5))
    own = knn.means(x, 7)
    assert (own == knn.means(x, 7)).all() and set(own) <= set(range(7))
    centres = np.stack([x[own == j].mean(0) for j in sorted(set(own))])
    wrong = sum(((x[i] - centres) ** 2).sum(1).argmin() != sorted(set(own)).index(own[i]) for i in range(400))
    assert wrong < 60  # nearly settled after a few rounds
    leaves = knn.leaves(x, 15)
    sizes = np.bincount(leaves)
    assert len(leaves) == 400 and sizes.min() >= 1 and 15 <= len(sizes) <= 60
    assert knn.leaves(x[:0], 15).tolist() == [] and knn.leaves(x[:3], 15).tolist() == [0, 0, 0]
