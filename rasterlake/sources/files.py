"""Readers and writers of the exchange formats, all through Spark's own sources."""

from __future__ import annotations

import html
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.functions.text import escape, one_line, unescape
from rasterlake.operators.raster import planes

# The heads of the binary formats, and the record of a glyph (little-endian).
ATLAS_MAGIC, PACK_MAGIC, VERSION = b"DKSA", b"DKPK", 1
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
GLYPH = struct.Struct("<IHHhHHHH")
HOG, INK = 128, 64
ATLAS_SCHEMA = "font string, ch int, px int, top int, w int, h int, cap_h int, x_h int, ink binary"
PACK_SCHEMA = "pack string, tag_key string, k int, ex_id int, label string, log_aspect float, fill float, hog binary, ink binary"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, fields of each line: cut at tabs, carriage returns dropped; quotes are data."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.split(F.replace("value", F.lit("\r"), F.lit("")), "\t").alias("f"))


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """image, gt: paths below the folder; lines of fewer than two fields are ignored."""
    rows = read_lines(spark, f"{folder}/manifest.tsv").where("size(f) >= 2")
    at = lambda k: F.concat(F.lit(f"{folder}/"), F.element_at("f", k))
    return rows.select(at(1).alias("image"), at(2).alias("gt"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """file, x, y, w, h, label, text: lines of fewer than five fields are ignored; text may be missing (empty)."""
    rows = read_lines(spark, path).where("size(f) >= 5")
    n = lambda k: F.coalesce(F.expr(f"try_cast(f[{k}] as int)"), F.lit(0))
    return rows.select("file", n(0).alias("x"), n(1).alias("y"), n(2).alias("w"), n(3).alias("h"), unescape(F.col("f")[4]).alias("label"), F.coalesce(unescape(F.try_element_at("f", F.lit(6))), F.lit("")).alias("text"))


def write_truth(boxes: DataFrame, path: str) -> None:
    """Boxes (x, y, w, h, label, text) as read_truth() reads them."""
    boxes.select(F.concat_ws("\t", *"xywh", escape(F.col("label")), escape(F.coalesce("text", F.lit("")))).alias("value")).write.mode("overwrite").text(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.select(F.concat_ws("\t", escape(F.col("image")), escape(F.col("gt"))).alias("value")).write.mode("overwrite").text(path)


def element_lines(elements: DataFrame) -> DataFrame:
    """value: x y w h kind depth is_text confidence text, by tabs; blanks for tabs and line feeds in text."""
    return elements.select(F.concat_ws("\t", *"xywh", "kind", "depth", F.col("is_text").cast("int"), "confidence", one_line(F.coalesce("text", F.lit("")))).alias("value"))


def tagged_lines(elements: DataFrame, tags: DataFrame) -> DataFrame:
    """value: x y w h kind depth and then key=value of each tag of (frame, elem), in the order of seq."""
    pair = F.struct("seq", F.concat_ws("=", "key", one_line(F.col("value"))).alias("kv"))
    own = tags.groupBy("frame", "elem").agg(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["kv"]).alias("kv"))
    joined = elements.join(own, ["frame", "elem"], "left")
    return joined.select("frame", "elem", F.concat_ws("\t", *"xywh", "kind", "depth", F.coalesce("kv", F.array().cast("array<string>"))).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def read_prior(spark: SparkSession, path: str) -> DataFrame:
    """cp, n, penalty from lines of a code point and a count: 1 - ln(n + 1) / ln(most + 1)."""
    rows = spark.read.text(path).select(F.expr("try_cast(split(trim(value), '\\\\s+')[0] as int)").alias("cp"), F.expr("try_cast(split(trim(value), '\\\\s+')[1] as double)").alias("n"))
    rows = rows.where("cp is not null and n is not null")
    most = rows.agg(F.greatest(F.max("n"), F.lit(1.0)).alias("most"))
    return rows.join(F.broadcast(most)).select("cp", "n", (1 - F.ln(F.col("n") + 1) / F.ln(F.col("most") + 1)).alias("penalty"))


def parse_atlas(data: bytes) -> list[tuple]:
    """Rows of ATLAS_SCHEMA; a bad head, another version or a short file raise ValueError."""
    if data[:4] != ATLAS_MAGIC:
        raise ValueError("not an atlas")
    version, n_fonts = struct.unpack_from("<II", data, 4)
    if version != VERSION:
        raise ValueError("unsupported version")
    at, fonts, rows = 12, [], []
    try:
        for _ in range(n_fonts):
            (n,) = struct.unpack_from("<H", data, at)
            fonts.append(data[at + 2 : at + 2 + n].decode())
            at += 2 + n
        (n_glyphs,) = struct.unpack_from("<I", data, at)
        at += 4
        for _ in range(n_glyphs):
            ch, font, px, top, w, h, cap, xh = GLYPH.unpack_from(data, at)
            at += GLYPH.size
            if at + w * h > len(data):
                raise ValueError("truncated")
            rows.append((fonts[font], ch, px, top, w, h, cap, xh, data[at : at + w * h]))
            at += w * h
    except (struct.error, IndexError) as e:
        raise ValueError("truncated") from e
    return rows


def build_atlas(rows: list[tuple]) -> bytes:
    """The inverse of parse_atlas(); fonts in order of their first glyph."""
    fonts = list(dict.fromkeys(r[0] for r in rows))
    out = [ATLAS_MAGIC, struct.pack("<II", VERSION, len(fonts))]
    out += [struct.pack("<H", len(f.encode())) + f.encode() for f in fonts]
    out.append(struct.pack("<I", len(rows)))
    out += [GLYPH.pack(ch, fonts.index(f), px, top, w, h, cap, xh) + bytes(ink) for f, ch, px, top, w, h, cap, xh, ink in rows]
    return b"".join(out)


def parse_pack(data: bytes) -> list[tuple] | None:
    """Rows of PACK_SCHEMA, or None for a bad head, another version or a short file."""
    at = 4

    def number() -> int:
        nonlocal at
        (v,) = struct.unpack_from("<I", data, at)
        at += 4
        return v

    def string() -> str:
        nonlocal at
        n = number()
        if at + n > len(data):
            raise struct.error("short")
        at += n
        return data[at - n : at].decode()

    try:
        if data[:4] != PACK_MAGIC or number() != VERSION:
            return None
        name, key, k = string(), string(), number()
        classes = [string() for _ in range(number())]
        rows = []
        for i in range(number()):
            cls, aspect, fill = struct.unpack_from("<Hff", data, at)
            at += 10
            if at + HOG + INK > len(data):
                return None
            rows.append((name, key, k, i, classes[cls], aspect, fill, data[at : at + HOG], data[at + HOG : at + HOG + INK]))
            at += HOG + INK
        return rows
    except (struct.error, IndexError):
        return None


def build_pack(rows: list[tuple]) -> bytes:
    """The inverse of parse_pack(); classes are numbered as they first appear."""
    name, key, k = rows[0][:3]
    classes = list(dict.fromkeys(r[4] for r in rows))
    string = lambda s: struct.pack("<I", len(s.encode())) + s.encode()
    out = [PACK_MAGIC, struct.pack("<I", VERSION), string(name), string(key), struct.pack("<II", k, len(classes)), *map(string, classes), struct.pack("<I", len(rows))]
    out += [struct.pack("<Hff", classes.index(r[4]), r[5], r[6]) + bytes(r[7]) + bytes(r[8]) for r in rows]
    return b"".join(out)


def _binary(spark: SparkSession, path: str, schema: str, parse) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content").to_pylist():
                found = parse(content) or []
                names = [f.split(" ")[0] for f in schema.split(", ")]
                types = [{"string": pa.string(), "int": pa.int32(), "float": pa.float32(), "binary": pa.binary()}[f.split(" ")[1]] for f in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], names)

    return files.mapInArrow(rows, schema)


def read_atlas(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path, ATLAS_SCHEMA, parse_atlas)


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """Exemplars of every pack file below a path; files that can't be read give no rows."""
    return _binary(spark, path, PACK_SCHEMA, parse_pack)


def read_labelled(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("png", "jpg", "jpeg", "bmp", "pgm", "ppm")) -> DataFrame:
    """path, label, content of the images in a tree of folders: the folder's name is the label."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.element_at(F.split("path", r"\."), -1))
    return files.where(ext.isin(*kinds)).select("path", F.element_at(F.split("path", "/"), -2).alias("label"), "content")


LABELME = "imagePath string, shapes array<struct<label: string, points: array<array<double>>>>"


def read_labelme(spark: SparkSession, path: str, labels: list[str] | None = None) -> DataFrame:
    """image, x, y, w, h, label: the boxes around the polygons of annotation files."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", LABELME).alias("j"))
    rows = raw.select(F.coalesce("j.imagePath", F.regexp_replace("file", r"\.json$", ".png")).alias("image"), F.explode("j.shapes").alias("s"))
    low = lambda k: F.array_min(F.transform("s.points", lambda p: p[k])).cast("int")
    high = lambda k: F.array_max(F.transform("s.points", lambda p: p[k])).cast("int")
    out = rows.select("image", low(0).alias("x"), low(1).alias("y"), (high(0) - low(0)).alias("w"), (high(1) - low(1)).alias("h"), F.col("s.label").alias("label"))
    return out.where(F.col("label").isin(*labels)) if labels else out


def decode_netpbm(data: bytes) -> tuple[int, int, str, bytes]:
    """width, height, format and pixels of a binary PGM or PPM; zeros and nothing if it is neither."""
    head, at = [], 0
    while len(head) < 4 and at < len(data):
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data)
        elif data[at : at + 1].isspace():
            at += 1
        else:
            end = at
            while end < len(data) and not data[end : end + 1].isspace():
                end += 1
            head.append(data[at:end])
            at = end
    size = {b"P5": 1, b"P6": 3}.get(head[0] if head else b"")
    if not size or len(head) < 4 or head[3] != b"255":
        return 0, 0, "", b""
    w, h = int(head[1]), int(head[2])
    pixels = data[at + 1 : at + 1 + w * h * size]
    return (w, h, "Gray8" if size == 1 else "RGB24", pixels) if len(pixels) == w * h * size else (0, 0, "", b"")


def _unfiltered(raw: bytes, rows: int, stride: int, step: int) -> np.ndarray | None:
    """The bytes of PNG scanlines, each with its filter undone; None if there are too few or a filter is unknown."""
    if len(raw) < rows * (stride + 1):
        return None
    lines = np.frombuffer(raw, np.uint8, rows * (stride + 1)).reshape(rows, stride + 1)
    out = np.zeros((rows + 1, stride + step), np.uint8)  # a blank row above and a blank pixel to the left
    for k in range(rows):
        kind, line = int(lines[k, 0]), lines[k, 1:]
        above, own = out[k], out[k + 1]
        if kind == 0:
            own[step:] = line
        elif kind == 2:
            own[step:] = line + above[step:]
        elif kind == 1:
            for c in range(step):  # a running sum modulo 256, colour by colour
                own[step + c :: step] = np.cumsum(line[c::step], dtype=np.uint64).astype(np.uint8)
        elif kind in (3, 4):
            up, got = above.tolist(), [0] * (stride + step)
            for x, v in enumerate(line.tolist(), step):
                a, b, c = got[x - step], up[x], up[x - step]
                if kind == 3:
                    near = (a + b) // 2
                else:
                    p = a + b - c
                    near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                got[x] = (v + near) & 255
            own[:] = got
        else:
            return None
    return out[1:, step:]


def decode_png(data: bytes) -> tuple[int, int, str, bytes]:
    """width, height, format and pixels of a PNG of 8 bits a channel, or of a palette; zeros and nothing for any other."""
    none, at, packed, palette, head = (0, 0, "", b""), 8, [], None, None
    while at + 8 <= len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR" and n == 13:
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body[: n - n % 3], np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    if not head or head[2] != 8 or head[3] not in (0, 2, 3, 4, 6) or head[6] or not packed or head[3] == 3 and palette is None:
        return none
    w, h, _, colour = head[:4]
    step = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    try:
        rows = _unfiltered(zlib.decompress(b"".join(packed)), h, w * step, step)
    except zlib.error:
        return none
    if rows is None:
        return none
    rows = rows.reshape(h, w, step)
    if colour == 3:
        return (w, h, "RGB24", palette[np.minimum(rows[..., 0], len(palette) - 1)].tobytes()) if len(palette) else none
    if colour == 4:
        rows = rows[..., :1]
    return w, h, {0: "Gray8", 2: "RGB24", 4: "Gray8", 6: "RGBA32"}[colour], rows.tobytes()


def decode_bmp(data: bytes) -> tuple[int, int, str, bytes]:
    """width, height, format and pixels of an uncompressed BMP of 24 or 32 bits; zeros and nothing for any other."""
    if len(data) < 54:
        return 0, 0, "", b""
    start, _, w, h, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    stride, rows = (w * bits // 8 + 3) // 4 * 4, abs(h)
    if bits not in (24, 32) or packing not in (0, 3) or w <= 0 or not rows or len(data) < start + stride * rows:
        return 0, 0, "", b""
    lines = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)[:, : w * bits // 8]
    return w, rows, "BGR24" if bits == 24 else "BGRA32", (lines[::-1] if h > 0 else lines).tobytes()


def decode_image(data: bytes) -> tuple[int, int, str, bytes]:
    """An image by its first bytes: PNG, BMP, PGM or PPM; zeros and nothing for any other."""
    return decode_png(data) if data[:8] == PNG_MAGIC else decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_png(width: int, height: int, form: str, pixels: bytes) -> bytes:
    """A PNG of a frame: grey as grey, other formats as colours without transparency."""
    rows = planes(width, height, form, pixels)
    rows = rows[..., :1] if form == "Gray8" else rows
    lines = np.zeros((height, 1 + width * rows.shape[2]), np.uint8)
    lines[:, 1:] = rows.reshape(height, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if form == "Gray8" else 2, 0, 0, 0)
    return PNG_MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def encoded(frames: DataFrame) -> DataFrame:
    """frames with a column png; frames without pixels have null."""

    @F.arrow_udf("binary")
    def run(w: pa.Array, h: pa.Array, form: pa.Array, pixels: pa.Array) -> pa.Array:
        return pa.array([encode_png(*r) if r[0] and r[1] else None for r in zip(*(c.to_pylist() for c in (w, h, form, pixels)))], pa.binary())

    return frames.withColumn("png", run("width", "height", "format", "pixels"))


def report(rows: DataFrame, path: str, title: str, most: int = 1000) -> None:
    """An HTML page with a table of at most `most` rows, as they are ordered; a report is for reading, so it is bounded."""
    cell = lambda v: html.escape("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v))
    line = lambda values, tag: "<tr>" + "".join(f"<{tag}>{cell(v)}</{tag}>" for v in values) + "</tr>"
    body = "".join(line(r, "td") for r in rows.limit(most).collect())
    page = f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table>{line(rows.columns, 'th')}{body}</table>"
    rows.sparkSession.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, format, pixels of the images below a path; unreadable ones are empty frames."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.select("path", decoded(F.col("content")).alias("d")).select("path", "d.*")


def decoded(content):
    @F.arrow_udf("struct<width: int, height: int, format: string, pixels: binary>")
    def run(contents: pa.Array) -> pa.Array:
        rows = [decode_image(c or b"") for c in contents.to_pylist()]
        types = (pa.int32(), pa.int32(), pa.string(), pa.binary())
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["width", "height", "format", "pixels"])

    return run(content)


def synthetic_tokens(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """id, text, fg, bg: seeded words, numbers, sums, dates and mails, with brightnesses that differ by more than 90."""
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 30))
    letters = F.lit("etaoinshrdlucmfwypvbgk")
    word = F.concat(*[F.substring(letters, (h(k) % 22 + 1).cast("int"), F.lit(1)) for k in range(6)])
    digits = h(10).cast("string")
    text = (
        F.when(h(20) % 5 == 0, F.initcap(word)).when(h(20) % 5 == 1, digits)
        .when(h(20) % 5 == 2, F.concat(F.lit("$"), (h(11) % 1000).cast("string"), F.lit("."), F.lpad((h(12) % 100).cast("string"), 2, "0")))
        .when(h(20) % 5 == 3, F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (h(13) % 1500).cast("int")), "yyyy-MM-dd"))
        .otherwise(F.concat(word, F.lit("@mail.example")))
    )
    bg = (h(30) % 256).cast("int")
    fg = F.when(bg > 127, (h(31) % F.greatest(bg - 90, F.lit(1))).cast("int")).otherwise((bg + 91 + h(31) % (165 - bg)).cast("int"))
    return spark.range(n).select("id", text.alias("text"), fg.alias("fg"), bg.alias("bg"))
