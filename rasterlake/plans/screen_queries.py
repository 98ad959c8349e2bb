"""Queries over frames with text on them: layout, and reading."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from rasterlake.operators import layout, math_reading, reading
from rasterlake.operators.cut import cut  # noqa: F401 - the benchmark takes it from here
from rasterlake.plans import font
from rasterlake.plans.adapters import bitmaps, table
from rasterlake.sources.files import ATLAS_SCHEMA

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


#: Dots are squares of so many pixels.
SCALE = 3
#: Frames that are painted at once: about 100 KB each.
FRAMES_AT_ONCE = 32


def word_lines(spark, d):
    """Two lines of text for each part, its name and its type.

    Lines are small and their frames are large: however few splits the lines come in, they are dealt over all tasks first.
    """
    lines = table(spark, d, "part").select(F.col("p_partkey").alias("frame"), F.upper("p_name").alias("one"), F.upper("p_type").alias("two"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, 2 * lines.rdd.getNumPartitions())
    return lines.repartition(tasks, "frame")


def word_page(one, two):
    return font.page([one, two], SCALE)


def word_frames(spark, d):
    """A frame for each part: its name and its type, a line each, in dark dots on a light ground."""

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, FRAMES_AT_ONCE) for whole in batches for k in range(0, whole.num_rows, FRAMES_AT_ONCE)):
            pages = [word_page(r["one"], r["two"]) for r in b.to_pylist()]
            sizes = [pa.array([p.shape[k] for p in pages], pa.int32()) for k in (1, 0)]
            yield pa.RecordBatch.from_arrays([b.column("frame"), *sizes, pa.array(["RGB24"] * len(pages)), pa.array([p.tobytes() for p in pages], pa.binary())], ["frame", "width", "height", "format", "pixels"])

    return word_lines(spark, d).mapInArrow(paint, "frame long, width int, height int, format string, pixels binary")


def dots_atlas(spark):
    return reading.templates(spark.createDataFrame([(*r[:-1], bytearray(r[-1])) for r in font.atlas()], ATLAS_SCHEMA))


# where lines lie: a glyph has six dots, a blank three, the last dot of a line stays blank; edges widen boxes by a pixel
_LINES = f"""
ln AS (
  SELECT p_partkey AS frame, k, t, {SCALE} * list_sum(list_transform(string_split(t, ''), lambda c: CASE WHEN c = ' ' THEN 3 ELSE 6 END))::INT AS px
  FROM (SELECT p_partkey, 1 AS k, upper(p_name) AS t FROM part UNION ALL SELECT p_partkey, 2, upper(p_type) FROM part))"""


@query(f"""WITH {_LINES}
SELECT frame, 0::BIGINT AS elem, 'Container' AS kind, 0 AS x, 0 AS y, max(px) + {8 * SCALE} AS w, {8 * 7 * SCALE} AS h, -1 AS parent, 0 AS depth FROM ln GROUP BY frame
UNION ALL SELECT frame, k, 'Text', {4 * SCALE} - 1, {7 * SCALE} - 1 + (k - 1) * {3 * 7 * SCALE}, px - {SCALE} + 2, {7 * SCALE} + 2, 0, 1 FROM ln""")
def layout_elements(spark, d):
    """Elements of frames with two lines of text: the ground is a container, and each line a text in it."""
    found = layout.layout(word_frames(spark, d))
    return found.where("level = 'element'").select("frame", "elem", "kind", "x", "y", "w", "h", "parent", "depth")


@query(f"""WITH {_LINES} SELECT frame, level, count(*) AS n, min(x) AS x, sum(w)::BIGINT AS w FROM (
  SELECT frame, 'block' AS level, {4 * SCALE} - 1 AS x, px - {SCALE} + 2 AS w FROM ln
  UNION ALL SELECT frame, 'word', {4 * SCALE} - 1, px - {SCALE} + 2 FROM ln) GROUP BY frame, level""")
def layout_words(spark, d):
    """Words and paragraphs of the same frames, painted where they are laid out; blanks of this font are narrower than the gap between words."""
    found = layout.layout(word_lines(spark, d), levels=("word", "block"), schema="frame long, level string, x int, w int", paint=word_page)
    return found.groupBy("frame", "level").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x"), F.sum("w").alias("w"))


@query(f"""WITH {_LINES} SELECT frame, k::BIGINT AS elem, t AS text, true AS is_text, length(replace(t, ' ', ''))::INT AS n_glyphs FROM ln
UNION ALL SELECT frame, 0, '', false, NULL FROM ln GROUP BY frame""")
def screen_text(spark, d):
    """What is read on frames of text: the text that was drawn. Containers aren't read."""
    read = reading.read_frames(word_frames(spark, d), dots_atlas(spark))
    return read.select("frame", "elem", "text", "is_text", "n_glyphs")


@query()
def ink_modes(spark, d):
    """Threshold, polarity and levels of images with shadows, with trimmed margins, and with local thresholds."""
    rows = bitmaps(spark, d).select(F.col("vec_id").alias("frame"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        modes = {"shadow": reading.InkRules(), "plain": reading.InkRules(shadows=False), "trim": reading.InkRules(shadows=False, trim=True), "local": reading.InkRules(shadows=False, local=True)}
        for b in batches:
            out = []
            for frame, v in zip(b.column("frame").to_pylist(), b.column("v").to_pylist()):
                for name, rules in modes.items():
                    ink = reading.extract_ink(np.array(v).reshape(8, 8), rules)
                    out.append({"frame": frame, "mode": name, "threshold": ink.threshold, "dark": bool(ink.dark), "ground": ink.ground, "level": ink.level, "pixels": int(ink.mask.sum())})
            yield reading._batch(out, "frame long, mode string, threshold int, dark boolean, ground int, level int, pixels int")

    return rows.mapInArrow(run, "frame long, mode string, threshold int, dark boolean, ground int, level int, pixels int")


@query()
def screen_formulas(spark, d):
    """Formula regions of the same frames, every text taken for one: regions, symbols and LaTeX."""
    return math_reading.formulas_in(word_frames(spark, d), dots_atlas(spark), rules=math_reading.FormulaRules(all_text=True))
