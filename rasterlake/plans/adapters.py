"""How the driver's tables stand in for frames: the same formulas in Spark and in DuckDB SQL, integers throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.operators.boxes import numbered

#: Orders in one frame: frames stay as small at any scale.
ORDERS_PER_FRAME = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def true_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, id, x, y, w, h: a box for each line item."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    rows = table(spark, sf_dir, "lineitem").select(*key, F.expr(f"l_orderkey div {ORDERS_PER_FRAME}").alias("frame"), F.col("l_quantity").cast("long").alias("q"))
    return numbered(rows, key).select(
        "frame", "id", F.expr("cast(l_partkey * 37 % 1700 as int)").alias("x"), F.expr("cast((l_partkey * 11 + l_suppkey * 53) % 950 as int)").alias("y"),
        F.expr("cast(8 + q * q % 400 as int)").alias("w"), F.expr("cast(6 + (q * 7 + l_linenumber * 13) % 120 as int)").alias("h"), F.expr("cast(l_partkey % 5 as int)").alias("jitter"),
    )


def found_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same boxes, moved by 0 to 4 and 0 to 8 pixels, without every eleventh."""
    return true_boxes(spark, sf_dir).where("id % 11 <> 7").select("frame", "id", F.expr("x + jitter").alias("x"), F.expr("y + 2 * jitter").alias("y"), "w", "h")


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat boxes on rows, as words of text are."""
    return true_boxes(spark, sf_dir).select("frame", "id", "x", F.expr("y div 24 * 24 + jitter").alias("y"), F.expr("10 + w % 60").alias("w"), F.expr("12 + h % 6").alias("h"))


TRUE_BOXES_SQL = f"""
tb AS (
  SELECT l_orderkey // {ORDERS_PER_FRAME} AS frame,
    (row_number() OVER (PARTITION BY l_orderkey // {ORDERS_PER_FRAME} ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1)::INT AS id,
    (l_partkey * 37 % 1700)::INT AS x, ((l_partkey * 11 + l_suppkey * 53) % 950)::INT AS y,
    (8 + l_quantity::BIGINT * l_quantity::BIGINT % 400)::INT AS w, (6 + (l_quantity::BIGINT * 7 + l_linenumber * 13) % 120)::INT AS h,
    (l_partkey % 5)::INT AS jitter
  FROM lineitem)"""
FOUND_BOXES_SQL = "fb AS (SELECT frame, id, x + jitter AS x, y + 2 * jitter AS y, w, h FROM tb WHERE id % 11 <> 7)"
TEXT_LINES_SQL = "tl AS (SELECT frame, id, x, y // 24 * 24 + jitter AS y, 10 + w % 60 AS w, 12 + h % 6 AS h FROM tb)"


def bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, v: each embedding as 64 grey values, an 8 by 8 image by rows."""
    grey = F.transform("embedding", lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + F.lit(0.55)) * F.lit(232.0)).cast("int"))))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", grey.alias("v"))


BITMAPS_SQL = """
bm AS (
  SELECT vec_id, label, list_transform(embedding, lambda e: least(255, greatest(0, floor((e::DOUBLE + 0.55::DOUBLE) * 232.0::DOUBLE)::INT))) AS v
  FROM embeddings)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, x, y, v: the pixels of the images."""
    return bitmaps(spark, sf_dir).select(F.col("vec_id").alias("frame"), F.posexplode("v").alias("i", "v")).select("frame", F.expr("i % 8").alias("x"), F.expr("i div 8").cast("int").alias("y"), "v")


PIXELS_SQL = BITMAPS_SQL + """,
px AS (SELECT vec_id AS frame, ((i - 1) % 8)::INT AS x, ((i - 1) // 8)::INT AS y, v[i] AS v FROM (SELECT vec_id, v, unnest(generate_series(1, 64)) AS i FROM bm))"""
