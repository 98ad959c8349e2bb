"""The stages of a screen: cursor, layout, text, packs and formulas, as functions from tables to tables for a Pipeline.

Tables: frames (frame, width, height, format, pixels), then elements, reads, tags, regions and exclusions. A stage that
finds no elements yet does nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.operators import knn, layout, math_reading, packs, reading, shapes
from rasterlake.operators.cut import cut
from rasterlake.plans.stages import Pipeline, Stage, Tables


def _with_tags(tables: Tables, more: DataFrame) -> Tables:
    return {"tags": tables["tags"].unionByName(more) if "tags" in tables else more}


def cursor_stage(cursors: Callable[[Tables], DataFrame]) -> Stage:
    """Paint over each frame's cursor; cursors() gives frame, x, y, w, h (one row a frame at most), kept as exclusions."""

    def stage(tables: Tables) -> Tables:
        spots = cursors(tables)
        return {"frames": layout.inpainted(tables["frames"], spots), "exclusions": spots}

    return stage


def layout_stage(rules: layout.LayoutRules = layout.LayoutRules()) -> Stage:
    def stage(tables: Tables) -> Tables:
        found = cut(layout.layout(tables["frames"], rules))
        return {"elements": found, **_with_tags(tables, layout.kind_tags(found))}

    return stage


def text_stage(atlas: DataFrame, rules: reading.ReadRules = reading.ReadRules(), verify: reading.VerifyRules = reading.VerifyRules()) -> Stage:
    def stage(tables: Tables) -> Tables:
        if "elements" not in tables:
            return {}
        read = cut(reading.read_screen(tables["frames"], tables["elements"], atlas, rules, verify))
        return {"reads": read, **_with_tags(tables, reading.text_tags(read))}

    return stage


def with_crops(frames: DataFrame, elements: DataFrame, around: int = 2) -> DataFrame:
    """Elements with their crops, widened by a margin, and the shape rows of them: crop, width, v and s."""
    own = elements.where("level = 'element'")
    every = reading.VerifyRules(tallest=1 << 30, kinds=("Text", "Icon", "Image", "Container"), around=around)
    crops = reading.box_crops(frames, elements, every).select("crop.*", F.col("v").alias("pixels"), "width")
    shaped = crops.select((F.col("frame") * packs.MOST_ELEMENTS + F.col("elem")).alias("id"), "frame", "elem", "pixels", F.col("width").alias("across"), shapes.shape_of(F.col("pixels"), F.col("width")).alias("f"))
    rows = knn.shape_rows(shaped, "f", "frame", "elem", "pixels", "across").drop("id")
    return own.join(rows, ["frame", "elem"]).withColumnsRenamed({"pixels": "crop", "across": "width"})


def pack_stage(registry: packs.Registry) -> Stage:
    """Packs see elements with the columns of with_crops()."""

    def stage(tables: Tables) -> Tables:
        if "elements" not in tables:
            return {}
        return {"tags": packs.detect(cut(with_crops(tables["frames"], tables["elements"])), tables["tags"], registry)}

    return stage


def formula_stage(atlas: DataFrame, prior: dict[str, float] | None = None, rules: math_reading.FormulaRules = math_reading.FormulaRules()) -> Stage:
    def stage(tables: Tables) -> Tables:
        if "elements" not in tables:
            return {}
        nothing = {"is_text": "boolean", "fitted": "boolean", "residual": "double"}
        read = tables.get("reads")
        if read is None:
            read = tables["elements"].where("level = 'element'").select("*", *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()))
        regions = cut(math_reading.formulas_of(tables["frames"], read, atlas, prior, rules))
        return {"regions": regions, **_with_tags(tables, math_reading.formula_tags(regions, rules))}

    return stage


def screen_pipeline(spark: SparkSession, atlas: DataFrame, math_atlas: DataFrame | None = None, registry: packs.Registry | None = None) -> Pipeline:
    """Layout and text, then packs and formulas where they are given."""
    out = Pipeline().add("layout", layout_stage()).add("text", text_stage(atlas))
    if registry is not None:
        out.add("detection", pack_stage(registry))
    if math_atlas is not None:
        out.add("latex", formula_stage(math_atlas))
    return out
