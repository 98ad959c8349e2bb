"""Scores of readings against the truth: sums over all rows, ratios after them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.functions.latex import canonical_tokens, structural, token_distance
from rasterlake.functions.text import fold_case


def _ratio(a: str, b: str):
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def text_score(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, chars, edits, exact and the case-blind pair of both, with cer, cer_ci, em, em_ci, for rows (gt, pred)."""
    g, p = F.col("gt"), F.col("pred")
    each = rows.select(*(by or []), F.length(g).alias("c"), F.levenshtein(g, p).alias("e"), F.levenshtein(fold_case(g), fold_case(p)).alias("f"))
    s = each.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("c"), F.lit(0)).alias("chars"), F.coalesce(F.sum("e"), F.lit(0)).alias("edits"),
        F.coalesce(F.sum("f"), F.lit(0)).alias("edits_ci"), F.count_if(F.col("e") == 0).alias("exact"), F.count_if(F.col("f") == 0).alias("exact_ci"),
    )
    for name, a, b in (("cer", "edits", "chars"), ("cer_ci", "edits_ci", "chars"), ("em", "exact", "n"), ("em_ci", "exact_ci", "n")):
        s = s.withColumn(name, _ratio(a, b))
    return s


def formula_score(rows: DataFrame) -> DataFrame:
    """One row for formulas (id, gt, pred): token edits, exact matches, and symbols found, claimed and true."""
    t = rows.select("id", canonical_tokens(F.col("gt")).alias("g"), canonical_tokens(F.col("pred")).alias("p"))
    edits = t.select("id", F.size("g").alias("tokens"), token_distance(F.col("g"), F.col("p")).alias("edits"))
    sums = edits.agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), F.sum("edits").alias("edits"), F.count_if(F.col("edits") == 0).alias("exact"))
    return sums.join(symbol_overlap(t))


def symbol_overlap(tokens: DataFrame) -> DataFrame:
    """sym_tp, sym_gt, sym_pred for rows (id, g, p) of token arrays: bags of tokens that aren't structure, met by count."""
    side = lambda c, n: tokens.select("id", F.explode(c).alias("token")).where(~structural(F.col("token"))).groupBy("id", "token").agg(F.count(F.lit(1)).alias(n))
    both = side("g", "a").join(side("p", "b"), ["id", "token"], "full")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return both.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in ((F.least(a, b), "sym_tp"), (a, "sym_gt"), (b, "sym_pred"))))
