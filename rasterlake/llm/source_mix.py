"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key. Within its source, documents are dealt into ranges of that key, each range is
summed, the sums before a range come from windows over ranges and over ranges of ranges, and a last window runs inside
each range: a distributed prefix sum in which no task ever holds a whole source. Each source is cut at its exact budget of words, as
many times round as the budget asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.llm.common import WORD, fresh, materialize, table

#: Weights of sources in order of code points, repeating; the share of all words that the mix has; times a source at most.
WEIGHTS, SHARE, MOST_TIMES = (5, 2, 1), 1.5, 2
#: Documents in a key range, about, and ranges in a range of ranges.
RANGE_ROWS, RANGES = 500, 4096


def words_of(text: str):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(doc_id: str, text: str, seed: str):
    """The random key: hexadecimal, from the seed, the id and the text, so that rows of one id, or of none, are dealt too."""
    own = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), own).cast("binary"))


def sized(docs: DataFrame, seed: str) -> DataFrame:
    """id, source, size in words and random key of each document: what the rest of the mix works on."""
    return docs.select(F.col("doc_id").alias("id"), F.col("source").cast("string").alias("src"), words_of("text").alias("size"), key_of("doc_id", "text", seed).alias("key"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_TIMES) -> DataFrame:
    """src, n, total -> with target: each source's words in the mix.

    Where a share by weight would be above `most` times a source, the source gives that and the others share the rest
    by weight, until none is above. So the level `words / weight` that the others reach is the one at which all targets
    sum to the mix; sources that stop below it are the first ones in the order of their most / weight.
    """
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), F.col("nth") % len(weights) + 1).cast("double")
    rated = sources.withColumn("nth", (F.row_number().over(by_name) - 1).cast("int")).withColumn("weight", w).withColumn("most", most * F.col("total").cast("double"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("nth"))
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (share * F.sum("total").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levels = rated.withColumn("level", level)
    # the level of the first source that it doesn't fill is everybody's
    reached = F.min(F.when(F.col("most") > F.col("level") * F.col("weight"), F.struct((F.col("most") / F.col("weight")).alias("a"), "nth", "level"))).over(Window.partitionBy())
    return levels.withColumn("reached", reached["level"]).select(
        "src", "n", "total", F.coalesce(F.least("most", F.col("reached") * F.col("weight")), F.col("most")).alias("target")
    )


def placed(sizes: DataFrame) -> DataFrame:
    """Each row of sized() with its source's total, target and rounds, and `more`: its words in the round that is cut.

    A source's budget is its target rounded to whole words: full rounds over all its documents, then one over those
    first in key order, the last of which is cut at the exact word.
    """
    sizes = materialize(sizes, "sizes")
    sources = targets(sizes.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")))
    budget = F.round("target").cast("long")
    rounds = F.when(F.col("total") > 0, F.expr("cast(round(target) as bigint) div total")).otherwise(F.lit(0)).cast("long")
    sources = sources.select(
        F.col("src").alias("s"), "total", "target", rounds.alias("rounds"), (budget - rounds * F.col("total")).alias("left"), F.ceil(F.col("n") / RANGE_ROWS).cast("long").alias("ranges")
    )
    sources = materialize(sources, "sources")
    # the leading 32 bits of the key, scaled to the source's number of ranges: ranges in key order
    bits = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    ranged = sizes.join(sources, sizes["src"].eqNullSafe(sources["s"])).drop("s").withColumn("range", F.shiftright(bits * F.col("ranges"), 32))
    sums = ranged.groupBy("src", "range").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("part", F.expr(f"range div {RANGES}"))
    earlier = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy("src", "part").agg(F.sum("words").alias("words"))
    parts = parts.select(F.col("src").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("src", "part").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("words").over(within), F.lit(0)))
    starts = sums.join(parts, F.col("src").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).select(
        F.col("src").alias("s"), F.col("range").alias("r"), (F.col("base") + F.col("start")).alias("start")
    )
    inside = Window.partitionBy("src", "range").orderBy("key", F.col("id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return (
        ranged.join(starts, F.col("src").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
        .withColumn("at", at)
        .withColumn("more", F.greatest(F.lit(0), F.least("size", F.col("left") - F.col("at"))).cast("long"))
        .select("id", "src", "key", "size", "total", "target", "rounds", "more")
    )


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes, repeats counted.

    Every row has its own line, rows with equal or null ids too (ties go to the smaller size, and rows equal in id,
    size and source are interchangeable). Null sources are one source, the last. Null and empty texts have size 0 and
    give 0; a source without words has target 0; an empty table gives an empty result.
    """
    return placed(sized(docs, seed)).select(
        F.col("id").alias("doc_id"), "size", F.col("total").alias("source_size"), "target", (F.col("rounds") * F.col("size") + F.col("more")).alias("taken")
    )


def mixed_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """docs as the mix has them: each row as often as it is taken, in whole texts.

    A source's cut is one key: texts up to it have one round more than the others, so texts pass through without a
    shuffle. The text at the cut counts if half of it or more is within the budget; rows equal in id and text go together.
    Documents without a word stay out. Columns are those of docs; equal rows may follow each other.
    """
    cut = placed(sized(docs, seed)).groupBy("src").agg(
        F.max("rounds").alias("rounds"), F.max(F.when((F.col("more") * 2 >= F.col("size")) & (F.col("more") > 0), F.col("key"))).alias("cut")
    )
    cut = materialize(cut, "cuts")
    names = fresh(docs, "size", "key", "src", "rounds", "cut", "copy")
    size, key, src, rounds, last, copy = names
    cut = cut.select(F.col("src").alias(src), F.col("rounds").alias(rounds), F.col("cut").alias(last))
    copies = F.col(rounds) + F.coalesce(F.col(key) <= F.col(last), F.lit(False)).cast("long")
    return (
        docs.withColumn(size, words_of("text")).where(F.col(size) > 0)
        .withColumn(key, key_of("doc_id", "text", seed))
        .join(cut, F.col("source").cast("string").eqNullSafe(F.col(src)))
        .withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies.cast("int"))))
        .select(*docs.columns)
    )


def op1_source_mix(spark, sf_dir: str) -> DataFrame:
    """mix() of all documents."""
    return mix(table(spark, sf_dir, "documents"))


SOURCE_MIX_SQL = f"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS nth FROM s GROUP BY source),
w AS (SELECT *, ([{', '.join(map(str, WEIGHTS))}])[nth % {len(WEIGHTS)} + 1]::DOUBLE AS weight, ({MOST_TIMES} * source_size)::DOUBLE AS most FROM t),
v AS (
  SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT level AS reached FROM v WHERE most > level * weight ORDER BY most / weight, nth LIMIT 1),
u AS (SELECT source, source_size, coalesce(least(most, (SELECT reached FROM g) * weight), most) AS target FROM v),
p AS (
  SELECT s.doc_id, s.size, u.source_size, u.target, round(u.target)::BIGINT AS budget,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY k, s.doc_id ASC NULLS LAST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_it
  FROM s JOIN u ON s.source IS NOT DISTINCT FROM u.source),
r AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS rounds FROM p)
SELECT doc_id, size, source_size, target,
  (rounds * size + greatest(0, least(size, budget - rounds * source_size - before_it)))::BIGINT AS taken
FROM r
"""
