"""Classification packs and tags: scoped classifiers in order, later ones seeing earlier tags; their evaluation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.operators import knn, shapes
from rasterlake.operators.cut import cut

TAG_SCHEMA = "frame long, elem long, key string, value string, score double, source string, seq long"


@dataclass(frozen=True)
class Scope:
    """Where a pack applies: kinds, sides of the element's box, and an earlier tag with one of some values."""

    kinds: tuple[str, ...] = ()
    least_side: int = 8
    most_side: int = 160
    needs: str = ""
    values: tuple[str, ...] = ()

    def of(self, elements: DataFrame, tags: DataFrame) -> DataFrame:
        """The elements (frame, elem, kind, w, h, ...) in scope. The required tag's first value counts, not the best."""
        low, high = F.least("w", "h"), F.greatest("w", "h")
        found = elements.where((low >= self.least_side) & (high <= self.most_side))
        if self.kinds:
            found = found.where(F.col("kind").isin(*self.kinds))
        if self.needs:
            first = tags.where(F.col("key") == self.needs).groupBy("frame", "elem").agg(F.min_by("value", "seq").alias("value"))
            if self.values:
                first = first.where(F.col("value").isin(*self.values))
            found = found.join(first, ["frame", "elem"], "left_semi")
        return found


@dataclass(frozen=True)
class Pack:
    """A named classifier: elements in scope -> frame, elem, value, score (all matches)."""

    name: str
    key: str
    classify: Callable[[DataFrame], DataFrame]
    scope: Scope = field(default_factory=Scope)


class Registry:
    """Packs in order; adding a name again replaces the pack in its place."""

    def __init__(self) -> None:
        self.packs: dict[str, Pack] = {}

    def add(self, pack: Pack) -> Registry:
        self.packs[pack.name] = pack
        return self

    def remove(self, name: str) -> bool:
        return self.packs.pop(name, None) is not None

    def __iter__(self):
        return iter(self.packs.values())


def best_tag(tags: DataFrame) -> DataFrame:
    """frame, elem, key, value, score: the tag of the best score, the first of equal ones."""
    best = F.max_by(F.struct("value", "score"), F.struct("score", (-F.col("seq")).alias("k")))
    return tags.groupBy("frame", "elem", "key").agg(best.alias("b")).select("frame", "elem", "key", "b.value", "b.score")


def detect(elements: DataFrame, tags: DataFrame, registry: Registry, least: float = 0.5) -> DataFrame:
    """tags with what the packs add, in order: each element's top match, if its score is at least `least`.

    What a pack adds is computed once where a later pack looks at tags.
    """
    packs = list(registry)
    for n, pack in enumerate(packs):
        hits = pack.classify(pack.scope.of(elements, tags))
        top = hits.groupBy("frame", "elem").agg(F.max_by("value", F.struct("score", F.lit(0))).alias("value"), F.max("score").alias("score")).where(F.col("score") >= least)
        new = top.select("frame", "elem", F.lit(pack.key).alias("key"), "value", "score", F.lit(pack.name).alias("source"), F.lit(1_000_000 + n).cast("long").alias("seq"))
        tags = tags.unionByName(cut(new) if any(p.scope.needs for p in packs[n + 1 :]) else new)
    return tags


def confusion(rows: DataFrame) -> DataFrame:
    """gt, pred, n, row_total, share: the confusion matrix, with each cell's share of its row."""
    n = rows.groupBy("gt", "pred").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("row_total", F.sum("n").over(Window.partitionBy("gt"))).withColumn("share", F.col("n") / F.col("row_total"))


def recall_by_class(rows: DataFrame) -> DataFrame:
    """gt, n, hits, recall, worst: each class's recall and its commonest confusion (ties to the smaller label)."""
    c = confusion(rows)
    wrong = F.when(F.col("gt") != F.col("pred"), F.struct("n", (-F.col("pred")).alias("k")))
    return c.groupBy("gt").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)).alias("hits"), F.max_by("pred", wrong).alias("worst")
    ).withColumn("recall", F.col("hits") / F.col("n"))


def every_nth(rows: DataFrame, label: str, order: str, nth: int) -> Column:
    """Whether a row is held out: every nth of its label, in order."""
    return F.row_number().over(Window.partitionBy(label).orderBy(order)) % nth == 0


def template_pack(name: str, key: str, exemplars: DataFrame, scope: Scope = Scope(), k: int = 5) -> Pack:
    """A pack that lets the k nearest exemplars (id, label, v, s) vote; elements have v and s, see knn.shape_rows().

    Labels are numbered in order of their first exemplar, which settles equal votes. Without exemplars it never matches.
    """
    first = exemplars.groupBy("label").agg(F.min("id").alias("first"))
    classes = cut(first.select("label", (F.row_number().over(Window.orderBy("first")) - 1).cast("long").alias("class")))  # as many as classes
    numbered = cut(exemplars.join(F.broadcast(classes), "label").select("id", F.col("class").alias("label"), "v", "s"))

    def classify(elements: DataFrame) -> DataFrame:
        asked = elements.select((F.col("frame") * MOST_ELEMENTS + F.col("elem")).alias("id"), "v", "s")
        voted = knn.shape_votes(asked, numbered, k).withColumnRenamed("label", "class").join(F.broadcast(classes), "class")
        return voted.select(F.expr(f"query div {MOST_ELEMENTS}").alias("frame"), (F.col("query") % MOST_ELEMENTS).alias("elem"), F.col("label").alias("value"), F.col("confidence").alias("score"))

    return Pack(name, key, classify, scope)


def state_pack(name: str = "check-state", key: str = "widget.state", scope: Scope = Scope()) -> Pack:
    """The rule pack: whether a control is checked, by the spread in its middle; elements have crop and width."""

    def classify(elements: DataFrame) -> DataFrame:
        return elements.select("frame", "elem", shapes.state_of(F.col("crop"), F.col("width")).alias("t")).where("t is not null").select("frame", "elem", "t.value", "t.score")

    return Pack(name, key, classify, scope)


#: Elements of a frame, at most, for numbers of elements over all frames.
MOST_ELEMENTS = 1_000_000
#: Packs with this in their name look only at elements that an earlier pack called one of these.
STATE_NAME, STATEFUL = "state", ("ui.checkbox", "ui.radio")


def registry_of(exemplars: DataFrame) -> Registry:
    """The packs of exemplars (pack, tag_key, k, ex_id, label, log_aspect, fill, hog, ink), as files of packs have them.

    In order of their names. Packs for states apply to widgets that have one; where no pack writes states, a rule does.
    """
    bytes_of = lambda c: F.expr(f"transform(sequence(1, length({c})), i -> cast(conv(hex(substring({c}, i, 1)), 16, 10) as int))")
    feature = F.struct(bytes_of("hog").alias("hog"), bytes_of("ink").alias("ink"), F.col("log_aspect").cast("double").alias("log_aspect"), F.col("fill").cast("double").alias("fill"))
    out, stateful = Registry(), Scope(needs="widget", values=STATEFUL)
    names = exemplars.select("pack", "tag_key", "k").distinct().orderBy("pack").collect()  # as many as packs
    for name, key, k in names:
        own = exemplars.where(F.col("pack") == name).select(F.col("ex_id").cast("long").alias("id"), "label", feature.alias("f"))
        out.add(template_pack(name, key, knn.shape_rows(own, "f", "label"), stateful if STATE_NAME in name else Scope(), k))
    if not any(key == "widget.state" for _, key, _ in names):
        out.add(state_pack(scope=stateful))
    return out
