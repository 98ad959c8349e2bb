"""Bounded samples of labelled texts for fitting a model on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import held_out


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, most: int, most_chars: int) -> list[tuple[str, int]]:
    """At most `most` (text, 0 or 1) of documents that aren't held out, half of them of each label if there are as many.

    Whole texts, of any length, as long as those of one label hold `most_chars` / 2 characters together at most: one that
    would go beyond is passed over. Rows come in the order of a hash of their id, so reruns agree whatever the partitions.
    Only labels of documents that are there, with a text, count, so that labels of other documents take no place. Null
    labels and ids, and null and empty texts, don't count; equal rows count once; an id that has both labels gives both.
    What reaches the driver is `most` narrow rows, and then the texts picked.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out()).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    own = docs.where(F.length("text") > 0).select("doc_id", F.xxhash64("text").alias("hash"), F.length("text").alias("chars"))
    rows = own.join(known, "doc_id").distinct()
    picked: list[tuple[int, int, int, int]] = []
    for value in (0, 1):
        left = most_chars // 2
        for i, h, chars, v in rows.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id", "hash").limit(most // 2).collect():
            if chars <= left:
                picked.append((i, h, v, len(picked)))
                left -= chars
    if not picked:
        return []
    ids = docs.sparkSession.createDataFrame(picked, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, hash long, label int, nth int")
    found = docs.select("doc_id", "text").withColumn("hash", F.xxhash64("text")).join(F.broadcast(ids), ["doc_id", "hash"])
    texts = found.groupBy("nth").agg(F.first("text").alias("text"), F.first("label").alias("label")).collect()
    return [(r["text"], r["label"]) for r in sorted(texts, key=lambda r: r["nth"])]
