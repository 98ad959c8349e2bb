"""The corpus pipeline: stages over documents, each applying one operator to all that the stage before it kept.

All stages but the last return the columns of documents. Between stages, rows are written as Parquet and read again.
Every stage takes rows with nulls in any column, repeated rows and ids, and empty tables (which give empty results); what
becomes of them is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import byte_bpe, line_dedup, ngram_join, quality, source_mix
from rasterlake.llm.common import materialize, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it is fitted on the labelled documents among them.

    Null and empty texts, and those without a word, score 0 and go; repeated rows fare alike. Without labels of
    documents that are there, all go.
    """
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave the texts, but for their first place; n_chars follows. Emptied documents stay as rows.

    Places are ordered by (doc_id, hash of the text, word), null ids last; rows equal in id and text are one document and
    are cut alike. Null and empty texts stay as they are.
    """
    out = line_dedup.without_passages(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the least (doc_id, hash of the text), null ids last.

    Of rows equal in both, the least hash of all columns stays. Rows without words are linked with nothing and stay.
    """
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in whole texts.

    A null source is one source, the last. Rows without a word stay out; repeated rows are taken alike.
    """
    return source_mix.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (packed little-endian u32) and the digest of the decoded bytes of each row.

    A null text is as empty: no ids, and the digest of nothing.
    """
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    byte_bpe.bounded_batches(spark)
    both = docs.select("doc_id", "source", byte_bpe.round_trip(F.col("text"), path, public_tokenizers.PATTERN).alias("both"))
    return both.select("doc_id", "source", F.expr("cast(octet_length(both.ids) div 4 as bigint)").alias("n_tokens"), "both.ids", F.sha2("both.decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_passages),
    ("n-gram Jaccard join", one_of_each),
    ("source mix", mix_sources),
    ("byte-level BPE", encode),
]
#: The stages are models, hashes of whole texts and encodings that SQL can't express; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
