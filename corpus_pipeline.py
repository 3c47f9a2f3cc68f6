"""A corpus pipeline: quality rules, near duplicates, repeated passages, mixing, packing.

run() applies the stages in order; each works on all rows that its predecessor kept. All but the
last return the columns of documents; the last returns the packed batches.

Defined results: null texts have no words and go in the first stage; an empty table passes
through all stages as an empty one; columns beyond those of documents are carried by the first
four stages, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm import jaccard_join, mixing, packing, quality, suffix_dedup
from tensorloom.llm.common import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and whose posterior quality is at least one half."""
    return quality.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id."""
    return jaccard_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of passages of 200 bytes or more that stand anywhere else too.

    Characters of which a passage took some bytes go whole. Documents of which only blanks are
    left go; n_chars is counted anew.
    """
    d = suffix_dedup.remove_repeats(docs)
    d = d.where((F.col("__sd_n_removed") == 0) | (F.length(F.trim("__sd_kept", F.lit(quality.BLANKS))) > 0))
    values = {"text": F.col("__sd_kept"), "n_chars": F.length("__sd_kept").cast("long")}
    same = F.col("__sd_n_removed") == 0
    return d.select(*[F.when(same, F.col(c)).otherwise(values[c]).alias(c) if c in values else F.col(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs)


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with length, bucket, batch and padding; copies are sequences of their own."""
    return packing.pack(docs.select("doc_id", "text")).select("doc_id", "length", "bucket", "bucket_length", "batch", "padding")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("length_packing", length_packing),
]

#: Weak supervision, duplicate classes and bucket bounds are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's rows are written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs
