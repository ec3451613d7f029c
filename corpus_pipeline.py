"""The corpus pipeline: documents are filtered, deduplicated and packed into training bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlift.llm.common import stored
from ledgerlift.llm.jaccard_join import near_duplicates
from ledgerlift.llm.line_dedup import dedupe_lines
from ledgerlift.llm.packing import pack_documents
from ledgerlift.llm.suffix_dedup import remove_repeats
from ledgerlift.llm.toxicity import fit_toxicity

CAPACITY = 8192  # bytes of a bin
PASSAGE_WORDS = 51  # a passage of so many words stands once,
PASSAGE_BYTES = 200  # if it is as long as this: 51 words of three letters or more are


def _bare(docs: DataFrame) -> DataFrame:
    """Id and text, and the other columns out of the operators' way, whatever their names."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others, F.lit(True)).alias("carried"))


def _whole(done: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of ``_bare`` with the columns of ``docs`` and the text as it is now."""
    return done.select(*(c if c in ("doc_id", "text") else F.col(f"carried.`{c}`") for c in docs.columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not take for toxic.

    As in all stages, other columns keep their values, whatever their names; null and empty texts and
    rows that repeat are documents like any other, and an empty table gives no rows.
    """
    bare = _bare(docs)
    model = fit_toxicity(bare, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _whole(model.score(bare, bare.columns).where("predicted = 0"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that stood earlier; those of which nothing is left go."""
    done = dedupe_lines(_bare(docs))
    return _whole(done.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S")), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near duplicates; of rows equal in id and text, one."""
    bare = _bare(docs).withColumn("k", F.xxhash64("text"))
    found = near_duplicates(bare)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("group_id")) & (F.col("k") == F.col("group_k"))).select(
        F.col("doc_id").alias("first_id"), F.col("k").alias("first_k")
    )
    kept = bare.join(first, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("k") == F.col("first_k")), "left_semi")
    return _whole(kept.dropDuplicates(["doc_id", "k"]), docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of over 50 words that stand more than once; those of which nothing is left go."""
    done = remove_repeats(_bare(docs), min_bytes=PASSAGE_BYTES, min_words=PASSAGE_WORDS)
    return _whole(done.where((F.size("spans") == 0) | F.col("text").rlike(r"\S")), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document lies in which training bin."""
    return pack_documents(
        docs, length=F.octet_length("text"), source=F.col("source"), cluster=F.sha2("text", 256), capacity=CAPACITY
    )


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("best-fit packing", packing),
]

# The first stage learns a model, which SQL cannot express; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
