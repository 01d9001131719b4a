"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of documents;
the last adds how often the mix takes each. Each stage sees all that the one before it kept.

In every stage a null text counts as empty, rows that repeat stay rows of their own until a stage drops copies, columns of any
name and kind pass through, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm import decontaminate, line_dedup, mixing, near_dedup, toxicity
from fieldlens.llm._spark import cut


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores 0.5 or more go. Empty texts get the score of no term; rows with a null doc_id are scored
    like others. Without labels of both kinds, or labels at all, the score is constant."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar lines the first stays. A document that loses every line it had goes, as its
    whole text is elsewhere; one that was blank before stays. n_chars follows the text. Of equal lines the one of the least doc_id and place stays."""
    done = line_dedup.counted_lines(docs)
    emptied = (F.col("dropped") > 0) & (F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")) == 0)
    left = done.where(~F.coalesce(emptied, F.lit(False)))

    def column(c: str):
        if c == "n_chars":
            new = F.length("text").cast(docs.schema[c].dataType)
            return F.when(F.col("dropped") > 0, new).otherwise(F.col("row.n_chars")).alias(c)
        return F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c)

    return left.select(*[column(c) for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity 0.8), that of the least doc_id. Texts without words are linked
    with nothing and stay."""
    return near_dedup.keep_one(docs, words=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 80 % of a benchmark item's five-word shingles go, with rows that share their doc_id; rows with a null doc_id stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: the documents with ``copies`` (1 to 3 times) and ``taken`` (words, repeats counted). Documents of no words take nothing and go; a null
    source is a source of its own, the last. Ties follow a hash of doc_id."""
    return mixing.take_mix(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: SQL can't express the learned toxicity stage; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
