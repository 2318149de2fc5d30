"""From raw documents to packed training sequences, in stages that are written and read again one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakweave.llm import packing, private_data, quality, simhash
from peakweave.session import ship, written

#: Documents that score below go: the classifier's own threshold. On check_s held-out labels 15 of 4410 good texts go and 9 of 689 poor ones stay.
LEAST_QUALITY = quality.THRESHOLD


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, with all their columns. A null text counts as empty; repeated rows stay or go together.

    Without labels of both classes there is nothing to learn, and no document goes. An empty table gives an empty table.
    """
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~quality.held_out())
    net = quality.fit(docs, labels)
    return docs if net.prior is not None else quality.keep(docs, net, LEAST_QUALITY)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, similarity of 0.8 or more. The smallest id of a class stays.

    Null and wordless texts are one class; of rows that repeat an id one stays. Rows with a null id all stay, unless a text like
    theirs has an id. An empty table gives an empty table.
    """
    ship(spark)
    return simhash.one_of_each(docs)


def private_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and disclosing terms replaced in their texts, and n_chars of the texts as they now are.

    A null text stays null and keeps its n_chars; repeated rows each stay; an empty table gives an empty table.
    """
    out = private_data.sanitised(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences. A null text counts as empty; repeated rows are packed each; an empty table gives an empty table."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("PII", private_data_stage),
    ("best-fit packing", packing_stage),
]
#: The classifier and the tokenizer are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
