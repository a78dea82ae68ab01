"""From raw documents to packed token windows: toxic documents go, copies go, near copies go, sources are mixed, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the next
one's documents. All stages but the last return the columns of their input as they are. A stage marks rows by a column of
its own that names each row of the files it reads, so equal ids and repeated rows are kept apart.

Defined cases follow the operators: null texts are empty; empty documents are not toxic, are copies of each other, and are packed
as their end id; an empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import common, exact_dedup, mixing, near_dedup, packing, toxicity

ROW = "__terravane_row"


def _numbered(docs: DataFrame) -> DataFrame:
    return common.with_row_id(docs, ROW)


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    return docs.join(kept.select(ROW), ROW, "left_semi").drop(ROW)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labels of the training rows, does not predict to be toxic."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, the one with the most code points, then the smallest id."""
    rows = _numbered(docs)
    found = exact_dedup.dedup(rows, row=F.col(ROW))
    return _only(rows, found.where("kept").withColumnRenamed("row", ROW))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest id."""
    rows = _numbered(docs)
    found = near_dedup.classes(rows, key=ROW).select(F.col("key").alias(ROW), "class_id")
    named = common.stored(found.join(rows.select(ROW, "doc_id"), ROW), f"{common.shared_dir(spark, 'pipeline')}/classes")
    first = named.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("m"))
    return _only(rows, first.select(F.col(f"m.{ROW}").alias(ROW)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights want them."""
    rows = _numbered(docs)
    taken = mixing.select(rows, mixing.TARGETS, row=ROW).where(F.col("epochs") > 0).select(ROW, F.col("epochs").cast("int").alias("__epochs"))
    out = rows.join(taken, ROW).withColumn("__epoch", F.explode(F.array_repeat(F.lit(0), F.col("__epochs"))))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4096 ids."""
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.withColumnRenamed("key", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: Learned models, near duplicates and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = common.shared_dir(spark, "corpus")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = common.stored(stage(spark, docs, sf_dir), f"{home}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
