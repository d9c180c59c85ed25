"""A training corpus from documents: rules, near duplicates, personal data, mixing, packing.

Each stage takes what its predecessor kept, with the columns of documents, and its
decisions take effect. The last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texloom.llm import mixing, packing, pii, quality_rules, set_join
from texloom.llm.common import small_batches, stage, table
from texloom.llm.queries import tokenizer_path

#: Ids of dropped documents are broadcast up to so many; beyond, the join is shuffled.
MOST_BROADCAST = 400_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep. Without labels only the base rules count."""
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct("*").alias("__row"), F.col("doc_id").alias("__id"), F.col("text").alias("__raw"))
    return quality_rules.apply_rules(rows, rules, "__id", "__raw", keep=("__row",)).where("kept").select("__row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the least id. Rows without an id stay.

    Where one id has several texts, each row is judged by its own text's group.
    """
    found = stage(set_join.join_sets(docs, with_sets=True).withColumn("gone", F.col("doc_id") != F.col("component_id")), "components")
    gone = found.where("gone").select("doc_id").distinct()
    counted = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("gone").alias("n_gone"))
    twice = stage(counted.where(F.col("n") > 1), "repeated_ids")
    repeated = bool(twice.head(1))
    mixed = twice.where((F.col("n_gone") > 0) & (F.col("n_gone") < F.col("n"))).select("doc_id")
    gone = stage(gone.join(mixed, "doc_id", "left_anti") if repeated else gone, "dropped")
    few = gone.count() <= MOST_BROADCAST
    left = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
    if not repeated:
        return left
    twice = twice.select("doc_id")
    if mixed.head(1):
        sets = found.where("gone").join(mixed, "doc_id", "left_semi").select("doc_id", F.col("set").alias("__set")).distinct()
        judged = left.join(mixed, "doc_id", "left_semi").withColumn("__set", set_join.set_of(F.col("text")))
        left = left.join(mixed, "doc_id", "left_anti").unionByName(judged.join(sets, ["doc_id", "__set"], "left_anti").select(left.columns))
    again = left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(twice, "doc_id", "left_anti").unionByName(again)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars follows. A null text stays null."""
    return docs.withColumn("text", pii.masked(F.col("text"))).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    # Small batches and tables, not kept: Python workers live through all stages and share an executor's memory with them.
    small_batches(spark)
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), most_chunks=20_000, keep_encoder=False)


STAGES = [
    ("quality_rules", keep_quality),
    ("near_copies", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The learned rules, the field and the tokenizer are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
