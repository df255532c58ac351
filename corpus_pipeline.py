"""A corpus pipeline of five stages; each is a function of (spark, docs, sf_dir), written as Parquet and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import common, jaccard, mixing, packing, substring, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that toxicity rejects go; all others stay as they are.

    Null and empty texts are scored like texts without words and stay; rows with equal ids go or stay together, those with
    a null id stay. An empty table gives an empty one. Of columns besides COLUMNS none is returned.
    """
    verdicts = toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bad = common.checkpointed(verdicts.where("predicted = 1").select(F.col("id").alias("doc_id")).distinct())
    return common.join_ids(docs, bad, "doc_id", "left_anti").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least id.

    Null and empty texts are in no group and stay. Of rows with equal ids one stays; rows with a null id stay all. An empty
    table gives an empty one. Of columns besides COLUMNS none is returned.
    """
    members = jaccard.jaccard_join(docs)["documents"]
    copies = common.checkpointed(members.where("id <> component_id").select(F.col("id").alias("doc_id")).distinct())
    kept = common.join_ids(docs, copies, "doc_id", "left_anti").select(*COLUMNS)
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut; a document of which nothing is left goes.

    Null and empty texts lose nothing and stay, as do rows with a null id. Ids must not repeat, which the stage before sees
    to. An empty table gives an empty one. Of columns besides COLUMNS none is returned; n_chars is that of the new text.
    """
    kept = substring.substring_dedup(docs, with_text=True)
    kept = kept.select(F.col("id").alias("doc_id"), "kept_text", "n_words", "n_removed")
    joined = docs.where("doc_id is not null").select("doc_id", "lang", "source").join(kept, "doc_id").where("n_removed = 0 or n_removed < n_words")
    nameless = docs.where("doc_id is null").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    return nameless.unionByName(joined.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes; what it takes twice is there twice.

    Null and empty texts and rows with a null id have nothing to take. A null source is a source of its own. An empty table
    gives an empty one. Of columns besides COLUMNS none is returned.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences.

    Null and empty texts are one end token. Rows with equal or null ids are documents of their own. An empty table gives an
    empty result; other columns aren't read.
    """
    return packing.packed(docs).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("substring_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Hash tokenizers, random permutations and learnt scores are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder, read again, and removed once the next
    stage is written. The last table is what the result reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = common.shared_folder(spark, f"pipeline-{uuid.uuid4().hex}")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if i:
            common.delete(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
