"""The corpus pipeline: toxic documents go, near-duplicates go, leaked benchmark items go, the rest is packed.

Each stage takes all that its predecessor kept, written as Parquet and read again. The first three return the columns
of ``documents`` and decide on whole documents; the last returns pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticksmith.llm import decontam, packing, simhash_trie, toxicity
from ticksmith.llm.storage import written
from ticksmith.llm.tokens import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, doesn't predict toxic. Rows go one by one; no shuffle."""
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: that with the smallest doc_id (nulls last), by input place.

    Rows are numbered once and stored with their numbers, so that a lost executor can't number them anew between the
    search and the join. The rows to drop are found on fingerprints alone.
    """
    uid = "_uid"
    while uid in docs.columns:
        uid += "_"
    marked = written(docs.withColumn(uid, F.monotonically_increasing_id()), "numbered")
    groups = simhash_trie.near_groups(marked, uid_col=uid)
    again = written(groups.where("uid != first_uid").select(F.col("uid").alias(uid)), "near-duplicates")
    return marked.join(again, uid, "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_leaks), ("packing", pack_sequences)]

#: Tokens, SimHash and a trained classifier aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
