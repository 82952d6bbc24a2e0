"""The corpus pipeline: five stages from raw documents to shards.

Each stage takes (spark, docs, sf_dir) and returns what it kept; ``run`` writes
each result as Parquet and reads it again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import dartminhash, decontam, language, mixing, shards
from ledgerlark.llm.common import free_name, materialize, read_table
from ledgerlark.llm.queries import MIX_REPEAT, MIX_WEIGHTS, SHARDS

MIN_SCORE = 0.5             # least posterior of the predicted language


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; ``und`` and unsure ones go."""
    learn = docs.where(~language.held_out(F.col("doc_id")))
    predict = language.predictor(spark, language.train(learn))
    found = free_name(docs, "found")
    kept = docs.withColumn(found, predict(F.col("text")))
    return kept.where((F.col(found)["lang"] != language.UNKNOWN) & (F.col(found)["score"] >= MIN_SCORE)).drop(found)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return dartminhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a passage of the benchmark."""
    return decontam.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix_documents(docs, weights=MIX_WEIGHTS, max_repeat=MIX_REPEAT)


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and slot."""
    return shards.shard_documents(docs, SHARDS)


STAGES = [("language ID", identify_language), ("MinHash near-dedup", drop_near_duplicates),
          ("benchmark decontamination", decontaminate), ("mixing sources", mix_sources),
          ("sharding", write_shards)]
ORACLE_SQL = None           # language prediction and near-duplicate search are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
