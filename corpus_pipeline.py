"""The corpus pipeline: documents in, shards of a clean mixture out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept, whose rows are written as Parquet and read again in between.  Null and
empty texts hold nothing toxic, link with nothing and hold no benchmark item, so
the filters keep them; the mixture takes them as often as their source's certain
copies, as they have no words.  Very long texts are worked on whole.  An empty
table passes through every stage and gives no rows.  Columns beside those of
documents pass through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontamination, deduplication, mixing, sharding, toxicity
from quarry.llm.spark import documents, stash


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field predicts toxic go; repeated rows go or stay together."""
    return toxicity.without_toxic(docs, toxicity.train(docs, documents(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the least doc_id, null last, ties by a hash of the text; once, if its row repeats."""
    return deduplication.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go; repeated rows go or stay together."""
    return decontamination.without_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it; equal rows are dealt as a group."""
    return mixing.mixture(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of each document; copies of one that don't fit together get pages."""
    return sharding.extendible_shards(docs, sharding.SHARD_BYTES, keep=["doc_id", "lang", "source", "n_chars"])


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix), ("sharding", shard)]

#: A trained classifier and an exact similarity join with components are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, name)
    return docs
