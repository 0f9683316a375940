"""The corpus pipeline: each stage works on all that its predecessor kept."""

from pyspark.sql import DataFrame, SparkSession

from downfield.llm import decontaminate, mixing, shards, simhash, toxicity
from downfield.llm.common import table
from downfield.session import materialise

SHARDS = 8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold. Null and empty texts score as texts without words do, whole texts count, ties and
    repeated rows are judged alike, other columns pass unchanged, no rows give none; so in all stages but the last."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: 3-word shingles, 2 bits. The smallest doc_id stays (null last), of
    repeated rows one; texts without words are copies of each other."""
    return simhash.keep_one(docs, shingle=3, radius=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark. Texts without words are clean."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as their source's target asks. Null is a source; texts without words are taken
    as their source is; rows with one training position follow each other in the order of a hash."""
    return mixing.mix(docs)


def place(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document taken; slots follow the training order in which the last stage was written. Null
    texts have size 1, a null doc_id is a key, repeated rows have a slot each, no rows give none; other columns are left out."""
    return shards.shard(docs, SHARDS, shards.written_order(docs))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_copies), ("decontamination", drop_contaminated),
          ("mixing", mix_sources), ("sharding", place)]

# A trained classifier and a 64-bit hash have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents, each written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
