"""Registered queries of the corpus operators, with production parameters over whole tables."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from downfield.llm import (
    decontaminate,
    linedup,
    merkle,
    mixing,
    oracles,
    quality,
    search,
    secrets,
    shards,
    simhash,
    tokens,
    toxicity,
    urls,
    warc,
)
from downfield.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


@query("op2_mixing", oracles.mixing_sql())
def op2(spark, sf_dir):
    return mixing.account(table(spark, sf_dir, "documents"))


@query("op4_simhash")
def op4(spark, sf_dir):
    marked = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return marked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_sharding")
def op5(spark, sf_dir):
    placed = shards.shard(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op7_toxicity")
def op7(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_decontamination", oracles.decontamination_sql())
def op8(spark, sf_dir):
    marked = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op1_quality", oracles.quality_sql())
def op1(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op3_urls")
def op3(spark, sf_dir):
    labelled = spark.createDataFrame(urls.labelled_urls(), "url string, blocked int")
    return urls.judge(table(spark, sf_dir, "pages"), labelled)


@query("op6_secrets")
def op6(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.labelled_findings(spark))


@query("op9_warc", oracles.captures_sql())
def op9(spark, sf_dir):
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


@query("op10_lines", oracles.line_runs_sql())
def op10(spark, sf_dir):
    cleaned = linedup.clean(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", "words_dropped", F.md5("text").alias("text_md5"))


@query("op11_search", oracles.search_sql())
def op11(spark, sf_dir):
    return search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), search.TOP)


@query("op12_merkle", oracles.merkle_sql())
def op12(spark, sf_dir):
    """Proofs of all rows, folded again from leaves of which every seventh or so tells of one character more."""
    more = {"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1}
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    told = merkle.manifest(table(spark, sf_dir, "documents"),
                           presented=F.when(changed, merkle.leaf([more.get(f, F.col(f)) for f in merkle.FIELDS])))
    root = merkle.folded(F.coalesce("presented", "leaf"), F.col("proof"))
    return told.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
                       root.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op13_tokens")
def op13(spark, sf_dir):
    return tokens.round_trip(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                             special=True)
