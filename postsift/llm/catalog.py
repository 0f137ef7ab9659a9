"""The operators as queries over whole tables, and DuckDB SQL where SQL can say it."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from postsift.llm import (filter_audit, language_model, packing, periodic_runs, pieces, prefix_counts, quality_rules, sharding,
                          simhash, superminhash, topk, toxicity, url_filter)
from postsift.llm.sql import ORACLES  # noqa: F401

WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark, folder):
    return quality_rules.judge(_table(spark, folder, "documents"))


def op2_url_filter(spark, folder):
    return url_filter.judge_urls(_table(spark, folder, "pages"))


def op3_sentencepiece(spark, folder):
    return pieces.encode_digest(_table(spark, folder, "documents"), vocabulary(PIECE_BPE))


def op4_toxicity(spark, folder):
    return toxicity.score_texts(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op5_token_counts(spark, folder):
    return prefix_counts.count_tokens(_table(spark, folder, "documents"), vocabulary(WORD_BPE))


def op6_topk_search(spark, folder):
    return topk.search(_table(spark, folder, "embeddings"))


def op7_lm_scores(spark, folder):
    return language_model.score_texts(_table(spark, folder, "documents"))


def op8_simhash(spark, folder):
    found = simhash.near_groups(_table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op9_sharding(spark, folder):
    return sharding.shard(_table(spark, folder, "documents"))


def op10_packing(spark, folder):
    return packing.pack(_table(spark, folder, "documents"), vocabulary(WORD_BPE)).drop("ids")


def op11_periodic_runs(spark, folder):
    docs = periodic_runs.with_planted_loops(_table(spark, folder, "documents"))
    return periodic_runs.run_digest(periodic_runs.find_runs(docs))


def op12_superminhash(spark, folder):
    return superminhash.near_groups(_table(spark, folder, "documents"))


def op13_filter_audit(spark, folder):
    return filter_audit.audit(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def pipeline(spark, folder):
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_url_filter, op3_sentencepiece, op4_toxicity, op5_token_counts, op6_topk_search, op7_lm_scores,
    op8_simhash, op9_sharding, op10_packing, op11_periodic_runs, op12_superminhash, op13_filter_audit, pipeline)}
