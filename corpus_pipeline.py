"""A corpus in four stages: good texts, no toxic ones, one of near copies, packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last keep the columns of
documents. ``run`` writes each stage's rows to the shared folder and reads them for the next, so a
lost executor never costs more than the stage it was in.
"""

import uuid

from postsift.llm import packing, quality_rules, simhash, toxicity
from postsift.llm.catalog import WORD_BPE, vocabulary
from postsift.operators.lineage import shared_folder


def keep_good_texts(spark, docs, sf_dir):
    return quality_rules.keep_good(docs)


def drop_toxic_texts(spark, docs, sf_dir):
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark, docs, sf_dir):
    return simhash.drop_near_copies(docs)


def pack_sequences(spark, docs, sf_dir):
    return packing.pack(docs, vocabulary(WORD_BPE)).drop("ids")


STAGES = [("quality rules", keep_good_texts), ("toxicity", drop_toxic_texts), ("SimHash near-dedup", drop_near_copies),
          ("packing", pack_sequences)]

# The toxicity model, SimHash and the vocabulary are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over ``documents``."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
