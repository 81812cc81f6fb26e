"""From raw documents to packed training sequences, in five stages.

1. toxicity: documents that the classifier chain rejects go;
2. SimHash near-dedup: one document of each component stays;
3. secret scans: found secrets are cut out of the texts;
4. mixing: documents are sampled by calibrated source, language and topic weights;
5. packing: what stays is packed into sequences of 4096 tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabrisk.llm import mixing, packing, secrets, simhash, toxicity
from tabrisk.llm.queries import VOCABULARY
from tabrisk.llm.spark_util import shared_folder, table


def clean_speech(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity chain rejects (null and empty texts stay)."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash component."""
    return simhash.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace the secrets in all texts; no document is dropped."""
    return secrets.redact(docs, secrets.scan_versions(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents by the mix's probabilities."""
    return mixing.sample(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of each document, with its sequence and offset."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("toxicity", clean_speech), ("simhash_near_dedup", one_of_each), ("secret_scans", without_secrets),
          ("mixing", mixed), ("packing", packed)]

#: Classifier, fingerprint and tokenizer stages can't be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = shared_folder(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
