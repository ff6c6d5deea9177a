"""Documents to token ids: toxic documents go, of near-duplicates one stays, personal data is replaced, sources are mixed
to their weights, texts are encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. Stages that
change a text also set n_chars. Rows with nulls go through every stage: a null text is empty, a null identifier can't be
compared and stays, a null source is a source of its own. A document without words has no share in the mix.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import byte_bpe, mixing, near_dedup, pii, toxicity
from storyloom.llm.common import forget, written_alone

WEIGHTS = (3, 1, 2)
SHINGLE_WORDS, PERCENT = 5, 80


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_first(docs, SHINGLE_WORDS, PERCENT)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pii.sanitise(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(mixing.mix(docs, WEIGHTS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SQL can't express a learned lexicon, MinHash signatures or byte-level BPE; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written_alone(lambda stage=stage, given=docs: stage(spark, given, sf_dir), name)
        if before is not None:
            forget(before)  # a stage's input goes when its output is written
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
