"""Corpus preparation: stages over `documents`, each written as Parquet and read again by the next.

language: texts without a letter, without one language that most of the probability goes to, or that no language codes in 8 bits a byte, are dropped.
near_duplicates: of each component of near copies (five-word shingles, similarity 0.8) the least id stays.
secrets: found spans are masked; no document is dropped.
mixing: sources are sampled to target weights; a document stays in as many copies as the mix takes of it.
packing: the documents become pieces of sequences of at most 1024 tokens.

Defined results: null texts and texts without words have no language and go in the first stage (empty documents in later stages are passed on); null
languages and sources are allowed; repeated rows are near copies of each other, of which those of the least id stay, all of them if they share it; ties
are decided as each operator says; an empty table gives no piece; extra columns are passed on up to the last stage, whatever their names.

Tables that a stage makes for itself are removed once its result is written, and a stage's result once the next one's is; the input of the
last stage stays for its reader. With `resume`, a name, results are kept under that name, and a run that was stopped goes on behind its last whole stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, mixing, nearjoin, packing, secrets
from tidemark.llm._shared import is_complete, remove, scratch, shared_folder, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs, language.learn(docs, F.lit(True)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearjoin.deduplicated(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redacted(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates), ("secrets", mask_secrets), ("mixing", mix_sources), ("packing", pack_sequences)]
#: Hashing, language statistics and tokenisation are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, resume: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/tidemark-pipeline-{resume or uuid.uuid4().hex}"
    paths = [f"{base}-{k}-{name}" for k, (name, _) in enumerate(STAGES[:-1])]
    done = next((k for k in reversed(range(len(paths))) if resume and is_complete(spark, paths[k])), -1)
    if done >= 0:
        docs = spark.read.parquet(paths[done])
    for k in range(done + 1, len(paths)):
        with scratch(spark):
            docs = stored(STAGES[k][1](spark, docs, sf_dir), paths[k])
        if k:
            remove(spark, paths[k - 1])
    return STAGES[-1][1](spark, docs, sf_dir)
