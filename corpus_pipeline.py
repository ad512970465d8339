"""From raw documents to token ids: five stages, each stored before the next one reads it.

1. toxicity: documents predicted to be toxic go.
2. n-gram Jaccard join: of each group of near duplicates the document with the smallest id stays.
3. benchmark decontamination: documents that hold a benchmark item go.
4. PII: entities in the texts give way to surrogates; n_chars follows.
5. SentencePiece: token ids of the texts that are left.

Stages 1 to 4 return the columns of their input. Each is judged on what its predecessor kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import decontaminate, jaccard, pieces, pii, toxicity
from cohortlens.llm.common import table
from cohortlens.llm.queries import PIECE_MODEL
from cohortlens.session import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.training_fold())
    return toxicity.reject(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    safe = pii.protect(docs, names=("__n", "__kinds")).select(*docs.columns)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        safe = safe.withColumn("n_chars", F.length("text").cast(kind))
    return safe


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, PIECE_MODEL)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontaminate", drop_benchmark),
    ("pii", replace_personal_data),
    ("sentencepiece", encode),
]

#: Compression lengths, latent spaces and keyed permutations have no SQL; tests take its place.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
