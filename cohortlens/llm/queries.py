"""Each operator over its whole table, with the columns that its query promises."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import (
    alignment,
    chat,
    decontaminate,
    extraction,
    jaccard,
    licenses,
    neighbours,
    oracles,
    pieces,
    pii,
    quality,
    toxicity,
    trie,
    urls,
)
from cohortlens.llm.common import table
from cohortlens.llm.registry import ORACLES, QUERIES

#: Model file of the public tokenizer that documents are encoded with.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Vocabulary file of the byte-level tokenizer that it is aligned with.
BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    shape = "conv_id long, turn long, role string, text string"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], shape)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.windows(turns.unionByName(extra)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.protect(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = toxicity.training_fold()
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold)
    held_out = F.coalesce(~fold, F.lit(False))
    return toxicity.score(docs, model).withColumn("held_out", held_out)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extracted(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    conv = F.col("conv_id").cast("long")
    grafts = said.select(conv.alias("conv_id")).filter("conv_id IS NOT NULL").distinct()
    grafts = grafts.withColumn("from_id", F.col("conv_id") - F.col("conv_id") % 100)
    crc = F.crc32(F.col("conv_id").cast("string").cast("binary"))
    return trie.nodes(said, grafts.withColumn("turns", crc % 6))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(neighbours.build(vectors), vectors.filter("vec_id % 100 = 0"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digests(table(spark, sf_dir, "documents"), BYTE_LEVEL, PIECE_MODEL)


for _query in (
    op1_sentencepiece,
    op2_license_scan,
    op3_chat_format,
    op4_quality_rules,
    op5_decontaminate,
    op6_pii_surrogates,
    op7_toxicity,
    op8_url_filter,
    op9_ngram_jaccard,
    op10_html_extract,
    op11_prefix_trie,
    op12_nearest_neighbours,
    op13_tokenizer_alignment,
):
    QUERIES[_query.__name__] = _query
ORACLES["op3_chat_format"] = oracles.CHAT_FORMAT
ORACLES["op9_ngram_jaccard"] = oracles.NGRAM_JACCARD
ORACLES["op11_prefix_trie"] = oracles.PREFIX_TRIE
