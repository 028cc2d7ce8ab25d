"""A corpus pipeline of five stages, each by one operator of weft.llm.

run(spark, sf_dir) applies STAGES to the documents; each stage works on all that its predecessor kept, and its result
is written as Parquet to the shared folder and read again. Empty tables pass through; null texts are handled as the operators
say, and columns besides those of documents are kept up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import bpe, line_dedup, minhash, mixing, toxicity
from weft.llm.common import rest, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that the classifier, with its threshold for the language, calls toxic. Null and empty texts have a score like others; repeated rows
    share theirs. Without labels nothing is learned and nothing goes."""
    net = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, net).where("not toxic").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them hold; one of which nothing would be left stays whole, for drop_near_duplicates() to
    keep one of its kind. No document goes here. n_chars follows the text. Null and empty texts stay as they are.

    Copies count as one document, so a group of them reaches drop_near_duplicates() whole.
    """
    kept = line_dedup.drop_common_lines(docs, copies_once=True, never_empty=True).select(docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity of 0.8 or more. Null and empty texts are near nothing and stay."""
    rest(spark)
    return minhash.one_of_each(docs).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: taken / size, rounded half up; texts without words stay as they are."""
    mixed = mixing.mix(docs.select(*docs.columns))
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5)).cast("int")
    return mixed.withColumn("__weft_again", F.explode(F.array_repeat(F.lit(0), times))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens and the token ids of each document that the mix holds; a null or empty text has none, repeated rows are encoded alike."""
    found = bpe.encode(docs.select("doc_id", "source", "lang", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_duplicates), ("mixing", mix_sources), ("bpe", encode)]

#: SQL can't express the classifier nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
