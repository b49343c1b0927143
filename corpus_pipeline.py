"""A training corpus from raw documents: five stages, each written as Parquet before the next reads it.

Every stage takes the rows that its predecessor kept and, but for the last, returns the columns of ``documents``. Rows with null keys or
texts, repeated rows and extra columns are treated as the operators say; an empty table passes through as no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm import byte_bpe, language_id, minmax_dedup, mixing, secret_scan
from tabforge.plans.scale import shared_folder

# A document is rejected when it has no letter, or when two languages are about as likely and neither is above this share.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognisable language; the classifier learns from the labelled ones, missing labels are filled in."""
    columns = docs.columns
    # names of our own, so that no column of the documents meets one that the classifier adds
    own = {c: f"column_{i}" for i, c in enumerate(columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    model = language_id.fit(rows, own["text"], own["lang"])
    out = language_id.predict(rows, model, own["text"])
    sure = (F.col("lang_pred") != language_id.UNKNOWN) & ~(F.col("ambiguous") & (F.col("score") < LEAST_SCORE))
    kept = out.filter(sure).withColumn(own["lang"], F.coalesce(own["lang"], "lang_pred"))
    return kept.select(*[F.col(n).alias(c) for c, n in own.items()])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return minmax_dedup.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, secrets replaced by a mark."""
    columns = docs.columns
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked by decoding them."""
    import public_tokenizers

    out = byte_bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    whole = F.col("decoded") == F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    ids = F.when(whole, F.col("ids")).otherwise(F.raise_error(F.lit("decoded bytes differ from the text")).cast("binary"))
    return out.select("doc_id", "source", "lang", byte_bpe.token_count(F.col("ids")).alias("n_tokens"), ids.alias("ids"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

# Signatures, classifiers and merges are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; the table of a stage is removed when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    files = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    before = None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(before), True)
        before = path
    return docs
