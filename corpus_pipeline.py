"""Corpus preparation: five stages over ``documents``, each written as Parquet and read back for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontaminate, language_id, near_join, secrets, token_ids
from strandline.llm.common import fresh_name, held_out, materialize, shrink_heaps

#: Near copies: words of a shingle, and the least similarity in hundredths.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
#: Distinct words and units that an encoding task remembers: fewer than by default, as it shares its executor with the
#: workers of the stages before.
WORDS_HELD, UNITS_HELD = 250_000, 120_000


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the profiles know; all columns of documents, unchanged.

    Profiles are made from the labelled documents outside the held-out fifth. What goes is text without any letter, null and empty
    texts, and texts whose n-grams fit the nearest language far worse than its own texts do, by more than their length
    explains: single words stay. Repeated rows stay or go alike; without any labelled document, all go.
    """
    profiles = language_id.fit(docs.filter(~held_out()))
    names = tuple(fresh_name(c) for c in ("lang", "score", "familiar"))
    return language_id.predict(docs, profiles, names=names).filter(F.col(names[2])).select(*[F.col(f"`{c}`") for c in docs.columns])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group of near copies; all columns, unchanged.

    Rows with a null id, null and empty texts, and texts without words stay; of equal rows one stays.
    """
    shrink_heaps(spark)
    return near_join.keep_one(docs, width=SHINGLE_WORDS, percent=SIMILAR_PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark; all columns, unchanged. Null and empty texts stay; repeated rows stay or
    go alike; an empty benchmark lets all stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts masked and n_chars counted anew (null for a null text); other columns unchanged."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids of each text, their number, and the SHA-256 of the bytes that they decode to.

    One row for each document; a null or empty text has no ids and decodes to no bytes.
    """
    import public_tokenizers

    shrink_heaps(spark)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = token_ids.encode(docs, ranks, public_tokenizers.PATTERN, make=token_ids.Decoded, words_held=WORDS_HELD, units_held=UNITS_HELD)
    return ids.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("byte_level_bpe", encoded),
]

#: SQL can't express the stages; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
