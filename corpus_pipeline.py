"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor wrote and decides over all of it. All but the last return the
columns of documents. A stage's own intermediate tables lie in the session's shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import chunk_recipes, language, packing, pseudonyms, simhash
from larder.llm.queries import KEY, PIECES, VOCABULARY
from larder.session import fresh_path


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents whose language cannot be told go."""
    model = language.learn(docs.where(~language.held_out()), public_tokenizers.path(PIECES))
    return language.reject_unknown(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each group of equal texts stays."""
    return chunk_recipes.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2, with its contract's shingles and distance: one document of each component stays."""
    return simhash.deduplicate(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: personal data gives way to pseudonyms; n_chars follows the new text."""
    return pseudonyms.pseudonymise(docs, KEY).withColumn("n_chars", F.char_length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: pieces of documents in sequences of at most 4096 ids."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), end_id=2)


STAGES = [
    ("language", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("pii", replace_personal_data),
    ("packing", pack_sequences),
]

# Learned language models and dynamic programming over token ids are not for SQL; tests/llm has a plain twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage_{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
