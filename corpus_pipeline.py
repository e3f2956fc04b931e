"""A corpus pipeline of five stages; each takes what the one before kept.

STAGES holds (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a
DataFrame.  All but the last return the columns of `documents`.

In each stage a null id is as good as any, columns beyond those of `documents` stay, whatever their names, texts of
any length are taken whole, and an empty table gives an empty one.  Repeated rows are each kept or each removed, but for the
near duplicates, of which one stays.  A null or an empty text is rejected by the first stage; the others keep it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, jaccard, language, packing, secrets
from lodestone.llm.session import kept, read


#: The least score of a text in a learned language.  On sf0.1 the lowest of 10,000 documents is 0.39; sentences in Polish, Finnish,
#: Greek, Russian and Japanese, random letters and one letter repeated have 0.25 at most.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without text or a letter in it, and those whose distance to every learned profile is more
    than 1 - LEAST_SCORE of the largest possible one.  Without any profile all texts with a letter stay."""
    profiles = language.fit(docs)
    if not profiles:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return language.predict(docs, profiles).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group that the Jaccard join links."""
    return jaccard.deduplicated(docs)


def drop_benchmark_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every document that holds a benchmark window, however little of it that is."""
    return decontaminate.remove(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents and masks the secrets in them."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of what is left into sequences."""
    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_benchmark_documents),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Tokenizing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
