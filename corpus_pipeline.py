"""The corpus pipeline: whole documents in, token-id shards out.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and reread as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.llm import decontam, langid, minhash, mixing, repair
from twinlens.llm.queries import language_model
from twinlens.sources.scratch import drop, materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts and texts without a letter.

    Each row is judged by its own text, so null and repeated ids are like others.
    Whole texts are read; an empty table gives an empty result.
    """
    found = langid.identify(docs, language_model(docs), keep=tuple(docs.columns))
    return found.where(f"lang_pred <> '{langid.UNDETERMINED}'").select(*[F.col(f"kept_{c}").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the document of the smallest id stays.

    Null ids come last in that order and are deduplicated like others; different
    texts under one id are judged by themselves; documents without words stay. An
    empty table gives an empty result.
    """
    return minhash.one_of_each(docs, width=5, threshold=0.8)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, whatever their ids; null texts stay. An empty table gives an empty result."""
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate and its coin say; null sources are one source, null texts go, repeated ids toss alike."""
    return mixing.mix(docs)


def encode_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id shards, and what reading them back gives per document; null texts are empty, null ids first, repeats each written."""
    return repair.encode_and_read(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_contaminated),
    ("mixing", mix_sources),
    ("token_shards", encode_shards),
]

#: Language models and byte-pair encoding are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs, path = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop(spark, before)
        before = path
    return docs
