"""A pipeline over `documents`: language ID, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents. run() writes each stage's rows as Parquet in the shared folder and reads them again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import fresh
from siltstone.llm.decontaminate import decontaminate
from siltstone.llm.langid import fitted, identify
from siltstone.llm.mixing import NAMES, mix_sources, repeat_rows
from siltstone.llm.ngram_join import jaccard_stays
from siltstone.llm.sharding import shard_rows_whole
from siltstone.session import dealt, remove, shared_dir, table

#: A document of which no n-gram list comes this near to any language's profile is no language that was learned.
LEAST_SCORE = 0.15
SHARDS = 16


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that was learned: null texts, texts without a letter and texts far from every profile go."""
    names = (fresh(docs, "_lang_pred"), fresh(docs, "_lang_score"))
    judged = identify(docs, fitted(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")), names=names)
    return judged.where((F.col(names[0]) != "und") & (F.col(names[1]) >= LEAST_SCORE)).select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 0.8 of their shingles of five words, the one with the smallest id."""
    return jaccard_stays(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document."""
    names = tuple(fresh(docs, f"_{n}") for n in NAMES)
    return repeat_rows(mix_sources(docs, names=names), names[NAMES.index("copies")]).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their slot in it."""
    return shard_rows_whole(docs, SHARDS)


STAGES = [("language_id", language_id), ("ngram_join", ngram_join), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]
#: Rank-order profiles and 64-bit shingle hashes have no practical SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the stages make of documents."""
    docs = dealt(table(spark, sf_dir, "documents"))
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")  # its successor is written
    return docs


QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
