"""End to end: load, parse, chunk, embed, index, retrieve, prompt."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.catalog import query
from siltstone.functions import text as T
from siltstone.session import table

DIMS, TOP = 64, 4


def hashed_vector(text: str, dims: int = DIMS) -> list[float]:
    """A stand-in for a model where none is at hand: signed feature hashing of words, of unit length."""
    v = np.zeros(dims)
    for w in (text or "").lower().split():
        h = zlib.crc32(w.encode())
        v[h % dims] += 1 if h & 0x10000 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def embed(chunks: DataFrame, column: str = "chunk", model=hashed_vector) -> DataFrame:
    run = F.pandas_udf(lambda s: pd.Series([model(x) for x in s]), "array<double>", F.PandasUDFType.SCALAR)
    return chunks.withColumn("vector", run(F.col(column)))


def retrieve(index: DataFrame, question: str, k: int = TOP, model=hashed_vector) -> DataFrame:
    """The k chunks nearest to a question, one best row first."""
    q = F.array(*[F.lit(float(x)) for x in model(question)])
    return index.withColumn("score", F.round(T.dot(F.col("vector"), q), 6)).orderBy(F.desc("score"), "source", "start").limit(k)


def prompt(found: DataFrame, question: str) -> DataFrame:
    """One row: the passages under their sources, and the question."""
    rows = found.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("source").cast("string").alias("source"), "start", "chunk"))).alias("t"))
    blocks = F.array_join(F.transform("t", lambda s: F.concat(F.lit("["), s["source"], F.lit("] "), s["chunk"])), "\n\n")
    return rows.select(F.concat(F.lit("Answer from these passages only.\n\n"), blocks, F.lit(f"\n\nQuestion: {question}\n")).alias("prompt"))


def run(docs: DataFrame, question: str, k: int = TOP) -> DataFrame:
    chunks = T.chunk_fixed(docs.select(F.col("doc_id").alias("source"), "text"), size=1000, overlap=200, stripped=True)
    return prompt(retrieve(embed(chunks), question, k), question)


@query("naive_pipeline")
def naive_pipeline(spark, sf_dir, question="then thereon and the than"):
    return run(table(spark, sf_dir, "documents"), question)
