"""Exact deduplication by content-defined chunk recipes.

Each text is cut where a rolling hash of its last 64 bytes has its low bits zero, so equal passages are cut alike. A
document becomes its recipe, the ordered list of its chunks' identifiers. Identifiers are verified: the bytes behind
each identifier are grouped, and where one identifier stands for different bytes the recipes that hold it are rewritten
with a number for each variant. Recipes, a hundredth of the texts, are then compared instead of the texts, which are
read where they lie; only distinct chunks move, once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import need
from siltstone.session import settle, small, table

#: Bytes of a chunk: at least, on average beyond that, and at most.
LEAST, AVERAGE, MOST = 512, 2048, 16384
#: Bytes hashed at once, so that a long text needs no more memory than this times about 30.
SLICE = 1 << 20
_GEAR = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64)


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of data, the last one being its length."""
    marks, n = [], len(data)
    if n > LEAST:
        raw = np.frombuffer(data, np.uint8)
        for start in range(0, n, SLICE):
            lead = min(63, start)
            h = _GEAR[raw[start - lead : start + SLICE]]
            for k in (1, 2, 4, 8, 16, 32):  # after the step with k, each hash covers 2k bytes
                h[k:] += h[:-k] << np.uint64(k)
            marks.append(np.flatnonzero((h[lead:] >> np.uint64(40)) % np.uint64(AVERAGE) == 0) + start + 1)
    ends, last = [], 0
    for m in (int(x) for part in marks for x in part):
        while m - last > MOST:
            last += MOST
            ends.append(last)
        if m - last >= LEAST and m < n:
            last = m
            ends.append(m)
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return [*ends, n] if n > last else ends


def normal(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").lower()


def chunk_id(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def pieces(text: str | None) -> list[bytes]:
    data, start, out = normal(text), 0, []
    for end in cut_points(data):
        out.append(data[start:end])
        start = end
    return out


def _recipes(make_id: Callable[[bytes], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            recipes, digests = [], []
            for t in b.column("_text"):
                parts = pieces(t.as_py())
                recipes.append([make_id(p) for p in parts])
                digests.append(hashlib.sha256(b"".join(parts)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_row"), pa.array(recipes, pa.list_(pa.binary())), pa.array(digests, pa.string())], names=["_id", "_row", "recipe", "text_sha256"])

    return run


def _chunks(make_id: Callable[[bytes], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):  # some MB at a time
                rows = [(make_id(p), p) for t in b.column("_text").slice(i, 256) for p in pieces(t.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["id", "chunk"])

    return run


def _placed(make_id: Callable[[bytes], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r, k, make_id(p), p) for r, t in zip(b.column("_row").to_pylist(), b.column("_text"), strict=True) for k, p in enumerate(pieces(t.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else ([], [], [], []), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["_row", "k", "id", "chunk"])

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, make_id: Callable[[bytes], bytes] = chunk_id) -> DataFrame:
    """A row for each row of docs: its id, keep_id, group_size, kept, n_chunks, text_sha256 (of the normalised text).

    Texts are equal if identical after lower-casing A-Z; null and empty texts are equal. Of equal texts the row with the
    largest id stays; null ids come below all others, and of rows that repeat id and text exactly one stays. An empty
    table gives no row. Other columns of docs are not read.
    """
    need(docs, id_col, text)
    rows = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    recipes = settle(rows.mapInArrow(_recipes(make_id), f"_id {kind}, _row long, recipe array<binary>, text_sha256 string"))
    chunks = rows.select("_text").mapInArrow(_chunks(make_id), "id binary, chunk binary")
    doubtful = settle(chunks.groupBy("id", "chunk").agg(F.count("*").alias("n")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    if doubtful.limit(1).count():  # one identifier, different bytes
        placed = rows.select("_row", "_text").mapInArrow(_placed(make_id), "_row long, k int, id binary, chunk binary").join(doubtful.withColumnRenamed("id", "_d"), F.col("id") == F.col("_d"), "left_semi")
        variants = placed.select("id", "chunk").distinct().withColumn("v", F.row_number().over(Window.partitionBy("id").orderBy("chunk")))
        named = placed.join(variants, ["id", "chunk"]).groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_v"))
        fixed = F.transform("recipe", lambda x, i: F.concat(x, F.coalesce(F.element_at("_v", i), F.lit(0)).cast("string").cast("binary")))
        recipes = settle(recipes.join(named, "_row", "left").withColumn("recipe", F.when(F.col("_v").isNull(), F.transform("recipe", lambda x: F.concat(x, F.lit("0").cast("binary")))).otherwise(fixed)).drop("_v"))
    groups = recipes.groupBy(F.col("recipe").alias("_recipe")).agg(F.count("*").alias("_size"), F.max(F.struct("_id", "_row")).alias("_best"))
    groups = settle(groups.where("_size > 1"))  # a recipe that one document has needs no partner
    out = recipes.join(small(groups), F.col("recipe") == F.col("_recipe"), "left")  # beyond the bound both sides are plain tables, so that adaptive execution splits a hot recipe
    best = F.coalesce("_best", F.struct("_id", "_row"))
    return out.select(F.col("_id").alias(id_col), best["_id"].alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"), (F.col("_row") == best["_row"]).alias("kept"), F.size("recipe").alias("n_chunks"), "text_sha256")


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
