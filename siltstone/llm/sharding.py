"""Sharding by proportional stratified interleaving.

The rows of each source are shuffled by a seeded hash and ranked; row r of n gets the fractional rank (r - 1/2) / n. In
the order of fractional ranks the sources alternate in proportion to their sizes, so every run of neighbours has the
mixture of the whole, and cutting that order into equal pieces gives the shards. Both orders are range-partitioned
sorts: a source, however large, is cut over as many partitions as its rows need, and a row's place is its place in its
partition plus the rows in the partitions before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import fresh, hash60, need
from siltstone.session import settle, table

#: Rows of a partition of the two sorts; they carry keys only, no text.
ROWS_PER_PARTITION = 2_000_000
IN_PARTITION = (1 << 33) - 1


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with each row's place, from 0, in the order of keys. Rows with equal keys are interchangeable."""
    parts = max(2 * df.sparkSession.sparkContext.defaultParallelism, df.count() // ROWS_PER_PARTITION)
    tie, part = fresh(df, "_tie"), fresh(df, "_part")
    ordered = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(parts, *keys, tie).sortWithinPartitions(*keys, tie).drop(tie)
    ordered = settle(ordered).withColumn(part, F.spark_partition_id()).withColumn(name, F.monotonically_increasing_id().bitwiseAND(F.lit(IN_PARTITION)))
    counts = ordered.groupBy(part).agg(F.count("*").alias("_rows"))  # a row for each partition
    before = counts.select(part, (F.sum("_rows").over(Window.orderBy(part)) - F.col("_rows")).alias("_before"))
    return ordered.join(F.broadcast(before), part).withColumn(name, F.col(name) + F.col("_before")).drop("_before", part)


def interleave(rows: DataFrame, source: str, h: str, shards: int) -> DataFrame:
    """rows (keys only) with shard and slot: the place in the shard, gapless from 0."""
    rank = numbered(rows, [source, h], "_rank")
    sources = rank.groupBy(source).agg(F.count("*").alias("_n"), F.min("_rank").alias("_first"))  # a row for each source
    sources = sources.select(F.col(source).alias("_s"), "_n", "_first")
    fraction = rank.join(sources, F.col(source).eqNullSafe(F.col("_s")), "left").withColumn("_f", (F.col("_rank") - F.col("_first") + 0.5) / F.col("_n"))
    places = numbered(fraction.drop("_s", "_n", "_first", "_rank"), ["_f", source, h], "_at")
    total = places.count()
    shard = F.expr(f"cast((_at * {shards}) div {max(1, total)} as int)")
    start = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return places.withColumn("shard", shard).withColumn("slot", F.col("_at") - start).drop("_at", "_f")


def shard_rows(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text: str = "text", source: str = "source", *, carry: dict[str, Column] | None = None, seed: str = "shard") -> DataFrame:
    """docs' ids with the columns of `carry`, shard and slot; counts of shards differ by one at most (law `rows`).

    A null source is a source of its own, null ids and texts hash as empty; rows with equal source, id and text are
    interchangeable and each gets a place. Under the law of even counts copies of one text may lie in several shards.
    An empty table gives no row. Texts are hashed where they are read and do not move.
    """
    need(docs, id_col, text, source)
    extra = carry or {}
    slim = docs.select(F.col(id_col), F.col(source).cast("string").alias("_source"), hash60(id_col, F.md5(F.coalesce(F.col(text), F.lit(""))), seed=seed).alias("_h"), *[c.alias(n) for n, c in extra.items()])
    return interleave(slim, "_source", "_h", shards).select(id_col, "shard", "slot", *extra)


def shard_rows_whole(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text: str = "text", source: str = "source", *, seed: str = "shard") -> DataFrame:
    """docs, all columns, with shard and slot. The text moves once, to rows that are told apart by a number in docs."""
    row, own = fresh(docs, "_row"), docs.drop("shard", "slot")
    key = fresh(docs, f"{row}_placed")
    placed = shard_rows(docs, shards, id_col, text, source, carry={row: F.monotonically_increasing_id()}, seed=seed)
    placed = settle(placed.select(F.col(row).alias(key), "shard", "slot"))
    return own.withColumn(row, F.monotonically_increasing_id()).join(placed, F.col(row) == F.col(key)).drop(row, key)


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    body = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    out = shard_rows(docs, 16, carry={"size": (F.octet_length(body) + 1).cast("long"), "text_crc32": F.crc32(body)})
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
