"""Micro-batch ingestion: every batch of documents becomes one segment, written again as a whole if the batch is repeated."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.catalog import query
from siltstone.operators.lexical import _base, worded
from siltstone.session import PER_CORE, file_bytes, shared_dir, table


def ingest(spark: SparkSession, source: str, segments: str, checkpoint: str, files_per_batch: int = 1, source_glob: str = "*.parquet") -> None:
    """Reads what is new below source and writes one segment a batch; a batch that is repeated overwrites its own segment."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", source_glob).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        postings = worded(batch).select("doc_id", F.explode(F.array_distinct("words")).alias("term"))
        postings.write.mode("overwrite").parquet(f"{segments}/segment_id={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, segments: str) -> DataFrame:
    """All segments that are there now."""
    return spark.read.parquet(segments)


@query("stream_segments", f"{_base()} SELECT term, count(*) AS df FROM p GROUP BY term")
def stream_segments(spark, sf_dir):
    """documents streamed in as segments, then document frequencies over all segments."""
    folder = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = max(4, -(-file_bytes(docs) // PER_CORE))  # files of bounded size, a batch of two, or an eighth of many
    docs.repartition(n, "doc_id").write.parquet(f"{folder}/in")
    ingest(spark, f"{folder}/in", f"{folder}/segments", f"{folder}/state", max(2, -(-n // 8)))
    return current(spark, f"{folder}/segments").groupBy("term").agg(F.count("*").alias("df"))
