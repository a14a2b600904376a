"""Session helpers: table reading, the shared scratch folder, size-checked broadcast."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is hinted as broadcast only when it has been counted and has at most so many rows.
BROADCAST_ROWS = 200_000
#: Bytes of a table for each core, below which it is dealt out anew before dear work on its rows.
PER_CORE = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_bytes(df: DataFrame) -> int:
    """Bytes of the files that df reads, whole files, as columns that are left out make them look smaller than they are; huge where Spark does not know."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def pieces(df: DataFrame, each: int = PER_CORE) -> int:
    """Into how many parts to deal df, so that none grows with the table: one for each core, and for each `each` bytes of its files."""
    context, size = df.sparkSession.sparkContext, file_bytes(df)
    known = -(-size // each) if size < 1 << 50 else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(context.defaultParallelism, known)


def by_id(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs dealt by their ids into parts of bounded size: what is grouped by id and more needs no other exchange, so texts move and not their words."""
    return docs.repartition(pieces(docs, PER_CORE // 2), key)


def dealt(df: DataFrame) -> DataFrame:
    """df dealt out to all cores if it has less than PER_CORE bytes for each, as files that small are often one piece that one task reads; else as it lies.

    Only the plan differs. Places of rows are not kept, so nothing may tell rows apart by them in two reads.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if file_bytes(df) < PER_CORE * cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all run in one JVM (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share with the driver")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="siltstone-"))
    return context._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so lost executors cost no lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Removes what settle wrote for df, once nothing reads it any more. Only for a frame that settle itself returned."""
    spark = df.sparkSession
    plan = df._jdf.queryExecution().logical()
    found = plan.rdd().getCheckpointFile()
    if found.isDefined():
        remove(spark, found.get())


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows at most `limit` rows, else df as it is: a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
