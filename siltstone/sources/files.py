"""Sources and sinks: passages, queries, judgments, binary files, JSON truth, text runs and index files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.session import pieces

#: Ids whose postings stay together in one file of a segment.
SLICE = 4096


def passages_tsv(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """pid, text: lines split at the first tab; bytes that are no UTF-8 become U+FFFD. A limit takes the smallest pids."""
    parts = F.split("value", "\t", 2)
    rows = spark.read.text(path).select(F.element_at(parts, 1).cast("long").alias("pid"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("text"))
    return rows if limit is None else rows.orderBy("pid").limit(limit)


def qrels_tsv(spark: SparkSession, path: str) -> DataFrame:
    """qid, pids: the judged passages of each query; the label is read and ignored."""
    rows = spark.read.csv(path, sep="\t", schema="qid long, iter string, pid long, label string")
    return rows.groupBy("qid").agg(F.collect_set("pid").alias("pids"))


def queries_tsv(spark: SparkSession, path: str) -> DataFrame:
    """qid, query: stripped; of lines with one qid the last in the file stays."""
    parts = F.split("value", "\t", 2)
    rows = spark.read.text(path).select(F.element_at(parts, 1).cast("long").alias("qid"), F.regexp_replace(F.try_element_at(parts, F.lit(2)), r"(?U)^\s+|\s+$", "").alias("query"), F.monotonically_increasing_id().alias("_at"))
    return rows.groupBy("qid").agg(F.max_by("query", "_at").alias("query"))


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, length, content, stem of the files that match."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return rows.withColumn("stem", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1))


def kind_of(content: Column) -> Column:
    """The type that the first bytes tell, whatever the name says."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("89504E47"), "png").when(head.startswith("25504446"), "pdf").when(head.startswith("52494646"), "riff").when(head.startswith("1F8B"), "gzip").when(head.startswith("504B0304"), "zip").otherwise("unknown")


def allocated(length: Column, block: int = 4096) -> Column:
    """Bytes on disk in whole blocks."""
    return F.ceil(length / F.lit(block)) * block


def truth_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON document over many lines, its nested lists as arrays."""
    return spark.read.json(path, multiLine=True)


def there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def require(spark: SparkSession, *paths: str, remedy: str = "") -> None:
    """Fails before any work if an input is missing, and says what to do about it."""
    if missing := [p for p in paths if not there(spark, p)]:
        raise FileNotFoundError(f"missing: {', '.join(missing)}. {remedy}".strip())


def snapshot(df: DataFrame, path: str, rows: int | None = None) -> DataFrame:
    """df from its Parquet snapshot, which is written the first time, and anew if it has not as many rows as given."""
    spark = df.sparkSession
    if there(spark, f"{path}/_SUCCESS"):
        stored = spark.read.parquet(path)
        if rows is None or stored.count() == rows:
            return stored
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0, through all files in order of their names) and value. Places within a partition and the lines before it, a row for each partition, give the number."""
    rows = spark.read.text(path).select(F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i"), F.input_file_name().alias("_f"), "value")
    counts = rows.groupBy("_p", "_f").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    order = Window.orderBy("_f", "_p", "_first")
    before = counts.select(F.col("_p").alias("_q"), F.col("_f").alias("_g"), "_first", (F.sum("_n").over(order) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), (F.col("_p") == F.col("_q")) & (F.col("_f") == F.col("_g"))).select((F.col("_i") - F.col("_first") + F.col("_before")).alias("line"), "value")


def corpus_lines(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """pid and text of the lines whose number is in wanted (line)."""
    lines = numbered_lines(spark, path).join(wanted.select("line").distinct(), "line", "left_semi")
    return lines.select(F.col("line").alias("pid"), F.regexp_extract("value", r"(?s)^[^\t]*\t(.*)$", 1).alias("text"))


#: Sizes by name, and what stands for all.
SCALES = {"10k": 10_000, "50k": 50_000, "100k": 100_000, "1m": 1_000_000}


def scale(name: str, limit: int | None = None) -> int:
    """How many passages a name or a limit stands for; the limit wins."""
    if limit is not None:
        return limit
    if name not in SCALES:
        raise ValueError(f"no such scale: {name}; there are {', '.join(SCALES)}")
    return SCALES[name]


def crossings(length: Column, buffer: int) -> Column:
    """Reads of a file of this length in pieces of `buffer` bytes, the last one empty."""
    return F.ceil(length / F.lit(buffer)) + 1


def write_run(postings: DataFrame, path: str, partitions: int = 1) -> None:
    """Lines `term<TAB>id,id,...`, sorted within each file; terms are dealt by range, so files follow one another."""
    lists = postings.groupBy("term").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    line = F.concat_ws("\t", "term", F.array_join(F.col("ids").cast("array<string>"), ","))
    lists.repartitionByRange(partitions, "term").sortWithinPartitions("term").select(line.alias("value")).write.mode("overwrite").text(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """term, ids of write_run."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).select(F.element_at(parts, 1).alias("term"), F.split(F.element_at(parts, 2), ",").cast("array<long>").alias("ids"))


def write_segments(postings: DataFrame, path: str, placed: bool = False) -> None:
    """Postings by segment; a segment is a partition of the table, its files each sorted by term so that row groups can be skipped.

    A file holds a range of ids, so that no task has a whole segment; `placed`: each part of postings has such a range already.
    """
    near = postings if placed else postings.repartition(pieces(postings), "segment_id", F.floor(F.col("doc_id") / SLICE))
    near.sortWithinPartitions("segment_id", "term", "doc_id").write.mode("overwrite").partitionBy("segment_id").parquet(path)


def small_files(docs: DataFrame, per_file: int = 12) -> DataFrame:
    """file_id, content: documents by order of id, `per_file` a file, joined by line ends."""
    numbered = docs.withColumn("file_id", F.floor(F.col("doc_id") / per_file))
    rows = numbered.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("t"))
    return rows.select("file_id", F.array_join(F.transform("t", lambda s: s["text"]), "\n").alias("content"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the largest order of each key."""
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_r", best).where("_r = 1").drop("_r")
