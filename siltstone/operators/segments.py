"""Segments: block-wise builds, merging, search with fan-out, gaps and code lengths, and the merge policy.

A segment is a partition of the postings table. Building, merging and searching are grouped aggregations; only the merge
policy, which looks at one row for each segment, runs on the driver.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.catalog import query
from siltstone.functions.text import running_sums
from siltstone.operators.lexical import RANGE, _base, joined, lists, passages, worded
from siltstone.session import pieces, remove, settle, shared_dir, table
from siltstone.sources.files import write_segments

#: Documents of a block and of a batch; slices of the ids that are segments, few and many.
BLOCK, PARTS, MANY = 250, 4, 64


def block_postings(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """block, term, doc_id: each document's terms once."""
    return worded(docs).select(F.floor(F.col("doc_id") / F.lit(size)).alias("block"), "doc_id", F.explode(F.array_distinct("words")).alias("term"))


def gaps(ids: Column) -> Column:
    """First differences of a sorted list, the first one from 0."""
    return F.transform(ids, lambda x, i: x - F.coalesce(F.get(ids, i - 1), F.lit(0)))


def from_gaps(steps: Column) -> Column:
    """Running sums: the inverse of gaps."""
    return running_sums(steps)


def code_length(value: Column) -> Column:
    """Bytes of a number at seven bits a byte."""
    out = F.lit(5)
    for n, most in ((4, 1 << 28), (3, 1 << 21), (2, 1 << 14), (1, 1 << 7)):
        out = F.when(value < most, F.lit(n)).otherwise(out)
    return out


def tier(n: int, fan: int) -> int:
    """The size class of a segment of n >= 1 documents."""
    return int(math.log(n, fan)) if n else 0


def merge_plan(segments: list[tuple[str, int]], fan: int = 4) -> tuple[list[list[str]], int]:
    """Which segments (name, documents) end up together, and how many documents are written again on the way.

    While some size class has `fan` members, the first `fan` of the lowest such class become one segment at the end of
    the list.
    """
    live = [([name], n) for name, n in segments]
    rewritten = 0
    while True:
        classes: dict[int, list[int]] = {}
        for i, (_, n) in enumerate(live):
            classes.setdefault(tier(max(n, 1), fan), []).append(i)
        full = sorted(t for t, members in classes.items() if len(members) >= fan)
        if not full or fan < 2:
            return [names for names, _ in live], rewritten
        chosen = classes[full[0]][:fan]
        merged = ([x for i in chosen for x in live[i][0]], sum(live[i][1] for i in chosen))
        rewritten += merged[1]
        live = [s for i, s in enumerate(live) if i not in set(chosen)] + [merged]


def segment_postings(docs: DataFrame, parts: int = PARTS) -> DataFrame:
    """segment_id, term, doc_id: contiguous slices of the ids."""
    n = docs.agg(F.max("doc_id")).first()[0] or 0
    return block_postings(docs, -(-(n + 1) // parts)).withColumnRenamed("block", "segment_id")


_IDS = "SELECT doc_id // {size} AS block, doc_id, unnest(list_distinct(w)) AS term FROM d"
_SEG = f"{_base()}, z AS (SELECT (max(doc_id) + {PARTS}) // {PARTS} AS size FROM documents), g AS (SELECT doc_id // (SELECT size FROM z) AS segment_id, doc_id, unnest(list_distinct(w)) AS term FROM d)"


@query("spimi_blocks", f"{_base()}, b AS ({_IDS.format(size=BLOCK)}) SELECT block::BIGINT AS block, term, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS doc_ids FROM b GROUP BY ALL")
def spimi_blocks(spark, sf_dir):
    lists = block_postings(passages(spark, sf_dir)).groupBy("block", "term").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return lists.select("block", "term", F.array_join(F.col("ids").cast("array<string>"), ",").alias("doc_ids"))


_PART = f"doc_id // {RANGE} AS part"


@query("spimi_merge", f"{_base()} SELECT term, {_PART}, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS doc_ids FROM p GROUP BY ALL")
def spimi_merge(spark, sf_dir):
    """Runs of the blocks joined in block order, as each run is sorted and blocks follow one another; a list is cut by ranges of ids."""
    runs = block_postings(passages(spark, sf_dir)).groupBy(F.floor(F.col("doc_id") / RANGE).alias("part"), "block", "term").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    merged = runs.groupBy("term", "part").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "ids"))), lambda r: r["ids"])).alias("ids"))
    return merged.select("term", "part", F.size("ids").cast("long").alias("n"), joined(F.col("ids")).alias("doc_ids"))


_GAP = f"doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term, doc_id // {RANGE} ORDER BY doc_id), 0) AS gap"


@query("gaps", f"{_base()}, g AS (SELECT term, doc_id, {_PART}, {_GAP} FROM p) SELECT term, part, string_agg(gap::VARCHAR, ',' ORDER BY doc_id) AS gaps FROM g GROUP BY ALL")
def q_gaps(spark, sf_dir):
    return lists(passages(spark, sf_dir)).select("term", "part", joined(gaps(F.col("ids"))).alias("gaps"))


@query("varbyte_sizes", f"""{_base()}, g AS (SELECT {_GAP} FROM p),
l AS (SELECT CASE WHEN gap < 128 THEN 1 WHEN gap < 16384 THEN 2 WHEN gap < 2097152 THEN 3 WHEN gap < 268435456 THEN 4 ELSE 5 END AS n FROM g)
SELECT count(*) AS postings, 4 * count(*) AS raw_bytes, sum(n)::BIGINT AS varbyte_bytes, round(4e0 * count(*) / sum(n), 6) AS ratio, round(sum(n) / count(*)::DOUBLE, 6) AS bytes_per_posting FROM l""")
def varbyte_sizes(spark, sf_dir):
    """Gaps are taken within a list's range of ids, so that no task holds all of a frequent term."""
    rows = worded(passages(spark, sf_dir)).select("doc_id", F.explode(F.array_distinct("words")).alias("term"))
    before = F.lag("doc_id").over(Window.partitionBy("term", F.floor(F.col("doc_id") / RANGE)).orderBy("doc_id"))
    n = code_length(F.col("doc_id") - F.coalesce(before, F.lit(0)))
    return rows.select(n.alias("n")).agg(F.count("*").alias("postings"), (4 * F.count("*")).alias("raw_bytes"), F.sum("n").alias("varbyte_bytes"), F.round(F.lit(4.0) * F.count("*") / F.sum("n"), 6).alias("ratio"), F.round(F.sum("n") / F.count("*"), 6).alias("bytes_per_posting"))


@query("segment_build", f"{_SEG} SELECT segment_id, count(DISTINCT doc_id) AS n_docs, count(*) AS n_postings, count(DISTINCT term) AS n_terms FROM g GROUP BY segment_id")
def segment_build(spark, sf_dir):
    return segment_postings(passages(spark, sf_dir)).groupBy("segment_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_postings"), F.count_distinct("term").alias("n_terms"))


@query("segment_search", f"{_SEG} SELECT DISTINCT doc_id, (SELECT count(DISTINCT segment_id) FROM g) AS fan_out FROM g WHERE term = 'then'")
def segment_search(spark, sf_dir, term="then"):
    """Distinct documents over all segments; the fan-out counts segments, not hits."""
    all_ = segment_postings(passages(spark, sf_dir))
    fan = all_.select("segment_id").distinct().count()
    return all_.where(F.col("term") == term).select("doc_id").distinct().withColumn("fan_out", F.lit(fan).cast("long"))


@query("segment_fanout", f"{_SEG} SELECT term, count(DISTINCT segment_id) AS reads FROM g GROUP BY term")
def segment_fanout(spark, sf_dir):
    """Segments that have a term: the reads that a search of it takes."""
    return segment_postings(passages(spark, sf_dir)).select("term", "segment_id").distinct().groupBy("term").agg(F.count("*").alias("reads"))


@query("segment_merge", f"{_SEG} SELECT term, {_PART}, string_agg(DISTINCT doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) AS doc_ids FROM g GROUP BY ALL")
def segment_merge(spark, sf_dir):
    """All segments as one; a list is cut by ranges of ids."""
    rows = segment_postings(passages(spark, sf_dir)).groupBy("term", F.floor(F.col("doc_id") / RANGE).alias("part"))
    return rows.agg(F.array_join(F.sort_array(F.collect_set(F.col("doc_id").cast("string"))), ",").alias("doc_ids"))


def manifest(postings: DataFrame) -> list[tuple[str, int]]:
    """Name and documents of each segment, a row for each."""
    rows = postings.groupBy("segment_id").agg(F.count_distinct("doc_id").alias("n")).orderBy("segment_id").collect()
    return [(str(r["segment_id"]), r["n"]) for r in rows]


@query("merge_policy", f"""WITH RECURSIVE z AS (SELECT (max(doc_id) + {MANY}) // {MANY} AS size FROM documents),
c AS (SELECT doc_id // (SELECT size FROM z) AS s, count(*) AS n FROM documents GROUP BY 1),
m AS (SELECT list({{'n': n, 'parts': 1::BIGINT}} ORDER BY s) AS live, 0::BIGINT AS rewritten FROM c
UNION ALL
SELECT list_append(list_transform(list_filter(range(1, len(live) + 1), lambda i: NOT list_contains(pos, i)), lambda i: live[i]), {{'n': n, 'parts': parts}}), rewritten + n
FROM (SELECT *, list_sum(list_transform(pos, lambda i: live[i].n))::BIGINT AS n, list_sum(list_transform(pos, lambda i: live[i].parts))::BIGINT AS parts
FROM (SELECT *, list_filter(range(1, len(live) + 1), lambda i: tiers[i] = tier)[1:4] AS pos
FROM (SELECT *, list_min(list_filter(tiers, lambda u: len(list_filter(tiers, lambda v: v = u)) >= 4)) AS tier
FROM (SELECT *, list_transform(live, lambda x: floor(ln(x.n) / ln(4))) AS tiers FROM m))) WHERE tier IS NOT NULL))
SELECT (i - 1)::INT AS segment, live[i].parts::INT AS parts, live[i].n AS docs, rewritten
FROM (SELECT *, unnest(range(1, len(live) + 1)) AS i FROM (SELECT * FROM m ORDER BY rewritten DESC LIMIT 1))""")
def merge_policy(spark, sf_dir, fan=4):
    """group, segments and docs after the policy has run over 64 slices of the ids."""
    n = (table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0] or 0) + 1
    rows = passages(spark, sf_dir).groupBy(F.floor(F.col("doc_id") / F.lit(-(-n // MANY))).alias("s")).count().orderBy("s").collect()
    counts = {str(r["s"]): r["count"] for r in rows}
    groups, rewritten = merge_plan(list(counts.items()), fan)
    return spark.createDataFrame([(i, len(g), sum(counts[x] for x in g), rewritten) for i, g in enumerate(groups)], "segment int, parts int, docs long, rewritten long")


def compact(spark: SparkSession, stored: str, to: str, fan: int = 4) -> int:
    """Applies the merge policy to stored segments and writes the outcome; returns how many documents were written again.

    The plan is made of one row a segment; merging is one pass that gives each posting its new segment.
    """
    postings = spark.read.parquet(stored)
    groups, rewritten = merge_plan(manifest(postings), fan)
    names = spark.createDataFrame([(int(x), i) for i, g in enumerate(groups) for x in g], "_old long, _new long")
    moved = postings.join(F.broadcast(names), F.col("segment_id") == F.col("_old")).select(F.col("_new").alias("segment_id"), "term", "doc_id")
    write_segments(moved, to)
    return rewritten


def _by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents by ranges of ids in parts of bounded size: a part's postings go to the files of one or a few segments."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.repartitionByRange(pieces(docs), "doc_id")


@query("stored_segment_search", f"{_SEG} SELECT DISTINCT doc_id, (SELECT count(DISTINCT segment_id) FROM g) AS fan_out FROM g WHERE term = 'then'")
def stored_segment_search(spark, sf_dir, term="then"):
    """Segments written to the store, and searched there: the filter on the sorted term skips row groups."""
    folder = f"{shared_dir(spark)}/segments-{uuid.uuid4().hex}"
    write_segments(segment_postings(_by_range(spark, sf_dir)), folder, placed=True)
    stored = spark.read.parquet(folder)
    fan = stored.select("segment_id").distinct().count()
    found = settle(stored.where(F.col("term") == term).select("doc_id").distinct().withColumn("fan_out", F.lit(fan).cast("long")))
    remove(spark, folder)
    return found


@query("compaction", f"{_base()} SELECT term, count(*) AS df, true AS fewer FROM p GROUP BY term")
def compaction(spark, sf_dir):
    """Document frequencies over stored segments after the policy has merged them, and whether there are fewer."""
    folder = f"{shared_dir(spark)}/segments-{uuid.uuid4().hex}"
    write_segments(segment_postings(_by_range(spark, sf_dir), MANY), f"{folder}/old", placed=True)
    compact(spark, f"{folder}/old", f"{folder}/new")
    old, new = (spark.read.parquet(f"{folder}/{x}") for x in ("old", "new"))
    fewer = new.select("segment_id").distinct().count() < old.select("segment_id").distinct().count()
    found = settle(new.groupBy("term").agg(F.count("*").alias("df")).withColumn("fewer", F.lit(fewer)))
    remove(spark, folder)
    return found


@query("tombstones", f"{_SEG} SELECT term, count(*) AS df FROM g WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY term")
def tombstones(spark, sf_dir):
    """Deletes as notes: postings of documents that are marked are left out."""
    dead = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    return segment_postings(passages(spark, sf_dir)).join(dead, "doc_id", "left_anti").groupBy("term").agg(F.count("*").alias("df"))


@query("batch_segments", "SELECT (event_id // 500)::BIGINT AS segment_id, count(*) AS n_docs, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def batch_segments(spark, sf_dir, size=500):
    return table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / size).alias("segment_id")).agg(F.count("*").alias("n_docs"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
