"""Mixing sources to target weights by hash-threshold histograms.

Tokens are summed by source and hash bucket. The running sum over the buckets finds, for each source, the bucket in
which the source's budget ends; only the rows of that bucket are looked at again, with the next 12 bits of their hash,
until a bucket holds one hash value. What remains is one threshold a source, so that the mix is a filter: no row is
sorted, and two budgets of one source give nested sets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import fresh, hash60, need
from siltstone.llm.sharding import numbered
from siltstone.session import dealt, release, settle, small, table

WORD = r"[^\x20\x09-\x0D]+"
BITS, LEVEL = 60, 12
NAMES = ("size", "source_size", "target", "copies", "taken")


def even_weights(place: Column) -> Column:
    """3, 1, 2, repeating, for the place of a source in order, from 0."""
    return F.when(place % 3 == 0, 3.0).when(place % 3 == 1, 1.0).otherwise(2.0)


def water_fill(sources: DataFrame, share: float, most: float) -> DataFrame:
    """sources (n and weight a row) with target: by weight, adding up to share * sum(n), none above most * n; the excess goes to the others by weight.

    One rate for a unit of weight serves all sources below their limit. It only rises as limits are met, so it is found
    by a few sums over the sources, of which none comes to the driver.
    """
    limit = F.lit(float(most)) * F.col("n")
    budget = float(share) * (sources.agg(F.sum("n")).first()[0] or 0)
    rate, met = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(rate) >= limit if met >= 0 else F.lit(False)
        r = sources.agg(F.count_if(full).alias("met"), F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)).alias("capped"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("free")).first()
        if r["met"] == met or not r["free"]:
            break
        rate, met = max(0.0, (budget - r["capped"]) / r["free"]), r["met"]
    return sources.withColumn("target", F.when(full, limit).otherwise(F.least(F.col("weight") * F.lit(rate), limit)))


def thresholds(sized: DataFrame, budgets: DataFrame, size: str, h: str) -> DataFrame:
    """_s and _cut: for each source (_s, _budget) the hash below which rows are in, so that their sizes add up to the budget but for the nearest whole hash value.

    sized: _source, and size and hash by name. Of a source only one row goes from level to level: the bucket in which its
    budget ends, and the sizes before it.
    """
    state = settle(budgets.select("_s", F.col("_budget").cast("double").alias("_budget"), F.lit(0).cast("long").alias("_low"), F.lit(0).cast("long").alias("_before"), F.when(F.col("_budget") <= 0, F.lit(0)).cast("long").alias("_cut")))
    run = Window.partitionBy("_s").orderBy("_b")  # at most 4096 rows a source
    for shift in range(BITS - LEVEL, -1, -LEVEL):
        open_ = state.where("_cut IS NULL")
        inside = sized.join(small(open_), F.col("_source").eqNullSafe(F.col("_s")) & (F.col(h) >= F.col("_low")) & (F.col(h) < F.col("_low") + F.lit(1 << (shift + LEVEL))))
        buckets = inside.groupBy("_s", (F.col("_budget") - F.col("_before")).alias("_left"), F.shiftright(F.col(h) - F.col("_low"), shift).alias("_b")).agg(F.sum(size).alias("_n"))
        ends = buckets.withColumn("_upto", F.sum("_n").over(run)).where("_upto > _left")
        ends = ends.groupBy("_s").agg(F.min(F.struct("_b", "_n", "_upto")).alias("_e")).select(F.col("_s").alias("_t"), "_e")
        low, before = F.col("_low") + F.shiftleft("_e._b", shift), F.col("_before") + F.col("_e._upto") - F.col("_e._n")
        nearer = before + F.col("_e._n") - F.col("_budget") < F.col("_budget") - before  # the hash value that the budget cuts is in if that comes nearer
        cut = F.when(F.col("_cut").isNotNull(), F.col("_cut")).when(F.col("_e").isNull(), F.col("_low") + F.lit(1 << (shift + LEVEL)))  # the budget takes the whole bucket
        if not shift:
            cut = cut.otherwise(low + nearer.cast("int"))
        new = settle(state.join(ends, F.col("_s").eqNullSafe(F.col("_t")), "left").select("_s", "_budget", F.coalesce(low, "_low").alias("_low"), F.coalesce(before, "_before").alias("_before"), cut.alias("_cut")))
        release(state)
        state = new
    return state.select("_s", "_cut")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", *, weights: Callable[[Column], Column] = even_weights, share: float = 1.5, most: float = 2.0, seed: str = "mix", names: tuple[str, str, str, str, str] = NAMES) -> DataFrame:
    """docs with size, source_size, target, copies, taken, or as `names` calls them.

    A row's copies are the whole times that its source's target holds the source's size, and one more if the row's hash
    is below the source's threshold for the rest. Null and empty texts have size 0 and are taken like others. A null
    source is a source of its own, last in order. A null id hashes as empty; rows with equal id and text share a hash,
    so they are in or out together. An empty table gives no row. Columns of docs with one of the five names are
    replaced; any other column stays, whatever its name. Sources may be as many as documents.
    """
    need(docs, id_col, text, source)
    docs = docs.drop(*[c for c in names if c not in (id_col, text, source)])
    size, source_size, target, copies, taken = names
    mark = fresh(docs, "_mix")
    counted = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    hashed = hash60(id_col, F.md5(F.coalesce(F.col(text), F.lit(""))), seed=seed)
    slim = settle(docs.select(F.col(source).cast("string").alias("_source"), counted.alias("_size"), hashed.alias("_hash")))
    sums = slim.groupBy(F.col("_source").alias("_s"), F.col("_source").isNull().alias("_last")).agg(F.sum("_size").alias("n"))
    places = numbered(sums, ["_last", "_s"], "_place")
    filled = water_fill(settle(places.select("_s", "n", weights(F.col("_place")).cast("double").alias("weight"))), share, most)
    whole = F.when(F.col("n") > 0, F.least(F.lit(int(most)), F.floor(F.col("target") / F.col("n")))).otherwise(0).cast("int")
    plan = settle(filled.select("_s", "n", "target", whole.alias("_whole")))
    cuts = thresholds(slim, plan.select("_s", (F.col("target") - F.col("_whole") * F.col("n")).alias("_budget")), "_size", "_hash").withColumnRenamed("_s", "_c")
    joined = plan.join(cuts, F.col("_s").eqNullSafe(F.col("_c")))
    each = small(settle(joined.select(F.struct("_s", "n", "target", "_whole", "_cut").alias(mark))))
    out = docs.withColumns({f"{mark}_n": counted, f"{mark}_h": hashed}).join(each, F.col(source).cast("string").eqNullSafe(F.col(f"{mark}._s")), "left")
    times = F.col(f"{mark}._whole") + (F.col(f"{mark}_h") < F.col(f"{mark}._cut")).cast("int")
    return out.select(*docs.columns, F.col(f"{mark}_n").alias(size), F.col(f"{mark}.n").alias(source_size), F.col(f"{mark}.target").alias(target), times.alias(copies), (F.col(f"{mark}_n") * times).alias(taken))


def repeat_rows(mixed: DataFrame, copies: str = "copies") -> DataFrame:
    """A row for each copy that the mix takes."""
    one = fresh(mixed, "_copy")
    return mixed.where(F.col(copies) > 0).withColumn(one, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(one)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mix_sources(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "copies")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS w, 2e0 * n AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, i) AS k, sum(cap) OVER (ORDER BY cap / w, i) - cap AS capped, sum(w) OVER () - sum(w) OVER (ORDER BY cap / w, i) + w AS free FROM w),
r AS (SELECT *, (1.5e0 * sum(n) OVER () - capped) / free AS rate FROM o),
f AS (SELECT *, min(CASE WHEN cap / w > rate THEN k END) OVER () AS first FROM r),
t AS (SELECT source, n, CASE WHEN first IS NULL OR k < first THEN cap ELSE w * min(CASE WHEN k = first THEN rate END) OVER () END AS target FROM f),
b AS (SELECT source, n, target, CASE WHEN n = 0 THEN 0 ELSE least(2, floor(target / n)) END AS whole FROM t),
c AS (SELECT d.doc_id, d.size, b.n, b.target, b.whole, b.target - b.whole * b.n AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
x AS (SELECT *, (budget > 0 AND (upto <= budget OR (upto - own <= budget AND upto - budget < budget - (upto - own)))) AS taken_in FROM c)
SELECT doc_id, size::BIGINT AS size, n::BIGINT AS source_size, round(target, 6) AS target,
       (size * (whole + taken_in::INT))::BIGINT AS taken, (whole + taken_in::INT)::INT AS copies
FROM x
"""
