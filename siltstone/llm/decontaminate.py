"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of the k-gram hashes in each window of a benchmark item the smallest is kept as the window's fingerprint, with its
offset. A document's fingerprint is a k-gram whose hash is the smallest of some window of the same length, so every span
as long as a window that both hold gives the same fingerprint in both. Fingerprints are joined, and a hit is extended to
the whole window and compared word by word. Documents' fingerprints are first tested against a bitmap of bounded size made
of the items', so that few of them become rows; words of the neighbourhood travel with them, whole documents never.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import LOWER, UPPER, fresh, need
from siltstone.session import dealt, settle, small, table

#: Words once A-Z is lower-cased; A-Z is let in here and lowered after.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a window and of a k-gram.
WINDOW, GRAM = 10, 5
#: Bits of the bitmap: for each fingerprint, at least, and at most (1 MB in the plan). A fuller bitmap only lets more k-grams through to the join.
BITS, FEWEST, MOST = 128, 1 << 20, 1 << 23


def words_of(text: str) -> Column:
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))
    return F.transform(found, lambda w: F.when(F.regexp_like(w, F.lit("[A-Z]")), F.translate(w, UPPER, LOWER)).otherwise(w))


def gram_hashes(words: Column, n: int) -> Column:
    """The hash of n words from each position on; none if there are fewer words."""
    last = F.size(words) - n
    at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.expr("array()").cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(n), *[F.get(words, i + j) for j in range(n)]))


def lowest(hashes: Column, start: Column, grams: int) -> Column:
    """The smallest of `grams` hashes from position start (from 0) on."""
    return F.array_min(F.slice(hashes, start + 1, F.lit(grams)))


def item_windows(items: DataFrame, item_id: str, text: str, window: int, gram: int) -> DataFrame:
    """A row for each different window and place of its fingerprint: h, back (words before it), window, item_ids."""
    own = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("_item"), words_of(text).alias("_w")).where(F.size("_w") > 0)
    long = own.where(F.size("_w") >= window).withColumn("_g", gram_hashes(F.col("_w"), gram))
    starts = long.select("_item", "_w", "_g", F.explode(F.sequence(F.lit(0), F.size("_w") - window)).alias("_s"))
    least = starts.withColumn("_h", lowest(F.col("_g"), F.col("_s"), window - gram + 1))
    backs = least.select("_item", "_h", F.slice("_w", F.col("_s") + 1, F.lit(window)).alias("_window"), F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(window - gram)), lambda o: F.when(F.get(F.col("_g"), F.col("_s") + o) == F.col("_h"), o)), lambda o: o.isNotNull())).alias("_back"))
    rows = backs.select("_item", "_h", "_back", "_window")
    for n in range(1, window):  # items shorter than a window are one window, hashed whole
        short = own.where(F.size("_w") == n)
        rows = rows.unionByName(short.select("_item", gram_hashes(F.col("_w"), n)[0].alias("_h"), F.lit(0).alias("_back"), F.col("_w").alias("_window")))
    return rows.groupBy("_h", "_back", "_window").agg(F.collect_set("_item").alias("_items"))


def bitmap(windows: DataFrame) -> tuple[Column, int]:
    """Bits as an array of longs in the plan, and their number, a power of two; a hash's bit is set if a window has it."""
    wanted = BITS * windows.select("_h").distinct().count()
    n = min(MOST, max(FEWEST, 1 << (wanted - 1).bit_length() if wanted else 0))
    slot = F.pmod(F.col("_h"), F.lit(n))
    bits = windows.select(slot.alias("b")).groupBy(F.shiftright("b", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits"))
    filled = [0] * (n // 64)
    for r in bits.collect():  # MOST / 64 rows at most
        filled[r["i"]] = r["bits"]
    return F.from_json(F.lit(str(filled)), "array<bigint>"), n


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", *, window: int = WINDOW, gram: int = GRAM, carry: dict[str, Column] | None = None) -> DataFrame:
    """A row for each row of docs: its id, n_words, spans (start and length in words of the windows found, from 0), item_ids (sorted as strings), and the columns of `carry`.

    Null texts have no words. Items without words match nothing; a null item id is the empty string; rows that repeat an
    item id are one item. Documents or items may be empty tables. Repeated rows of docs each give a row.
    """
    need(docs, id_col, text)
    need(items, item_id, item_text)
    windows = settle(item_windows(items, item_id, item_text, window, gram))
    lengths = [r[0] for r in windows.select(F.size("_window").alias("n")).where(F.col("n") < window).distinct().collect()]  # under `window` rows
    (bits, size), extra = bitmap(windows), carry or {}
    slim = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), words_of(text).alias("_w"), *[c.alias(n) for n, c in extra.items()])
    slim = slim.withColumn("_g", gram_hashes(F.col("_w"), gram))

    def known(h: Column) -> Column:
        b = F.pmod(h, F.lit(size))
        return F.get(bits, F.shiftright(b, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), b.bitwiseAND(F.lit(63)).cast("int"))) != 0

    def least_somewhere(i: Column, h: Column) -> Column:
        first, last = F.greatest(F.lit(0), i - (window - gram)), F.least(i, F.size("_w") - window)
        return F.when(first <= last, F.exists(F.sequence(first, F.greatest(first, last)), lambda j: lowest(F.col("_g"), j, window - gram + 1) == h)).otherwise(False)

    def near(h: Column, i: Column) -> Column:
        start = F.greatest(F.lit(0), i - (window - gram))
        return F.struct(h.alias("h"), i.alias("i"), start.alias("from"), F.slice(F.col("_w"), start + 1, F.lit(2 * window)).alias("near"))

    def picked(hashes: Column, more) -> Column:
        marked = F.filter(F.transform(hashes, lambda h, i: F.when(known(h), F.struct(h.alias("h"), i.alias("i")))), lambda x: x.isNotNull() & more(x))
        return F.transform(marked, lambda x: near(x["h"], x["i"]))

    found = picked(F.col("_g"), lambda x: least_somewhere(x["i"], x["h"]))
    for n in lengths:
        found = F.concat(found, picked(gram_hashes(F.col("_w"), n), lambda x: F.lit(True)))
    rows = slim.select("_row", "_id", F.size("_w").cast("long").alias("n_words"), F.explode_outer(found).alias("_f"), *extra)
    rows = rows.select("*", F.col("_f.h").alias("_fh"), F.col("_f.i").alias("_i"), F.col("_f.from").alias("_from"), F.col("_f.near").alias("_near")).drop("_f")
    start = F.col("_i") - F.col("_back")
    same = (F.col("_fh") == F.col("_h")) & (start >= F.col("_from")) & (F.slice(F.col("_near"), F.greatest(start - F.col("_from"), F.lit(0)) + 1, F.size("_window")) == F.col("_window"))
    hits = rows.join(small(windows, 50_000), same, "left").select("_row", "_id", "n_words", F.when(F.col("_h").isNotNull(), F.struct(start.alias("start"), F.size("_window").alias("n"))).alias("_span"), "_items", *extra)
    keep = [F.first(c).alias(c) for c in ("_id", "n_words", *extra)]
    out = hits.groupBy("_row").agg(*keep, F.collect_set("_span").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("item_ids"))
    return out.drop("_row").withColumnRenamed("_id", id_col)


def hit_words(spans: str = "spans") -> Column:
    """How many different words the spans cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(F.col(spans), lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))).cast("long")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs, all columns, without the rows that hold a window of an item. Rows are told apart by id and text."""
    key, bad_id, bad_text = fresh(docs, "_text"), fresh(docs, "_bad"), fresh(docs, "_bad_text")
    marked = contamination(docs, items, id_col, text, carry={key: F.md5(F.coalesce(F.col(text), F.lit("")))}, **options)
    bad = settle(marked.where(F.size("spans") > 0).select(F.col(id_col).alias(bad_id), F.col(key).alias(bad_text)).distinct())
    own = F.md5(F.coalesce(docs[text], F.lit("")))
    return docs.join(small(bad), docs[id_col].eqNullSafe(F.col(bad_id)) & (own == F.col(bad_text)), "left_anti")


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = dealt(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = contamination(docs, items).withColumn("n_hit", hit_words())
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
m AS (SELECT DISTINCT item, n, array_to_string(w[s + 1 : s + n], ' ') AS k
      FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(len(w) - least(10, len(w)) + 1)) AS s FROM b WHERE len(w) > 0)),
l AS (SELECT DISTINCT n FROM m),
g AS (SELECT r, l.n, unnest(range(len(w) - l.n + 1)) AS s, w FROM d, l WHERE len(w) >= l.n),
k AS (SELECT r, n, s, array_to_string(w[s + 1 : s + n], ' ') AS k FROM g),
h AS (SELECT k.r, k.s, k.n, m.item FROM k JOIN m ON k.k = m.k AND k.n = m.n),
p AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, p.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN i USING (r)
"""
