"""Chunks, text measures, byte arithmetic and comparison metrics as queries."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.catalog import query
from siltstone.functions import text as T
from siltstone.operators.lexical import passages
from siltstone.session import table
from siltstone.sources.files import crossings


@query("chunk_fixed", "SELECT doc_id, s AS start, s + length(c) AS end_, md5(c) AS digest FROM (SELECT doc_id, s, substr(text, s + 1, 500) AS c FROM (SELECT doc_id, text, unnest(range(0, length(text), 400)) AS s FROM documents)) WHERE trim(c, ' \t\n\r') <> ''")
def chunk_fixed(spark, sf_dir):
    return T.chunk_fixed(passages(spark, sf_dir)).select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end_"), F.md5("chunk").alias("digest"))


@query("chunk_strip", "SELECT doc_id, s AS start, md5(trim(c, ' \t\n\r')) AS digest FROM (SELECT doc_id, s, substr(text, s + 1, 1000) AS c FROM (SELECT doc_id, text, unnest(range(0, length(text), 800)) AS s FROM documents)) WHERE trim(c, ' \t\n\r') <> ''")
def chunk_strip(spark, sf_dir):
    return T.chunk_fixed(passages(spark, sf_dir), size=1000, overlap=200, stripped=True).select("doc_id", F.col("start").cast("long").alias("start"), F.md5("chunk").alias("digest"))


@query("chunk_sentences", r"""WITH j AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([.!?])\s+', '\1 ', 'g'), '([.!?]) $', '\1') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, '(?s).{1,500}$|.{0,499}[.!?] |.*?[.!?] |.+') AS cs FROM j),
c AS (SELECT doc_id, n, cs[n + 1] AS c FROM (SELECT *, unnest(range(len(cs))) AS n FROM m)),
k AS (SELECT doc_id, n, regexp_replace(c, '([.!?]) $', '\1') AS c FROM c),
e AS (SELECT *, sum(length(c) + 1) OVER (PARTITION BY doc_id ORDER BY n) - 1 AS e FROM k)
SELECT doc_id, n::INT AS n, (e - length(c))::INT AS start, e::INT AS end_, md5(c) AS digest FROM e""")
def chunk_sentences(spark, sf_dir):
    chunks = passages(spark, sf_dir).select("doc_id", T.sentence_chunks(F.col("text")).alias("cs")).select("doc_id", F.posexplode("cs").alias("n", "c"))
    return chunks.select("doc_id", "n", F.col("c.start").alias("start"), F.col("c.end").alias("end_"), F.md5("c.text").alias("digest"))


@query("straddling", r"""SELECT doc_id, s AS start, regexp_extract(l, '(\S+)$', 1) || regexp_extract(r, '^(\S+)', 1) AS word FROM (SELECT doc_id, s, substr(text, 1, s) AS l, substr(text, s + 1) AS r FROM (SELECT doc_id, text, unnest(range(400, length(text), 400)) AS s FROM documents) WHERE trim(substr(text, s + 1, 500), ' ' || chr(9) || chr(10) || chr(13)) <> '') WHERE regexp_matches(l, '\S$') AND regexp_matches(r, '^\S')""")
def q_straddling(spark, sf_dir):
    """Chunks that begin within a word, and the word."""
    return T.cut_words(passages(spark, sf_dir)).withColumn("start", F.col("start").cast("long"))


@query("chunk_stats", r"""WITH c AS (SELECT doc_id, s, substr(text, s + 1, 500) AS c FROM (SELECT doc_id, text, unnest(range(0, length(text), 400)) AS s FROM documents) WHERE trim(substr(text, s + 1, 500), ' ' || chr(9) || chr(10) || chr(13)) <> ''),
b AS (SELECT doc_id, s, substr(text, s, 1) AS l, substr(text, s + 1, 1) AS r FROM c JOIN documents USING (doc_id) WHERE s > 0)
SELECT count(*) AS chunks, round(avg(length(c)), 6) AS mean_len, (SELECT count(*) FROM b WHERE regexp_matches(l, '\S') AND regexp_matches(r, '\S')) AS broken, round((SELECT count(*) FROM b WHERE regexp_matches(l, '\S') AND regexp_matches(r, '\S')) / count(*)::DOUBLE, 6) AS share FROM c""")
def chunk_stats(spark, sf_dir):
    chunks = T.chunk_fixed(passages(spark, sf_dir)).agg(F.count("*").alias("chunks"), F.round(F.avg(F.length("chunk")), 6).alias("mean_len"))
    broken = q_straddling(spark, sf_dir).agg(F.count("*").alias("broken"))
    return chunks.join(F.broadcast(broken)).withColumn("share", F.round(F.col("broken") / F.col("chunks"), 6))


@query("table_cut", "SELECT doc_id, min(s) AS start FROM (SELECT doc_id, s, substr(text, s + 1, 40) AS head, substr(text, s - 39, 40) AS tail FROM (SELECT doc_id, text, unnest(range(400, length(text), 400)) AS s FROM documents)) WHERE regexp_matches(head, '[0-9]') AND regexp_matches(tail, '[0-9]') GROUP BY doc_id")
def table_cut(spark, sf_dir):
    """The first chunk of a document whose cut has digits on both sides."""
    both = F.regexp_like(F.left("r", F.lit(40)), F.lit("[0-9]")) & F.regexp_like(F.right("l", F.lit(40)), F.lit("[0-9]"))
    return T.cuts(passages(spark, sf_dir)).where(both).groupBy("doc_id").agg(F.min("start").cast("long").alias("start"))


@query("text_measures", "SELECT doc_id, length(text)::BIGINT AS chars, strlen(text)::BIGINT AS bytes, (strlen(text) > length(text)) AS has_wide FROM documents")
def text_measures(spark, sf_dir):
    return passages(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"), (F.octet_length("text") > F.length("text")).alias("has_wide"))


@query("wrap_unsigned", "SELECT event_id, w AS width, (event_id % (256 ** w)::BIGINT)::BIGINT AS stored, event_id >= (256 ** w)::BIGINT AS overflow FROM events, (VALUES (1), (2), (4)) t(w)")
def wrap_unsigned(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))).alias("width"))
    most = F.pow(F.lit(256), "width").cast("long")
    return rows.select("event_id", "width", F.pmod("event_id", most).alias("stored"), (F.col("event_id") >= most).alias("overflow"))


@query("float_facts", "SELECT 0.1e0 + 0.2e0 = 0.3e0 AS double_equal, 0.1 + 0.2 = 0.3 AS decimal_equal")
def float_facts(spark, sf_dir):
    return spark.sql("SELECT 0.1D + 0.2D = 0.3D AS double_equal, 0.1 + 0.2 = 0.3 AS decimal_equal")


@query("ocr_decision", "SELECT page_id, length(t) < 40 AS failed FROM (SELECT page_id, trim(regexp_replace(html, '<[^>]*>', '', 'g'), ' \t\n\r') AS t FROM pages)")
def ocr_decision(spark, sf_dir):
    """Pages whose plain extraction is too short go to the dear extractor."""
    plain = F.regexp_replace("html", "<[^>]*>", "")
    return table(spark, sf_dir, "pages").select("page_id", T.extraction_failed(plain).alias("failed"))


_SIDES = "s AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user') AS a, string_agg(text, ' ' ORDER BY turn) FILTER (role <> 'user') AS b FROM conversations GROUP BY conv_id), p AS (SELECT conv_id, coalesce(a, '') AS a, coalesce(b, '') AS b FROM s)"


def _sides(spark, sf_dir) -> DataFrame:
    """conv_id, a, b: what either side of a conversation says."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(*[F.array_sort(F.collect_list(F.when(c, F.struct("turn", "text")))).alias(n) for n, c in (("a", F.col("role") == "user"), ("b", F.col("role") != "user"))])
    return rows.select("conv_id", *[F.array_join(F.transform(n, lambda s: s["text"]), " ").alias(n) for n in ("a", "b")])


@query("levenshtein", "SELECT page_id, levenshtein(a, b)::BIGINT AS distance FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS a, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS b FROM pages)")
def levenshtein(spark, sf_dir):
    """Edit distance of a page's host and path."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("a"), F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("b"))
    return pages.select("page_id", F.levenshtein("a", "b").cast("long").alias("distance"))


@query("cer", "SELECT page_id, round(CASE WHEN length(a) = 0 THEN 0 ELSE levenshtein(a, b) / length(a)::DOUBLE END, 6) AS cer FROM (SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)', 1), '\\s+', ' ', 'g')) AS a, trim(regexp_replace(regexp_extract(html, '<h1>([^<]*)', 1), '\\s+', ' ', 'g')) AS b FROM pages)")
def cer(spark, sf_dir):
    """Character error rate of a page's heading against its title."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("a"), F.regexp_extract("html", "<h1>([^<]*)", 1).alias("b"))
    return pages.select("page_id", F.round(T.character_error_rate(F.col("a"), F.col("b")), 6).alias("cer"))


@query("word_accuracy", f"WITH {_SIDES}, w AS (SELECT conv_id, string_split(trim(regexp_replace(a, '\\s+', ' ', 'g')), ' ') AS x, string_split(trim(regexp_replace(b, '\\s+', ' ', 'g')), ' ') AS y, trim(a) AS t FROM p) SELECT conv_id, round(CASE WHEN length(t) = 0 THEN 0 ELSE len(list_filter(x, lambda v: list_contains(y, v))) / len(x)::DOUBLE END, 6) AS accuracy FROM w")
def word_accuracy(spark, sf_dir):
    return _sides(spark, sf_dir).select("conv_id", F.round(T.word_accuracy(F.col("a"), F.col("b")), 6).alias("accuracy"))


@query("bag_compare", f"WITH {_SIDES}, w AS (SELECT conv_id, list_filter(string_split_regex(a, '\\s+'), lambda v: v <> '') AS x, list_filter(string_split_regex(b, '\\s+'), lambda v: v <> '') AS y FROM p) SELECT conv_id, list_sort(x) = list_sort(y) AS same_bag, len(list_filter(list_distinct(x), lambda v: NOT list_contains(y, v)))::BIGINT AS only_a, len(list_filter(list_distinct(y), lambda v: NOT list_contains(x, v)))::BIGINT AS only_b, abs(len(x) - len(y))::BIGINT AS gap FROM w")
def bag_compare(spark, sf_dir):
    split = lambda c: F.filter(F.split(c, r"\s+"), lambda v: v != "")
    w = _sides(spark, sf_dir).select("conv_id", split("a").alias("x"), split("b").alias("y"))
    return w.select("conv_id", (F.array_sort("x") == F.array_sort("y")).alias("same_bag"), F.size(F.array_except("x", "y")).cast("long").alias("only_a"), F.size(F.array_except("y", "x")).cast("long").alias("only_b"), F.abs(F.size("x") - F.size("y")).cast("long").alias("gap"))


@query("evidence", "WITH q AS (SELECT b.item_id AS qid, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0) SELECT qid, round(count(*) FILTER (toxic = 0) / count(*)::DOUBLE, 6) AS coverage FROM q LEFT JOIN labels USING (doc_id) GROUP BY qid")
def evidence(spark, sf_dir):
    """Of the documents that a query needs, the share that a filtered store still has."""
    from siltstone.operators.lexical import qrels

    kept = table(spark, sf_dir, "labels").where("toxic = 0").select("doc_id", F.lit(1).alias("kept"))
    return qrels(spark, sf_dir).join(kept, "doc_id", "left").groupBy("qid").agg(F.round(F.count("kept") / F.count("*"), 6).alias("coverage"))


@query("accuracy_by_kind", "SELECT quality AS kind, round(avg((toxic = 0)::INT), 6) AS accuracy, count(*) AS n FROM labels GROUP BY 1")
def accuracy_by_kind(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy(F.col("quality").alias("kind")).agg(F.round(F.avg((F.col("toxic") == 0).cast("int")), 6).alias("accuracy"), F.count("*").alias("n"))


def _same_sql() -> str:
    from siltstone.operators.lexical import _bm25_sql, _ranked_sql

    lists = [f"SELECT qid, list(doc_id ORDER BY rank) AS x, list(score ORDER BY rank) AS s FROM ({_ranked_sql(_bm25_sql(distinct=d))}) GROUP BY qid" for d in (False, True)]
    return f"SELECT count(*) AS queries, round(avg((a.x = b.x)::INT), 6) AS same_order, round(avg((list_sort(a.x) = list_sort(b.x))::INT), 6) AS same_set, round(max(abs(a.s[1] - b.s[1])), 6) AS gap FROM ({lists[0]}) a JOIN ({lists[1]}) b USING (qid)"


@query("agreement", _same_sql())
def agreement(spark, sf_dir):
    """Share of queries for which two ways of ranking give the same order and the same set, and the largest gap of their best scores."""
    from siltstone.operators.lexical import _both, best_of

    found = best_of(_both(spark, sf_dir), ("bm25", "distinct"))
    lists = [found[f].groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda s: s["doc_id"]).alias(n), F.max("score").alias(f"{n}_best")) for f, n in (("bm25", "a"), ("distinct", "b"))]
    both = lists[0].join(lists[1], "qid")
    same = lambda x, y: F.round(F.avg((x == y).cast("int")), 6)
    return both.agg(F.count("*").alias("queries"), same(F.col("a"), F.col("b")).alias("same_order"), same(F.array_sort("a"), F.array_sort("b")).alias("same_set"), F.round(F.max(F.abs(F.col("a_best") - F.col("b_best"))), 6).alias("gap"))


@query("gains", "WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT source, n, n - lag(n) OVER (ORDER BY source) AS gain, (max(n) OVER () - min(n) OVER ())::BIGINT AS spread FROM s")
def gains(spark, sf_dir):
    """Each stage's gain over the one before, and the spread of all; stages are aggregated first."""
    from pyspark.sql import Window

    s = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return s.select("source", "n", (F.col("n") - F.lag("n").over(Window.orderBy("source"))).alias("gain"), (F.max("n").over(every) - F.min("n").over(every)).alias("spread"))


@query("read_crossings", "SELECT count(*) AS opens, sum((strlen(text) + 65535) // 65536 + 1)::BIGINT AS reads, count(*) AS closes, round(sum((strlen(text) + 4095) // 4096 * 4096) / sum(strlen(text))::DOUBLE, 6) AS waste FROM documents")
def read_crossings(spark, sf_dir):
    """System calls of reading each document as a file in pieces of 64 KB, and disk blocks of 4 KB over bytes."""
    n = F.octet_length("text")
    blocks = lambda size: F.floor((n + size - 1) / size)
    return passages(spark, sf_dir).agg(F.count("*").alias("opens"), F.sum(blocks(65_536) + 1).alias("reads"), F.count("*").alias("closes"), F.round(F.sum(blocks(4096) * 4096) / F.sum(n), 6).alias("waste"))


@query("prompts", "SELECT conv_id, md5(string_agg('[' || role || '] ' || text, chr(10) || chr(10) ORDER BY turn)) AS prompt FROM conversations GROUP BY conv_id")
def prompts(spark, sf_dir):
    """Passages under their source's name, in order, as one prompt."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return rows.select("conv_id", F.md5(F.array_join(F.transform("t", lambda s: F.concat(F.lit("["), s["role"], F.lit("] "), s["text"])), "\n\n")).alias("prompt"))


@query("buffer_crossings", "SELECT sum((strlen(text) + 4095) // 4096 + 1)::BIGINT AS small, sum((strlen(text) + 4194303) // 4194304 + 1)::BIGINT AS large, ((sum(strlen(text)) + 4095) // 4096 + 1)::BIGINT AS one_file_small, ((sum(strlen(text)) + 4194303) // 4194304 + 1)::BIGINT AS one_file_large FROM documents")
def buffer_crossings(spark, sf_dir):
    """Reads of all documents as files of their own and as one file, in pieces of 4 KB and 4 MB."""
    n = F.octet_length("text")
    own, one = ({"small": 4096, "large": 4 << 20}, {"one_file_small": 4096, "one_file_large": 4 << 20})
    return passages(spark, sf_dir).agg(*[F.sum(crossings(n, b)).alias(k) for k, b in own.items()], *[crossings(F.sum(n), b).alias(k) for k, b in one.items()])


def sequence_compare(a: str | None, b: str | None, context: int = 90) -> dict:
    """How alike two texts are as sequences, and where they first differ: the kind, the place in the first and what either has there."""
    match = difflib.SequenceMatcher(None, a or "", b or "")
    out = {"ratio": match.ratio(), "kind": None, "at": None, "a": None, "b": None}
    first = next((c for c in match.get_opcodes() if c[0] != "equal"), None)
    if first:
        kind, i, _, j, _ = first
        squeeze = lambda t: " ".join(t.split())
        out |= {"kind": kind, "at": i, "a": squeeze((a or "")[i : i + context]), "b": squeeze((b or "")[j : j + context])}
    return out


def compared(rows: DataFrame, a: str, b: str) -> DataFrame:
    """rows with compare: ratio, kind, at, a, b of sequence_compare."""

    @F.pandas_udf("ratio double, kind string, at int, a string, b string")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sequence_compare(*p) for p in zip(x, y, strict=True)], columns=["ratio", "kind", "at", "a", "b"]).astype({"at": "Int32"})

    return rows.withColumn("compare", run(a, b))


@query("title_differences")
def title_differences(spark, sf_dir):
    """Each page's heading against its title."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.regexp_extract("html", "<h1>([^<]*)", 1).alias("heading"))
    return compared(pages, "title", "heading").select("page_id", F.round("compare.ratio", 6).alias("ratio"), "compare.kind", "compare.at")
