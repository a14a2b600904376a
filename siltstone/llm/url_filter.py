"""URL filters: longest-prefix rules, else host word segmentation and multinomial naive Bayes.

Host labels are split into words by a unigram Viterbi search; the words of host and path are scored by a multinomial
naive Bayes model. It is learned from the URLs that a rule decides, blocked or allowed, and judges the others. Counts of
words and tokens stay in tables on the executors, all of them; the substrings and tokens that the distinct hosts and
paths need are joined to them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import LOWER, UPPER, fresh, need
from siltstone.session import dealt, settle, small, table

#: host suffix, path prefix, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
_PART = re.compile(r"[^\W_]+")


def host_of(url: str) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The index of the longest rule (host and path together) that fits, or null."""
    fits = F.lit(None).cast("int")
    for i in sorted(range(len(rules)), key=lambda i: len(rules[i][0]) + len(rules[i][1])):  # the longest is asked first
        h, p, _ = rules[i]
        fits = F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.lit(i)).otherwise(fits)
    return fits


def verdict_of(host: Column, path: Column, rules=RULES) -> Column:
    """The verdict of the longest rule that fits, or null."""
    return F.get(F.array(*[F.lit(v) for *_, v in rules]), rule_of(host, path, rules)) if rules else F.lit(None).cast("string")


class Words:
    """Unigram model with a Viterbi split; counts need only hold the words that a split can use, if total is given."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.counts, self.total = counts, sum(counts.values()) + 1 if total is None else total
        self.lengths = sorted({len(w) for w in counts})

    def split(self, s: str) -> list[str]:
        """An unknown word costs more with each letter, so of all starts of one the same stays best until a better one comes."""
        base, best, start = math.log(self.total), [(0.0, 0)], 0
        for end in range(1, len(s) + 1):
            found = (best[start][0] + base + 3.0 * (end - start), start)
            for n in self.lengths:
                if n > end:
                    break
                if count := self.counts.get(s[end - n : end]):
                    found = min(found, (best[end - n][0] + math.log(self.total / count), end - n))
            best.append(found)
            if found[0] - 3.0 * end < best[start][0] - 3.0 * start:
                start = end
        out, end = [], len(s)
        while end:
            out.append(s[best[end][1] : end])
            end = best[end][1]
        return out[::-1]


class Vocabulary(NamedTuple):
    """w, n of all words; the sum of n, and one; the lengths of words."""

    table: DataFrame
    total: int
    lengths: list[int]


class Bayes(NamedTuple):
    """Multinomial naive Bayes with add-one smoothing: t, odds (log, block against allow) of all tokens, and the odds of unknown ones and of no token."""

    table: DataFrame
    unknown: float
    prior: float


def looked_up(rows: DataFrame, key: str, among: DataFrame, how: str) -> DataFrame:
    """rows joined to the rows of `among` (one for each key) that they need."""
    return rows.join(small(settle(among.join(rows.select(key).distinct(), key, "left_semi"))), key, how)


def word_counts(pages: DataFrame, url: str, html: str | None) -> Vocabulary:
    """Counts over the words of all pages and of all host labels between hyphens."""
    texts = F.lower(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"<[^>]*>", " ")) if html else F.lit("")
    labels = F.split(F.regexp_replace(host_of(url), r"[^a-z]+", " "), " ")
    words = pages.select(F.explode(F.concat(F.regexp_extract_all(texts, F.lit("[a-z]+"), F.lit(0)), F.when(host_of(url).contains("-"), labels).otherwise(F.array()))).alias("w"))
    counts = settle(words.where("w != ''").groupBy("w").agg(F.count("*").alias("n")))
    by_length = counts.groupBy(F.length("w").alias("l")).agg(F.sum("n").alias("n")).collect()  # a row for each length
    return Vocabulary(counts, sum(r["n"] for r in by_length) + 1, sorted(r["l"] for r in by_length))


def split_hosts(hosts: DataFrame, words: Vocabulary) -> DataFrame:
    """host, words in order; hosts has each host once. Only substrings as long as some word are looked up."""
    parts = settle(hosts.select("host", F.posexplode(F.regexp_extract_all("host", F.lit("[a-z]+|[0-9]+"), F.lit(0))).alias("at", "part")))
    own = parts.select("part").distinct()
    lengths = F.filter(F.array(*[F.lit(n) for n in words.lengths]), lambda n: n <= F.length("part"))
    cut = F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.length("part") - n + 1), lambda i: F.substring(F.col("part"), i, n)))
    pieces = own.where(F.regexp_like("part", F.lit("^[a-z]"))).select("part", F.explode(F.array_distinct(F.flatten(cut))).alias("w"))
    known = looked_up(pieces, "w", words.table, "inner").groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("known"))
    total = words.total

    @F.pandas_udf("array<string>")
    def split(s: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([Words(dict(k or {}), total).split(x) for x, k in zip(s, known, strict=True)], dtype=object)

    done = settle(own.join(known, "part", "left").select("part", split("part", "known").alias("split")))
    lists = parts.join(small(done), "part").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "split"))).alias("lists"))
    return lists.select("host", F.flatten(F.transform("lists", lambda x: x["split"])).alias("words"))


def path_words(path: str) -> Column:
    @F.pandas_udf("array<string>")
    def run(paths: pd.Series) -> pd.Series:
        return pd.Series([[w for w in _PART.findall(p.lower()) if not w.isdigit()] for p in paths], dtype=object)

    return run(path)


def marks(words: Column, kind: str) -> Column:
    """Tokens: h: words of the host, p: words of the path."""
    return F.transform(words, lambda w: F.concat(F.lit(f"{kind}:"), w))


def train(pages: DataFrame, url: str = "url", html: str | None = "html", *, rules=RULES) -> tuple[Vocabulary, Bayes]:
    """Fits both models: words on all rows of pages, naive Bayes on all rows that a rule decides. The driver gets sums alone.

    Where no rule decides a row, every score is 0, which allows.
    """
    need(pages, url)
    words = word_counts(pages, url, html)
    urls = pages.select(host_of(url).alias("host"), path_of(url).alias("path"))
    labelled = urls.select("host", "path", (verdict_of(F.col("host"), F.col("path"), rules) == "block").alias("bad")).where("bad IS NOT NULL")
    hosts = settle(labelled.groupBy("host", "bad").agg(F.count("*").alias("rows")))
    sizes = hosts.groupBy("bad").agg(F.sum("rows").alias("n")).collect()
    n_block, n_allow = (sum(r["n"] for r in sizes if r["bad"] is bad) for bad in (True, False))
    split = split_hosts(hosts.where("host != ''").select("host").distinct(), words)
    of_hosts = hosts.join(split, "host").select(F.explode(marks(F.col("words"), "h")).alias("t"), "bad", F.col("rows").alias("n"))
    of_paths = labelled.select(F.explode(marks(path_words("path"), "p")).alias("t"), "bad", F.lit(1).cast("long").alias("n"))
    counts = settle(of_hosts.unionAll(of_paths).groupBy("t").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(~F.col("bad"), F.col("n")).otherwise(0)).alias("a")))
    all_ = counts.agg(F.count("*").alias("size"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("a"), F.lit(0)).alias("a")).first()
    b, a = all_["b"] + all_["size"] + 1, all_["a"] + all_["size"] + 1

    @F.pandas_udf("double")
    def odds(block: pd.Series, allow: pd.Series) -> pd.Series:
        return pd.Series([math.log((x + 1) / b) - math.log((y + 1) / a) for x, y in zip(block, allow, strict=True)], dtype=float)

    return words, Bayes(settle(counts.select("t", odds("b", "a").alias("odds"))), math.log(a / b), math.log((n_block + 1) / (n_allow + 1)))


def odds_of(rows: DataFrame, key: str, tokens: Column, bayes: Bayes) -> DataFrame:
    """key, odds of its tokens in order; rows has each key once."""
    each = settle(rows.select(key, F.posexplode(tokens).alias("at", "t")))
    found = looked_up(each, "t", bayes.table, "left").select(key, F.struct("at", F.coalesce("odds", F.lit(bayes.unknown)).alias("odds")).alias("x"))
    return found.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("xs")).select(key, F.transform("xs", lambda x: x["odds"]).alias("odds"))


def judge_urls(pages: DataFrame, models: tuple[Vocabulary, Bayes], url: str = "url", *, rules=RULES, threshold: float = 0.0) -> DataFrame:
    """pages with host, path, rule, verdict, score and host_words.

    A null url, and one without ://, has empty host and path, fits no rule and has score 0: allow. A score above the
    threshold blocks. Of rules that fit, the longest (host and path together) wins. Columns of pages with one of the six
    names are replaced (not the url's); an empty table gives no row.
    """
    need(pages, url)
    words, bayes = models
    pages = pages.drop(*[c for c in ("host", "path", "rule", "verdict", "score", "host_words") if c != url])
    mark = fresh(pages, "_judged")
    h, p = f"{mark}_h", f"{mark}_p"
    placed = pages.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    split = settle(split_hosts(placed.select("host").where("host != ''").distinct(), words))
    of_hosts = settle(split.join(odds_of(split, "host", marks(F.col("words"), "h"), bayes), "host", "left").select(F.struct("host", "words", "odds").alias(h)))
    of_paths = settle(odds_of(placed.select("path").where("path != ''").distinct(), "path", marks(path_words("path"), "p"), bayes).select(F.struct("path", "odds").alias(p)))
    prior = bayes.prior

    @F.pandas_udf("double")
    def score(of_host: pd.Series, of_path: pd.Series) -> pd.Series:
        lists = ([*(() if x is None else x), *(() if y is None else y)] for x, y in zip(of_host, of_path, strict=True))
        return pd.Series([float(prior + sum(map(float, x))) if x else 0.0 for x in lists], dtype=float)

    fits = rule_of(F.col("host"), F.col("path"), rules)
    names = F.array(*[F.lit(f"{h}{p}") for h, p, _ in rules])
    out = placed.join(small(of_hosts), F.col("host") == F.col(f"{h}.host"), "left").join(small(of_paths), F.col("path") == F.col(f"{p}.path"), "left")
    out = out.withColumn(mark, F.struct(score(f"{h}.odds", f"{p}.odds").alias("score"), F.coalesce(F.array_join(f"{h}.words", " "), F.lit("")).alias("host_words")))
    own = F.when(F.col(f"{mark}.score") > threshold, "block").otherwise("allow")
    return out.select(*[c for c in placed.columns], F.get(names, fits).alias("rule"), F.coalesce(verdict_of(F.col("host"), F.col("path"), rules), own).alias("verdict"), f"{mark}.score", f"{mark}.host_words")


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = dealt(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return judge_urls(pages.select("page_id", "url"), train(pages)).select("page_id", "host", "path", "rule", "verdict", "score", "host_words")
