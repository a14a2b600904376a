"""Language ID by rank-order profiles.

A language's profile is the list of its most frequent character n-grams (1 to 3, words padded by a blank), best first.
A document's own list is compared to each profile by the out-of-place distance: the sum over the document's n-grams of
how far their ranks lie apart, with the profile's length for n-grams that it lacks. The nearest profile wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import fresh, hash60, need
from siltstone.session import dealt, table

#: N-grams of a profile and of a document's list.
TOP = 300
#: Labelled rows that the profiles of one language are fitted on; a sample by hash beyond.
TRAIN_ROWS = 20_000
UND = "und"
_NO_LETTER = re.compile(r"[\W\d_]+")


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """N-grams as whole numbers, 21 bits a character, with their counts; none if the text has no letter."""
    words = _NO_LETTER.sub(" ", (text or "").lower())
    if not any(map(str.isalpha, words)):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.frombuffer(f" {words.strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    mid = c[1:-1]
    keep = three[(mid != 32)]  # no n-gram spans two words
    found = [np.unique(x, return_counts=True) for x in (c[c != 32], two, keep)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The `top` n-grams, most frequent first, ties by their number."""
    return codes[np.lexsort((codes, -counts))[:top]]


def train_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", *, top: int = TOP, bound: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """A profile for each label: at most `top` numbers a language come to the driver."""
    need(docs, text, lang, key)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("lang"), F.col(key).alias("k"))
    share = F.create_map(*[x for r in rows.groupBy("lang").count().collect() for x in (F.lit(r["lang"]), F.lit(min(1.0, bound / r["count"])))] or [F.lit(""), F.lit(0.0)])
    rows = rows.where(hash60("k", seed="langid") < share[F.col("lang")] * F.lit(float(1 << 60)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, dict[int, int]] = {}
        for b in batches:
            for text_, lang_ in zip(b["t"], b["lang"], strict=True):
                own = sums.setdefault(lang_, {})
                for g, n in zip(*(x.tolist() for x in grams(text_)), strict=True):
                    own[g] = own.get(g, 0) + n
        for lang_, own in sums.items():
            yield pd.DataFrame({"lang": lang_, "gram": list(own), "n": list(own.values())})

    sums = rows.select("t", "lang").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = sums.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= top)
    found: dict[str, list] = {}
    for r in best.orderBy("lang", "rank").collect():
        found.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64) for k, v in found.items()}


def distances(own: np.ndarray, vocabulary: np.ndarray, ranks: np.ndarray, top: int) -> np.ndarray:
    """Out-of-place distance of a document's list to each profile. ranks: profile by number in the vocabulary, `top` if it has it not."""
    at = np.searchsorted(vocabulary, own)
    known = (at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] == own)
    place = np.arange(len(own))
    there = ranks[:, at[known]]
    gaps = np.where(there < top, np.abs(there - place[known]), top)
    return gaps.sum(axis=1) + top * int((~known).sum())


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", *, top: int = TOP, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and a score from 0 to 1: 1 less the nearest distance as a share of the largest.

    `und` with score 0 for null texts, texts without a letter, and where there is no profile. Equal distances go to the
    label first in code point order. Columns of docs with the two names are replaced; other columns pass as they are.
    """
    need(docs, text)
    langs = sorted(profiles)
    vocabulary = np.unique(np.concatenate([profiles[x] for x in langs])) if langs else np.empty(0, np.int64)
    ranks = np.full((len(langs), len(vocabulary)), top)
    for i, x in enumerate(langs):
        ranks[i, np.searchsorted(vocabulary, profiles[x])] = np.arange(len(profiles[x]))

    def one(t: str | None) -> tuple[str, float]:
        codes, counts = grams(t)
        if not len(codes) or not langs:
            return UND, 0.0
        own = ranked(codes, counts, top)
        d = distances(own, vocabulary, ranks, top)
        return langs[int(d.argmin())], float(1 - d.min() / (top * len(own)))

    @F.pandas_udf(f"{names[0]} string, {names[1]} double")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            yield pd.DataFrame([one(x) for x in t], columns=list(names))

    judged = fresh(docs, "_judged")
    out = docs.drop(*names).withColumn(judged, judge(F.col(text)))
    return out.select("*", f"{judged}.*").drop(judged)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 by 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fitted(docs: DataFrame) -> dict[str, np.ndarray]:
    return train_profiles(docs.where(~held_out()))


def op8_langid(spark, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), fitted(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
