"""Text functions as column expressions: tokens, chunks, measures."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The token pattern and the stop words.
TOKEN = "[a-z0-9]+"
STOPWORDS = """a an and are as at be by for from has have how in is it its of
on or that the this to was were what when where which who why will with""".split()
#: Shorter extractions, stripped, count as failed.
MIN_CHARS = 40


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of a-z and 0-9, in order, repeats kept; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def without_stopwords(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(STOPWORDS))


def strip(text: Column) -> Column:
    """Trims Unicode white space."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def extraction_failed(text: Column, least: int = MIN_CHARS) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) < least


def running_sums(steps: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda x: np.cumsum(np.asarray(x, np.int64)).tolist()), "array<long>", F.PandasUDFType.SCALAR)(steps)


def pieces(text: Column, step: int, make: Callable[[Column, Column, Column], Column]) -> Column:
    """make(all pieces, piece, index) for each piece of `step` characters; one pass over the text cuts them all."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    return F.get(F.transform(F.array(cut), lambda a: F.transform(a, lambda p, i: make(a, p, i))), F.lit(0))


def chunk_fixed(docs: DataFrame, text: str = "text", size: int = 500, overlap: int = 100, stripped: bool = False) -> DataFrame:
    """A row for each chunk: start, end and chunk beside the columns of docs; blank chunks and empty texts give none.

    A chunk is a piece and the begin of those after it, so the time is linear in the text where `text` is not kept.
    """
    step = size - overlap

    def chunk(a: Column, p: Column, i: Column) -> Column:
        after = F.substring(F.array_join(F.slice(a, i + 2, F.lit(-(-overlap // step))), ""), 1, overlap)
        return F.struct((i * step).alias("start"), F.concat(p, after).alias("chunk"))

    out = docs.drop("start", "chunk", "end").select("*", F.inline(pieces(F.col(text), step, chunk)))
    out = out.withColumn("end", F.col("start") + F.length("chunk"))
    if stripped:
        out = out.withColumn("chunk", strip(F.col("chunk")))
    return out.where(F.length(strip(F.col("chunk"))) > 0)


def cuts(docs: DataFrame, step: int = 400) -> DataFrame:
    """doc_id, start, l, r: a row for each cut within a text, with the pieces before and after it."""
    rows = docs.select("doc_id", F.inline(pieces(F.col("text"), step, lambda a, p, i: F.struct((i * step).alias("start"), F.get(a, i - 1).alias("l"), p.alias("r")))))
    return rows.where("start > 0")


def cut_words(docs: DataFrame, step: int = 400) -> DataFrame:
    """doc_id, start, word: the words that a cut falls into. Only one that fills a whole piece is sought beyond it."""
    blank = F.lit(r"(?U)\s")

    def sides(a: Column, p: Column, i: Column) -> Column:
        before = F.get(a, i - 1)
        left = F.when(F.regexp_like(before, blank), before).otherwise(F.array_join(F.slice(a, F.lit(1), i), ""))
        right = F.when(F.regexp_like(p, blank), p).otherwise(F.array_join(F.slice(a, i + 1, F.size(a)), ""))
        return F.struct((i * step).alias("start"), left.alias("l"), right.alias("r"))

    rows = docs.select("doc_id", F.inline(pieces(F.col("text"), step, sides))).where("start > 0")
    within = F.regexp_like(F.right("l", F.lit(1)), F.lit(r"(?U)\S")) & F.regexp_like(F.left("r", F.lit(1)), F.lit(r"(?U)\S"))
    word = F.concat(F.element_at(F.split("l", r"(?U)\s+"), -1), F.get(F.split("r", r"(?U)\s+", 2), F.lit(0)))
    return rows.where(within).select("doc_id", "start", word.alias("word"))


def sentence_chunks(text: Column, most: int = 500) -> Column:
    """Chunks of whole sentences as an array of structs (start, end, text), in one pass over the text.

    A chunk takes sentences while their lengths, one more for each before, stay within `most`; a longer one stands alone.
    Starts count one character between sentences, whatever white space was there; a text's own ends are not trimmed.
    """
    joined = F.regexp_replace(F.regexp_replace(text, r"(?U)([.!?])\s+", "$1 "), r"(?<=[.!?]) \z", "")
    longest_first = rf"(?s)(.{{1,{most}}}\z|.{{0,{most - 1}}}[.!?](?= )|.*?[.!?](?= )|.+)(?: |\z)"
    chunks = F.regexp_extract_all(joined, F.lit(longest_first), F.lit(1))
    after = running_sums(F.transform(chunks, lambda c: F.length(c) + 1))

    def placed(c: Column, e: Column) -> Column:
        return F.struct((e - 1 - F.length(c)).cast("int").alias("start"), (e - 1).cast("int").alias("end"), c.alias("text"))

    return F.zip_with(chunks, after, placed)


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def picked(values: Column, share: str) -> Column:
    """The value at floor(n * share) of the sorted values: an index pick, no interpolation."""
    sorted_ = F.array_sort(F.collect_list(values))
    return F.get(sorted_, F.floor(F.size(sorted_) * F.expr(share)).cast("int"))


def squeezed(text: Column) -> Column:
    """Runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def character_error_rate(truth: Column, guess: Column) -> Column:
    """Edit distance over the length of the truth, both squeezed; 0 for an empty truth, and it may exceed 1."""
    a, b = squeezed(truth), squeezed(guess)
    return F.when(F.length(a) == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / F.length(a))


def word_accuracy(truth: Column, guess: Column) -> Column:
    """The share of the truth's words, with repeats, that the guess has."""
    a, b = F.split(squeezed(truth), " "), F.split(squeezed(guess), " ")
    return F.when(F.length(squeezed(truth)) == 0, F.lit(0.0)).otherwise(F.size(F.filter(a, lambda w: F.array_contains(b, w))) / F.size(a))
