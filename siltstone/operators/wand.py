"""Top-k with upper bounds: documents that cannot reach the k best are not scored.

Postings are cut into ranges of documents; the kernel runs for each range and query on sorted arrays, and the k best of
all ranges are the answer, the same as scoring all.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.catalog import query
from siltstone.operators.lexical import B, K1, TOP, Index, _both, _bm25_sql, _ranked_sql, idf_of, top_k
from siltstone.session import small

#: Documents of a range.
RANGE = 50_000


def pruned_topk(lists: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[list[tuple[int, float]], int]:
    """The k best of the sums over posting lists (ids sorted, contributions), ties by id, and how many documents were scored.

    Lists in falling order of their bound; a document is worth scoring if some list holds it whose bounds, with those of
    all later lists, exceed the k-th best score so far.
    """
    docs = np.unique(np.concatenate([ids for ids, _ in lists]))
    placed = sorted(((np.searchsorted(docs, ids), part) for ids, part in lists), key=lambda p: -p[1].max())
    rest = np.cumsum([float(part.max()) for _, part in placed][::-1])[::-1].tolist() + [0.0]
    seen, scored, floor = np.zeros(len(docs), bool), 0, -1.0
    best, scores = np.empty(0, np.int64), np.empty(0)
    for i, (places, _) in enumerate(placed):
        if rest[i] < floor - 1e-6:
            break
        new = places[~seen[places]]  # in none of the lists before
        seen[new] = True
        total = np.zeros(len(new))
        for j in range(i, len(placed)):
            own, part = placed[j]
            at = np.minimum(np.searchsorted(own, new), len(own) - 1)
            total += np.where(own[at] == new, part[at], 0.0)
            alive = total + rest[j + 1] >= floor - 1e-6
            if not alive.all():
                new, total = new[alive], total[alive]
        scored += len(new)
        best, scores = np.concatenate([best, new]), np.concatenate([scores, np.round(total, 6)])
        order = np.lexsort((best, -scores))[:k]
        best, scores = best[order], scores[order]
        floor = float(scores[-1]) if len(scores) == k else -1.0
    return list(zip(docs[best].tolist(), scores.tolist(), strict=True)), scored


class Cursor:
    """A place in a posting list, ids sorted; looks counts the postings that were read to move it."""

    def __init__(self, ids: np.ndarray, parts: np.ndarray):
        self.ids, self.parts, self.bound = ids.tolist(), parts.tolist(), float(parts.max())
        self.at, self.looks = 0, 0

    def doc(self) -> float:
        return self.ids[self.at] if self.at < len(self.ids) else float("inf")

    def move(self, target: float, stride: int) -> None:
        """To the first document from target on: whole strides while their last posting is before it, then one by one."""
        n = len(self.ids)
        while stride > 1 and self.at + stride < n and self.ids[self.at + stride] < target:
            self.at += stride
            self.looks += 1
        while self.at < n and self.ids[self.at] < target:
            self.at += 1
            self.looks += 1


def document_at_a_time(lists: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[list[tuple[int, float]], int]:
    """The k best of the sums, all documents scored in order of their ids."""
    ids, parts = np.concatenate([x for x, _ in lists]), np.concatenate([y for _, y in lists])
    order = np.argsort(ids, kind="stable")
    docs, first = np.unique(ids[order], return_index=True)
    scores = np.round(np.add.reduceat(parts[order], first), 6)
    best = np.lexsort((docs, -scores))[:k]
    return [(int(docs[i]), float(scores[i])) for i in best], len(docs)


def pivoted_topk(lists: list[tuple[np.ndarray, np.ndarray]], k: int, stride: int = 64) -> tuple[list[tuple[int, float]], int, int]:
    """The k best of the sums, how many documents were scored, and how many postings were looked at.

    Cursors are kept in order of their documents. The pivot is the first cursor at which the bounds so far can beat the
    k-th best score; documents before its own cannot, so the cursors skip them.
    """
    cursors = every = [Cursor(*x) for x in lists]
    heap: list[tuple[float, int]] = []  # (score, -id): the worst first
    scored = 0
    while True:
        cursors = sorted((c for c in cursors if c.at < len(c.ids)), key=Cursor.doc)
        floor = heap[0][0] if len(heap) == k else -math.inf
        total, pivot = 0.0, None
        for c in cursors:
            total += c.bound
            if total > floor + 1e-9 - 1e-6:  # scores are rounded to six places
                pivot = c.doc()
                break
        if pivot is None:
            break
        if cursors[0].doc() == pivot:
            score = 0.0
            for c in cursors:
                if c.doc() != pivot:
                    break
                score += c.parts[c.at]
                c.at += 1
                c.looks += 1
            scored += 1
            entry = (round(score, 6), -int(pivot))
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
        else:
            for c in cursors:
                if c.doc() >= pivot:
                    break
                c.move(pivot, stride)
    return [(-d, s) for s, d in sorted(heap, key=lambda e: (-e[0], -e[1]))], scored, sum(c.looks for c in every)


def wand_topk(index: Index, k: int = TOP, width: int = RANGE, kernel=pruned_topk) -> DataFrame:
    """qid, doc_id, score, rank by BM25 over distinct terms; kernel: pruned_topk, pivoted_topk or document_at_a_time."""
    part = idf_of(index.n) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(index.avgdl or 1.0)))
    terms = index.asked.select("t", "df").distinct()
    rows = index.postings.join(small(terms), "t").select(F.floor(F.col("doc_id") / width).alias("part"), "t", "doc_id", part.alias("c"))
    packed = rows.groupBy("part", "t").agg(F.sort_array(F.collect_list(F.struct("doc_id", "c"))).alias("p"))  # at most `width` documents; once a term, whoever asks
    each = packed.select("part", "t", F.struct(F.col("p.doc_id").alias("ids"), F.col("p.c").alias("cs")).alias("list"))
    lists = each.join(small(index.asked.select("qid", "t")), "t").groupBy("qid", "part").agg(F.collect_list("list").alias("lists"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                found, scored, *_ = kernel([(np.asarray(x["ids"], np.int64), np.asarray(x["cs"], float)) for x in r.lists], k)
                out += [(r.qid, d, s, scored) for d, s in found]
            yield pd.DataFrame(out, columns=["qid", "doc_id", "score", "scored"])

    return top_k(lists.mapInPandas(run, "qid long, doc_id long, score double, scored long"), k)


@query("wand_topk", _ranked_sql(_bm25_sql(distinct=True)))
def q_wand_topk(spark, sf_dir):
    return wand_topk(_both(spark, sf_dir)).select("qid", "doc_id", "score", "rank")


@query("daat_topk", _ranked_sql(_bm25_sql(distinct=True)))
def q_daat_topk(spark, sf_dir):
    """Document at a time: the same answers."""
    return wand_topk(_both(spark, sf_dir), kernel=document_at_a_time).select("qid", "doc_id", "score", "rank")


@query("wand_pivot", _ranked_sql(_bm25_sql(distinct=True)))
def q_wand_pivot(spark, sf_dir):
    """Pivots on upper bounds, with cursors that skip: the same answers."""
    return wand_topk(_both(spark, sf_dir), kernel=pivoted_topk).select("qid", "doc_id", "score", "rank")
