"""The k best of each query, kept while scores come by."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: What is yielded: a row for each query and what it keeps.
FOUND = "qid long, {} long, score double"


def rounded(s: np.ndarray) -> np.ndarray:
    """Scores in millionths, halves away from zero as in SQL."""
    y = s * 1e6
    whole = np.trunc(y)
    return whole + np.trunc((y - whole) * 2)


class Best:
    """The k best of each of n queries among the scores taken so far: score with six places, then id. It holds n times k."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def take(self, at: np.ndarray, s: np.ndarray, own: np.ndarray) -> None:
        """Scores of the queries at the places `at` (rows) for the ids `own` (columns); -inf is no hit."""
        near = 1e-6  # rounding moves a score by less
        floor = self.scores[at, -1]
        hits = (s >= floor[:, None] - near) & (s > -np.inf)
        if self.k < len(own) and np.count_nonzero(hits) > 4 * self.k * len(at):
            floor = np.maximum(floor, np.partition(s, len(own) - self.k, axis=1)[:, len(own) - self.k])
            hits = (s >= floor[:, None] - near) & (s > -np.inf)
        i, j = np.nonzero(hits)
        score, ids = rounded(s[i, j]) / 1e6 + 0.0, own[j]
        last, last_id = self.scores[at[i], -1], self.ids[at[i], -1]
        better = (score > last) | ((score == last) & (ids < last_id))
        i, score, ids = i[better], score[better], ids[better]
        if not len(i):
            return
        rows, i = np.unique(i, return_inverse=True)
        held = at[rows]
        each = np.concatenate([np.repeat(np.arange(len(rows)), self.k), i])
        score, ids = np.concatenate([self.scores[held].ravel(), score]), np.concatenate([self.ids[held].ravel(), ids])
        order = np.lexsort((ids, -score, each))
        first = np.searchsorted(each[order], np.arange(len(rows)))  # every query has k places at least
        order = order[first[:, None] + np.arange(self.k)]
        self.scores[held], self.ids[held] = score[order], ids[order]

    def rows(self, qids: np.ndarray, name: str = "vec_id") -> Iterator[pa.RecordBatch]:
        """qid, the id, score."""
        step = max(1, 100_000 // self.k)
        for i in range(0, len(qids), step):
            score = self.scores[i : i + step].ravel()
            there = score > -np.inf
            yield batch(np.repeat(qids[i : i + step], self.k)[there], self.ids[i : i + step].ravel()[there], score[there], name)


def batch(qids: np.ndarray, ids: np.ndarray, scores: np.ndarray, name: str = "vec_id") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(qids, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], ["qid", name, "score"])
