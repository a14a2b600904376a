"""Suffix-array deduplication by bucket-pointer refinement, to the depth that a repeat must have.

Every window of `length` bytes has a leader, the q-gram in it with the smallest hash; equal windows have equal leaders at
equal places, so the leaders' q-grams are the initial buckets, and a bucket that one window leads alone needs no sort.
Only leaders that occur twice keep their neighbourhood. Each suffix of it points to its bucket, at first that of its next 8
bytes. Buckets of several suffixes are refined by sorting on the bucket of the suffix 8 later, then 16, 32 and so on to
the whole depth; a suffix alone in its bucket is done, and its pointer serves all later steps as it is. Of equal windows
the first in the order of the documents stays and the others are marked.

Texts are packed into compressed batches once. Leaders are dealt as packed arrays by hash, neighbourhoods that are equal
within a batch are sent once, and marks return to the batch: a passage in a third of all documents is one entry a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import need
from siltstone.session import settle, small, table

#: Bytes of a repeat, and of a leading q-gram.
LENGTH, Q = 100, 32
#: Bytes of text in a batch, in a piece that is hashed at once, and behind one bucket.
BATCH, PIECE, PER_BUCKET = 4 << 20, 1 << 16, 8 << 20
_BYTE = np.random.default_rng(20240718).integers(0, 1 << 63, 256, dtype=np.uint64)
_BASE = 0xD6E8FEB86659FD93
_LOW = np.uint64((1 << 17) - 1)
_META = pa.struct([("id", pa.int64()), ("tie", pa.int64()), ("n", pa.int64()), ("row", pa.int64())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents to batches: what is known of each, and their bytes, compressed."""
    docs: list[dict] = []
    parts: list[bytes] = []
    size = 0

    def out() -> pa.RecordBatch:
        data = b"".join(parts)
        return pa.RecordBatch.from_arrays([pa.array([docs], pa.list_(_META)), pa.array([len(data)], pa.int64()), pa.array([pa.compress(data, "zstd", asbytes=True)], pa.binary())], names=["docs", "size", "data"])

    for b in batches:
        for key, row, text in zip(b.column("_id").to_pylist(), b.column("_row").to_pylist(), b.column("_text"), strict=True):
            data = (text.as_py() or "").encode("utf-8", "replace")
            tie = int.from_bytes(hashlib.sha256(data).digest()[:8], "big", signed=True)
            docs.append({"id": key, "tie": tie, "n": len(data), "row": row})
            parts.append(data)
            size += len(data)
            if size >= BATCH:
                yield out()
                docs, parts, size = [], [], 0
    if docs:
        yield out()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def runs(raw: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring windows with one leader: its hash, its place, the first window's place, the number of windows. ends: of the documents."""
    found, width = [], length - Q + 1
    for at in range(0, max(0, len(raw) - length + 1), PIECE):
        piece = raw[at : at + PIECE + length - 1]
        h, step = _BYTE[piece], 1
        while step < Q:
            h = h[:-step] * np.uint64(pow(_BASE, step, 1 << 64)) + h[step:]
            step *= 2
        h = _mix(h)
        key, step = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64), 1  # ties: the first
        while 2 * step <= width:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        if width > step:
            key = np.minimum(key[: len(key) - (width - step)], key[width - step :])
        lead = (key & _LOW).astype(np.int64)
        window = np.arange(at, at + len(lead))
        doc = np.searchsorted(ends, window, side="right")
        good = window + length <= ends[np.minimum(doc, len(ends) - 1)]
        new = np.concatenate([[True], (lead[1:] != lead[:-1]) | (good[1:] != good[:-1]) | (doc[1:] != doc[:-1])])
        first = np.flatnonzero(new)
        count = np.diff(np.concatenate([first, [len(lead)]]))
        keep = good[first]
        first, count = first[keep], count[keep]
        found.append((h[lead[first]], lead[first] + at, first + at, count))
    if not found:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3)
    return tuple(np.concatenate([f[k] for f in found]) for k in range(4))


def _opened(data: bytes, size: int, docs: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, size, "zstd", asbytes=True) if size else b"", np.uint8)
    return raw, np.cumsum([d["n"] for d in docs])


def _each(b: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The rows of a batch as Python values, one at a time."""
    columns = [b.column(c) for c in names]
    for i in range(b.num_rows):
        yield tuple(c[i].as_py() for c in columns)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)


def _cuts(h: np.ndarray, buckets: int) -> tuple[np.ndarray, Iterator[tuple[int, int, int]]]:
    """An order by bucket, and bucket, start and end of each one that occurs."""
    to = _bucket(h, buckets)
    order = np.argsort(to, kind="stable")
    names, start = np.unique(to[order], return_index=True)
    return order, zip(names.tolist(), start.tolist(), [*start[1:].tolist(), len(h)][: len(start)], strict=True)


def _leaders(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for number, docs, size, data in _each(b, "batch", "docs", "size", "data"):
                raw, ends = _opened(data, size, docs)
                h, place, *_ = runs(raw, ends, length)
                order = np.argsort(place, kind="stable")
                h, place = h[order], place[order]
                once = np.concatenate([[True], place[1:] != place[:-1]]) if len(h) else np.empty(0, bool)
                h, counts = np.unique(h[once], return_counts=True)
                order, spans = _cuts(h, buckets)
                h, more = h[order], (counts > 1)[order].astype(np.uint8)
                rows += [{"bucket": k, "batch": number, "h": h[x:y].tobytes(), "more": more[x:y].tobytes()} for k, x, y in spans]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("h", pa.binary()), ("more", pa.binary())]))

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[tuple]]:
    """The rows of one bucket after the other; they come sorted by bucket."""
    at, rows = None, []
    for b in batches:
        for bucket, *row in _each(b, "bucket", *names):
            if bucket != at and rows:
                yield rows
                rows = []
            at = bucket
            rows.append(tuple(row))
    if rows:
        yield rows


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The leaders of each batch that occur twice."""
    for rows in _by_bucket(batches, ("batch", "h", "more")):
        parts = [np.frombuffer(r[1], np.uint64) for r in rows]
        h, more = np.concatenate(parts), np.concatenate([np.frombuffer(r[2], np.uint8) for r in rows])
        values, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
        twice = ((counts > 1)[inverse] | (more > 0))
        cuts, out = np.cumsum([0] + [len(p) for p in parts]), []
        for r, x, y in zip(rows, cuts[:-1], cuts[1:], strict=True):
            if twice[x:y].any():
                out.append({"batch": r[0], "h": h[x:y][twice[x:y]].tobytes()})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("batch", pa.int64()), ("h", pa.binary())]))


_CONTEXT = np.dtype([("h", "<u8"), ("none", "u1"), ("id", "<i8"), ("tie", "<i8"), ("pos", "<i8"), ("doc", "<i4"), ("off", "<i4"), ("count", "<i4"), ("bytes", "<i4")])
_MARK = np.dtype([("doc", "<i4"), ("pos", "<i8"), ("count", "<i4")])
_SENT = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("heads", pa.binary()), ("body", pa.binary()), ("size", pa.int64()), ("marks", pa.binary())])


def _in_order(c: np.ndarray) -> np.ndarray:
    """Earlier documents first: null ids last, then by id, text and place."""
    return np.lexsort((c["pos"], c["tie"], c["id"], c["none"]))


def _contexts(length: int, buckets: int):
    """The neighbourhoods of repeated leaders by bucket; those that repeat within the batch are marked here."""

    def one(number: int, docs: list[dict], size: int, data: bytes, blobs: list[bytes]) -> Iterator[dict]:
        raw, ends = _opened(data, size, docs)
        h, place, first, count = runs(raw, ends, length)
        repeated = np.unique(np.frombuffer(b"".join(blobs), np.uint64))
        keep = np.isin(h, repeated)
        h, place, first, count = h[keep], place[keep], first[keep], count[keep]
        doc = np.searchsorted(ends, first, side="right")
        start = np.concatenate([[0], ends[:-1]])
        c = np.zeros(len(h), _CONTEXT)
        c["h"], c["doc"], c["off"], c["count"], c["bytes"] = h, doc, place - first, count, count + length - 1
        ids = [d["id"] for d in docs]
        c["none"] = np.array([x is None for x in ids], np.uint8)[doc]
        c["id"], c["tie"] = (np.array(x, np.int64)[doc] for x in ([x or 0 for x in ids], [d["tie"] for d in docs]))
        c["pos"] = first - start[doc]
        order = _in_order(c)
        c, first = c[order], first[order]
        text, seen, keep, marks = raw.tobytes(), set(), [], []
        for i, (a, n, hh, off) in enumerate(zip(first.tolist(), c["bytes"].tolist(), c["h"].tolist(), c["off"].tolist(), strict=True)):
            key = (hh, off, text[a : a + n])
            if key in seen:
                marks.append(i)
            else:
                seen.add(key)
                keep.append(i)
        out = np.zeros(len(marks), _MARK)
        for f in ("doc", "pos", "count"):
            out[f] = c[f][marks]
        if len(out):
            yield {"bucket": number % buckets, "batch": number, "heads": b"", "body": b"", "size": 0, "marks": out.tobytes()}
        c, first = c[keep], first[keep]
        order, spans = _cuts(c["h"], buckets)
        c, first = c[order], first[order]
        for k, x, y in spans:
            body = b"".join(text[a : a + n] for a, n in zip(first[x:y].tolist(), c["bytes"][x:y].tolist(), strict=True))
            yield {"bucket": k, "batch": number, "heads": pa.compress(c[x:y].tobytes(), "zstd", asbytes=True), "body": pa.compress(body, "zstd", asbytes=True), "size": len(body), "marks": b"", "_n": y - x}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in _each(b, "batch", "docs", "size", "data", "blobs"):
                rows = [{k: v for k, v in r.items() if k != "_n"} | {"heads": int(r["_n"]).to_bytes(8, "little") + r["heads"] if "_n" in r else b""} for r in one(*row)]
                yield pa.RecordBatch.from_pylist(rows, schema=_SENT)

    return run


def refine(pool: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """The bucket of the `length` bytes from each place of the pool on; left: bytes from there to the end of its context. Places with fewer get -1.

    Only buckets of several places are sorted again, on the pointers of their places and of those one step later. A place
    that is alone keeps its pointer, which tells it from all others at any depth.
    """
    n = len(pool)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = pool
    first = np.zeros(n, np.uint64)
    for k in range(8):
        first = (first << np.uint64(8)) | wide[k : n + k]
    _, bucket, counts = np.unique(first, return_inverse=True, return_counts=True)
    bucket, several, buckets, depth = bucket.astype(np.int64), counts[bucket] > 1, len(counts), 8
    while depth < length:
        step = min(depth, length - depth)
        again = np.flatnonzero(several & (left >= depth + step))
        if not len(again):
            break
        _, own, counts = np.unique(bucket[again] * buckets + bucket[again + step], return_inverse=True, return_counts=True)
        bucket[again] = own + buckets
        several[:] = False
        several[again] = counts[own] > 1
        if buckets + len(counts) > 1 << 31:
            bucket, counts = np.unique(bucket, return_inverse=True)[1].astype(np.int64), ()
            buckets = int(bucket.max()) + 1
        buckets, depth = buckets + len(counts), depth + step
    return np.where(left >= length, bucket, -1)


def _marked(length: int):
    """Windows that also start earlier, from the contexts of one bucket after the other."""

    def one(rows: list[tuple]) -> Iterator[dict]:
        heads, bodies, whose = [], [], []
        for batch, head, body, size, marks in rows:
            if marks:
                yield {"batch": batch, "marks": marks}
                continue
            n = int.from_bytes(head[:8], "little")
            heads.append(np.frombuffer(pa.decompress(head[8:], n * _CONTEXT.itemsize, "zstd", asbytes=True), _CONTEXT))
            bodies.append(pa.decompress(body, size, "zstd", asbytes=True))
            whose.append(np.full(n, batch))
        if not heads:
            return
        c, text, whose = np.concatenate(heads), b"".join(bodies), np.concatenate(whose)
        at = np.cumsum(c["bytes"].astype(np.int64)) - c["bytes"]
        order = _in_order(c)
        c, at, whose = c[order], at[order], whose[order]
        seen: set[tuple] = set()
        new = np.ones(len(c), bool)
        for i, (a, n, hh, off) in enumerate(zip(at.tolist(), c["bytes"].tolist(), c["h"].tolist(), c["off"].tolist(), strict=True)):
            key = (hh, off, text[a : a + n])
            if key in seen:
                new[i] = False
            seen.add(key)
        found = [(np.flatnonzero(~new), c["pos"][~new], c["count"][~new])]
        _, inverse, counts = np.unique(c["h"][new], return_inverse=True, return_counts=True)
        rest = np.flatnonzero(new)[counts[inverse] > 1]  # different contexts of one leader, in order
        if len(rest):
            sizes = c["bytes"][rest].astype(np.int64)
            pool = np.frombuffer(b"".join(text[a : a + n] for a, n in zip(at[rest].tolist(), sizes.tolist(), strict=True)), np.uint8)
            ends = np.cumsum(sizes)
            owner = np.repeat(np.arange(len(rest)), sizes)
            place = np.arange(len(pool))
            rank = refine(pool, ends[owner] - place, length)
            good = np.flatnonzero(rank >= 0)
            _, first, inverse = np.unique(rank[good], return_index=True, return_inverse=True)
            late = good[first[inverse] < np.arange(len(good))]
            who = owner[late]
            pos = late - (ends - sizes)[who]
            begin = np.concatenate([[True], (np.diff(late) != 1) | (np.diff(who) != 0)]) if len(late) else np.empty(0, bool)
            start = np.flatnonzero(begin)
            found.append((rest[who[start]], c["pos"][rest[who[start]]] + pos[start], np.diff(np.concatenate([start, [len(late)]]))))
        i, pos, count = (np.concatenate([f[k] for f in found]) for k in range(3))
        out = np.zeros(len(i), _MARK)
        out["doc"], out["pos"], out["count"] = c["doc"][i], pos, count
        order = np.argsort(whose[i], kind="stable")
        names, start = np.unique(whose[i][order], return_index=True)
        for batch, x, y in zip(names.tolist(), start, [*start[1:], len(i)][: len(start)], strict=True):
            yield {"batch": batch, "marks": out[order[x:y]].tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("batch", pa.int64()), ("marks", pa.binary())])
        for rows in _by_bucket(batches, ("batch", "heads", "body", "size", "marks")):
            yield pa.RecordBatch.from_pylist(list(one(rows)), schema=schema)

    return run


def _cut_out(length: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for docs, size, data, blobs in _each(b, "docs", "size", "data", "blobs"):
                raw, ends = _opened(data, size, docs)
                starts = np.concatenate([[0], ends[:-1]])
                marks = np.frombuffer(b"".join(blobs or []), _MARK)
                edge = np.zeros(len(raw) + 1, np.int32)
                begin = starts[marks["doc"]] + marks["pos"]
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + marks["count"] + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                out = []
                for d, x, y in zip(docs, starts.tolist(), ends.tolist(), strict=True):
                    own = gone[x:y]
                    step = np.diff(own.astype(np.int8), prepend=0, append=0)
                    spans = list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))
                    kept = raw[x:y][~own].tobytes()
                    out.append({"_row": d["row"], "n_bytes": y - x, "n_removed": int(own.sum()), "spans": [{"start": s, "end": e} for s, e in spans], "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept if texts else None})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("_row", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_sha256", pa.string()), ("kept", pa.binary())]))

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, length: int = LENGTH, texts: bool = True) -> DataFrame:
    """A row for each row of docs: its id, n_bytes, n_removed, spans (start and end in bytes of the maximal removed runs), kept_sha256, kept (the remaining bytes; null unless `texts`).

    A byte is removed if a string of `length` bytes that covers it also starts earlier: in a document of smaller id, or
    in the same document before. Null ids come last; documents of one id and different texts are ordered by their texts'
    hashes; rows that repeat id and text are one document, each with its result. Null and short texts lose nothing. An
    empty table gives no row. The id must be a whole number. Other columns of docs are not read.
    """
    need(docs, id_col, text)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"))
    body = F.coalesce(F.col("_text"), F.lit(""))
    base = settle(rows.select("_id", "_row", F.sha2(body, 256).alias("_sha"), F.octet_length(body).cast("long").alias("_n")))
    twins = settle(base.groupBy("_id", "_sha").agg(F.min("_row").alias("_one"), F.count("*").alias("_rows")).where("_rows > 1").select(F.col("_id").alias("_i"), F.col("_sha").alias("_s"), "_one"))
    some = twins.limit(1).count() > 0
    if some:
        again = base.join(small(twins), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_sha") == F.col("_s")) & (F.col("_row") != F.col("_one"))).select(F.col("_row").alias("_again"), "_one")
        again = settle(again)
        rows = rows.join(small(again.select("_again")), F.col("_row") == F.col("_again"), "left_anti")
    total = base.agg(F.sum("_n")).first()[0] or 0
    buckets = max(2 * spark.sparkContext.defaultParallelism, total // PER_BUCKET)
    packed = settle(rows.mapInArrow(_pack, "docs array<struct<id: long, tie: long, n: long, row: long>>, size long, data binary").select(F.monotonically_increasing_id().alias("batch"), "*"))
    leaders = packed.mapInArrow(_leaders(length, buckets), "bucket long, batch long, h binary, more binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    repeated = leaders.mapInArrow(_repeated, "batch long, h binary").groupBy(F.col("batch").alias("_b")).agg(F.collect_list("h").alias("blobs"))
    sent = packed.join(repeated, F.col("batch") == F.col("_b")).drop("_b").mapInArrow(_contexts(length, buckets), "bucket long, batch long, heads binary, body binary, size long, marks binary")
    marks = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_marked(length), "batch long, marks binary")
    marks = marks.groupBy(F.col("batch").alias("_b")).agg(F.collect_list("marks").alias("blobs"))
    kinds = "_row long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept_sha256 string, kept binary"
    done = packed.join(marks, F.col("batch") == F.col("_b"), "left").select("docs", "size", "data", "blobs").mapInArrow(_cut_out(length, texts), kinds)
    names = base.select("_id", F.col("_row").alias("_r"))
    if some:
        names = names.join(again, F.col("_r") == F.col("_again"), "left").select("_id", F.coalesce("_one", "_r").alias("_r"))
    out = names.join(done, F.col("_r") == F.col("_row"))
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_removed", "spans", "kept_sha256", "kept")


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
