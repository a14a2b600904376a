"""Byte codecs: variable-length numbers and the index file, and their use as Arrow-batched functions."""

from __future__ import annotations

import io
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.catalog import query
from siltstone.operators.lexical import lists, passages, worded

# Fixed values of the index file: magic, versions, and the flag of the appended section.
MAGIC, VERSION, VERSION_2, FLAG_LENGTHS = b"BTP1", 1, 2, 1


def _encoded(values) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some numbers, and where each number ends."""
    v = np.asarray(values, np.uint64)
    if not len(v):
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    width = np.maximum(1, np.ceil(np.log2(v.astype(np.float64) + 1) / 7).astype(np.int64))
    width += (v >> (np.uint64(7) * width.astype(np.uint64)).clip(max=63)) > 0  # where the logarithm fell short
    end = np.cumsum(width)
    at = np.arange(end[-1]) - np.repeat(end - width, width)
    out = ((np.repeat(v, width) >> (np.uint64(7) * at.astype(np.uint64))) & np.uint64(127)).astype(np.uint8)
    out[end - 1] |= 128
    return out, end


def _decoded(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of some bytes, and the place of each number's last byte."""
    end = np.flatnonzero(raw & 128)
    if not len(end):
        return np.empty(0, np.uint64), end
    start = np.concatenate([[0], end[:-1] + 1])
    at = np.arange(end[-1] + 1) - np.repeat(start, end - start + 1)
    parts = (raw[: end[-1] + 1] & 127).astype(np.uint64) << (np.uint64(7) * at.astype(np.uint64))
    return np.add.reduceat(parts, start), end


def encode(values) -> bytes:
    """Seven bits a byte, low ones first; the high bit is set on a number's last byte."""
    return _encoded(values)[0].tobytes()


def decode(data: bytes) -> list[int]:
    return _decoded(np.frombuffer(data, np.uint8))[0].tolist()


def pack(postings: dict[str, list[int]], lengths: dict[int, int] | None = None) -> bytes:
    """An index file: header, terms in order with their ids; document lengths follow, under a flag, if given."""
    out = io.BytesIO()
    out.write(MAGIC + struct.pack("<HHI", *((VERSION, 0) if lengths is None else (VERSION_2, FLAG_LENGTHS)), len(postings)))
    for term, ids in sorted(postings.items()):
        name = term.encode()
        out.write(struct.pack("<H", len(name)) + name + struct.pack("<I", len(ids)) + np.asarray(ids, "<u4").tobytes())
    if lengths is not None:
        out.write(struct.pack("<I", len(lengths)) + np.array(sorted(lengths.items()), "<u4").tobytes())
    return out.getvalue()


def unpack(data: bytes, newest: int = VERSION_2, tail: bool = True) -> tuple[dict[str, int], dict[str, list[int]], dict[int, int]]:
    """Header, postings, lengths. Refuses other files, and versions newer than `newest`; without `tail` what follows the postings is not read."""
    source = io.BytesIO(data)
    take = lambda form: struct.unpack(form, source.read(struct.calcsize(form)))
    if source.read(4) != MAGIC:
        raise ValueError(f"not an index file: it begins with {data[:4]!r}")
    version, flags, terms = take("<HHI")
    if version > newest:
        raise ValueError(f"version {version} is newer than {newest}")
    postings = {}
    for _ in range(terms):
        name = source.read(take("<H")[0]).decode()
        postings[name] = np.frombuffer(source.read(4 * take("<I")[0]), "<u4").tolist()
    lengths = dict(np.frombuffer(source.read(8 * take("<I")[0]), "<u4").reshape(-1, 2).tolist()) if tail and flags & FLAG_LENGTHS else {}
    return {"version": version, "flags": flags, "terms": terms}, postings, lengths


def encode_lists(ids: pa.ListArray) -> pa.BinaryArray:
    """The gaps of each list, coded; all lists at once."""
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
    ends = np.concatenate([[0], np.cumsum(sizes)])
    own = ids.flatten().to_numpy().astype(np.int64)
    steps, first = np.diff(own, prepend=0), ends[:-1][sizes > 0]
    steps[first] = own[first]
    raw, end = _encoded(steps.view(np.uint64))
    offsets = np.concatenate([[0], end])[ends].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def decode_lists(data: pa.BinaryArray) -> pa.ListArray:
    """The inverse of encode_lists."""
    o = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(data), 0).to_numpy())])
    begin = np.frombuffer(data.buffers()[1], np.int32)[data.offset]
    steps, end = _decoded(np.frombuffer(data.buffers()[2] or b"", np.uint8)[begin : begin + o[-1]])
    ends = np.searchsorted(end, o)
    upto = np.concatenate([[0], np.cumsum(steps.view(np.int64))])
    ids = upto[1:] - np.repeat(upto[ends[:-1]], np.diff(ends))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))


def encode_gaps(ids: Column) -> Column:
    return F.arrow_udf(_encode_batch, "binary")(ids)


def decode_gaps(data: Column) -> Column:
    return F.arrow_udf(_decode_batch, "array<long>")(data)


def _encode_batch(ids: pa.Array) -> pa.Array:
    return encode_lists(ids)


def _decode_batch(data: pa.Array) -> pa.Array:
    return decode_lists(data)


def index_files(docs: DataFrame, blocks: int) -> DataFrame:
    """segment_id, index: an index file for each of `blocks` slices of the documents by id."""
    words = worded(docs).withColumn("segment_id", F.pmod("doc_id", F.lit(blocks)))

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        postings: dict[str, list[int]] = {}
        lengths = {}
        for doc, own in sorted(zip(frame["doc_id"], frame["words"], strict=True), key=lambda x: x[0]):
            lengths[doc] = len(own)
            for t in set(own):
                postings.setdefault(t, []).append(doc)
        return pd.DataFrame({"segment_id": [key[0]], "index": [pack(postings, lengths)]})

    return words.groupBy("segment_id").applyInPandas(build, "segment_id long, index binary")


@query("codec_round_trip", "SELECT count(DISTINCT term) AS terms, count(*) AS postings, 0::BIGINT AS wrong FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM documents)")
def codec_round_trip(spark, sf_dir):
    """Every posting list through the code and back."""
    back = lists(passages(spark, sf_dir)).withColumn("back", decode_gaps(encode_gaps(F.col("ids"))))
    return back.agg(F.count_distinct("term").alias("terms"), F.sum(F.size("ids")).alias("postings"), F.sum((F.col("ids") != F.col("back")).cast("long")).alias("wrong"))


@query("index_file")
def index_file(spark, sf_dir):
    """Index files as bytes, a slice of about 1,000 documents each."""
    docs = passages(spark, sf_dir)
    return index_files(docs, max(1, docs.count() // 1000)).select("segment_id", F.octet_length("index").alias("n_bytes"), F.md5("index").alias("digest"))
