"""Literal cases of the operators."""

import math
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone import catalog
from siltstone.functions import best
from siltstone.functions import text as T
from siltstone.operators import codec, lexical, parse, records, segments, vectors, wand
from siltstone.plans import naive
from siltstone.sources import files
from siltstone.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_tokens_keep_repeats(spark):
    assert one(spark, T.tokens(F.lit("a a B, é2"))) == ["a", "a", "b", "2"]


@pytest.mark.parametrize("a, b, n", [("kitten", "sitting", 3), ("block", "b1ock", 1), ("same", "same", 0), ("", "abc", 3)])
def test_levenshtein(spark, a, b, n):
    assert one(spark, F.levenshtein(F.lit(a), F.lit(b))) == n


@pytest.mark.parametrize("a, b, x", [("abc", "abc", 0), ("abcd", "abcx", 0.25), ("a b", "a \n b", 0), ("", "x", 0)])
def test_character_error_rate(spark, a, b, x):
    assert one(spark, T.character_error_rate(F.lit(a), F.lit(b))) == x


def test_extraction_failed(spark):
    assert [one(spark, T.extraction_failed(F.lit(x))) for x in ("", " \n\t", "word " * 200)] == [True, True, False]


@pytest.mark.parametrize("ids, steps", [([3, 17, 18, 92], [3, 14, 1, 74]), ([0, 1, 2], [0, 1, 1]), ([5], [5])])
def test_gaps_and_back(spark, ids, steps):
    column = F.array(*[F.lit(i).cast("long") for i in ids])
    assert one(spark, segments.gaps(column)) == steps
    assert one(spark, segments.from_gaps(segments.gaps(column))) == ids


def test_varbyte():
    values = [0, 1, 127, 128, 129, 16383, 16384, 1_000_000, 2**40]
    assert codec.decode(codec.encode(values)) == values
    assert (len(codec.encode([3])), len(codec.encode([200])), codec.encode([]), codec.decode(b"")) == (1, 2, b"", [])
    assert codec.encode([3])[0] == 0x83 and codec.encode([200]) == bytes([72, 129])


def test_index_file():
    postings = {"block": [0, 2], "a": [1], "é": [7]}
    head, back, lengths = codec.unpack(codec.pack(postings))
    assert (head["version"], head["terms"], back, lengths) == (1, 3, postings, {})
    new = codec.pack(postings, {0: 3, 1: 2})
    assert codec.unpack(new)[2] == {0: 3, 1: 2}
    with pytest.raises(ValueError):
        codec.unpack(new, newest=1)
    with pytest.raises(ValueError):
        codec.unpack(b"nope" + new[4:])


def test_merge_policy():
    groups, rewritten = segments.merge_plan([(str(i), 1) for i in range(16)], 4)
    assert len(groups) < 16 and sorted(x for g in groups for x in g) == sorted(map(str, range(16))) and rewritten > 0
    assert segments.merge_plan([("a", 9)], 4) == ([["a"]], 0)
    assert segments.tier(243, 3) == 4 and segments.tier(1000, 10) == 2


@pytest.mark.parametrize("ranked, relevant, p, ndcg", [([7, 1, 2], [7], 0.1, 1), ([1, 7, 2], [7], 0.1, 1 / math.log2(3)), ([1, 2, 3], [9], 0, 0), ([1, 2, 9, 8], [1, 2], 0.2, 1), ([*range(10), 77], [77], 0, 0)])
def test_metrics(spark, ranked, relevant, p, ndcg):
    rows = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(ranked)], "qid int, doc_id int, rank int")
    got = lexical.evaluated(rows, spark.createDataFrame([(1, d) for d in relevant], "qid int, doc_id int")).first()
    assert (round(got["precision"], 9), round(got["ndcg"], 9)) == (round(p, 9), round(ndcg, 9))


def test_fusion(spark):
    lists = [(i, 1, d, r) for i, x in enumerate(([10, 11, 12, 13], [13, 12, 99, 10])) for r, d in enumerate(x)]
    rows = spark.createDataFrame(lists, "list int, qid int, doc_id int, rank int")
    assert [r["doc_id"] for r in vectors.rrf(rows).orderBy("place").collect()] == [10, 13, 12, 11, 99]


def test_repeated_query_terms_count_twice_unless_distinct(spark):
    words = lexical.worded(docs_of(spark, ["block device", "block block the", "the", ""]))
    asked = spark.createDataFrame([(1, "block", 2)], "qid int, term string, qtf int")
    twice, once = (lexical.bm25(lexical.indexed(words, asked), distinct=d).orderBy("doc_id").collect() for d in (False, True))
    assert [round(a["score"] / b["score"], 4) for a, b in zip(twice, once, strict=True)] == [2, 2]
    assert lexical.corpus_stats(words)[0] == 4


def test_judgments_find_every_place(spark):
    docs = docs_of(spark, ["one two three four five", "xone two three fourx", "two three", "five", "a one  two", None, ""])
    items = spark.createDataFrame([(1, "one two three four"), (2, "two three"), (3, "five"), (4, "one  two"), (5, ""), (6, "e two three f")], "item_id int, text string")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    want = {(q, d) for q, t in ((r["item_id"], r["text"]) for r in items.collect()) if t for d, x in texts.items() if t in x}
    got = [tuple(r) for r in lexical.judgments(docs, items).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_pruned_topk_equals_all(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(30):
        lists = [(np.unique(rng.integers(0, 200, rng.integers(1, 120))),) for _ in range(rng.integers(1, 5))]
        lists = [(ids, rng.integers(1, 9, len(ids)) / rng.integers(1, 4)) for (ids,) in lists]
        total: dict[int, float] = {}
        for ids, part in lists:
            for d, c in zip(ids.tolist(), part.tolist(), strict=True):
                total[d] = total.get(d, 0) + c
        want = sorted(((-round(s, 6), d) for d, s in total.items()))[:10]
        got, scored = wand.pruned_topk(lists, 10)
        assert [(-s, d) for d, s in got] == want and scored <= len(total)


@pytest.mark.parametrize("stride", [1, 3, 64])
def test_kernels_give_the_same_answers(stride):
    import numpy as np

    rng, looked = np.random.default_rng(5), []
    for _ in range(40):
        lists = [(ids, rng.integers(1, 99, len(ids)) / rng.integers(1, 9)) for ids in (np.unique(rng.integers(0, 900, rng.integers(1, 500))) for _ in range(rng.integers(1, 6)))]
        want, every = wand.document_at_a_time(lists, 10)
        got, scored, looks = wand.pivoted_topk(lists, 10, stride)
        assert got == want == wand.pruned_topk(lists, 10)[0] and scored <= every
        looked.append(looks)
    assert sum(looked) > 0


def test_lists_are_cut_by_ranges(spark):
    words = lexical.worded(docs_of(spark, ["a b", "a", "b a", "a"]))
    assert {(r["term"], r["part"], tuple(r["ids"])) for r in lexical.lists(words, 2).collect()} == {("a", 0, (0, 1)), ("a", 1, (2, 3)), ("b", 0, (0,)), ("b", 1, (2,))}


def test_stored_segments_are_compacted(spark, tmp_path):
    rows = spark.createDataFrame([(s, t, d) for s in range(9) for d in (2 * s, 2 * s + 1) for t in ("all", f"t{s}")], "segment_id long, term string, doc_id long")
    files.write_segments(rows, str(tmp_path / "old"))
    rewritten = segments.compact(spark, str(tmp_path / "old"), str(tmp_path / "new"), 3)
    new = spark.read.parquet(str(tmp_path / "new"))
    assert (new.select("segment_id").distinct().count(), rewritten) == (1, 36)
    assert sorted(map(tuple, new.select("term", "doc_id").collect())) == sorted(map(tuple, rows.select("term", "doc_id").collect()))


def test_index_readers():
    """Old and new readers on old and new data: read, refuse, read without lengths, read with them."""
    old, new = codec.pack({"a": [1]}), codec.pack({"a": [1]}, {1: 4})
    assert codec.unpack(old, newest=1)[1:] == ({"a": [1]}, {}) and codec.unpack(old)[1:] == ({"a": [1]}, {})
    assert codec.unpack(new, tail=False)[1:] == ({"a": [1]}, {}) and codec.unpack(new)[1:] == ({"a": [1]}, {1: 4})
    with pytest.raises(ValueError):
        codec.unpack(new, newest=1)


def test_line_numbers_snapshots_and_scales(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"c{n}.tsv").write_text("".join(f"{n}{i}\ttext {n} {i}\twith tab\n" for i in range(5)))
    path = str(tmp_path / "*.tsv")
    assert [r["line"] for r in files.numbered_lines(spark, path).orderBy("line").collect()] == list(range(15))
    wanted = spark.createDataFrame([(0,), (7,), (14,), (99,)], "line long")
    assert [tuple(r) for r in files.corpus_lines(spark, path, wanted).orderBy("pid").collect()] == [(0, "text 0 0\twith tab"), (7, "text 1 2\twith tab"), (14, "text 2 4\twith tab")]
    stored = str(tmp_path / "snap")
    assert files.snapshot(spark.range(3), stored).count() == 3 and files.snapshot(spark.range(5), stored).count() == 3
    assert files.snapshot(spark.range(5), stored, rows=5).count() == 5
    assert (files.scale("10k"), files.scale("10k", 7)) == (10_000, 7)
    for bad in (lambda: files.scale("2k"), lambda: files.require(spark, str(tmp_path / "none"), remedy="Fetch it first.")):
        with pytest.raises((ValueError, FileNotFoundError)):
            bad()
    files.require(spark, str(tmp_path / "c0.tsv"))


def test_measurements(tmp_path):
    from siltstone import measure

    path = str(tmp_path / "m.json")
    assert measure.read_measurements(path) == {}
    measure.write_measurements(path, {"a": 1, "b": 2})
    assert measure.write_measurements(path, {"b": 3})["a"] == 1 and measure.read_measurements(path)["b"] == 3 and "machine" in measure.read_measurements(path)
    assert "a" not in measure.write_measurements(path, {"c": 1}, merge=False)
    runs = []
    assert measure.best_of(lambda: runs.append(1) or len(runs))[0] == 3 and len(runs) == 3
    got = measure.growth([(10, 20.0), (100, 300.0)], 900.0)
    assert (got["last"], got["least"], got["most"], got["until_full"]) == (3.0, 2.0, 3.0, 300.0)
    assert measure.rebuild_ratio(lambda: sum(range(200_000)), lambda: sum(range(200))) > 1


def test_sequences():
    from siltstone.operators.evaluate import sequence_compare

    got = sequence_compare("the quick fox", "the slow fox")
    assert got["at"] == 4 and got["kind"] in ("replace", "delete", "insert") and 0.5 < got["ratio"] < 1
    assert sequence_compare("same", "same") == {"ratio": 1.0, "kind": None, "at": None, "a": None, "b": None} and sequence_compare(None, "x")["kind"] == "insert"


def test_pdf_by_place():
    import zlib

    body = b"BT 1 0 0 1 200 700 Tm (right) Tj ET BT 1 0 0 1 10 700 Tm (left) Tj 0 -20 Td (below) Tj ET"
    pdf = b"%PDF-1.4\nstream\n" + zlib.compress(body) + b"\nendstream\nstream\n" + zlib.compress(b"BT (next page) Tj ET") + b"\nendstream"
    assert parse.pdf_text_by_place(pdf) == "left right\nbelow\nnext page"
    assert parse.operator_counts(pdf) == {"BT": 3, "ET": 3, "Td": 1, "Tj": 4, "Tm": 2}


def test_boxes_and_wav_and_invoices(spark, tmp_path):
    import zlib

    words = spark.createDataFrame([(1, 1, 1, 2, 30, 5, 10, 8, "two"), (1, 1, 1, 1, 10, 6, 10, 8, "one"), (1, 1, 2, 1, 0, 20, 5, 5, "next")], "block int, par int, line int, i int, left int, top int, width int, height int, text string")
    assert [tuple(r[c] for c in ("text", "left", "top", "right", "bottom")) for r in parse.boxes_to_lines(words).orderBy("line").collect()] == [("one two", 10, 5, 40, 14), ("next", 0, 20, 5, 25)]
    (tmp_path / "inv-1.pdf").write_bytes(b"%PDF-1.4\nstream\n" + zlib.compress(b"BT (Invoice INV-1) Tj ET") + b"\nendstream")
    assert [tuple(r) for r in parse.invoices_of(files.files(spark, str(tmp_path), "*.pdf")).collect()] == [("inv-1", "Invoice INV-1")]
    (tmp_path / "truth.json").write_text('{"records": [{"id": 1,\n "lines": [{"n": 2}]}]}')
    assert files.truth_json(spark, str(tmp_path / "truth.json")).select(F.inline("records")).first()["lines"][0]["n"] == 2
    packed = files.small_files(docs_of(spark, [f"t{i}" for i in range(5)]), 2).orderBy("file_id").collect()
    assert [r["content"] for r in packed] == ["t0\nt1", "t2\nt3", "t4"]


def test_chunks(spark):
    text = "One two three. Four five! " * 20
    rows = T.chunk_fixed(docs_of(spark, [text, "", "  "]), size=60, overlap=10).collect()
    assert all(text[r["start"] : r["end"]] == r["chunk"] for r in rows) and {r["start"] % 50 for r in rows} == {0} and {r["doc_id"] for r in rows} == {0}
    got = one(spark, T.sentence_chunks(F.lit(text), 60))
    assert " ".join(c["text"] for c in got).split() == text.split() and all(len(c["text"]) <= 60 and c["text"][-1] in ".!?" for c in got)


def packed(text, most):
    """Sentence chunks one sentence at a time."""
    out, at = [], 0
    for s in filter(None, re.split(r"(?<=[.!?])\s+", text)):
        if out and len(out[-1][1]) + 1 + len(s) <= most:
            out[-1][1] += " " + s
        else:
            out.append([at, s])
        at += len(s) + 1
    return [(start, start + len(s), s) for start, s in out]


CHUNKED = ["", " ", "\n\n", "  Led by blanks. And ended by them.  ", "No end", "One.  Two!\n\nThree?\t", ". . b ... c", "é😀. " * 40, "x" * 130 + ". Short. " + "y" * 70, "a" * 59 + ". b. " + "c" * 60 + " d. e", "Dr.No stop. " * 9 + "\n", "x" * 1000]


@pytest.mark.parametrize("text", CHUNKED)
@pytest.mark.parametrize("most", [5, 60])
def test_sentence_chunks_against_brute_force(spark, text, most):
    assert [tuple(c) for c in one(spark, T.sentence_chunks(F.lit(text), most))] == packed(text, most)


@pytest.mark.parametrize("size, overlap", [(60, 10), (50, 0), (10, 9), (30, 20)])
def test_fixed_chunks_against_brute_force(spark, size, overlap):
    rows = T.chunk_fixed(docs_of(spark, [*CHUNKED, None]), size=size, overlap=overlap).collect()
    want = {(d, s, min(s + size, len(t)), t[s : s + size]) for d, t in enumerate(CHUNKED) for s in range(0, len(t), size - overlap) if t[s : s + size].strip()}
    assert {(r["doc_id"], r["start"], r["end"], r["chunk"]) for r in rows} == want and len(rows) == len(want)


def test_cut_words_against_brute_force(spark):
    want = set()
    for d, t in enumerate(CHUNKED):
        spans = [m.span() for m in re.finditer(r"\S+", t)]
        want |= {(d, s, t[a:b]) for s in range(20, len(t), 20) for a, b in spans if a < s < b}
    assert {tuple(r) for r in T.cut_words(docs_of(spark, [*CHUNKED, None]), 20).collect()} == want


@pytest.mark.parametrize("line, fields", [("a,b", ["a", "b"]), ('"a,b",c', ["a,b", "c"]), ('"say ""hi""",x', ['say "hi"', "x"]), ("a,,b", ["a", "", "b"]), ("a,", ["a", ""]), ("", [""]), (",a", ["", "a"]), ('x"y,z"w,""', ["xy,zw", ""]), ('"open, to the end', ["open, to the end"]), ('a"b""c",d', ['ab"c', "d"])])
def test_csv(spark, line, fields):
    assert one(spark, parse.csv_fields(F.lit(line))) == fields


def test_html_and_bytes():
    assert parse.html_text("<p>a&amp;b</p><script>x</script><td>1</td><td>2</td>") == "a&b\n1 2"
    head = b"RIFF" + bytes(4) + b"WAVE" + bytes(10) + (1).to_bytes(2, "little") + (16000).to_bytes(4, "little") + bytes(6) + (16).to_bytes(2, "little")
    assert parse.wav_header(head)["rate"] == 16000 != parse.wav_header(head, "big")["rate"]


def test_byte_views(spark):
    import struct

    dump = lambda b: one(spark, parse.hexdump(F.lit(bytearray(b))))
    assert dump(b"AB\x00") == ["00000000  41 42 00" + " " * 41 + " |AB.|"] and dump(b"") == []
    assert dump(bytes(range(48, 65)))[0] == "00000000  30 31 32 33 34 35 36 37  38 39 3a 3b 3c 3d 3e 3f  |0123456789:;<=>?|" and dump(bytes(17))[1].startswith("00000010  00 ")
    for x in (0.1, -2.5, 0.0, 5e-324, 1.7e308, float("inf")):
        assert one(spark, parse.double_at(F.lit(bytearray(struct.pack("<d", x))))) == x
    raw = F.lit(bytearray(b"\xfe\xff\xff\xff"))
    assert (one(spark, parse.number_at(raw, 0, 4)), one(spark, parse.number_at(raw, 0, 4, little=False)), one(spark, parse.number_at(raw, 2, 4))) == (-2, -16777217, None)


def test_pdf_streams():
    import zlib

    pdf = b"%PDF-1.4\n1 0 obj<</Filter/FlateDecode>>\nstream\n" + zlib.compress(b"BT (Hello \\(x\\)) Tj 0 -12 Td (there) Tj ET") + b"\nendstream"
    assert parse.pdf_text(pdf) == "Hello (x)\nthere"


def test_fallback_runs_only_where_needed(spark):
    rows = parse.with_fallback(docs_of(spark, ["x" * 50, "y"]), "text", lambda t: t, lambda t: t * 60).orderBy("doc_id").collect()
    assert [(len(r["extracted"]), r["dear"]) for r in rows] == [(50, False), (60, True)]


INVOICE = """Acme Corp
Invoice INV-0042 for Ridgeline Analytics
2024-01-02 2024-02-01 Net 30 Purchase order PO-77
Servo motor, 400W
2
ea
$412.00
$824.00
Subtotal
$824.00
Sales tax (7.25%)
$59.74
Total due
$1,883.74
Status: overdue"""


def test_records(spark):
    got = records.extract_records(docs_of(spark, [INVOICE, "nothing"]), ["Acme Corp"], ["Blue Harbor Robotics", "Ridgeline Analytics"]).orderBy("doc_id").collect()
    r = got[0]
    assert (r["invoice_id"], r["vendor"], r["customer"], r["issue_date"], r["due_date"], r["terms"], r["purchase_order"], r["total"], r["status"]) == ("INV-0042", "Acme Corp", "Ridgeline Analytics", "2024-01-02", "2024-02-01", "Net 30", "PO-77", 1883.74, "overdue")
    assert [(x["description"], x["quantity"], x["uom"], x["unit_price"], x["amount"]) for x in r["line_items"]] == [("Servo motor, 400W", 2, "ea", 412.0, 824.0)]
    assert got[1]["invoice_id"] is None and got[1]["vendor"] is None and got[1]["line_items"] == []
    lines = got and spark.createDataFrame([("INV-0042", "servo motor, 400W", 2)], "invoice_id string, description string, quantity int")
    table = spark.createDataFrame([("INV-0042", "Acme Corp", 1883.74, "overdue", "PO-77")], "invoice_id string, vendor string, total double, status string, purchase_order string")
    ask = lambda q: records.answer(q, table, lines).first()["answer"]
    assert (ask("How many invoices did Acme Corp issue?"), ask("total across all invoices from Acme Corp?"), ask("How many servo motors?"), ask("Why?")) == ("1", "1883.74", "2", None)
    assert [r[0] for r in records.describe("Which invoice is PO-77?", table, lines).collect()] == ["INV-0042"]


def test_files(spark, tmp_path):
    (tmp_path / "p.tsv").write_bytes(b"1\tone\ttwo\n2\tbad \xff\n")
    (tmp_path / "q.tsv").write_text("5\tfirst \n5\t second\n")
    (tmp_path / "r.tsv").write_text("5\t0\t1\t1\n5\t0\t2\t1\n5\t0\t2\t1\n")
    assert [tuple(r) for r in files.passages_tsv(spark, str(tmp_path / "p.tsv")).orderBy("pid").collect()] == [(1, "one\ttwo"), (2, "bad �")]
    assert [tuple(r) for r in files.queries_tsv(spark, str(tmp_path / "q.tsv")).collect()] == [(5, "second")]
    assert sorted(files.qrels_tsv(spark, str(tmp_path / "r.tsv")).first()["pids"]) == [1, 2]
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    assert [tuple(r) for r in files.files(spark, str(tmp_path), "*.pdf").select("stem", files.kind_of(F.col("content")), files.allocated(F.col("length"))).collect()] == [("a", "pdf", 4096)]
    rows = spark.createDataFrame([("b", 2), ("a", 3), ("a", 1)], "term string, doc_id long")
    files.write_run(rows, str(tmp_path / "run"))
    assert [tuple(r) for r in files.read_run(spark, str(tmp_path / "run")).orderBy("term").collect()] == [("a", [1, 3]), ("b", [2])]


def test_end_to_end_prompt(spark):
    got = naive.run(docs_of(spark, ["alpha beta", "gamma delta"]), "gamma delta", 1).first()["prompt"]
    assert "[1] gamma delta" in got and "alpha" not in got


def test_ann_recall(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 16)) + 3 * rng.normal(size=(20, 16))[rng.integers(0, 20, 2000)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    found = vectors.recall(vectors.cell_topk(v, vectors.asked(v)), vectors.exact_topk(v, vectors.asked(v)))
    assert found.agg(F.avg("recall")).first()[0] >= 0.9


def test_ann_recall_of_weak_clusters(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 32)) + 0.3 * rng.normal(size=(20, 32))[rng.integers(0, 20, 4000)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    truth = vectors.exact_topk(v, vectors.asked(v))
    assert vectors.recall(vectors.cell_topk(v, vectors.asked(v)), truth).agg(F.avg("recall")).first()[0] >= 0.9
    every = vectors.cell_topk(v, vectors.asked(v), probes=1000)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, truth.collect()))


def test_rerank_reads_vectors_and_whole_queries(spark):
    docs = docs_of(spark, ["alpha beta", "ключ слово другое", "needle", "gamma", None])
    items = spark.createDataFrame([(7, "ключ слово другое"), (8, "a1 a2 a3 a4 a5 a6 a7 a8 needle")], "item_id int, text string")
    best = {r["qid"]: r["doc_id"] for r in vectors.reranked(docs, items).where("rank = 1").collect()}
    assert best == {7: 1, 8: 2}


def test_grand_total_is_exact(spark):
    rows = spark.createDataFrame([(0, 1e15)] + [(i, 0.01) for i in range(1, 101)], "invoice_id long, total double").coalesce(1)
    assert records.answer("What is the total value of every invoice?", rows, None).collect()[0][0] == "1000000000000001.00"


@pytest.mark.parametrize("cosine", [False, True])
def test_best_holds_k_of_each_query_whatever_is_offered(monkeypatch, cosine):
    monkeypatch.setattr(vectors, "ROWS", 7)
    monkeypatch.setattr(vectors, "TILE", 20)
    rng = np.random.default_rng(3)
    x = rng.integers(-1, 2, (200, 4)).astype(np.float32)  # few different vectors: ties, and zeros
    q, ids = x[::9], rng.permutation(200)
    best = vectors.Best(q, 5, cosine)
    for i in range(0, 200, 40):
        best.offer(x[i : i + 40], ids[i : i + 40])
    assert best.scores.shape == best.ids.shape == (len(q), 5)
    length = lambda m: np.sqrt((m.astype(float) ** 2).sum(axis=1))
    for v, n, got, scores in zip(q, length(q), best.ids, best.scores, strict=True):
        s = x.astype(float) @ v
        s = np.round(np.divide(s, n * length(x), out=np.zeros(200), where=n * length(x) > 0) if cosine else s, 6)
        want = np.lexsort((ids, -s))[:5]
        assert got.tolist() == ids[want].tolist() and np.allclose(scores, s[want])


@pytest.mark.parametrize("most", [1 << 22, 0])
def test_matrices_rank_as_rows_do(spark, monkeypatch, most):
    docs = docs_of(spark, ["the cat", "the dog the cat", "the", "", None, "the bird", "The cat", "the cat sat on the mat"]).withColumn("doc_id", F.col("doc_id") * 3)
    items = spark.createDataFrame([(7, "the cat"), (2, "the the dog"), (5, "nowhere"), (6, "")], "item_id long, text string")
    monkeypatch.setattr(lexical, "DOCS", 3)
    monkeypatch.setattr(lexical, "MATRIX", most)
    index = lexical.indexed(lexical.worded(docs), lexical.queries_of(items))
    assert (index.n, index.avgdl) == (8, 17 / 8)
    plain = {"counts": lexical.term_counts(index), "tfidf": lexical.tfidf(index), "bm25": lexical.bm25(index), "distinct": lexical.bm25(index, distinct=True)}
    for name, found in lexical.best_of(index, tuple(plain), 3).items():
        rows = lambda df: [(r["qid"], r["doc_id"], float(r["score"]), r["rank"]) for r in df.orderBy("qid", "rank").collect()]
        assert rows(found) == rows(lexical.top_k(plain[name], 3)) and found.count() == 6


def test_words_are_counted_where_they_are_read(spark):
    docs = docs_of(spark, ["a b a", None, "c", "b b"])
    counted = lexical.counted(lexical.worded(docs), ["a", "b"])
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    assert [(r["doc_id"], r["dl"], r["ts"], r["tfs"]) for r in counted.orderBy("doc_id").collect()] == [(0, 3, [0, 1], [2, 1]), (1, 0, [], []), (2, 1, [], []), (3, 2, [1], [2])]


def test_both_rankings_come_from_one_index(spark, monkeypatch):
    made, make = [], lexical.indexed
    monkeypatch.setattr(lexical, "indexed", lambda *a: made.append(1) or make(*a))
    assert catalog.queries()["agreement"](spark, "/root/testdata/sf0.001").count() == 1 and len(made) == 1


def test_no_task_has_a_whole_segment(spark, tmp_path):
    rows = spark.range(40_000).select((F.col("id") % 2).alias("segment_id"), F.lit("the").alias("term"), F.col("id").alias("doc_id"))
    files.write_segments(rows, f"file://{tmp_path}/s")
    got = spark.read.parquet(f"file://{tmp_path}/s")
    assert len(list((tmp_path / "s" / "segment_id=0").glob("*.parquet"))) > 1
    assert got.groupBy("segment_id").agg(F.count_distinct("doc_id").alias("n")).orderBy("segment_id").collect() == [(0, 20_000), (1, 20_000)]


def test_streamed_files_grow_in_number_not_in_size(spark, monkeypatch):
    seen, run = [], ingest.ingest
    monkeypatch.setattr(ingest, "PER_CORE", 1 << 12)
    monkeypatch.setattr(ingest, "ingest", lambda s, source, *a: seen.append((len(s.read.parquet(source).inputFiles()), a[-1])) or run(s, source, *a))
    rows = catalog.queries()["stream_segments"](spark, "/root/testdata/sf0.001").count()
    assert seen[0][0] > 16 and 2 < seen[0][1] < seen[0][0] and rows > 0


def test_postings_are_counted_in_the_parts_that_texts_are_dealt_to(spark):
    plan = catalog.queries()["weighted_postings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and "hashpartitioning(term" not in plan


def test_ids_that_are_no_numbers_are_ranked_by_rows(spark):
    docs = spark.createDataFrame([("x", "the cat"), ("y", "the dog the dog")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "dog"), ("r", "cat the")], "item_id string, text string")
    found = lexical.best_of(lexical.indexed(lexical.worded(docs), lexical.queries_of(items)), ("bm25",), 1)["bm25"]
    assert [(r["qid"], r["doc_id"]) for r in found.orderBy("qid").collect()] == [("q", "y"), ("r", "x")]


def test_blocks_of_queries_give_the_same_rows(spark, monkeypatch):
    v = vectors.vectors(spark, "/root/testdata/sf0.001")
    rows = lambda: [sorted(tuple(r) for r in f(v, vectors.asked(v), 5).collect()) for f in (vectors.exact_topk, vectors.cell_topk)]
    one = rows()
    monkeypatch.setattr(vectors, "QUERIES", 4)
    assert rows() == one and one[0]
    assert vectors.exact_topk(v, vectors.asked(v).where("false"), 5).count() == 0


@pytest.mark.parametrize("blocks", [False, True])
def test_places_in_complete_rankings_are_counted_not_sorted(spark, tmp_path, monkeypatch, blocks):
    rng = np.random.default_rng(8)
    words = np.array([f"w{i}" for i in range(60)])
    texts = [" ".join(words[np.minimum(59, rng.geometric(0.08, rng.integers(1, 12)))]) for _ in range(700)]
    texts = [None, "", "ONE"] + texts + texts[:300] * 7 + ["w1"] * 200  # many equal scores, and 3,003 documents
    docs = [(int(i), t) for i, t in zip(rng.permutation(len(texts)) + 5, texts, strict=True)]
    items = [(9, "w1 w2 w50"), (2, ""), (4, "w3 w3 w4 w7"), (7, None), (1, "unseen"), (30, texts[10])]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    sorted_, plain = [], vectors.top_k
    monkeypatch.setattr(vectors, "top_k", lambda scores, k=10: (sorted_.append(scores.count()), plain(scores, k))[1])
    if blocks:
        monkeypatch.setattr(vectors, "CLOSE", 600)
    got = sorted(map(tuple, catalog.queries()["rrf_full"](spark, str(tmp_path)).select("qid", "doc_id", "score", "rank").collect()))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.sql(f"SELECT qid, doc_id, score, rank FROM ({catalog.oracle_sql()['rrf_full']})").fetchall())
    assert got == want and len(got) == 4 * len(items)
    assert max(sorted_) < len(docs) * len(items) / 2


def test_halves_are_rounded_as_in_sql():
    assert best.rounded(np.array([1 / 128, -1 / 128, 3 / 128, 0.1234564, 0.0])).tolist() == [7813, -7813, 23438, 123456, 0]


def test_lists_are_inverted_where_texts_are_read(spark, monkeypatch):
    rng = np.random.default_rng(11)
    texts = [None, "", "...", "Ab-c é1é ab", "x"] + [" ".join(f"{'É,'[i % 2]}W{w}" for i, w in enumerate(rng.integers(0, 40, rng.integers(0, 9)))) for _ in range(600)]
    docs = spark.createDataFrame([(int(i), t) for i, t in zip(rng.permutation(len(texts)) * 3, texts, strict=True)], "doc_id long, text string").repartition(3)
    want = {}
    for r in docs.select("doc_id", F.explode(F.array_distinct(T.tokens("text"))).alias("t")).collect():
        want.setdefault((r["t"], r["doc_id"] // 100), []).append(r["doc_id"])
    for n in (1, 50, 1 << 20):  # a text or word at once, some, all
        monkeypatch.setattr(lexical, "BYTES", n)
        monkeypatch.setattr(lexical, "WORDS", n)
        for rows in (docs, lexical.worded(docs)):
            got = lexical.lists(rows, 100).collect()
            assert {(r["term"], r["part"]): r["ids"] for r in got} == {k: sorted(v) for k, v in want.items()} and len(got) == len(want)
    plan = lexical.lists(docs, 100)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "collect_list" not in plan  # lists are sorted and moved, no row for each posting


def test_lists_of_small_batches_are_put_together(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("all"), (F.col("id") % 7).cast("string")).alias("text")).repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = {(r["term"], r["part"]): r["ids"] for r in lexical.lists(docs, 1000).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 24 and got[("all", 1)] == list(range(1000, 2000)) and got[("3", 2)] == [i for i in range(2000, 3000) if i % 7 == 3]


def test_lists_are_coded_together():
    rng = np.random.default_rng(12)
    rows = [sorted(set(rng.integers(0, 1 << int(b), rng.integers(0, 30)).tolist())) for b in rng.integers(1, 60, 300)] + [[], [0], [2**62], [-5, 7]]
    coded = codec.encode_lists(pa.array(rows, pa.list_(pa.int64())))
    assert [bytes(x) for x in coded.to_pylist()] == [codec.encode(np.diff(np.array(r, np.int64), prepend=0)) if r else b"" for r in rows]
    assert codec.decode_lists(coded).to_pylist() == rows
    assert codec.decode_lists(coded.slice(5, 40)).to_pylist() == rows[5:45] and codec.encode_lists(pa.array(rows, pa.list_(pa.int64())).slice(3, 9)).to_pylist() == coded.to_pylist()[3:12]
    assert codec.decode_lists(codec.encode_lists(pa.array([], pa.list_(pa.int64())))).to_pylist() == []
