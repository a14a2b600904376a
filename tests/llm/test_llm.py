"""Dealt operators: against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, exact_dedup, langid, line_dedup, mixing, ngram_join, sharding, suffix_dedup, url_filter, warc

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, source string, lang string, _row long, size long, shard int"


def docs_of(spark, rows):
    """rows of (doc_id, text) or (doc_id, text, source); extra columns have names that operators use themselves."""
    return spark.createDataFrame([(*r, *(("s",) if len(r) == 2 else ()), "en", 1, 2, 3) for r in rows], COLUMNS)


def words_of(n, seed=0, size=40):
    rng = random.Random(seed)
    return [rng.choice("abcdefghij") + str(rng.randrange(size * 10)) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, long, equal and repeated rows."""
    long = " ".join(words_of(30_000, 5))
    return docs_of(spark, [(1, None, "a"), (2, "", None), (3, " \n", "a"), (4, long, "b"), (5, long, "b"), (None, "x", "a"), (6, "Equal TEXT", "c"), (7, "equal text", "c"), (7, "equal text", "c"), (8, "É", None)])


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


def words_to(i, n):
    """n words of letters that no other i has."""
    return ["".join(chr(97 + int(d)) for d in f"{i}{j:07d}") for j in range(n)]


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_exact_dedup(spark, odd, none):
    got = {(r["doc_id"], i): r for i, r in enumerate(exact_dedup.exact_dedup(odd).collect())}
    by = collections.defaultdict(list)
    for (d, _), r in got.items():
        by[d].append(r)
    assert by[1][0]["keep_id"] == by[2][0]["keep_id"] == 2 and by[1][0]["group_size"] == 2
    assert by[4][0]["keep_id"] == 5 and not by[4][0]["kept"] and by[5][0]["kept"] and by[5][0]["n_chunks"] > 10
    assert by[6][0]["group_size"] == 3 and sorted(r["kept"] for r in by[7]) == [False, True] and by[None][0]["kept"]
    assert by[7][0]["text_sha256"] == hashlib.sha256(b"equal text").hexdigest()
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_tells_chunks_of_one_identifier_apart(spark, odd):
    rows = [(i, f"text {i % 7}") for i in range(40)]
    got = exact_dedup.exact_dedup(docs_of(spark, rows), make_id=lambda b: bytes([b[-1] % 2])).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got} == {(i, max(j for j in range(40) if j % 7 == i % 7), len(range(i % 7, 40, 7))) for i in range(40)}


def test_cut_points_join_to_the_text_and_follow_content():
    data = " ".join(words_of(20_000)).encode()
    ends = exact_dedup.cut_points(data)
    assert ends[-1] == len(data) and ends == sorted(set(ends)) and max(b - a for a, b in zip([0, *ends], ends)) <= exact_dedup.MOST
    moved = exact_dedup.cut_points(b"z" * 700 + data)
    assert len({e + 700 for e in ends} & set(moved)) > 0.9 * len(ends)
    assert exact_dedup.cut_points(b"") == []


def test_mixing(spark, odd, none):
    rows = [(i, " ".join(words_of(1 + i % 50, i)), "abc"[0 if i % 3 else i % 2 + 1]) for i in range(600)]
    got = mixing.mix_sources(docs_of(spark, rows)).collect()
    again = mixing.mix_sources(docs_of(spark, rows[::-1])).collect()
    assert {(r["doc_id"], r["taken"]) for r in got} == {(r["doc_id"], r["taken"]) for r in again}
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6 * sum(sizes.values())
    assert all(abs(taken[s] - target[s]) <= 25 and target[s] <= 2 * sizes[s] for s in sizes)
    found = mixing.mix_sources(odd).collect()
    assert len(found) == 10 and {r["source"]: r["source_size"] for r in found}[None] == 1
    assert mixing.mix_sources(none).count() == 0
    filled = mixing.water_fill(spark.createDataFrame([(10, 3.0), (10, 1.0), (1000, 2.0), (0, 3.0)], "n long, weight double"), 1.5, 2)
    assert [r["target"] for r in filled.orderBy("n", F.desc("weight")).collect()] == pytest.approx([0, 20, 20, 1490])
    every = mixing.water_fill(spark.createDataFrame([(10, 3.0), (4, 1.0)], "n long, weight double"), 5.0, 2)
    assert sorted(r["target"] for r in every.collect()) == [8, 20]


def test_mixing_of_very_many_sources(spark):
    """Above the 100,000 sources that were once the most."""
    docs = spark.range(100_007).select(F.col("id").alias("doc_id"), F.lit("two words").alias("text"), F.format_string("s%06d", "id").alias("source"))
    r = mixing.mix_sources(docs).groupBy("source_size").agg(F.count("*").alias("n"), F.sum("target").alias("t"), F.sum("taken").alias("taken"), F.max("taken").alias("most")).collect()
    assert [(x["source_size"], x["n"]) for x in r] == [(2, 100_007)] and r[0]["t"] == pytest.approx(300_021) and r[0]["most"] <= 4


def test_line_dedup(spark, odd, none):
    rows = [(i, f"{' '.join(words_of(12, i))}\nOrder {i} was sent on day {i * 3} to the customer\nshort") for i in range(12)]
    got = line_dedup.drop_template_lines(docs_of(spark, [*rows, (99, "a quite different line of words here")])).collect()
    for r in got:
        if r["doc_id"] == 99:
            assert r["n_dropped"] == 0
        else:
            assert r["n_dropped"] == 1 and "Order" not in r["kept_text"] and r["kept_text"].endswith("short")
    copies = line_dedup.drop_template_lines(docs_of(spark, [(i, "one line that only copies of one text have") for i in range(20)]))
    assert copies.agg(F.sum("n_dropped")).first()[0] == 0
    assert line_dedup.drop_template_lines(odd).count() == 10 and line_dedup.drop_template_lines(none).count() == 0


def test_line_dedup_of_lines_in_two_texts(spark):
    passage = " ".join(words_of(60, 1))
    rows = [(1, f"own words of the first\n{passage}"), (2, f"quite other words here\n  {passage.replace(' ', '  ')}"), (3, "Order 1 of the day\nand a line alone here"), (4, "Order 2 of the day\nbut no other like it")]
    got = {r["doc_id"]: r for r in line_dedup.drop_template_lines(docs_of(spark, rows)).collect()}
    assert {d: r["n_dropped"] for d, r in got.items()} == {1: 1, 2: 1, 3: 0, 4: 0}
    assert got[1]["kept_text"] == "own words of the first" and got[2]["kept_text"] == "quite other words here"


def test_line_dedup_of_short_lines(spark):
    rows = [(i, f"{' '.join(words_of(12, i))}\nMenu\n\nAll rights reserved.\n本文由作者授权发布未经许可不得转载或复制全文内容") for i in range(20)]
    for r in line_dedup.drop_template_lines(docs_of(spark, rows)).collect():
        assert (r["n_dropped"], r["kept_text"]) == (3, f"{' '.join(words_of(12, r['doc_id']))}\n")
    few = line_dedup.drop_template_lines(docs_of(spark, rows[:2])).collect()
    assert {(r["n_dropped"], "Menu" in r["kept_text"]) for r in few} == {(2, True)}


def brute_repeats(rows, length):
    """Per document: removed bytes, as a mask."""
    seen, out = {}, {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.setdefault(b[p : p + length], (d, p))
        out[d] = gone
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, seed):
    rng = random.Random(seed)
    parts = [" ".join(words_of(n, n)) for n in (10, 25, 40, 60)] + ["ab" * 90, "é" * 120]
    rows = [(i, "".join(rng.choice([rng.choice(parts), " ".join(words_of(9, rng.random())), parts[3][rng.randrange(40) :]]) for _ in range(rng.randrange(5)))) for i in range(60)]
    rows += [(100, None), (101, "x" * 99), (102, "x" * 101), (103, "y" * 99)]
    want = brute_repeats(rows, 100)
    for r in suffix_dedup.remove_repeats(docs_of(spark, rows)).collect():
        gone, body = want[r["doc_id"]], (dict(rows)[r["doc_id"]] or "").encode()
        assert r["n_removed"] == sum(gone) and r["n_bytes"] == len(body)
        assert bytes(r["kept"]) == bytes(c for c, g in zip(body, gone) if not g) and r["kept_sha256"] == hashlib.sha256(bytes(r["kept"])).hexdigest()
        assert len(r["spans"]) == len(re.findall(b"\1+", bytes(gone)))


def test_suffix_dedup_of_odd_rows(spark, odd, none):
    got = suffix_dedup.remove_repeats(odd).collect()
    assert len(got) == 10 and [r["n_removed"] for r in got if r["doc_id"] == 5] == [[r["n_bytes"] for r in got if r["doc_id"] == 5][0]]
    twin = suffix_dedup.remove_repeats(docs_of(spark, [(1, "q" + "w" * 100 + "z" * 100)] * 2)).collect()
    assert len(twin) == 2 and twin[0] == twin[1] and twin[0]["n_removed"] == 0
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (3, None, None), (4, "http://c/ d", "x" * 300_000), (None, "u", ""), (5, "v", "only"), (5, "v", "only")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, offset int")
    folder = f"file://{tmp_path}/warc"
    index = warc.write_warc(pages, folder, archive_bytes=400)
    got = warc.read_warc(index, folder, gap=0).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got if r["page_id"] != 5) == [(0, "revisit", 3, 0), (1, "revisit", 2, 9), (2, "response", None, 9), (3, "response", None, 0), (4, "response", None, 300_000)]
    assert {r["payload"] for r in got if r["record_type"] == "response"} == {"<p>é</p>", "", "x" * 300_000, "only"}
    assert all(r["payload_digest"] == warc.digest((dict((p, h) for p, _, h in rows)[r["page_id"]] or "").encode()) for r in got)
    assert [r["record_type"] for r in got if r["page_id"] == 5] == ["response"] * 2
    late = warc.write_warc(pages, f"{folder}2", revisit_from=10)
    assert late.where("record_type = 'revisit'").count() == 0
    empty = warc.write_warc(pages.where("false"), f"{folder}3")
    assert warc.read_warc(empty, f"{folder}3").count() == 0


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(rows, k, percent):
    sets, up = {d: shingles(t, k) for d, t in rows}, {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize("k, percent, block", [(4, 85, 8), (5, 80, 256), (2, 60, 16)])
def test_ngram_join(spark, k, percent, block):
    rng, rows = random.Random(percent), []
    for i in range(240):
        base = words_of(rng.choice([3, 12, 60, 120]), seed=i % 9)
        for _ in range(rng.randrange(7)):
            base[rng.randrange(len(base))] = f"w{rng.randrange(30)}"
        rows.append((1000 - i, " ".join(base) + (" and a passage that many texts share" if i % 3 == 0 else "")))
    got = ngram_join.jaccard_components(docs_of(spark, rows), words=k, percent=percent, block=block).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, k, percent)
    assert sorted(r["component_id"] for r in got if r["stays"]) == sorted({r["component_id"] for r in got})


def test_ngram_join_of_odd_rows(spark, odd, none):
    got = ngram_join.jaccard_components(odd).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 10 and by[1]["component_id"] == 1 and by[2]["component_id"] == 2 and by[1]["n_shingles"] == 0 and by[1]["stays"]
    assert by[5]["component_id"] == 4 and by[7]["component_id"] == 6 and sum(r["stays"] for r in got if r["doc_id"] == 7) == 0
    assert by[8]["component_id"] == 8 and by[None]["component_id"] is None and by[None]["stays"]
    kept = ngram_join.jaccard_stays(odd)
    assert kept.columns == odd.columns and kept.count() == 7
    assert ngram_join.jaccard_components(none).count() == 0


def test_sharding(spark, odd, none):
    rows = [(i, f"text {i}", "abc"[i % 10 % 3] if i % 7 else None) for i in range(1003)]
    got = sharding.shard_rows(docs_of(spark, rows), 16).collect()
    shards = collections.defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r["slot"])
    assert sorted(shards) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    source = {d: s for d, _, s in rows}
    per = collections.Counter((r["shard"], source[r["doc_id"]]) for r in got)
    for s in {*source.values()}:
        own = [per[k, s] for k in range(16)]
        assert max(own) - min(own) <= 2
    again = sharding.shard_rows(docs_of(spark, rows[::-1]), 16).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in again}
    whole = sharding.shard_rows_whole(odd, 4)
    assert whole.count() == 10 and sorted(set(r["shard"] for r in whole.collect())) == [0, 1, 2, 3]
    assert sharding.shard_rows(none, 4).count() == 0


def test_sharding_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in sharding.op7_sharding(spark, SF).collect():
        body = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(body) + 1, zlib.crc32(body))


def test_langid(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    got = langid.op8_langid(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    profiles = langid.fitted(docs)
    by = {r["doc_id"]: r for r in langid.identify(odd, profiles).collect()}
    assert [by[d]["lang_pred"] for d in (1, 2, 3)] == ["und"] * 3 and by[8]["lang_pred"] != "und" and by[4]["score"] <= 1
    assert langid.identify(none, profiles).count() == 0 and langid.train_profiles(none) == {}
    assert {r["lang_pred"] for r in langid.identify(odd, {}).collect()} == {"und"}


def test_language_distance_by_hand():
    import numpy as np

    vocabulary, ranks = np.array([1, 2, 3]), np.array([[0, 1, 2], [2, 1, 300]])
    assert langid.distances(np.array([1, 2, 9]), vocabulary, ranks, 300).tolist() == [300, 302]
    codes, counts = langid.grams("Aa!")
    assert dict(zip(codes.tolist(), counts.tolist()))[ord("a")] == 2


def brute_hits(doc, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    w, hit, found = words(doc), set(), set()
    for name, t in items:
        v = words(t)
        n = min(10, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(name))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark, odd, none):
    items = [(1, " ".join(words_of(30, 1))), (2, "Three short words"), (3, " ".join(words_of(10, 2))), (10, "a a a a a a a a a a a a"), (4, None), (5, ""), (6, " ".join(words_of(5, 3))), (2, "Three short words")]
    rng, rows = random.Random(4), []
    for i in range(80):
        w = words_of(rng.randrange(60), 100 + i)
        at, own = rng.randrange(len(w) + 1), (rng.choice(items)[1] or "").split()
        a = rng.randrange(len(own) + 1)
        rows.append((i, " ".join(w[:at] + own[a : a + rng.randrange(9, 14)] + w[at:])))
    rows += [(90, "THREE, short; words!"), (91, "a " * 30), (92, items[0][1].upper()), (93, None)]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs_of(spark, rows), table).withColumn("n_hit", decontaminate.hit_words()).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["item_ids"])) for r in got} == {d: brute_hits(t, items) for d, t in rows}
    clean = decontaminate.decontaminate(docs_of(spark, rows), table)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, t in rows if not brute_hits(t, items)[1]} and clean.columns == COLUMNS.replace(",", "").split()[::2]
    assert decontaminate.contamination(odd, table).count() == 10 and decontaminate.contamination(none, table).count() == 0
    assert decontaminate.decontaminate(odd, table.where("false")).count() == 10


def test_url_rules(spark, none):
    urls = ["http://A.com/x", "https://example.com/en/1", "http://www.example.com/en/1?q", "ftp://n.net/es/", "http://net/fr/x#y", "http://spam-farm.example.org/a", "http://o.example.org/en", None, "no scheme", "http://x.notcom", "http://cheappills.org/"]
    pages = spark.createDataFrame([(i, u, 0) for i, u in enumerate(urls)], "page_id int, url string, score int")
    model = url_filter.train(pages, html=None)
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, model).orderBy("page_id").collect()]
    assert got[:5] == [("a.com", "/x", "com/", "allow"), ("example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("n.net", "/es/", "net/es/", "block"), ("net", "/fr/x", "net/fr/", "block")]
    assert got[5][2] is None and got[7] == got[8] == ("", "", None, "allow") and got[9][2] is None
    assert url_filter.judge_urls(pages.where("false"), model).count() == 0


def test_viterbi():
    words = url_filter.Words({"cheap": 5, "pills": 5, "the": 50, "he": 9})
    assert words.split("cheappills") == ["cheap", "pills"] and words.split("") == [] and words.split("thezzz") == ["the", "zzz"]


def test_url_words_of_any_rank_and_length(spark):
    long = "incomprehensibilitiesandmore"
    many = [(i, f"http://h{i}.org/", f"<p>{' '.join(words_to(i, 20_100))}</p>") for i in range(10)]
    host = "rareonewordhere" + "x" * 250 + long
    pages = spark.createDataFrame([*many, (98, "http://b.org/", f"zzrare {long}"), (99, f"http://zzrare{long}.{host}/q", "")], "page_id int, url string, html string")
    vocabulary, _ = model = url_filter.train(pages)
    counts = {r["w"]: r["n"] for r in vocabulary.table.collect()}
    assert len(counts) > 200_000 and counts[long] == counts["zzrare"] == 1
    got = {r["page_id"]: r["host_words"] for r in url_filter.judge_urls(pages, model).collect()}
    assert got[99].split()[:2] == ["zzrare", long] and got[99].split()[-1] == long


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept, rows = docs, docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, SF).collect()
        if name == "language_id":
            assert {r["doc_id"] for r in out} == {r["doc_id"] for r in rows if any(c.isalpha() for c in r["text"] or "")}
        elif name == "ngram_join":
            assert {r["doc_id"] for r in out} == {c for _, c in brute_components([(r["doc_id"], r["text"]) for r in rows], 5, 80).values()}
        elif name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert {r["doc_id"] for r in out} == {r["doc_id"] for r in rows if not brute_hits(r["text"], items)[1]}
        elif name == "mixing":
            assert collections.Counter(r["doc_id"] for r in out) == collections.Counter({r["doc_id"]: r["copies"] for r in mixing.mix_sources(kept).collect() if r["copies"]})
        else:
            assert len(out) == len(rows) and {*docs.columns, "shard", "slot"} == set(out[0].asDict())
        if name != "sharding":
            kept = spark.createDataFrame(out, docs.schema).repartition(2).checkpoint()
        rows = out
    assert names == ["language_id", "ngram_join", "decontamination", "mixing", "sharding"]
    assert corpus_pipeline.run(spark, SF).count() == len(rows)


def test_mixing_of_many_equal_hashes(spark):
    got = mixing.mix_sources(docs_of(spark, [(1, "same row here", "a")] * 30 + [(2, "other row", "b")] * 5)).collect()
    assert len(got) == 35 and len({(r["doc_id"], r["taken"]) for r in got}) == 2


CLASH = ("_s", "_cut", "_whole", "_copy", "_placed", "_bad", "_bad_text", "_keep", "_row", "_row_placed", "_lang_pred", "_lang_score", "_mix", "_mix_n", "_text", "_judged", "_judged_h", "size", "target", "copies", "taken", "source_size", "_size", "_copies", "_id", "_h", "_n", "label", "node")


def clashing(spark, rows):
    """documents with extra columns of all names that operators use themselves."""
    fields = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(*r, *(f"{c}{i}" for c in CLASH)) for i, r in enumerate(rows)], fields)


ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", None, "a", 3), (None, "no id here", "en", None, None), (5, "long " * 40_000, "en", "b", 7), (6, "the same row twice over here", "en", "a", 1), (6, "the same row twice over here", "en", "a", 1), (7, "É", None, "c", 1), (8, "and then there were words in a sentence of this language", "en", "a", 5)]


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_on_odd_rows(spark, stage):
    """Nulls, empty and long texts, repeated rows, an empty table and extra columns: no crash, and columns come back as they were."""
    import corpus_pipeline

    docs = clashing(spark, ODD)
    name, run = corpus_pipeline.STAGES[stage]
    assert run(spark, docs.where("false"), SF).count() == 0
    out = run(spark, docs, SF)
    assert out.columns == [*docs.columns, *(["shard", "slot"] if stage == 4 else [])]
    before, after = (collections.Counter(tuple(r)[: len(docs.columns)] for r in x.collect()) for x in (docs, out))
    assert set(after) <= set(before)
    rows = collections.Counter(r[0] for r in after.elements())
    if name == "language_id":
        assert not {1, 2, 3} & set(rows) and {8} <= set(rows)
    elif name == "ngram_join":
        assert rows == {1: 1, 2: 1, 3: 1, None: 1, 5: 1, 6: 1, 7: 1, 8: 1}
    elif name == "decontamination":
        assert after == before
    elif name == "mixing":
        want = mixing.mix_sources(docs.select("doc_id", "text", "source")).groupBy("doc_id").agg(F.sum("copies").alias("c")).where("c > 0").collect()
        assert rows == {r["doc_id"]: r["c"] for r in want}
    else:
        assert after == before and sorted(r["shard"] * 100 + r["slot"] for r in out.collect()) == sorted(100 * s for s in sorted(i * 16 // 9 for i in range(9)))


def test_operators_keep_columns_that_have_their_names(spark, tmp_path):
    docs = clashing(spark, ODD)
    mixed = mixing.mix_sources(docs)
    assert {tuple(r) for r in mixed.select(*[c for c in docs.columns if c not in mixing.NAMES]).collect()} == {tuple(r) for r in docs.select(*[c for c in docs.columns if c not in mixing.NAMES]).collect()}
    assert set(mixing.repeat_rows(mixed).columns) == set(mixed.columns)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.org/x").alias("url"), F.col("text").alias("html"), *CLASH)
    judged = url_filter.judge_urls(pages, url_filter.train(pages))
    assert set(pages.columns) < set(judged.columns) and judged.select(*CLASH).distinct().count() == len(ODD)
    assert exact_dedup.exact_dedup(docs).count() == suffix_dedup.remove_repeats(docs, texts=False).count() == line_dedup.drop_template_lines(docs).count() == len(ODD)
    index = warc.write_warc(pages, f"file://{tmp_path}/warc")
    assert warc.read_warc(index, f"file://{tmp_path}/warc").count() == len(ODD)


def brute_lines(rows, texts=5, fixed=0.6, verbatim=2, tokens=4, chars=16, short=16, depth=3):
    """Per row: the lines that go."""
    parsed = []
    for d, t in rows:
        for at, raw in enumerate((t or "").split("\n")):
            flat = re.sub(r"[ \t\r\f\x0B]+", " ", raw).strip(" ")
            if flat:
                masked = tuple("<*>" if re.search("[0-9]", w) else w for w in flat.split(" "))
                parsed.append((d, t or "", at, flat, masked))
    own = collections.defaultdict(set)
    for _, t, _, flat, masked in parsed:
        own[flat].add(t)
    leaf = lambda m: (len(m), m[:depth]) if len(m) >= tokens else None
    reach = collections.defaultdict(set)
    for _, t, _, _, m in parsed:
        reach[leaf(m)].add(t)
    forms = {(m, t) for _, t, _, _, m in parsed if leaf(m) and len(reach[leaf(m)]) >= texts}
    places = collections.Counter((leaf(m), p, w) for m, _ in forms for p, w in enumerate(m))
    def template(m):
        parts = tuple((p, w) for p, w in enumerate(m) if w != "<*>" and places[leaf(m), p, w] >= texts)
        return (leaf(m), parts) if leaf(m) and len(reach[leaf(m)]) >= texts and parts and len(parts) >= len(m) * fixed else None
    often = collections.defaultdict(set)
    for m, t in forms:
        often[template(m)].add(t)
    gone = collections.defaultdict(set)
    for d, t, at, flat, m in parsed:
        need = short if len(m) < tokens and len(flat) < chars else verbatim
        if len(own[flat]) >= need or template(m) and len(often[template(m)]) >= texts:
            gone[d].add(at)
    return gone


@pytest.mark.parametrize("options", [{}, {"tokens": 2, "texts": 3, "depth": 2, "chars": 8, "short": 3}])
def test_line_dedup_against_brute_force(spark, options):
    rng, rows = random.Random(7), []
    for i in range(160):
        lines = []
        for _ in range(rng.randrange(9)):
            lines.append(rng.choice([f"User {rng.choice('abc')} logged in from host h{rng.randrange(99)} at {i}:{rng.randrange(60)}", f"{rng.choice(['warn', 'info'])} the  job {rng.choice(['x', 'y', 'z'])} ended with code {rng.randrange(3)}", "Menu", "All rights reserved", "", "  ", " ".join(words_of(rng.randrange(1, 6), rng.randrange(60))), "a plain sentence that many have", f"own line of text number {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 16]}", "one\ttab here"]))
        rows.append((i, "\n".join(lines)))
    rows += [(900, None), (901, rows[3][1])]
    want = brute_lines(rows, **options)
    for r in line_dedup.drop_template_lines(docs_of(spark, rows), **options).collect():
        lines = (dict(rows)[r["doc_id"]] or "").split("\n")
        assert r["kept_text"] == "\n".join(x for i, x in enumerate(lines) if i not in want[r["doc_id"]]) and r["n_dropped"] == len(want[r["doc_id"]])


def test_sharding_against_brute_force(spark):
    rows = [(i, f"text {i}", "abc"[i % 10 % 3] if i % 7 else None) for i in range(500)]
    by = collections.defaultdict(list)
    for d, t, s in rows:
        by[s].append((int(hashlib.md5(f"shard:{d}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[:15], 16), d))
    order = sorted(((r + 0.5) / len(x), s is not None, s or "", h, d) for s, x in by.items() for r, (h, d) in enumerate(sorted(x)))
    shard = [i * 16 // len(rows) for i in range(len(rows))]
    want = {x[-1]: (shard[i], i - shard.index(shard[i])) for i, x in enumerate(order)}
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_rows(docs_of(spark, rows), 16).collect()} == want


def brute_grams(text):
    words = re.sub(r"[\W\d_]+", " ", (text or "").lower()).split()
    found = collections.Counter()
    for w in words:
        found.update(w)
        w = f" {w} "
        found.update(w[i : i + 2] for i in range(len(w) - 1))
        found.update(w[i : i + 3] for i in range(len(w) - 2))
    return found


def best_of(counts, top=300):
    return sorted(counts, key=lambda g: (-counts[g], [len(g), *map(ord, g)]))[:top]


def test_langid_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    sums = collections.defaultdict(collections.Counter)
    for r in docs:
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            sums[r["lang"]].update(brute_grams(r["text"]))
    profiles = {x: {g: i for i, g in enumerate(best_of(c))} for x, c in sums.items()}
    got = {r["doc_id"]: r for r in langid.op8_langid(spark, SF).collect()}
    for r in docs:
        own = best_of(brute_grams(r["text"]))
        if not own:
            assert got[r["doc_id"]]["lang_pred"] == "und" and got[r["doc_id"]]["score"] == 0
            continue
        far = {x: sum(abs(p[g] - i) if g in p else 300 for i, g in enumerate(own)) for x, p in profiles.items()}
        near = min(sorted(far), key=far.get)
        assert got[r["doc_id"]]["lang_pred"] == near and got[r["doc_id"]]["score"] == pytest.approx(1 - far[near] / (300 * len(own)))


def brute_urls(pages):
    """Verdicts, and the tokens of each page: words by Viterbi, counts by hand."""
    import math

    def parts(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        return (low(m[1]), m[2]) if m else ("", "")

    def rule(host, path):
        fits = [(len(h) + len(p), v) for h, p, v in url_filter.RULES if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
        return max(fits)[1] if fits else None

    counts = collections.Counter()
    for _, url, html in pages:
        counts.update(re.findall("[a-z]+", re.sub("<[^>]*>", " ", html or "").lower()))
        if "-" in parts(url)[0]:
            counts.update(re.findall("[a-z]+", parts(url)[0]))
    total = sum(counts.values()) + 1

    def split(s):
        best = [(0.0, [])]
        for end in range(1, len(s) + 1):
            options = []
            for start in range(end):
                c = counts.get(s[start:end])
                options += [(best[start][0] + cost, start) for cost in ([math.log(total / c)] if c else []) + [math.log(total) + 3 * (end - start)]]
            cost, start = min(options)
            best.append((cost, [*best[start][1], s[start:end]]))
        return best[-1][1]

    def tokens(host, path):
        return [f"h:{w}" for x in re.findall("[a-z]+|[0-9]+", host) for w in split(x)] + [f"p:{w}" for w in re.findall(r"[^\W_]+", path.lower()) if not w.isdigit()]

    each = {i: (rule(*parts(url)), tokens(*parts(url))) for i, url, _ in pages}
    seen = {v: collections.Counter(t for u, ts in each.values() if u == v for t in ts) for v in ("block", "allow")}
    rows = collections.Counter(u for u, _ in each.values())
    kinds = set(seen["block"]) | set(seen["allow"])
    size = {v: sum(seen[v].values()) + len(kinds) + 1 for v in seen}
    odds = lambda t: math.log((seen["block"][t] + 1) / size["block"]) - math.log((seen["allow"][t] + 1) / size["allow"])
    prior = math.log((rows["block"] + 1) / (rows["allow"] + 1))
    return {i: (v or ("block" if ts and prior + sum(map(odds, ts)) > 0 else "allow"), v is None, ts) for i, (v, ts) in each.items()}


def test_url_filter_against_brute_force(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    more = [(10_000 + i, f"http://{'www.' * (i % 2)}{h}/{p}/{i}", "") for i, (h, p) in enumerate((h, p) for h in ("cheap-pills.example.net", "thetime.org", "a1b2.net", "timethe.com", "example.com") for p in ("en", "es", "fr", "x"))]
    want = brute_urls(pages + more)
    frame = spark.createDataFrame(pages + more, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(frame, url_filter.train(frame)).collect()}
    assert got == {i: v for i, (v, _, _) in want.items()}
    scored = [(v == "block", set(ts)) for v, own, ts in want.values() if own]
    assert {b for b, _ in scored} == {True, False}
    assert all(any((t in ts) != b for b, ts in scored) for t in set().union(*(ts for _, ts in scored)))  # no single word decides


def test_ngram_join_of_a_component_of_many_blocks(spark):
    """Over 1,000 different texts in a chain of near copies, an outlier, and a passage that all share."""
    base = words_of(60, 3)
    rows = [(i, " ".join([*base[:i % 40], f"v{i}", *base[i % 40 :], *(f"t{i // 40}x{j}" for j in range(2))])) for i in range(1100)]
    rows += [(5000, " ".join(base[:30])), (5001, " ".join(words_of(60, 4)))]
    docs = docs_of(spark, rows).select("*", *[F.lit("x").alias(c) for c in ("_keep", "_c", "label")])
    got = ngram_join.jaccard_components(docs, words=1, percent=90, block=32).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, 1, 90)
    assert ngram_join.jaccard_stays(docs, words=1, percent=90, block=32).columns == docs.columns


def test_warc_of_large_groups(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "same page" if i % 3 else f"page {i}" * 200) for i in range(3000)]
    folder = f"file://{tmp_path}/warc"
    index = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), folder, archive_bytes=20_000)
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload"]) for r in warc.read_warc(index, folder, gap=100, span=5000).collect()}
    last = max(i for i, _, h in rows if h == "same page")
    assert got == {i: ("revisit", last, None) if h == "same page" and i != last else ("response", None, h) for i, _, h in rows}


def test_suffix_refinement_equals_sorting():
    import numpy as np

    rng = random.Random(5)
    for length in (8, 20, 64, 100):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(300))) + b"abc" * rng.randrange(60) for _ in range(12)]
        pool = np.frombuffer(b"".join(texts), np.uint8)
        left = np.concatenate([np.arange(len(t), 0, -1) for t in texts])
        rank = suffix_dedup.refine(pool, left, length)
        data, seen = pool.tobytes(), {}
        for p, (r, n) in enumerate(zip(rank.tolist(), left.tolist())):
            if n < length:
                assert r == -1
            else:
                assert seen.setdefault(r, data[p : p + length]) == data[p : p + length]
        assert len(seen) == len({data[p : p + length] for p, n in enumerate(left.tolist()) if n >= length})
