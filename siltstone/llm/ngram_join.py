"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Documents with equal n-gram sets are one class, and only classes are joined. N-grams have one global order, frequent
ones last; if two sets are similar enough, the first n - a + 1 n-grams of each, with a the least overlap that their
sizes allow, have one in common. So only those prefixes are multiplied first, and only n-grams that two classes share
become rows. Pairs of classes below such an n-gram are discarded where their sizes, or their n-grams' counts by hash
bin, bound the overlap below what is needed; of the pairs left no list gives more than the edges that hold its members
together. The components of these edges hold every link. Each is put in blocks of a bounded size, in which the whole
incidence is multiplied, accumulating overlap counts, and again a block gives no more links than hold it together: a
group of m near copies gives about m links, not m * m. Texts of a component of many blocks meet across blocks only
where links within blocks, and between one text of each linked part, leave it in several parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import fresh, need
from siltstone.session import release, settle, small, table

#: Words of an n-gram and the least similarity, in percent, where no contract says otherwise.
WORDS, PERCENT = 5, 80
#: Classes in a block of the product, columns multiplied at once, classes per partition of the shared n-grams' search,
#: and members of a list that are compared at once.
BLOCK, COLUMNS, PER_BUCKET, LIST = 256, 4096, 5000, 256
#: Rows that a worker turns into sets at once, entries of sets that it multiplies at once, and nodes of which it joins edges.
ROWS, ENTRIES, NODES = 256, 1 << 19, 1 << 20
#: Bins of the counts that bound an overlap, by set size; larger numbers fold to smaller ones. Sets of n unrelated
#: n-grams differ by about 1.13 * sqrt(bins * n), links of 80 percent by at most 0.22 * n, so bins must grow with n.
BINS = ((256, 32), (1024, 128), (4096, 512), (16384, 2048), (1 << 62, 8192))
#: The frequent n-grams that are ordered last: a fixed bound on what is broadcast (8 bytes each). Any order gives the same result.
FREQUENT = 500_000
_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_MULT = [int(x) | 1 for x in _RNG.integers(0, 1 << 63, 64, dtype=np.uint64)]
_BASE = 0x9E3779B97F4A7C15
#: Bytes hashed at once; a text is cut between words.
SLICE = 1 << 16
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """1, B, B * B, ... and their inverses: at least n of each."""
    if not _POWERS or len(_POWERS[-1][0]) < n:
        found, inverse = [], pow(_BASE, -1, 1 << 64)
        for base in (_BASE, inverse):
            p, size = np.ones(1, np.uint64), 1
            while size < max(n, SLICE):
                p, size = np.concatenate([p, p * np.uint64(pow(base, size, 1 << 64))]), 2 * size
            found.append(p)
        _POWERS[:] = [tuple(found)]
    return _POWERS[-1]


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of data and its start; words end at blanks and \\x09-\\x0D."""
    raw = np.frombuffer(data, np.uint8)
    blank = (raw == 32) | ((raw - np.uint8(9)) <= 4)
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    power, inverse = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=sums[1:])
    return _mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64)), start


def _set_of(h: np.ndarray, words: int) -> np.ndarray:
    if not len(h):
        return h
    n = min(words, len(h))
    last = len(h) - n + 1
    total = np.full(last, n, np.uint64)
    for j in range(n):
        total += h[j : last + j] * np.uint64(_MULT[j % 64])
    total = np.sort(_mix(total))
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def _sets_of(h: np.ndarray, cuts: np.ndarray, words: int) -> list[np.ndarray]:
    """_set_of for the words between neighbouring cuts."""
    if len(h) < words:
        return [_set_of(h[x:y], words) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    last = len(h) - words + 1
    total = np.full(last, words, np.uint64)
    for j in range(words):
        total += h[j : last + j] * np.uint64(_MULT[j % 64])
    total, out = _mix(total), []
    spans = [(x, y - words + 1) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    for x, y in spans:
        if y > x:
            total[x:y].sort()
    new = np.concatenate([[True], total[1:] != total[:-1]])
    new[cuts[cuts < last]] = True
    for (x, y), end in zip(spans, cuts[1:].tolist(), strict=True):
        out.append(total[x:y][new[x:y]] if y > x else _set_of(h[x:end], words))
    return out


def ngram_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text, A-Z lower-cased; with fewer words the whole sequence is one."""
    out: list[np.ndarray] = []
    group: list[bytes] = []

    def flush() -> None:
        if group:
            h, start = _words(b" ".join(group))
            cuts = np.searchsorted(start, np.cumsum([0] + [len(g) + 1 for g in group]))
            out.extend(_sets_of(h, cuts, words))
            group.clear()

    size = 0
    for t in texts:
        data = (t or "").encode("utf-8", "replace").lower()
        if size + len(data) > SLICE:
            flush()
            size = 0
        if len(data) <= SLICE:
            group.append(data)
            size += len(data)
            continue
        parts, at = [], 0
        while at < len(data):  # cut after a blank, or at the end of a word that is longer than a slice
            end = min(len(data), at + SLICE)
            if end < len(data):
                last = max(data.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r"))
                end = last + 1 if last >= at else min([x for c in (b" ", b"\n", b"\t", b"\r") if (x := data.find(c, end)) >= 0], default=len(data))
            parts.append(_words(data[at:end])[0])
            at = end
        out.append(_set_of(np.concatenate(parts), words))
    flush()
    return out


def least_overlap(a: int, b: int, percent: int) -> int:
    """The least overlap of sets of these sizes with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def prefix(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The first n-grams in the global order: frequent ones last, else by hash. frequent: sorted."""
    n = len(tokens)
    take = min(n, n + (-percent * n // 100) + 1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        often = frequent[at] == tokens
        tokens = np.concatenate([tokens[~often], tokens[often]])
    return tokens[:take]


def bins(tokens: np.ndarray) -> bytes:
    """How many n-grams fall in each hash bin, 255 at most. The sum of two sets' differences is a lower bound of the n-grams that only one has."""
    n = next(b for most, b in BINS if len(tokens) < most)
    return np.minimum(np.bincount(((tokens >> np.uint64(7)) & np.uint64(n - 1)).astype(np.int64), minlength=n), 255).astype(np.uint8).tobytes()


def folded(counts: np.ndarray, n: int) -> np.ndarray:
    return counts.astype(np.int32).reshape(-1, n).sum(axis=0)


def _count_frequent(words: int, window: int = 1 << 20, least: int = 2):
    def flush(sets: dict[bytes, np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(list(sets.values())), return_counts=True) if sets else (np.empty(0, np.uint64),) * 2
        often = counts >= least
        return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, size = {}, 0
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                for s in ngram_sets(b.column(0).slice(at, ROWS).to_pylist(), words):
                    sets[hashlib.blake2b(s.tobytes(), digest_size=16).digest()] = s  # copies count once
                    size += len(s)
                    if size >= window:
                        yield flush(sets)
                        sets, size = {}, 0
        yield flush(sets)

    return run


def _sets(words: int, percent: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                keys, sizes, parts, counts = [], [], [], []
                for s in ngram_sets(b.column("_text").to_pylist(), words):
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sizes.append(len(s))
                    parts.append(prefix(s, often, percent).view(np.int64))
                    counts.append(bins(s))
                made = [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(parts, pa.list_(pa.int64())), pa.array(counts, pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_row"), *made], names=["_id", "_row", "_n", "_key", "_prefix", "_bins"])

    return run


def _dealt(buckets: int):
    """Prefix n-grams by bucket: a row for each bucket and batch, with the n-grams and classes as packed arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = b.column("_prefix")
            h = part.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            cls = np.repeat(b.column("_row").to_numpy(zero_copy_only=False), np.diff(part.offsets.to_numpy()))
            to = (h >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(to, kind="stable")
            h, cls, to = h[order], cls[order], to[order]
            cuts = np.searchsorted(to, np.arange(buckets + 1, dtype=np.uint64))
            rows = [{"bucket": k, "h": h[x:y].tobytes(), "cls": cls[x:y].tobytes()} for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("cls", pa.binary())]))

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The classes below each n-gram that two have, with their number, from rows of _dealt that are sorted by bucket. h is a hash of these classes: n-grams of the same classes give one list."""

    def found(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        h, cls = (np.frombuffer(b"".join(r[k] for r in rows), np.int64) for k in (0, 1))
        order = np.argsort(h, kind="stable")
        h, cls = h[order], cls[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        m = np.diff(np.concatenate([start, [len(h)]]))
        same = _mix(np.add.reduceat(_mix(cls.view(np.uint64) + np.uint64(_BASE)), start) + m.astype(np.uint64))
        once = np.zeros(len(start), bool)
        once[np.unique(same, return_index=True)[1]] = True
        keep = np.repeat(once & (m > 1), m)
        h, m = np.repeat(same.view(np.int64), m), np.repeat(m, m)
        return pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(cls[keep]), pa.array(m[keep])], names=["h", "cls", "m"])

    at, rows = None, []
    for b in batches:
        for bucket, *row in zip(*(b.column(c).to_pylist() for c in ("bucket", "h", "cls")), strict=True):
            if bucket != at and rows:
                yield found(rows)
                rows = []
            at = bucket
            rows.append(tuple(row))
    if rows:
        yield found(rows)


class Sets:
    """Disjoint sets of whole numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


class Stars:
    """Joins edges of any nodes and gives them back as an edge from each node to the least of its part."""

    def __init__(self):
        self.number: dict[int, int] = {}
        self.nodes: list[int] = []
        self.sets = Sets(0)

    def add(self, pairs: list[tuple[int, int]]) -> None:
        for pair in pairs:
            for x in pair:
                if x not in self.number:
                    self.number[x] = len(self.nodes)
                    self.nodes.append(x)
                    self.sets.up.append(len(self.sets.up))
            self.sets.join(self.number[pair[0]], self.number[pair[1]])

    def out(self) -> pa.RecordBatch:
        roots, least = [self.sets.root(i) for i in range(len(self.nodes))], {}
        for root, node in zip(roots, self.nodes, strict=True):
            least[root] = min(least.get(root, node), node)
        ends = [(node, least[root]) for root, node in zip(roots, self.nodes, strict=True) if node != least[root]]
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in ends], pa.int64()) for k in (0, 1)], names=["a", "b"])


def compatible(key: np.ndarray, n: np.ndarray, counts: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that join, below each key, the members that pairs within the bounds join. key is sorted; counts: as bins gives them."""
    low = np.stack([folded(c, BINS[0][1]) for c in counts]).astype(np.int16) if counts else np.empty((0, 1), np.int16)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    size = np.diff(np.concatenate([start, [len(key)]]))
    whose = np.repeat(np.arange(len(start)), size)
    left, sets, out = size - 1, Sets(len(key)), []  # joins that each list still lacks
    step, longest = 1, int(size.max(initial=0))
    while step < longest:
        i = np.flatnonzero((whose[:-step] == whose[step:]) & (left[whose[:-step]] > 0))
        if not len(i):
            break
        i = i[np.minimum(n[i], n[i + step]) * 100 >= np.maximum(n[i], n[i + step]) * percent]
        total = n[i] + n[i + step]
        apart = total - 2 * -(-percent * total // (100 + percent))  # the most n-grams that only one may have
        near = np.zeros(len(i), bool)
        for x in range(0, len(i), 1 << 16):
            part = i[x : x + (1 << 16)]
            near[x : x + (1 << 16)] = np.abs(low[part] - low[part + step]).sum(axis=1, dtype=np.int32) <= apart[x : x + (1 << 16)]
        for a, most in zip(i[near].tolist(), apart[near].tolist(), strict=True):
            b = a + step
            wide = min(len(counts[a]), len(counts[b]))
            if wide > BINS[0][1] and int(np.abs(folded(counts[a], wide) - folded(counts[b], wide)).sum()) > most:
                continue
            if sets.join(a, b):
                out.append((a, b))
                left[whose[a]] -= 1
        step += 1
    return out


def _edges(percent: int):
    """Edges that join the classes that edges below the same n-gram join, from rows sorted by list."""

    def found(rows: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        t = pa.Table.from_batches(rows)
        _, key = np.unique(t.column("list").to_numpy(), return_inverse=True)
        counts = [np.frombuffer(x, np.uint8) for x in t.column("_bins").to_pylist()]
        cls, n = t.column("cls").to_numpy(), t.column("_n").to_numpy()
        order = np.lexsort((n, key))
        pairs = compatible(key[order], n[order], [counts[k] for k in order.tolist()], percent)
        return [(int(cls[order[i]]), int(cls[order[j]])) for i, j in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        stars = Stars()
        for whole in batches:
            for at in range(0, whole.num_rows, LIST):
                b = whole.slice(at, LIST)
                lists = b.column("list").to_numpy()
                last = int(np.searchsorted(lists, lists[-1]))  # where the last list begins; it may go on
                if last and sum(x.num_rows for x in held) + last >= 16 * LIST:
                    stars.add(found([*held, b.slice(0, last)]))
                    held = [b.slice(last)]
                else:
                    held.append(b)
                if len(stars.nodes) >= NODES:
                    yield stars.out()
        if held:
            stars.add(found(held))
        yield stars.out()

    return run


def product(sets: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of all pairs of a block: the incidence matrix by its transpose, a range of hashes and some columns at a time. Sets are sorted."""
    m = len(sets)
    if m == 2:
        return np.array([[len(sets[0]), (n := len(np.intersect1d(sets[0], sets[1], assume_unique=True)))], [n, len(sets[1])]])
    out = np.zeros((m, m), np.float64)
    ranges = -(-sum(len(s) for s in sets) // ENTRIES)
    edges = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
    cuts = [[0, *np.searchsorted(s, edges).tolist(), len(s)] for s in sets]
    for k in range(ranges):
        own = [s[c[k] : c[k + 1]] for s, c in zip(sets, cuts, strict=True)]
        who = np.repeat(np.arange(m), [len(s) for s in own])
        _, column, counts = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        wide = counts > 1
        number = np.cumsum(wide) - 1
        keep = wide[column]
        who, column = who[keep], number[column[keep]]
        order = np.argsort(column, kind="stable")
        who, column = who[order], column[order]
        for start in range(0, int(wide.sum()), COLUMNS):
            x, y = np.searchsorted(column, (start, start + COLUMNS))
            a = np.zeros((m, COLUMNS), np.float32)
            a[who[x:y], column[x:y] - start] = 1
            out += a @ a.T
    return out


def forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of a block that join all of its classes that links join."""
    counts, sizes = product(sets), np.array([len(s) for s in sets])
    linked = (100 + percent) * counts >= percent * (sizes[:, None] + sizes[None, :])
    out, left = [], set(range(len(sets)))
    while left:
        stack = [left.pop()]
        while stack:
            i = stack.pop()
            for j in [j for j in np.flatnonzero(linked[i]).tolist() if j in left]:
                left.discard(j)
                stack.append(j)
                out.append((i, j))
    return out


def _blocks(words: int, percent: int):
    """Links within blocks, from rows sorted by block."""

    def links(members: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        return [(members[i], members[j]) for i, j in forest(sets, percent)] if len(members) > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members, sets, stars = None, [], [], Stars()
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                b = whole.slice(start, ROWS)
                for block, cls, own in zip(b.column("block").to_pylist(), b.column("cls").to_pylist(), ngram_sets(b.column("_text").to_pylist(), words), strict=True):
                    if block != at:
                        stars.add(links(members, sets))
                        members, sets = [], []
                    at = block
                    members.append(cls)
                    sets.append(own)
                if len(stars.nodes) >= NODES:
                    yield stars.out()
        stars.add(links(members, sets))
        yield stars.out()

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) from edges a, b, by large-star and small-star rounds, none if the edges are stars already."""
    e = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = F.count_if(F.col("v") < F.col("u"))
        nodes = settle(both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"), ((near > 1) | ((near == 1) & (F.count("*") > 1))).alias("more")))
        if nodes.where("more").isEmpty():  # each node is the least of its part or has one edge, to that
            release(nodes)
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        least = small(nodes.select("x", F.least("x", "m").alias("m")))
        large = settle(both.join(least, F.col("u") == F.col("x")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = settle(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m"))
        rest = large.join(small(least), F.col("u") == F.col("x")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = settle(rest.union(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct())
        for old in (e, nodes, large, least):
            release(old)
        e = new


def _pairs_of_parts(df: DataFrame, part: str, parts: str) -> DataFrame:
    """Each row once for each pair of parts, x <= y, that its own part is in; df has one row and x = y = 0 where there is one part."""
    other = F.explode(F.sequence(F.lit(0), F.greatest(F.col(parts).cast("int") - 1, F.lit(0))))
    both = df.withColumn("_o", other)
    return both.withColumn("x", F.least(part, "_o")).withColumn("y", F.greatest(part, "_o")).drop("_o")


def _listed(shared: DataFrame, reps: DataFrame) -> DataFrame:
    """list, cls, _n, _bins: the classes below each n-gram; a list of more than LIST is cut, and its parts are listed two by two."""
    cut = shared.withColumn("_parts", F.ceil(F.col("m") / F.lit(LIST))).withColumn("_part", F.pmod(F.xxhash64("cls"), F.col("_parts")).cast("int"))
    named = _pairs_of_parts(cut, "_part", "_parts").select(F.when(F.col("_parts") == 1, F.col("h")).otherwise(F.xxhash64("h", "x", "y")).alias("list"), "cls")
    return named.join(reps.select("_row", "_n", "_bins"), F.col("cls") == F.col("_row")).select("list", "cls", "_n", "_bins")


def _split(members: DataFrame, block: int) -> DataFrame:
    """block, cls: each member of a label in one block of about half the size given, or all of them in one if they fit."""
    sizes = members.groupBy("label").agg(F.count("*").alias("_m")).select(F.col("label").alias("_l"), "_m")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("_m") / F.lit(block / 2)))
    return members.join(sizes, F.col("label") == F.col("_l")).select(F.when(F.col("_m") <= block, F.col("label")).otherwise(F.xxhash64("label", part)).alias("block"), F.col("node").alias("cls"))


def _across(members: DataFrame, block: int) -> DataFrame:
    """block, cls: all pairs of members (label, node, own) whose own differs. The largest own of a label meets the others part by part, but not itself."""
    owns = members.groupBy("label", "own").agg(F.count("*").alias("_m"))
    most = owns.groupBy("label").agg(F.max(F.struct("_m", "own")).alias("f"), F.sum("_m").alias("_all"))
    most = most.select(F.col("label").alias("_l"), F.col("f.own").alias("_most"), F.ceil(F.col("f._m") / F.lit(block / 2)).cast("int").alias("_pl"), F.greatest(F.ceil((F.col("_all") - F.col("f._m")) / F.lit(block / 2)), F.lit(1)).cast("int").alias("_ps"))
    cut = members.join(most, F.col("label") == F.col("_l")).withColumn("_stray", F.col("own") != F.col("_most"))
    cut = cut.withColumn("_part", F.pmod(F.xxhash64("node"), F.when(F.col("_stray"), F.col("_ps")).otherwise(F.col("_pl"))).cast("int"))
    part, strays = F.col("_part"), F.sequence(F.lit(0), F.col("_ps") - 1)
    met = F.transform(F.sequence(F.lit(0), F.col("_pl") - 1), lambda i: F.struct(F.lit(0).alias("k"), i.alias("x"), part.alias("y")))
    each = F.transform(F.filter(strays, lambda j: j != part), lambda j: F.struct(F.lit(1).alias("k"), F.least(j, part).alias("x"), F.greatest(j, part).alias("y")))
    own = F.transform(strays, lambda j: F.struct(F.lit(0).alias("k"), part.alias("x"), j.alias("y")))
    pairs = cut.select("label", "node", F.explode(F.when(F.col("_stray"), F.concat(met, each)).otherwise(own)).alias("p"))
    return pairs.select(F.xxhash64("label", "p.k", "p.x", "p.y").alias("block"), F.col("node").alias("cls"))


def links_within(texts: DataFrame, joined: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """a, b: links that hold together what all links between texts (_r, _text) of one label (joined: node, label) do.

    Labels of at most `block` members are one block. Larger ones are first dealt to blocks once, and then one member of
    each part that links hold together; only where a label is still in several parts do these meet in all pairs.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def links(placed: DataFrame) -> DataFrame:
        blocks = texts.join(small(settle(placed)), F.col("cls") == F.col("_r")).select("block", "cls", "_text").repartition(parts, "block").sortWithinPartitions("block")
        return settle(blocks.mapInArrow(_blocks(words, percent), "a long, b long"))

    def parted(found: DataFrame) -> DataFrame:
        held = components(found.join(large.select(F.col("node").alias("_n")), F.col("a") == F.col("_n"), "left_semi")).select(F.col("node").alias("_n"), F.col("label").alias("_own"))
        return settle(large.join(held, F.col("node") == F.col("_n"), "left").select("label", "node", F.coalesce("_own", "node").alias("own")))

    found = links(_split(joined, block))
    sizes = joined.groupBy("label").agg(F.count("*").alias("_m")).where(F.col("_m") > block).select(F.col("label").alias("_l"))
    large = settle(joined.join(sizes, F.col("label") == F.col("_l"), "left_semi"))
    if large.isEmpty():
        return found
    found = found.union(links(_split(parted(found).select("label", F.col("own").alias("node")).distinct(), block)))
    members = parted(found)
    several = members.groupBy("label").agg(F.min("own").alias("_x"), F.max("own").alias("_y")).where("_x <> _y").select(F.col("label").alias("_l"))
    members = settle(members.join(several, F.col("label") == F.col("_l"), "left_semi"))
    return found if members.isEmpty() else found.union(links(_across(members, block)))


def _frequent(rows: DataFrame, words: int, most: int = FREQUENT) -> np.ndarray:
    """The most frequent n-grams, sorted: all those above the least count that leaves at most `most` of them."""
    counted = settle(rows.select("_text").mapInArrow(_count_frequent(words), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    level = F.floor(F.log2("n") * 16)
    levels = sorted(counted.groupBy(level.alias("k")).agg(F.count("*").alias("c")).collect(), reverse=True)  # 16 rows at most for each doubling
    total, least = 0, None
    for k, c in levels:
        total += c
        if total > most:
            break
        least = k
    found = np.empty(0, np.int64) if least is None else counted.where(level >= least).select("h").toArrow().column("h").to_numpy()
    release(counted)
    return np.sort(found.view(np.uint64))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """A row for each row of docs: its id, n_shingles, component_id, class_id, stays, row (its monotonically_increasing_id in docs).

    Two documents link if 100 * overlap >= percent * union of their n-gram sets. component_id is the smallest id that
    links reach, class_id that of the documents with the same set, and `stays` marks one row of each component: that
    with component_id. Null, empty and blank texts have no set, link with nothing and stay. Null ids come after all
    others; rows that repeat id and text are in one class and one of them stays. An empty table gives no row.
    """
    need(docs, id_col, text)
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"))
    frequent = spark.sparkContext.broadcast(_frequent(rows, words))
    sets = settle(rows.mapInArrow(_sets(words, percent, frequent), f"_id {kind}, _row long, _n long, _key binary, _prefix array<long>, _bins binary"))
    first = F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_row")))
    classes = settle(sets.where("_n > 0").groupBy("_key").agg(first.alias("f")).select("_key", F.col("f._id").alias("_least"), F.col("f._row").alias("_cls")))
    reps = sets.join(classes.select(F.col("_cls").alias("_c")), F.col("_row") == F.col("_c"), "left_semi")
    buckets = max(2 * spark.sparkContext.defaultParallelism, classes.count() // PER_BUCKET)
    dealt = reps.select("_row", "_prefix").mapInArrow(_dealt(buckets), "bucket int, h binary, cls binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    shared = settle(dealt.mapInArrow(_shared, "h long, cls long, m long").distinct())

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    joined = settle(components(settle(_listed(shared, reps).repartition(parts, "list").sortWithinPartitions("list").mapInArrow(_edges(percent), "a long, b long"))))
    links = links_within(rows.select(F.col("_row").alias("_r"), "_text"), joined, words, percent, block)

    final = components(links).select(F.col("node").alias("_node"), "label")
    labelled = classes.join(final, F.col("_cls") == F.col("_node"), "left").select("_key", "_least", "_cls", F.coalesce("label", "_cls").alias("_label"))
    best = labelled.groupBy("_label").agg(F.min(F.struct(F.col("_least").isNull(), F.col("_least"), F.col("_cls"))).alias("f")).select(F.col("_label").alias("_l"), F.col("f._least").alias("component_id"), F.col("f._cls").alias("_stay"))
    ends = labelled.join(best, F.col("_label") == F.col("_l")).select(F.col("_key").alias("_k"), F.col("_least").alias("class_id"), "component_id", "_stay")
    out = sets.select("_id", "_row", F.col("_n").alias("n_shingles"), "_key").join(ends, F.col("_key") == F.col("_k"), "left")
    alone = F.col("_k").isNull()
    return out.select(F.col("_id").alias(id_col), "n_shingles", F.when(alone, F.col("_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, F.col("_id")).otherwise(F.col("class_id")).alias("class_id"), (alone | (F.col("_row") == F.col("_stay"))).alias("stays"), F.col("_row").alias("row"))


def jaccard_stays(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs, all columns, with one row of each component and all rows without a set."""
    row = fresh(docs, "_row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    own = fresh(numbered, "_keep")
    keep = settle(jaccard_components(docs, id_col, text, **options).where("stays").select(F.col("row").alias(own)))
    return numbered.join(keep, F.col(row) == F.col(own), "left_semi").drop(row)


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs, words=4, percent=85).select("doc_id", "n_shingles", "component_id", "class_id")
