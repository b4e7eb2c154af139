"""Similarity self-join of documents on word shingles, with signature trees.

A document's set holds the hashes of its distinct shingles of ``words`` consecutive words (the whole sequence where
there are fewer). Two documents link when the Jaccard similarity of their sets reaches percent/100. The join is exact:

1. equal sets are one vertex from here on (a 128-bit digest of the set);
2. two linked sets share one of their first ``n - ceil(n * percent / 100) + 1`` shingles in any common order of
   shingles, so that documents meet in buckets by such a shingle. Shingles found to be in very many buckets come last
   in that order;
3. a first round verifies, for every vertex, the pair with one likely partner; most copies of a large group are then
   in one component, and pairs inside a component need no second look;
4. in each bucket, a signature tree: documents by size, nodes with the OR of their bitmaps and their range of sizes. A
   dual traversal drops pairs of nodes whose maximum possible overlap is too small, or that are one class already. Of
   the pairs that remain, those that join two classes of the bucket are kept: a forest, never all pairs of a group;
5. the forests' components hold all pairs that may still link. In each, documents meet in pairs of blocks, a tree with
   wide bitmaps proposes pairs, and whole sets decide; links that join two classes are kept.

Cases. Documents without words or text have an empty set and link with nothing. Repeated rows are equal sets, which link.
Where ids are null or shared, every row is a document of its own; a component is named by the smallest id in it, and by
null if it has none. Texts may be of any length and are read whole. Candidates are tried in the order of their sizes and
ids, ties don't matter to the result. Other columns are not read by ``classes`` and pass ``first_of_each`` unread,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

#: Shingles in more buckets than this, or than a millionth of all entries, come last in the order of shingles.
HOT_BUCKETS = 30
LEAF = 32
#: Bytes of bitmaps that a tree compares at once.
CHUNK_BYTES = 4 << 20
#: Documents of a cluster that a task compares with as many others.
BLOCK = 512
#: Pieces into which the partners of one likely centre are dealt.
SALTS = 16


# ---------------------------------------------------------------- sets


def shingle_sets(buf: np.ndarray, off: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    low = C.lower_ascii(buf)
    s, e, first = C.word_spans(low, off, C.SPACE_WORD)
    wh = C.prefix_hash(C.span_hash(C.prefix_hash(low), s, e))
    lo, hi = first[:-1], first[1:]
    m = np.where(hi > lo, np.maximum(hi - lo - words + 1, 1), 0)
    row = np.repeat(np.arange(len(m)), m)
    start = np.arange(int(m.sum())) - (np.cumsum(m) - m)[row] + lo[row]
    h = C.span_hash(wh, start, np.minimum(start + words, hi[row]))
    cut = np.concatenate(([0], np.cumsum(m)))
    return [np.unique(h[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def needed(n, percent: int):
    """Least overlap that a set of n needs with any partner."""
    return -(-n * percent // 100)


def prefix_of(h: np.ndarray, percent: int, hot: np.ndarray) -> np.ndarray:
    p = len(h) - needed(len(h), percent) + 1
    if len(hot):
        at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
        h = h[np.argsort(hot[at] == h, kind="stable")]
    return h[:p]


def bitmap_of(h: np.ndarray, per: int = 1) -> bytes:
    """A bit for each hash, in ``per`` to twice as many bits as there are hashes."""
    bits = max(64, 1 << (per * len(h) - 1).bit_length())
    b = np.zeros(bits, np.uint8)
    b[(h & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(b, bitorder="little").tobytes()


def _sketches(docs: DataFrame, words: int, percent: int, hot=None, bitmaps: bool = False) -> DataFrame:
    """(doc_id, sig, n, prefix[, bits]) of each document with a set; n = 0 for the others."""
    extra = ", bits binary" if bitmaps else ""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = hot.value if hot is not None else np.zeros(0, np.uint64)
        for batch in batches:
            for part in C.slices(batch, "text", 1 << 20):
                sets = shingle_sets(*C.buffer_of(part.column("text")), words)
                cols = {
                    "doc_id": part.column("doc_id"),
                    "sig": pa.array([hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in sets], pa.binary()),
                    "n": pa.array([len(h) for h in sets], pa.int32()),
                    "prefix": pa.array([prefix_of(h, percent, last).view(np.int64) if len(h) else [] for h in sets], pa.list_(pa.int64())),
                }
                if bitmaps:
                    cols["bits"] = pa.array([bitmap_of(h) if len(h) else None for h in sets], pa.binary())
                yield pa.RecordBatch.from_pydict(cols)

    return docs.select("doc_id", "text").mapInArrow(make, f"doc_id long, sig binary, n int, prefix array<long>{extra}")


# ---------------------------------------------------------------- buckets


def _likely(batches: Iterator[pa.RecordBatch], percent: int, least_hot: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (token, n, vid): pairs of each document and the first of its bucket that its size allows; hot tokens."""
    for t in C.whole_groups(batches, "token"):
        token, vid, n = (t.column(c).to_numpy() for c in ("token", "vid", "n"))
        head = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        size = np.diff(np.append(head, len(token)))
        hot = token[head[size >= least_hot]]
        centre = np.repeat(head, size)
        many = size > 1
        for a, k in zip(head[many].tolist(), size[many].tolist()):
            if needed(int(n[a + k - 1]), percent) > n[a]:  # sizes too far apart: several centres
                c = a
                for i in range(a, a + k):
                    if needed(int(n[i]), percent) > n[c]:
                        c = i
                    centre[i] = c
        pair = vid != vid[centre]
        both = np.unique(np.stack([vid[pair], vid[centre[pair]]], 1), axis=0, return_counts=True) if pair.any() else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_pydict(
            {
                "vid": pa.array(np.concatenate([both[0][:, 0], hot]), pa.int64()),
                "centre": pa.array([*both[0][:, 1].tolist(), *[None] * len(hot)], pa.int64()),
                "n": pa.array(np.concatenate([both[1], np.zeros(len(hot), np.int64)]), pa.int64()),
            }
        )


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of buckets whose documents lie in several components."""
    for t in C.whole_groups(batches, "token"):
        token, comp = t.column("token").to_numpy(), t.column("comp").to_numpy()
        head = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        size = np.diff(np.append(head, len(token)))
        keep = np.repeat(np.minimum.reduceat(comp, head) != np.maximum.reduceat(comp, head), size)
        if keep.any():
            yield from t.filter(pa.array(keep)).to_batches()


def bucket_forest(n: np.ndarray, comp: np.ndarray, bits: list[bytes], percent: int, linked=None) -> list[tuple[int, int]]:
    """Of the pairs (i, j) of a bucket in order of size that may link (of which ``linked`` holds, if given): those that
    join two classes, comp being the classes so far. A tree for each width of bitmaps, with the larger documents that
    its own may link with, folded to that width."""
    out: list[tuple[int, int]] = []
    comp = comp.copy()
    width = np.array([len(b) for b in bits])
    for w in np.unique(width).tolist():
        own = np.flatnonzero((width >= w) & (n <= 100 * n[width == w].max() // percent))
        small = int((width[own] == w).sum())
        tree = SignatureTree(n[own], comp[own], [bits[k] for k in own], w)
        for i, j in tree.pairs(percent):
            keep = i < small
            i, j = i[keep], j[keep]
            while len(i):
                apart = tree.comp[i] != tree.comp[j]
                i, j = i[apart], j[apart]
                if len(i):
                    a, b = int(own[i[0]]), int(own[j[0]])
                    i, j = i[1:], j[1:]
                    if linked is None or linked(a, b):
                        out.append((a, b))
                        to, gone = comp[a], comp[b]
                        comp[comp == gone] = to
                        tree.comp[tree.comp == gone] = to
    return out


class SignatureTree:
    """Documents of a bucket in order of size; every node holds the OR of its bitmaps and ranges of what lies below."""

    def __init__(self, n: np.ndarray, comp: np.ndarray, bits: list[bytes], width: int):
        rows = np.zeros((len(n), width), np.uint8)
        for i, b in enumerate(bits):  # bit k of a wider bitmap is bit k mod width
            rows[i] = np.bitwise_or.reduce(np.frombuffer(b, np.uint8).reshape(-1, width), axis=0)
        self.bits, self.n, self.comp = rows.view(np.uint64), n, comp
        own = np.bitwise_count(self.bits).sum(1).astype(np.int64)
        self.own = own
        self.slack = n - own  # tokens that hide behind a bit of another
        level = [(i, min(i + LEAF, len(n))) for i in range(0, len(n), LEAF)]
        self.levels = [self._nodes(level)]
        while len(level) > 1:
            level = [(level[i][0], level[min(i + 3, len(level) - 1)][1]) for i in range(0, len(level), 4)]
            self.levels.append(self._nodes(level))

    def _nodes(self, spans: list[tuple[int, int]]) -> dict[str, np.ndarray]:
        s = np.array([a for a, _ in spans])
        return {
            "lo": s,
            "hi": np.array([b for _, b in spans]),
            "or": np.bitwise_or.reduceat(self.bits, s, axis=0),
            "min": np.minimum.reduceat(self.n, s),
            "max": np.maximum.reduceat(self.n, s),
            "slack": np.maximum.reduceat(self.slack, s),
            "c0": np.minimum.reduceat(self.comp, s),
            "c1": np.maximum.reduceat(self.comp, s),
        }

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i < j) of different components that may link. Depth first over chunks of node pairs, the smaller the
        wider the bitmaps are: bounded memory."""
        chunk = max(16, CHUNK_BYTES // (8 * self.bits.shape[1]))
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, x, y = todo.pop()
            node = self.levels[level]
            least = np.maximum(self._overlap(node["min"][x], node["min"][y], percent), needed(np.maximum(node["min"][x], node["min"][y]), percent))
            most = np.minimum(node["max"][x], node["max"][y])
            seen = np.bitwise_count(node["or"][x] & node["or"][y]).sum(1).astype(np.int64)
            most = np.minimum(most, seen + np.minimum(node["slack"][x], node["slack"][y]))
            one = (node["c0"][x] == node["c1"][x]) & (node["c0"][x] == node["c0"][y]) & (node["c1"][x] == node["c1"][y])
            stay = (most >= least) & ~one
            x, y = x[stay], y[stay]
            if not len(x):
                continue
            if level == 0:
                for a, b in zip(x.tolist(), y.tolist()):
                    yield from self._leaf(node["lo"][a], node["hi"][a], node["lo"][b], node["hi"][b], percent)
                continue
            below = len(self.levels[level - 1]["lo"])
            cx = (4 * x[:, None] + np.arange(4)).repeat(4, 1)
            cy = np.tile(4 * y[:, None] + np.arange(4), 4)
            ok = (cx < below) & (cy < below) & (cx <= cy)
            cx, cy = cx[ok], cy[ok]
            for at in range(0, len(cx), chunk):
                todo.append((level - 1, cx[at : at + chunk], cy[at : at + chunk]))

    @staticmethod
    def _overlap(a, b, percent: int):
        """Least overlap of sets of sizes a and b: o / (a + b - o) >= percent / 100."""
        return -(-(a + b) * percent // (100 + percent))

    def _leaf(self, a0, a1, b0, b1, percent):
        c = self.comp[a0]
        if (self.comp[a0:a1] == c).all() and (self.comp[b0:b1] == c).all():
            return
        rows = max(1, CHUNK_BYTES // (8 * self.bits.shape[1] * LEAF))
        for lo in range(a0, a1, rows):
            hi = min(a1, lo + rows)
            n, m = self.n[lo:hi, None], self.n[None, b0:b1]
            both = np.bitwise_count(self.bits[lo:hi, None] & self.bits[None, b0:b1]).sum(2, dtype=np.int64)
            only_a, only_b = self.own[lo:hi, None] - both, self.own[None, b0:b1] - both
            ok = (np.minimum(n - only_a, m - only_b) >= self._overlap(n, m, percent)) & (self.comp[lo:hi, None] != self.comp[None, b0:b1])
            i, j = np.nonzero(ok)
            i, j = i + lo, j + b0
            up = i < j
            if up.any():
                yield i[up], j[up]


def _traverse(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Forests of the buckets."""
    for t in C.whole_groups(batches, "token"):
        token, vid, comp = (t.column(c).to_numpy() for c in ("token", "vid", "comp"))
        n, bits = t.column("n").to_numpy().astype(np.int64), t.column("bits").to_pylist()
        head = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        found: set[tuple[int, int]] = set()
        for a, b in zip(head.tolist(), [*head[1:].tolist(), len(token)]):
            found.update(tuple(sorted((int(vid[a + i]), int(vid[a + j])))) for i, j in bucket_forest(n[a:b], comp[a:b], bits[a:b], percent))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


# ---------------------------------------------------------------- verification


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity. Texts travel, as they are smaller than sets of hashes: one for
    each pair, and that of b once for each b and salt."""
    ends = pairs.select(F.col("a").alias("_id")).union(pairs.select(F.col("b").alias("_id"))).distinct()
    own = docs.join(ends, docs["doc_id"] == ends["_id"], "left_semi").select("doc_id", "text")
    own = C.staged(own, "ngram-texts")
    salt = F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")
    leaves = pairs.withColumn("salt", salt).join(own, F.col("a") == F.col("doc_id")).select("b", "salt", "a", "text")
    centres = pairs.select("b", salt.alias("salt")).distinct().join(own, F.col("b") == F.col("doc_id")).select("b", "salt", F.lit(None).cast("long").alias("a"), "text")
    both = leaves.union(centres).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())

    def judge(batches):
        key, mine = None, []
        for batch in batches:
            for part in C.slices(batch, "text", 1 << 20):
                out = []
                sets = shingle_sets(*C.buffer_of(part.column("text")), words)
                for b, s, a, h in zip(*(part.column(c).to_pylist() for c in ("b", "salt", "a")), sets):
                    if a is None:
                        mine = mine if key == (b, s) else []
                        key = (b, s)
                        mine.append(h)
                        continue
                    for m in mine if key == (b, s) else ():
                        o = len(np.intersect1d(h, m, assume_unique=True))
                        if o and 100 * o >= percent * (len(h) + len(m) - o):
                            out.append((a, b))
                            break
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return C.staged(both.mapInArrow(judge, "a long, b long"), "ngram-links")


def _decided(clusters: DataFrame, comp: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that join classes, among documents (id) of one cluster (root). Members of a cluster lie in blocks by
    a hash, and every two blocks meet, so that no task holds a cluster."""
    sizes = clusters.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).withColumnRenamed("root", "_root")
    dealt = clusters.join(sizes, F.col("root") == F.col("_root")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.join(comp.select(F.col("id").alias("_c"), F.col("root").alias("comp")), F.col("id") == F.col("_c"), "left")
    dealt = dealt.select(F.col("id").alias("vid"), "root", "blocks", "block", F.coalesce("comp", "id").alias("comp"))
    met = dealt.join(docs, F.col("vid") == F.col("doc_id")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("pair")
    met = met.select(pair, "vid", "block", "comp", (F.col("block") == F.col("other")).alias("own"), "text")

    def judge(batches):
        for t in C.whole_groups(batches, "pair"):
            vid, block, comp = (t.column(c).to_numpy() for c in ("vid", "block", "comp"))
            own, pair = t.column("own").to_numpy(zero_copy_only=False), t.column("pair").to_numpy()
            head = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            out: list[tuple[int, int]] = []
            for a, b in zip(head.tolist(), [*head[1:].tolist(), len(pair)]):
                part = pa.table({"text": t.column("text").slice(a, b - a)}).combine_chunks().to_batches()
                sets = [h for p in part for q in C.slices(p, "text", 1 << 20) for h in shingle_sets(*C.buffer_of(q.column("text")), words)]
                n = np.array([len(h) for h in sets])
                order = np.argsort(n, kind="stable")
                sets, one = [sets[k] for k in order], own[a]
                v, c, where = (x[a:b][order] for x in (vid, comp, block))

                def linked(i: int, j: int, sets=sets, where=where, one=one) -> bool:
                    if not one and where[i] == where[j]:
                        return False
                    o = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    return o > 0 and 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o)

                some = n[order] > 0
                first = int((~some).sum())
                edges = bucket_forest(n[order][first:], c[first:], [bitmap_of(h, 16) for h in sets[first:]], percent, lambda i, j: linked(i + first, j + first)) if some.any() else []
                out += [(int(v[i + first]), int(v[j + first])) for i, j in edges]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    dealt = met.repartition("pair").sortWithinPartitions("pair", "vid")
    return C.staged(dealt.mapInArrow(judge, "a long, b long"), "ngram-links")


# ---------------------------------------------------------------- operator


def _plain(docs: DataFrame) -> bool:
    """Whether no id is null or shared."""
    return docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty()


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, in a column of the name that is returned."""
    name = C.free_name(docs, "_row")
    return C.staged(docs.withColumn(name, F.monotonically_increasing_id()), "ngram-rows"), name


def classes(docs: DataFrame, words: int = 5, percent: int = 80, hot_buckets: int = HOT_BUCKETS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    docs = docs.select("doc_id", "text")
    if _plain(docs):
        return _classes(docs, words, percent, hot_buckets)
    rows, name = _numbered(docs)
    told = _classes(rows.select(F.col(name).alias("doc_id"), "text"), words, percent, hot_buckets)
    told = told.select(F.col("doc_id").alias("_k"), "n_shingles", F.col("component_id").alias("_c"))
    told = rows.select(name, "doc_id").join(told, F.col(name) == F.col("_k"))
    names = told.groupBy("_c").agg(F.min("doc_id").alias("component_id"))
    return told.join(names, "_c").select("doc_id", "n_shingles", "component_id")


def _classes(docs: DataFrame, words: int, percent: int, hot_buckets: int) -> DataFrame:
    """The classes of documents whose ids are neither null nor shared."""
    spark = docs.sparkSession
    sketch = C.staged(_sketches(docs, words, percent), "ngram-sketches")
    sets = sketch.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("vid"))
    sets = C.staged(sets, "ngram-classes")
    reps = sets.select(F.col("vid").alias("doc_id"), "sig")
    # round 1: a likely partner
    first = sketch.join(reps, ["doc_id", "sig"], "left_semi").dropDuplicates(["doc_id", "sig"])
    entries = first.select(F.explode("prefix").alias("token"), F.col("doc_id").alias("vid"), "n")
    total = sketch.agg(F.sum(F.size("prefix"))).first()[0] or 0
    least_hot = max(hot_buckets, int(total) // 1_000_000)
    sorted_ = entries.repartition("token").sortWithinPartitions("token", "n", "vid")
    likely = C.staged(sorted_.mapInArrow(lambda it: _likely(it, percent, least_hot), "vid long, centre long, n long"), "ngram-likely")
    # At most total / least_hot, that is a million, of eight bytes.
    hot = np.sort(likely.where("centre is null").select("vid").toArrow().column("vid").to_numpy().view(np.uint64))
    votes = likely.where("centre is not null").groupBy("vid", "centre").agg(F.sum("n").alias("n"))
    best = votes.groupBy("vid").agg(F.max(F.struct("n", "centre")).alias("m"))
    sizes = first.select("doc_id", F.size("prefix").alias("p"))
    pairs = best.join(sizes, F.col("vid") == F.col("doc_id")).where("2 * m.n >= p").select(F.col("vid").alias("a"), F.col("m.centre").alias("b"))
    links = _verified(C.staged(pairs, "ngram-pairs"), docs, words, percent)
    comp = components(links, "ngram-first")
    # round 2: all other pairs
    shared = spark.sparkContext.broadcast(hot)
    again = C.staged(_sketches(docs, words, percent, shared, bitmaps=True), "ngram-sketches").where("n > 0")
    again = again.join(reps, ["doc_id", "sig"], "left_semi").dropDuplicates(["doc_id", "sig"])
    vertex = again.join(comp, F.col("doc_id") == F.col("id"), "left").select(
        F.col("doc_id").alias("vid"), "sig", "n", "prefix", "bits", F.coalesce("root", "doc_id").alias("comp")
    )
    vertex = C.staged(vertex, "ngram-vertices")
    entries = vertex.select(F.explode("prefix").alias("token"), "vid", "sig", "comp").repartition("token").sortWithinPartitions("token")
    mixed = entries.mapInArrow(_mixed, "token long, vid long, sig binary, comp long")
    full = mixed.join(vertex.select("vid", "sig", "n", "bits"), ["vid", "sig"]).select("token", "vid", "n", "comp", "bits")
    full = full.repartition("token").sortWithinPartitions("token", "n", "vid")
    forest = C.staged(full.mapInArrow(lambda it: _traverse(it, percent), "a long, b long"), "ngram-forest")
    # A pair of the forest stands for all pairs of its two classes, so that classes are in clusters as a whole.
    clusters = components(forest.union(links), "ngram-clusters")
    open_ = clusters.join(forest.select(F.col("a").alias("id")).distinct(), "id", "left_semi").select("root").distinct()
    clusters = C.staged(clusters.join(open_, "root", "left_semi").select("id", "root"), "ngram-clusters")
    links = links.union(_decided(clusters, comp, docs, words, percent))
    comp = components(links, "ngram-second")
    out = sketch.select("doc_id", "sig", F.col("n").cast("long").alias("n_shingles")).join(sets, "sig", "left")
    out = out.join(comp, F.col("vid") == F.col("id"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "vid", "doc_id").alias("component_id"))


def first_of_each(docs: DataFrame, words: int = 5, percent: int = 80, hot_buckets: int = HOT_BUCKETS) -> DataFrame:
    """docs with one document of each component: the one with the smallest id, rows without an id last; all columns kept.
    Rows without words are like nothing and all stay. Where ids are null or shared, every row is a document of its own."""
    if _plain(docs):
        kept = _classes(docs.select("doc_id", "text"), words, percent, hot_buckets).where("doc_id = component_id")
        return docs.join(kept.select(F.col("doc_id").alias("_kept")), docs["doc_id"] == F.col("_kept"), "left_semi")
    rows, name = _numbered(docs)
    told = _classes(rows.select(F.col(name).alias("doc_id"), "text"), words, percent, hot_buckets)
    told = told.select(F.col("doc_id").alias("_k"), "n_shingles", F.col("component_id").alias("_c"))
    told = told.join(rows.select(F.col(name).alias("_n"), F.col("doc_id").alias("_id")), F.col("_k") == F.col("_n"))
    first = told.groupBy("_c").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_k").alias("k"))).alias("first"))
    kept = C.staged(first.select(F.col("first.k").alias("_kept")), "ngram-kept")
    return rows.join(kept, rows[name] == kept["_kept"], "left_semi").drop(name)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 2), ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 90 * (na.n + nb.n - o)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""
