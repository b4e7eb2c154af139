"""Near-duplicate embeddings by NN-descent.

1. Equal vectors are one vertex from here on, with the number of its rows. Vertices are numbered; vectors of different
   lengths are searched one length after the other.
2. A first neighbour graph: in each of some tables, random hyperplanes (as many as make cells of about ``cell``
   vectors) deal the vertices into cells, and each vertex takes its nearest of the cell. Cells that stay too large are
   dealt by a hash, so that no task holds them, and then split further by a random direction.
3. NN-descent: for some rounds, each vertex introduces its neighbours (those it points to and those that point to it,
   a bounded draw of both) to each other, and each keeps its nearest; rounds end when few lists change.
4. Edges of cosine >= threshold, in double precision, make components. A list whose last entry is such an edge is
   saturated and may leave links out: saturated vertices meet those of other components in new cells, until no two
   components meet. Then each list is enlarged to all of its component, which counts links exactly without listing them:
   members within half the angle of the threshold of their centre all link with each other, which needs no comparison;
   the others meet all members, block by block.
5. The audit: for rows whose id is divisible by 50, links are counted by brute force, in blocks. Recall is the mean, over
   rows with links, of the share that was found. While it is below ``recall``, another set of tables is drawn and joins
   the graph; if the last draw leaves it below, an error says so. It is logged and returned.

Cases. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do rows without
an id; both are kept, each under its own id. Vectors of different lengths don't link. Rows with equal vectors link, under
one id or several; rows that share an id but not the vector are different vertices, and each gets its own row. Of a
component, the smallest id is its name, and every row of that id is kept. Other columns are not read, nor returned. An
empty table gives no rows.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

NEIGHBOURS = 10
TABLES = 8
CELL = 200
MOST_CELL = 1_000
#: Vertices of a cell that meet in one task.
MOST_PART = 8_000
ROUNDS = 4
#: Rounds end when fewer than this share of the entries of lists change.
STILL = 0.02
BLOCK = 1_024
RECALL = 0.95
MOST_DRAWS = 16
#: Tables are so many that a pair at the threshold shares no cell with this probability at most.
MISS = 0.01
#: The audit takes the rows whose id is divisible by this, in blocks, until so many of them had links or all are taken.
QUERIES = 50
LINKED = 1_000
QUERY_BLOCK = 2_048


_log = logging.getLogger(__name__)


def _matrix(column: pa.Array) -> np.ndarray:
    raw, off = C.buffer_of(column)
    return np.ascontiguousarray(raw).view(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def unit_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, u): the unit vector in double precision as bytes; null where it links with nothing."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            at = column.offsets.to_numpy().astype(np.int64)
            flat = column.values.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)  # null components are nan
            n = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
            out: list[bytes | None] = [None] * len(n)
            for size in np.unique(n[n > 0]).tolist():
                rows = np.flatnonzero(n == size)
                x = flat[at[rows][:, None] + np.arange(size)]
                big = np.abs(x).max(1)
                fine = np.isfinite(big) & (big > 0)
                x = x[fine] / big[fine, None]
                x /= np.sqrt((x * x).sum(1))[:, None]
                for r, v in zip(rows[fine].tolist(), x):
                    out[r] = v.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "u"])

    return vectors.select(F.col(id_column).cast("long"), F.col(column).cast("array<double>")).mapInArrow(make, "id long, u binary")


def _runs(key: np.ndarray) -> Iterator[tuple[int, int]]:
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else []
    yield from zip(head, [*head[1:], len(key)])


def _edges(a, b, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array(np.asarray(a, np.int64)), "b": pa.array(np.asarray(b, np.int64)), "s": pa.array(np.asarray(s, np.float64))})


_EDGE = "a long, b long, s double"


def _nearest(ids: np.ndarray, x: np.ndarray, k: int, root: np.ndarray | None = None):
    """Directed edges from each to its k nearest of the group; with roots, to those of other components (a similarity
    of -2 stands for none)."""
    n = len(ids)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    k = min(k, n - 1)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    if root is not None:
        s[root[:, None] == root] = -2
    top = np.argpartition(s, n - k, axis=1)[:, n - k :]
    return np.repeat(ids, k), ids[top].ravel(), np.take_along_axis(s, top, 1).ravel()


def _split(rows: np.ndarray, x: np.ndarray, rng) -> Iterator[np.ndarray]:
    """Parts of at most MOST_CELL, halved along random directions between two members."""
    if len(rows) <= MOST_CELL:
        yield rows
        return
    p, q = rng.choice(len(rows), 2, replace=False)
    side = x[rows] @ (x[rows[p]] - x[rows[q]])
    order = np.argsort(side, kind="stable")
    half = len(rows) // 2
    yield from _split(rows[order[:half]], x, rng)
    yield from _split(rows[order[half:]], x, rng)


def _bits(n: int) -> int:
    return max(0, min(24, int(np.ceil(np.log2(max(n, 1) / CELL)))))


def tables_of(n: int, threshold: float) -> int:
    """Tables that n vertices need: each plane parts a pair at the threshold with probability angle / pi."""
    meet = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** _bits(n)
    return TABLES if meet >= 1 else max(TABLES, math.ceil(math.log(MISS) / math.log1p(-meet)))


def _draw(verts: DataFrame, n: int, dim: int, seed: int, tables: int, k: int, floor: float | None = None) -> DataFrame:
    """Edges of a set of tables of cells; with a floor, those at or above it between vertices of different ``root``."""
    names = ["id", "u"] if floor is None else ["id", "u", "root"]
    bits = _bits(n)
    planes = np.random.default_rng(seed).normal(size=(tables, max(bits, 1), dim))

    def code(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            for t in range(tables):
                cell = ((x @ planes[t].T > 0) @ (1 << np.arange(planes.shape[1]))).astype(np.int64) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell * tables + t), *batch.columns], names=["cell", *names])

    def near(batches):
        rng = np.random.default_rng(seed + 1)
        for table in C.whole_groups(batches, "cell"):
            ids, x = table.column("id").to_numpy(), _matrix(table.column("u").combine_chunks())
            root = None if floor is None else table.column("root").to_numpy()
            for a, b in _runs(table.column("cell").to_numpy()):
                for rows in _split(np.arange(a, b), x, rng):
                    if root is None:
                        yield _edges(*_nearest(ids[rows], x[rows], k))
                    elif (root[rows] != root[a]).any():
                        own, other, s = _nearest(ids[rows], x[rows], k, root[rows])
                        yield _edges(own[s >= floor], other[s >= floor], s[s >= floor])

    cells = verts.select(*names).mapInArrow(code, "cell long, id long, u binary" + ("" if floor is None else ", root long"))
    # Few cells, if any, are large; those are dealt so that a task holds a bounded part of them.
    large = verts.select(*names).mapInArrow(lambda it: (b.select(["cell"]) for b in code(it)), "cell long").groupBy("cell").count()
    large = C.staged(large.where(F.col("count") > MOST_PART), "nn-large")
    if not large.isEmpty():
        parts = F.ceil(F.col("count") / MOST_PART)
        cells = cells.join(large, "cell", "left").withColumn("cell", F.when(F.col("count").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", F.pmod(F.xxhash64("id", F.lit(seed)), parts)))).drop("count")
    return cells.repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(near, _EDGE)


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each vertex."""

    def keep(batches):
        for table in C.whole_groups(batches, "a"):
            a, b, s = (table.column(c).to_numpy() for c in "abs")
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            a, b, s = a[new], b[new], s[new]
            order = np.lexsort((b, -s, a))
            a, b, s = a[order], b[order], s[order]
            head = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            rank = np.arange(len(a)) - np.repeat(head, np.diff(np.append(head, len(a))))
            yield _edges(a[rank < k], b[rank < k], s[rank < k])

    return edges.repartition("a").sortWithinPartitions("a", "b").mapInArrow(keep, _EDGE)


def _introduce(graph: DataFrame, verts: DataFrame, k: int) -> DataFrame:
    """Edges between neighbours of a common vertex. Of those that point to a vertex, a draw of k at most by a hash takes
    part in a round, so that a vertex that many point to isn't a hot group."""
    back = graph.select(F.col("b").alias("v"), F.col("a").alias("w"))
    salted = back.groupBy("v", F.pmod(F.xxhash64("w"), F.lit(16)).alias("salt")).agg(F.min_by("w", F.xxhash64("w", "v")).alias("w"))
    both = graph.select(F.col("a").alias("v"), F.col("b").alias("w")).union(salted.select("v", "w")).distinct()
    own = both.join(verts, F.col("w") == F.col("id")).select("v", "w", "u").repartition("v").sortWithinPartitions("v", "w")

    def join(batches):
        for table in C.whole_groups(batches, "v"):
            w, x = table.column("w").to_numpy(), _matrix(table.column("u").combine_chunks())
            out = [_nearest(w[a:b], x[a:b], min(k, 4)) for a, b in _runs(table.column("v").to_numpy()) if b - a > 1]
            if out:
                yield _edges(*(np.concatenate(c) for c in zip(*out)))

    return own.mapInArrow(join, _EDGE)


def neighbour_graph(verts: DataFrame, n: int, dim: int, seed: int, k: int = NEIGHBOURS, tables: int = TABLES, rounds: int = ROUNDS) -> DataFrame:
    """(a, b, s): lists of about k nearest of every vertex, refined through neighbours of neighbours."""
    graph = C.staged(_best(_draw(verts, n, dim, seed, tables, k), k), "nn-graph")
    for _ in range(rounds):
        more = C.staged(_best(graph.union(_introduce(graph, verts, k)), k), "nn-graph")
        changed = more.join(graph.select(F.col("a").alias("_a"), F.col("b").alias("_b")), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti").count()
        graph = more
        if changed < STILL * k * n:
            break
    return graph


def _bridged(verts: DataFrame, links: DataFrame, members: DataFrame, dim: int, seed: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(links, members) joined over the pairs that saturated lists leave out. A link that is in neither list of its ends
    has two saturated ends. Cells of saturated vertices are drawn anew, in which each sees only vertices of other
    components, so that its own can't fill its list; that goes on until no two components meet."""
    while True:
        full = links.distinct().groupBy("a").count().where(F.col("count") >= NEIGHBOURS).select(F.col("a").alias("id"))
        left = C.staged(verts.join(full, "id", "left_semi").join(members, "id").select("id", "u", "root"), "nn-saturated")
        if left.select("root").distinct().count() < 2:
            return links, members
        n = left.count()
        seed += 1
        found = C.staged(_draw(left, n, dim, seed, tables_of(n, threshold), NEIGHBOURS, threshold).select("a", "b").distinct(), "nn-bridges")
        if found.isEmpty():
            return links, members
        links = C.staged(links.union(found), "nn-links")
        members = components(links, "nn-components")


def _centres(large: DataFrame, verts: DataFrame) -> DataFrame:
    """(root, centre): the direction of the sum of the members' unit vectors. Tasks hand on one sum for a component."""

    def add(batches):
        for batch in batches:
            root, x = batch.column("root").to_numpy(), _matrix(batch.column("u"))
            order = np.argsort(root, kind="stable")
            spans = list(_runs(root[order]))
            sums = [x[order[a:b]].sum(0).tobytes() for a, b in spans]
            yield pa.RecordBatch.from_pydict({"root": pa.array([root[order[a]] for a, _ in spans], pa.int64()), "sums": pa.array(sums, pa.binary())})

    def unite(batches):
        for table in C.whole_groups(batches, "root"):
            x, root = _matrix(table.column("sums").combine_chunks()), table.column("root").to_numpy()
            spans = list(_runs(root))
            c = np.stack([x[a:b].sum(0) for a, b in spans])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
            yield pa.RecordBatch.from_pydict({"root": pa.array([root[a] for a, _ in spans], pa.int64()), "centre": pa.array([v.tobytes() for v in c], pa.binary())})

    sums = large.join(verts, "id").select("root", "u").mapInArrow(add, "root long, sums binary")
    return sums.repartition("root").sortWithinPartitions("root").mapInArrow(unite, "root long, centre binary")


def _enlarged(members: DataFrame, verts: DataFrame, threshold: float) -> DataFrame:
    """(id, n): rows that each vertex of a component links with, itself not counted. In components of more than a block,
    members near the centre link with each other by the triangle inequality of angles; all other pairs are compared,
    blocks of the others with blocks of all."""
    sizes = C.staged(members.groupBy("root").agg(F.count("*").alias("size")), "nn-sizes")
    large = members.join(sizes.where(F.col("size") > BLOCK).select("root"), "root", "left_semi")
    own = members.join(verts, "id").select("id", "root", "u", "m")
    half = math.cos(math.acos(min(1.0, max(-1.0, threshold))) / 2) + 1e-9

    def near(batches):
        for batch in batches:
            x, c, known = _matrix(batch.column("u")), batch.column("centre"), batch.column("centre").is_valid().to_numpy(zero_copy_only=False)
            core = np.zeros(batch.num_rows, bool)
            if known.any():
                rows = np.flatnonzero(known)
                core[rows] = (x[rows] * _matrix(c.take(pa.array(rows)))).sum(1) >= half
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("id", "root", "u", "m")), pa.array(core)], names=["id", "root", "u", "m", "core"])

    told = own.join(_centres(large, verts).withColumnRenamed("root", "_root"), F.col("root") == F.col("_root"), "left").select("id", "root", "u", "m", "centre")
    told = C.staged(told.mapInArrow(near, "id long, root long, u binary, m long, core boolean"), "nn-members")
    # Every member lies in one block of its component and kind, by a hash; blocks hold about BLOCK members.
    count = told.groupBy("root").agg(F.count("*").alias("size"), F.count_if("core").alias("cores"), F.sum(F.when(F.col("core"), F.col("m"))).alias("mass"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    count = count.select(F.col("root").alias("_root"), blocks(F.col("cores")).alias("cb"), blocks(F.col("size") - F.col("cores")).alias("ob"), "mass")
    dealt = told.join(count, F.col("root") == F.col("_root"))
    hash_ = lambda n: F.pmod(F.xxhash64("id"), F.greatest(n, F.lit(1))).cast("int")
    block = F.when(F.col("core"), hash_(F.col("cb"))).otherwise(F.col("cb") + hash_(F.col("ob")))
    dealt = dealt.withColumn("block", block)
    inner = dealt.where("core").select("id", (F.col("mass") - F.col("m")).alias("n"))
    # Blocks from cb on hold the others: a block of them meets every block, a block of the core only those.
    all_ = F.col("cb") + F.col("ob")
    first = F.when(F.col("core"), F.col("cb")).otherwise(0)
    met = dealt.where("ob > 0").withColumn("other", F.explode(F.sequence(first, all_ - 1)))
    met = met.select("id", "block", "u", "m", F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("pair"), (F.col("block") == F.col("other")).alias("own"))
    met = met.repartition("pair").sortWithinPartitions("pair", "block", "id")

    def count_(batches):
        for table in C.whole_groups(batches, "pair"):
            ids, block, m = (table.column(c).to_numpy() for c in ("id", "block", "m"))
            own, x = table.column("own").to_numpy(zero_copy_only=False), _matrix(table.column("u").combine_chunks())
            for a, b in _runs(table.column("pair").to_numpy()):
                n = np.zeros(b - a)
                if own[a]:
                    for at in range(a, b, BLOCK):
                        to = min(b, at + BLOCK)
                        n[at - a : to - a] = (x[at:to] @ x[a:b].T >= threshold) @ m[a:b] - m[at:to]
                else:
                    first = block[a:b] == block[a]
                    s = x[a:b][first] @ x[a:b][~first].T >= threshold
                    n[first], n[~first] = s @ m[a:b][~first], m[a:b][first] @ s
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids[a:b]), "n": pa.array(n.astype(np.int64))})

    return inner.union(met.mapInArrow(count_, "id long, n long")).groupBy("id").agg(F.sum("n").alias("n"))


def _recall(rows: DataFrame, verts: DataFrame, members: DataFrame, threshold: float) -> tuple[float, int]:
    """(mean share of its links that each query with links has in its component, number of such queries), by brute
    force. Copies of a query are found for certain and don't count."""
    root = members.select(F.col("id").alias("_r"), "root")
    all_ = C.staged(verts.join(root, F.col("id") == F.col("_r"), "left").select("id", "u", "m", F.coalesce("root", "id").alias("root")), "nn-audit")
    asked = rows.where((F.col("id") % QUERIES == 0) & F.col("u").isNotNull()).select("u").distinct()
    asked = C.staged(all_.join(asked, "u", "left_semi").select("id", "u", "root", F.xxhash64("id", F.lit(3)).alias("h")), "nn-queries")
    parts = -(-asked.count() // QUERY_BLOCK)
    share, linked = 0.0, 0
    for part in range(parts):
        block = asked.where(F.pmod("h", F.lit(parts)) == part).collect()
        if not block:
            continue
        q = np.stack([np.frombuffer(r.u, np.float64) for r in block])
        ids, roots = np.array([r.id for r in block]), np.array([r.root for r in block])

        def search(batches, q=q, ids=ids, roots=roots):
            true, got = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for batch in batches:
                own, x, m, root = batch.column(0).to_numpy(), _matrix(batch.column(1)), batch.column(2).to_numpy(), batch.column(3).to_numpy()
                i, j = np.nonzero(x @ q.T >= threshold)
                keep = own[i] != ids[j]
                i, j = i[keep], j[keep]
                np.add.at(true, j, m[i])
                np.add.at(got, j, np.where(root[i] == roots[j], m[i], 0))
            hit = np.flatnonzero(true)
            yield pa.RecordBatch.from_pydict({"q": pa.array(hit), "true": pa.array(true[hit]), "got": pa.array(got[hit])})

        sums = all_.select("id", "u", "m", "root").mapInArrow(search, "q long, true long, got long").groupBy("q").agg(F.sum("true").alias("true"), F.sum("got").alias("got"))
        r = sums.agg(F.sum(F.col("got") / F.col("true")).alias("share"), F.count("*").alias("n")).first()
        share, linked = share + (r.share or 0.0), linked + r.n
        if linked >= LINKED:
            break
    return (share / linked if linked else 1.0), linked


def _linked(verts: DataFrame, asked: DataFrame, dim: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame, float]:
    """(members (id, root), counts (id, n), recall) of the vertices (id, u, m) of one length."""
    n, links = verts.count(), None
    for seed in range(MOST_DRAWS):
        graph = neighbour_graph(verts, n, dim, 100 * seed, tables=tables_of(n, threshold))
        found = graph.where(F.col("s") >= threshold).select("a", "b")
        links = C.staged(found if links is None else links.union(found), "nn-links")
        members = components(links, "nn-components")
        links, members = _bridged(verts, links, members, dim, 100 * seed + 50, threshold)
        share, linked = _recall(asked, verts, members, threshold)
        _log.info("recall %.4f over %d vectors with links after %d draws", share, linked, seed + 1)
        if share >= recall:
            return members, C.staged(_enlarged(members, verts, threshold), "nn-counts"), share
    raise RuntimeError(f"recall of links is {share:.3f} over {linked} vectors after {MOST_DRAWS} draws; {recall} is required")


def classes(vectors: DataFrame, threshold: float = 0.95, recall: float = RECALL, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) of every row."""
    rows = C.staged(unit_vectors(vectors, id_column, column), "nn-vectors")
    # Equal vectors, or equal up to their length: one vertex.
    verts = rows.where("u is not null and id is not null").groupBy("u").agg(F.min("id").alias("least"), F.count("*").alias("m"))
    verts = C.staged(verts, "nn-vertices").select(F.monotonically_increasing_id().alias("id"), "u", "m", "least")
    verts = C.staged(verts, "nn-vertices")
    told, share = None, 1.0
    for r in verts.groupBy(F.octet_length("u").alias("size")).count().orderBy("size").collect():
        own, asked = (x.where(F.octet_length("u") == r.size) for x in (verts.select("id", "u", "m"), rows.where("id is not null")))
        members, counts, reached = _linked(own, asked, r.size // 8, threshold, recall)
        part = members.join(counts, "id").select("id", "root", "n")
        told, share = part if told is None else told.union(part), min(share, reached)
    if told is None:
        told = verts.select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("n"))
    told = verts.join(told, "id", "left").select("u", "m", "least", F.coalesce("root", "id").alias("root"), F.coalesce("n", F.lit(0)).alias("n"))
    told = C.staged(told, "nn-told")
    names = told.groupBy("root").agg(F.min("least").alias("component")).withColumnRenamed("root", "_root")
    told = told.join(names, F.col("root") == F.col("_root")).select(F.col("u").alias("_u"), "m", "n", "component")
    out = rows.join(told, (F.col("u") == F.col("_u")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_column),
        F.coalesce(F.col("n") + F.col("m") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
        F.lit(share).alias("recall"),
    )
