"""Removal of repeated substrings by merging Burrows-Wheeler transforms.

A byte goes when it lies in a string of ``length`` bytes that also starts earlier: in a document of smaller doc_id, or
earlier in the same one. Strings are judged on the input, overlaps count, and no match crosses documents.

1. Winnowing finds where such strings can be: of every ``length`` bytes the smallest hash of ``length - 68`` bytes marks
   an anchor, so that equal strings hold equal anchors. An anchor's context is all that any such string around it can
   cover. Anchors are sorted by hash and context; of equal contexts all but the first are repeats as a whole. A task
   that finds anchors remembers contexts in a table of fixed size, so that of a very common context it sends on only
   what may still be the first; the rest are known repeats, which are dealt evenly.
2. Distinct contexts of equal anchors may still share strings. They are cut out of the documents and meet by anchor.
   There they are dealt into shards. Each shard sorts the suffixes that start at its anchors, which gives its part of a
   Burrows-Wheeler transform: the preceding bytes in that order. The shards are merged, and the interleave is refined
   byte by byte: the merged order of suffixes and the bytes before them give, by one stable counting step, the order of
   the suffixes that start a byte earlier, and the common prefixes of new neighbours are one more than the least of
   those between them before. Intervals of common prefixes of ``length`` bytes are the repeated strings. After the
   shards' own, no suffix is sorted again. Every string that matters starts at an anchor or at most 68 bytes before, so
   that many refinements are enough, and one suffix of a context takes part in each.
   Where an anchor has more than 4096 distinct contexts, every 4096 of them are merged by a task of their own. Of the
   strings of each such part, the first ones meet those of the anchor's other parts by a 64-bit hash, so that no task
   holds all contexts of an anchor.
   Contexts that are equal as a whole don't take part; they are told by two 64-bit hashes, of the anchor and of the whole
   context, without a look at the bytes. The first interleave is a sorted merge of the shards' suffixes.
3. Covered ranges of each document are united and cut.

Cases. A null or empty text has no bytes. Rows that share a doc_id are told apart by a hash of their text and come in the
order of that; equal rows are one document, of which nothing goes on account of the other. A row without an id stands
among the others at a place that a hash of its text gives. Of equal strings, the first by (doc_id, start) stays, so that
there are no ties. Texts may be of any length up to 4 GB and are read whole. Other columns are not read, nor returned.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH = 100
ANCHOR = 32
#: Bytes of contexts that are merged at once, unless one part of an anchor has more.
MERGE_BYTES = 4 << 20
#: Distinct contexts of an anchor that are merged in one task.
KINDS = 1 << 12
#: Contexts that a task remembers while it looks for anchors.
REMEMBERED = 1 << 16
SHARDS = 4


# ---------------------------------------------------------------- anchors


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over windows of w."""
    k = 1
    while 2 * k <= w:
        x = f(x[:-k], x[k:])
        k *= 2
    return f(x[: len(x) - (w - k)], x[w - k :]) if w > k else x


def anchors(buf: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, hash of the context) of a document's anchors."""
    n = len(buf)
    if n < length:
        z = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), z, z
    left = length - anchor
    prefix = C.prefix_hash(buf)
    start = np.arange(n - anchor + 1)
    h = C.span_hash(prefix, start, start + anchor)
    least = _slide(h, left + 1, np.minimum)
    edge = np.zeros(left, np.uint64)
    chosen = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), left + 1, np.maximum) == h)
    a, b = np.maximum(chosen - left, 0), np.minimum(chosen + length, n)
    with np.errstate(over="ignore"):
        context = C.mix(C.span_hash(prefix, a, b) + (chosen - a).astype(np.uint64) * np.uint64(0x1F3) + (b - chosen).astype(np.uint64) * np.uint64(0x1000193))
    return chosen, h[chosen], context


class Remembered:
    """The least (doc_id, at) of contexts met so far. A context that meets another in its slot takes its place, so that
    some repeats stay unknown here, and none is wrong."""

    def __init__(self, slots: int):
        self.rows = np.zeros((4, slots), np.int64)
        self.used = np.zeros(slots, bool)

    def repeats(self, fp: np.ndarray, ctx: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which rows have an equal context before them, in this call or a former one."""
        order = np.lexsort((at, doc, ctx, fp))
        rows = np.stack([fp, ctx, doc, at])[:, order]
        new = np.concatenate(([True], (rows[:2, 1:] != rows[:2, :-1]).any(0)))
        head, group = np.flatnonzero(new), np.cumsum(new) - 1
        first = rows[:, head]
        slot = first[1] & (len(self.used) - 1)
        known = self.rows[:, slot]
        same = self.used[slot] & (known[:2] == first[:2]).all(0)
        later = same & ((first[2] > known[2]) | ((first[2] == known[2]) & (first[3] > known[3])))
        put, at_ = np.unique(slot[~later], return_index=True)
        self.rows[:, put] = first[:, ~later][:, at_]
        self.used[put] = True
        out = np.zeros(len(fp), bool)
        out[order] = later[group] | (rows[2:] != first[2:, group]).any(0)
        return out


def _marked(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """(fp, ctx, doc_id, at): at holds the row's hash and the position; fp is null where the context is a known repeat."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Remembered(REMEMBERED)
        for batch in batches:
            for part in C.slices(batch, "text"):
                buf, off = C.buffer_of(part.column("text"))
                x, ids = part.column("x").to_numpy(), part.column("doc_id").to_numpy()
                out = [[], [], [], []]
                for r in range(part.num_rows):
                    pos, fp, ctx = anchors(buf[off[r] : off[r + 1]], length, anchor)
                    if len(pos):
                        for col, v in zip(out, (fp.view(np.int64), ctx.view(np.int64), np.full(len(pos), ids[r]), (np.int64(x[r]) << np.int64(32)) | pos)):
                            col.append(v)
                if out[0]:
                    cols = [np.concatenate(c) for c in out]
                    again = seen.repeats(*cols)
                    cols[1][again] = 0
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], mask=again), *map(pa.array, cols[1:])], names=["fp", "ctx", "doc_id", "at"])

    return docs.select("doc_id", "text", "x").mapInArrow(mark, "fp long, ctx long, doc_id long, at long")


def _repeats(batches: Iterator[pa.RecordBatch], kinds_: int) -> Iterator[pa.RecordBatch]:
    """Of anchors sorted by (fp, ctx, doc_id, at): all but the first of a context (fp null, as known repeats come in);
    and the first of each context where an anchor has several, with the number of its part of ``kinds_`` contexts.
    Memory holds a batch and one row."""
    carry, pending = None, False  # first row of the last context; whether it is the only one of its anchor so far
    place = 0  # of that context among those of its anchor
    for batch in batches:
        if batch.column("fp").null_count:
            known = batch.filter(batch.column("fp").is_null())
            yield pa.RecordBatch.from_arrays([known.column("fp"), known.column("ctx"), known.column("doc_id"), known.column("at")], names=["fp", "part", "doc_id", "at"])
            batch = batch.filter(batch.column("fp").is_valid())
        if not batch.num_rows:
            continue
        cols = [c.to_numpy() for c in batch.columns]
        had = carry is not None
        if had:
            cols = [np.concatenate([[v], c]) for v, c in zip(carry, cols)]
        fp, ctx, doc, at = cols
        new_f = np.concatenate(([True], fp[1:] != fp[:-1]))
        new_c = new_f | np.concatenate(([True], ctx[1:] != ctx[:-1]))
        head = np.maximum.accumulate(np.where(new_c, np.arange(len(fp)), 0))
        again = ~new_c & ((doc != doc[head]) | (at != at[head]))
        group = np.cumsum(new_f) - 1
        kinds = np.bincount(group, new_c)
        if had and not pending:
            kinds[0] += 1
        probe = new_c & (kinds[group] > 1)
        if had and not pending:
            probe[0] = False
        nth = np.cumsum(new_c) - 1
        nth -= nth[np.flatnonzero(new_f)][group]
        if had:
            nth[group == 0] += place
        last = int(head[-1])
        out_fp = np.concatenate([np.zeros(int(again.sum()), np.int64), fp[probe]])
        null = np.concatenate([np.ones(int(again.sum()), bool), np.zeros(int(probe.sum()), bool)])
        out = {"fp": pa.array(out_fp, mask=null)}
        for name, v in (("part", nth // kinds_), ("doc_id", doc), ("at", at)):
            out[name] = pa.array(np.concatenate([v[again], v[probe]]))
        yield pa.RecordBatch.from_pydict(out)
        carry, pending, place = [c[last] for c in cols], bool(kinds[group[-1]] == 1), int(nth[last])


# ---------------------------------------------------------------- Burrows-Wheeler transforms


class Shard:
    """Contexts of a shard as fixed-width rows of their bytes from the anchor on, in order."""

    def __init__(self, right: np.ndarray):
        self.order = np.argsort(right, kind="stable")
        self.right = right[self.order]


def merge(shards: list[Shard]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, place in the shard, common prefix with the one before) along the merged order of the shards' suffixes."""
    z, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = shards[0].right[:0]
    for k, s in enumerate(shards):
        to = np.searchsorted(rows, s.right, side="right")  # an interleave: sorted into sorted
        rows, z, at = np.insert(rows, to, s.right), np.insert(z, to, k), np.insert(at, to, np.arange(len(s.right)))
    width = rows.dtype.itemsize
    raw = np.frombuffer(rows.tobytes(), np.uint8).reshape(len(rows), width)
    lcp = np.zeros(len(rows), np.int32)
    if len(rows) > 1:
        differ = raw[1:] != raw[:-1]
        lcp[1:] = np.where(differ.any(1), differ.argmax(1), width)
    return z, at, lcp


def refine(order: np.ndarray, lcp: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes that start one byte earlier, and their common prefixes. before: that byte for each
    place of the order, -1 where the text starts here."""
    at = np.flatnonzero(before >= 0)
    sym = before[at].astype(np.uint8)
    by = np.argsort(sym, kind="stable")
    at, sym = at[by], sym[by]
    new = np.zeros(len(at), np.int32)
    same = np.flatnonzero(sym[1:] == sym[:-1]) + 1
    if len(same):
        ends = np.stack([at[same - 1] + 1, at[same] + 1], 1).ravel()
        least = np.minimum.reduceat(np.append(lcp, 0), ends)[::2]
        new[same] = least + 1
    return order[at], new


def repeated(contexts: list[bytes], left: list[int], keys: list[tuple[int, int]], depth: int, anchor: int, shards: int = SHARDS) -> np.ndarray:
    """For each context, whose anchor follows ``left`` bytes and whose first byte stands at keys = (document, position):
    whether the string of ``depth`` bytes that starts t bytes before the anchor starts earlier elsewhere, t in columns."""
    n = len(contexts)
    length, left_ = np.array([len(c) for c in contexts]), np.array(left)
    doc, at = (np.array([k[i] for k in keys], np.int64) for i in (0, 1))
    buf = np.frombuffer(b"".join(contexts), np.uint8)
    start = np.cumsum(length) - length
    # A byte that no text holds fills up what is shorter; the number of true bytes bounds common prefixes.
    col = left_[:, None] + np.arange(depth)
    right = np.where(col < length[:, None], buf[np.minimum(start[:, None] + col, max(len(buf) - 1, 0))], 255).astype(np.uint8)
    right = np.ascontiguousarray(right).view(f"S{depth}").ravel() if n else np.zeros(0, f"S{depth}")
    per = -(-n // shards)
    parts = [Shard(right[a : a + per]) for a in range(0, n, per)]
    z, place, lcp = merge(parts)
    order = np.zeros(n, np.int64)
    for k, part in enumerate(parts):
        own = z == k
        order[own] = part.order[place[own]] + k * per
    lcp[1:] = np.minimum(lcp[1:], np.minimum((length - left_)[order[1:]], (length - left_)[order[:-1]]))
    gone = np.zeros((n, depth - anchor + 1), bool)
    for t in range(depth - anchor + 1):
        if len(order) < 2:
            break
        edge = lcp < depth
        edge[0] = True
        block = np.cumsum(edge) - 1
        use = np.flatnonzero(np.bincount(block)[block] > 1)
        if len(use):
            i, b = order[use], block[use]
            d, p = doc[i], at[i] + left_[i] - t
            by = np.lexsort((p, d, b))
            i, d, p, b = i[by], d[by], p[by], b[by]
            head = np.maximum.accumulate(np.where(np.concatenate(([True], b[1:] != b[:-1])), np.arange(len(b)), 0))
            gone[i[(d != d[head]) | (p != p[head])], t] = True
        if t < depth - anchor:
            q = left_[order] - t - 1
            before = np.where(q >= 0, buf[start[order] + np.maximum(q, 0)].astype(np.int16), np.int16(-1))
            order, lcp = refine(order, lcp, before)
    return gone


def _merged(batches: Iterator[pa.RecordBatch], length: int, anchor: int, kinds: int) -> Iterator[pa.RecordBatch]:
    """From contexts (fp, part, doc_id, at, left, ctx) sorted by (fp, part), at being that of the context's first byte:
    covered ranges (h null), and of anchors of several parts the strings that are first in theirs, h being their hash."""
    held: list[tuple[int, int, int, int, int, bytes]] = []

    def out() -> pa.RecordBatch:
        fp, part, doc, at, left = (np.array([r[k] for r in held], np.int64) for k in range(5))
        texts = [r[5] for r in held]
        gone = repeated(texts, left, list(zip(doc, at)), length, anchor)
        # ranges of neighbouring strings become one
        edge = np.diff(np.pad(gone[:, ::-1], ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (i, lo), (_, hi) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        first = left[i] - (length - anchor)
        cols = [[doc[i]], [at[i] + first + lo], [(at[i] & 0xFFFFFFFF) + first + hi - 1 + length]]
        h = [np.zeros(len(i), np.int64)]
        _, part_of, many = np.unique(np.stack([fp, part]), axis=1, return_inverse=True, return_counts=True)
        open_ = np.flatnonzero((part > 0) | (many[part_of.ravel()] >= kinds))
        if len(open_):
            size = np.array([len(x) for x in texts])
            start = np.cumsum(size) - size
            prefix = C.prefix_hash(np.frombuffer(b"".join(texts), np.uint8))
            i, t = np.nonzero(~gone[open_])
            i = open_[i]
            q = left[i] - t
            ok = (q >= 0) & (q + length <= size[i])
            i, q = i[ok], q[ok]
            h.append(C.span_hash(prefix, start[i] + q, start[i] + q + length).view(np.int64))
            for col, v in zip(cols, (doc[i], at[i] + q, (at[i] & 0xFFFFFFFF) + q + length)):
                col.append(v)
        held.clear()
        known = np.arange(sum(map(len, h))) < len(h[0])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(h), mask=known), *(pa.array(np.concatenate(c)) for c in cols)], names=["h", "doc_id", "at", "to"])

    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:2] != held[-1][:2] and size >= MERGE_BYTES:
                yield out()
                size = 0
            held.append(row)
            size += len(row[5])
    if held:
        yield out()


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (h, doc_id, at, to) sorted by (h, doc_id, at): those without h, and all but the first of each h. Memory
    holds a batch and one row."""
    carry = None
    for batch in batches:
        yield batch.filter(batch.column("h").is_null()).select(["doc_id", "at", "to"])
        batch = batch.filter(batch.column("h").is_valid())
        if not batch.num_rows:
            continue
        cols = [c.to_numpy() for c in batch.columns]
        if carry is not None:
            cols = [np.concatenate([[v], c]) for v, c in zip(carry, cols)]
        h, doc, at, to = cols
        new = np.concatenate(([True], h[1:] != h[:-1]))
        head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        again = (doc != doc[head]) | (at != at[head])
        yield pa.RecordBatch.from_arrays([pa.array(v[again]) for v in (doc, at, to)], names=["doc_id", "at", "to"])
        carry = [c[head[-1]] for c in cols]


# ---------------------------------------------------------------- operator


def _covered(docs: DataFrame, length: int, anchor: int) -> tuple[DataFrame, DataFrame]:
    """(docs dealt by doc_id, their covered ranges (doc_id, ranges))."""
    left = length - anchor
    own = docs.select(F.col("doc_id").alias("id"), F.coalesce("doc_id", F.xxhash64("text")).alias("doc_id"), "text", F.hash("text").alias("x"))
    marks = _marked(own, length, anchor).repartition(F.coalesce("fp", "at")).sortWithinPartitions("fp", "ctx", "doc_id", "at")
    kinds = KINDS
    marks = C.staged(marks.mapInArrow(lambda it: _repeats(it, kinds), "fp long, part long, doc_id long, at long"), "suffix-anchors")
    dealt = own.repartition(C.partitions(docs.sparkSession), "doc_id")
    probes = marks.where("fp is not null").groupBy("doc_id").agg(F.collect_list(F.struct("at", "fp", "part")).alias("probes"))

    def cut(batches):
        for batch in batches:
            for part in C.slices(batch, "text"):
                out: list[list] = [[], [], [], [], [], []]
                raw = part.column("text").cast(pa.binary()).to_pylist() if part.num_rows else []
                for doc, text, x, probes_ in zip(part.column("doc_id").to_pylist(), raw, part.column("x").to_pylist(), part.column("probes").to_pylist()):
                    for q in probes_:
                        at, pos = q["at"], q["at"] & 0xFFFFFFFF
                        if at >> 32 == x:
                            lo = max(0, pos - left)
                            for col, v in zip(out, (q["fp"], q["part"], doc, at - pos + lo, pos - lo, text[lo : pos + length])):
                                col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["fp", "part", "doc_id", "at", "left", "ctx"])

    contexts = dealt.drop("id").join(probes, "doc_id").mapInArrow(cut, "fp long, part long, doc_id long, at long, left int, ctx binary")
    contexts = contexts.repartition("fp", "part").sortWithinPartitions("fp", "part", "doc_id", "at")
    merged = contexts.mapInArrow(lambda it: _merged(it, length, anchor, kinds), "h long, doc_id long, at long, to long")
    merged = merged.repartition(F.coalesce("h", "at")).sortWithinPartitions("h", "doc_id", "at").mapInArrow(_across, "doc_id long, at long, to long")
    pos = F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))
    whole = marks.where("fp is null").select("doc_id", (F.col("at") - F.least(pos, F.lit(left))).alias("at"), (pos + length).alias("to"))
    both = merged.union(whole).groupBy("doc_id").agg(F.collect_list(F.struct("at", "to")).alias("ranges"))
    return dealt, both


def deduplicated(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): spans are removed ranges (start, end, ...) in bytes, kept the remaining bytes."""
    dealt, covered = _covered(docs, length, anchor)

    def finish(batches):
        for batch in batches:
            for part in C.slices(batch, "text"):
                buf, off = C.buffer_of(part.column("text"))
                ranges, xs = part.column("ranges"), part.column("x").to_numpy()
                if part.num_rows:
                    flat = ranges.combine_chunks() if isinstance(ranges, pa.ChunkedArray) else ranges
                    cuts = flat.offsets.to_numpy()
                    at, to = (flat.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                spans, kept = [], []
                for r in range(part.num_rows):
                    text = buf[off[r] : off[r + 1]]
                    n, own = len(text), slice(int(cuts[r]), int(cuts[r + 1]))
                    a, b = at[own], to[own]
                    mine = (a >> 32) == xs[r]
                    lo, hi = a[mine] & 0xFFFFFFFF, np.minimum(b[mine], n)
                    ok = hi - lo >= length
                    step = np.bincount(lo[ok], minlength=n + 1) - np.bincount(hi[ok], minlength=n + 1)
                    gone = np.cumsum(step)[:n] > 0
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                    spans.append(edge)
                    kept.append(text[~gone].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(off), pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"]
                )

    empty = F.array().cast("array<struct<at:long,to:long>>")
    both = dealt.join(covered, "doc_id", "left").select("id", "text", "x", F.coalesce("ranges", empty).alias("ranges"))
    return both.mapInArrow(finish, "doc_id long, n_bytes long, spans array<long>, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    ends = F.transform("spans", lambda v, i: F.when(i % 2 == 1, v).otherwise(-v))
    removed = F.aggregate(ends, F.lit(0).cast("long"), lambda a, v: a + v).alias("n_removed")
    return deduplicated(docs).select("doc_id", "n_bytes", removed, (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
