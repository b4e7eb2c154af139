"""Best-fit-decreasing packing of tokenised documents into sequences.

Documents are tokenised on the executors; each piece is at most ``capacity`` ids long. The packing is one global
best-fit decreasing: only the number of pieces of each length (at most ``capacity`` counts, whatever the corpus) goes
to the driver, which replays best fit by runs of equal lengths. A segment tree over remaining capacities finds the
tightest open bin in logarithmic time. The plan (runs of bins by length) is joined back to the ranked pieces, so that
no task ever holds all documents.

Cases. A null or empty text is one piece of the end id alone. Repeated rows, and rows with a null or shared doc_id, are
packed each for itself; equal lengths are placed in order of (doc_id, piece, crc), and which of rows that are equal in
these comes first doesn't matter. Texts may be of any length and are encoded whole, in one task each. Other columns are
not read, nor returned. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common as C

CAPACITY = 4096
END_ID = 1
#: Words whose ids a worker remembers; beyond it, those not seen for longest go.
CACHE_WORDS = 600_000
#: Runs of the plan that are broadcast, of 48 bytes each.
BROADCAST_RUNS = 1_000_000

_GAPLESS = np.ones(256, bool)
_GAPLESS[[0x20, 0x0A]] = False


class Encoder:
    """Ids of whole texts, a slice of many documents at a time.

    The tokenizer never joins across a space or a newline, so that each distinct word between them is encoded once
    and its ids are remembered under a 64-bit hash, in arrays of a few bytes a word.
    """

    def __init__(self, tokenizer_path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.tok, self.end = Tokenizer.from_file(tokenizer_path), end_id
        self.keys, self.at, self.n, self.seen = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool, self.used, self.round = np.zeros(1 << 16, np.uint32), 0, 0

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """hashes are sorted and new."""
        ids = [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum()))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + len(flat), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(n) - n
        self.used += len(flat)
        to = np.searchsorted(self.keys, hashes)
        self.keys, self.at, self.n = (np.insert(x, to, v) for x, v in ((self.keys, hashes), (self.at, at), (self.n, n)))
        self.seen = np.insert(self.seen, to, self.round)

    def _forget(self) -> None:
        stay = self.seen > np.median(self.seen)
        self.keys, n, at, self.seen = self.keys[stay], self.n[stay], self.at[stay], self.seen[stay]
        self.pool = np.concatenate([self.pool[_ranges(at, n)], np.zeros(1 << 16, np.uint32)])
        self.n, self.at, self.used = n, np.cumsum(n) - n, int(n.sum())

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows with the end id after each, offsets by row)."""
        self.round += 1
        s, e, first = C.word_spans(buf, off, _GAPLESS)
        own, index, inverse = np.unique(C.span_hash(C.prefix_hash(buf), s, e), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS:
            self._forget()
        at = np.searchsorted(self.keys, own)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == own[known]
        if not known.all():
            raw, new = buf.tobytes(), index[~known]
            self._learn(own[~known], [raw[a:b].decode() for a, b in zip(s[new].tolist(), e[new].tolist())])
            at = np.searchsorted(self.keys, own)
        self.seen[at] = self.round
        n = self.n[at][inverse]
        ids = self.pool[_ranges(self.at[at][inverse], n)]
        ends = np.concatenate(([0], np.cumsum(n)))[first]
        return np.insert(ids, ends[1:], np.uint32(self.end)), ends + np.arange(len(ends))


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... n[0] of them, then those of start[1], and so on."""
    n = n.astype(np.int64)
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


_encoders: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


_PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document; ``with_ids`` adds the ids themselves."""
    schema = T.StructType([*_PIECE.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path, end_id)
        for batch in batches:
            for part in C.slices(batch, "text", 1 << 20):
                out: list[list] = [[], [], [], [], [], []]
                all_ids, ends = encode(*C.buffer_of(part.column("text")))
                for doc, a, b in zip(part.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                    for k, at in enumerate(range(a, b, capacity)):
                        own = all_ids[at : min(b, at + capacity)]
                        row = (doc, k, at - a, len(own), zlib.crc32(own), own if with_ids else None)
                        for col, v in zip(out, row):
                            col.append(v)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = [*_PIECE.names, "ids"][: len(schema)]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k, _ in zip(out, kinds, names)], names=names)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


class SegmentTree:
    """Open bins by remaining capacity 0..n: how many there are below each node; the tightest that fits in O(log n)."""

    def __init__(self, n: int):
        self.base = 1 << n.bit_length()
        self.sums = [0] * (2 * self.base)

    def add(self, r: int, count: int) -> None:
        i = self.base + r
        while i:
            self.sums[i] += count
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest r >= least with an open bin."""
        i = self.base + least
        if self.sums[i]:
            return least
        while i > 1:
            if not i & 1 and self.sums[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if self.sums[2 * i] else 2 * i + 1
                return i - self.base
            i >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing of counts[length] pieces of each length.

    Returns runs (length, first rank, pieces, first bin, pieces per bin, offset in the bin) and the number of bins.
    The piece of rank k of a run goes to bin ``first bin + k // per`` at ``offset + (k % per) * length``. As no bin
    lies between a length and the tightest that fits, equal lengths fill one bin after the other, and a run of them
    needs one search.
    """
    tree, open_bins, runs, bins = SegmentTree(capacity), {}, [], 0

    def put(r: int, first: int, n: int) -> None:
        if r and n:
            open_bins.setdefault(r, deque()).append((first, n))
            tree.add(r, n)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            r = tree.tightest(length)
            if r is None:
                r, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_bins[r].popleft()
                tree.add(r, -n)
            per = r // length
            full = min(n, left // per)
            used = full
            if full:
                runs.append((length, rank, full * per, first, per, capacity - r))
                rank, left = rank + full * per, left - full * per
                put(r - per * length, first, full)
            if left and full < n:
                runs.append((length, rank, left, first + full, per, capacity - r))
                put(r - left * length, first + full, 1)
                rank, left, used = rank + left, 0, full + 1
            put(r, first + used, n - used)
    return runs, bins


def pack(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """lengths (doc_id, piece, length, ...) with sequence_id and offset."""
    spark = lengths.sparkSession
    parts = C.partitions(spark)
    order = ["doc_id", "piece", *(c for c in ("ids_crc32",) if c in lengths.columns)]
    dealt = lengths.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    counts = dealt.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    counts = C.staged(counts, "packing-counts")
    by_length = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs, _ = best_fit_decreasing(by_length, capacity)
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_part").orderBy(*order)
    ranked = (
        dealt.withColumn("_k", F.row_number().over(own))
        .join(starts, ["length", "_part"])
        .withColumn("_rank", F.col("_before") + F.col("_k") - 1)
    )
    # At most a run for each pair of a length and a remaining capacity, however many pieces there are; a plan that is not
    # small is joined by the length instead of being sent to all.
    small = len(runs) <= BROADCAST_RUNS
    plan = spark.createDataFrame(runs, "_length long, _first long, _pieces long, _bin long, _per long, _offset long")
    on = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_pieces"))
    k = F.col("_rank") - F.col("_first")
    return ranked.join(F.broadcast(plan) if small else plan, on).select(
        *lengths.columns,
        (F.col("_bin") + F.floor(k / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + (k % F.col("_per")) * F.col("length")).cast("long").alias("offset"),
    )


def digest(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(C.staged(pieces(docs, tokenizer_path, capacity), "packing-pieces"), capacity)
