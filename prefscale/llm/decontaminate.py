"""Benchmark decontamination.

The benchmark's normalised word n-grams form a hash set that is broadcast; each executor slides windows over the
words of its documents with a rolling hash, and every hash hit is verified against the window's own words.

Words are maximal runs of ASCII letters (lower-cased), ASCII digits and non-ASCII characters. A window is ``n``
consecutive words of an item; an item of fewer words, but not none, is one window.

The size of the benchmark is measured first: blocks of at most ``block_bytes`` of text are indexed and broadcast one
after the other, and an index takes about 25 bytes a word, so that memory is bounded whatever the benchmark's size. With
several blocks, what is kept between them are the spans and items of the texts that are hit.

Cases. A null or empty text has no words and is never hit; an empty benchmark hits nothing; items without an id or text
hit nothing, and items that share an id are one in the report. Repeated rows, null and shared doc_ids: every row is
judged by itself. Texts may be of any length and are read whole. Other columns pass; the report takes the place of a
column of its name in ``hits``, and ``clean`` returns the columns of its input. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

N_WORDS = 13
#: Bytes of benchmark text in one broadcast index; a larger benchmark is scanned block by block.
BLOCK_BYTES = 16 << 20
#: Verified windows that a worker remembers.
REMEMBERED = 100_000

REPORT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.IntegerType())),
    ]
)


def window_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Prefix hashes over the words of lower-case bytes."""
    return C.prefix_hash(C.span_hash(C.prefix_hash(buf), s, e))


_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.int32()))])


class Index:
    """Windows of benchmark items by length, as arrays: sorted hashes, the word each starts at, a bitmap before them;
    and the words' spans in one buffer of lower-case text, to verify."""

    def __init__(self, items: list[tuple], n: int):
        items = [(str(i), (t or "").encode()) for i, t in items if i is not None]
        names = sorted({i for i, _ in items})
        place = {i: k for k, i in enumerate(names)}
        self.names = names
        off = np.concatenate(([0], np.cumsum([len(t) + 1 for _, t in items]))).astype(np.int64)
        low = C.lower_ascii(np.frombuffer(b" ".join([*(t for _, t in items), b""]), np.uint8))
        s, e, first = C.word_spans(low, off, C.ALNUM_WORD)
        self.low, self.start, self.end = low, s.astype(np.int32), e.astype(np.int32)
        count = np.diff(first)
        self.item = np.repeat(np.array([place[i] for i, _ in items], np.int32), count)
        size = np.minimum(n, count)
        self.by_length, self.seen = {}, {}
        hashes = window_hashes(low, s, e) if len(s) else None
        for k in np.unique(size[size > 0]).tolist():
            own = np.flatnonzero(size == k)
            m = count[own] - k + 1
            at = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[own], m)
            h = C.span_hash(hashes, at, at + k)
            order = np.argsort(h, kind="stable")
            bitmap = np.zeros(1 << 20, bool)
            bitmap[(h >> np.uint64(44)).astype(np.int64)] = True
            self.by_length[k] = (h[order], at[order].astype(np.int32), bitmap)

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}

    def nbytes(self) -> int:
        return self.low.nbytes + self.start.nbytes + self.end.nbytes + self.item.nbytes + sum(x.nbytes for own in self.by_length.values() for x in own)

    def items_of(self, k: int, p: int, told: bytes) -> list[str]:
        """Items that hold the window told, whose hash is that of entry p (the first such) of length k."""
        key = (k, p, told)
        if key not in self.seen:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            hashes, at, _ = self.by_length[k]
            same = at[p : int(np.searchsorted(hashes, hashes[p], side="right"))]
            text = lambda w: b" ".join(self.low[a:b].tobytes() for a, b in zip(self.start[w : w + k], self.end[w : w + k]))
            self.seen[key] = [self.names[i] for i in np.unique([self.item[w] for w in same.tolist() if text(w) == told]).astype(int).tolist()]
        return self.seen[key]

    def scan(self, buf: np.ndarray, off: np.ndarray):
        """(word starts, ends, first word by row, hit flag by word, row and items of each hit)."""
        low = C.lower_ascii(buf)
        s, e, first = C.word_spans(low, off, C.ALNUM_WORD)
        step, found = np.zeros(len(s) + 1, np.int32), []
        if len(s) and self.by_length:
            wh = window_hashes(low, s, e)
            row_end = np.repeat(first[1:], np.diff(first))
            for k, (hashes, _, bitmap) in self.by_length.items():
                if len(s) < k:
                    continue
                i = np.flatnonzero(np.arange(k, len(s) + 1) <= row_end[: len(s) - k + 1])
                h = C.span_hash(wh, i, i + k)
                near = bitmap[(h >> np.uint64(44)).astype(np.int64)]
                i, h = i[near], h[near]
                at = np.searchsorted(hashes, h)
                same = at < len(hashes)
                same[same] = hashes[at[same]] == h[same]
                for j, p in zip(i[same].tolist(), at[same].tolist()):
                    items = self.items_of(k, p, b" ".join(low[s[x] : e[x]].tobytes() for x in range(j, j + k)))
                    if items:
                        step[j] += 1
                        step[j + k] -= 1
                        found.append((j, items))
        return s, e, first, np.cumsum(step[:-1]) > 0, found


def _scanned(part: pa.RecordBatch, index: Index) -> list[dict]:
    """The report of each row's text."""
    buf, off = C.buffer_of(part.column("text"))
    s, e, first, hit, found = index.scan(buf, off)
    ids: dict[int, set[str]] = {}
    for j, names in found:
        ids.setdefault(int(np.searchsorted(first, j, side="right")) - 1, set()).update(names)
    out = [{"n_words": n, "n_hit": 0, "items": [], "spans": []} for n in np.diff(first).tolist()]
    for r, names in ids.items():
        a, b = first[r], first[r + 1]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[a:b].view(np.int8), [0]))))
        spans = [int(v) for lo, hi in zip(edge[::2], edge[1::2]) for v in (s[a + lo] - off[r], e[a + hi - 1] - off[r])]
        out[r] |= {"n_hit": int(hit[a:b].sum()), "items": sorted(names), "spans": spans}
    return out


def _united(text: str | None, items: list[str], spans: list[int]) -> dict:
    """The report of a text from the items and spans of several blocks."""
    buf = C.lower_ascii(np.frombuffer((text or "").encode(), np.uint8))
    s, e, _ = C.word_spans(buf, np.array([0, len(buf)]), C.ALNUM_WORD)
    step = np.zeros(len(s) + 1, np.int64)
    np.add.at(step, np.searchsorted(s, spans[::2]), 1)
    np.add.at(step, np.searchsorted(s, spans[1::2]), -1)
    hit = np.cumsum(step[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return {"n_words": len(s), "n_hit": int(hit.sum()), "items": sorted(set(items)), "spans": [int(v) for lo, hi in zip(edge[::2], edge[1::2]) for v in (s[lo], e[hi - 1])]}


def hits(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, block_bytes: int = BLOCK_BYTES, report: str = "_hits") -> DataFrame:
    """docs with one more column: the words, the hit words, the items and the byte spans (start, end, ...) of hits."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("string").alias("id"), "text").where("id is not null and text is not null")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 if total <= block_bytes else 2 * -(-int(total) // block_bytes)
    shape = docs.drop(report).withColumn(report, F.lit(None).cast(REPORT)).schema

    def index_of(b: int):
        rows = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        return spark.sparkContext.broadcast(Index([tuple(r) for r in rows.collect()], n))

    if blocks == 1:
        index = index_of(0)

        def annotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in C.slices(batch, "text"):
                    told = pa.array(_scanned(part, index.value), _ARROW)
                    yield pa.RecordBatch.from_arrays([*part.columns, told], names=shape.names)

        return docs.drop(report).mapInArrow(annotate, shape)
    key = F.sha2("text", 256)
    found = None
    for b in range(blocks):
        index = index_of(b)

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in C.slices(batch, "text"):
                    told = [(k, r) for k, r in zip(part.column("_key").to_pylist(), _scanned(part, index.value)) if r["items"]]
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in told], pa.string()), pa.array([r["items"] for _, r in told], pa.list_(pa.string())), pa.array([r["spans"] for _, r in told], pa.list_(pa.int32()))], names=["_key", "items", "spans"])

        own = docs.select(key.alias("_key"), "text").mapInArrow(scan, "_key string, items array<string>, spans array<int>").dropDuplicates(["_key"])
        own = C.staged(own, "decontaminate")
        found = own if found is None else found.union(own)
    found = found.groupBy("_key").agg(F.flatten(F.collect_list("items")).alias("_items"), F.flatten(F.collect_list("spans")).alias("_spans"))
    rest = docs.drop(report)
    pair = C.free_name(rest, "_found")
    found = found.select(F.col("_key").alias(pair), F.struct("_items", "_spans").alias(pair + "s"))
    told = rest.join(found, key == F.col(pair), "left").drop(pair)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch, "text"):
                own = part.column(part.num_columns - 1).to_pylist()
                reports = [_united(t, f["_items"] if f else [], f["_spans"] if f else []) for t, f in zip(part.column("text").to_pylist(), own)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(reports, _ARROW)], names=shape.names)

    return told.mapInArrow(unite, shape)


def contaminated(report: str = "_hits", least: float = 0.05):
    """The judgement on a report: hit words are at least ``least`` of the words."""
    per = round(1 / least)
    return (F.col(f"{report}.n_hit") > 0) & (F.col(f"{report}.n_hit") * per >= F.col(f"{report}.n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, mode: str = "document", **options) -> DataFrame:
    """docs without contaminated documents (mode "document"), or with every hit span cut out of the text ("span")."""
    report = C.free_name(docs, "_hits")
    told = hits(docs, benchmark, report=report, **options)
    if mode == "document":
        return told.where(~F.coalesce(contaminated(report), F.lit(False))).drop(report)
    if mode != "span":
        raise ValueError("mode is 'document' or 'span'")

    def cut(it):
        for batch in it:
            texts, reports = batch.column("text").to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            for r, (t, rep) in enumerate(zip(texts, reports)):
                if t is not None and rep and rep["spans"]:
                    raw, at, keep = t.encode(), 0, []
                    for a, b in zip(rep["spans"][::2], rep["spans"][1::2]):
                        keep.append(raw[at:a])
                        at = b
                    texts[r] = b"".join([*keep, raw[at:]]).decode()
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))

    return told.mapInArrow(cut, told.schema).drop(report)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    told = hits(docs.select("doc_id", "text"), benchmark)
    return told.select(
        "doc_id",
        F.col("_hits.n_words").alias("n_words"),
        F.col("_hits.n_hit").alias("n_hit"),
        F.size("_hits.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_hits.items").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, least(13, len(ws)) AS k,
         array_to_string(list_slice(ws, i, i + least(13, len(ws)) - 1), ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dg AS (
  SELECT doc_id, k, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS g
  FROM (SELECT doc_id, ws, k, unnest(range(1, CAST(len(ws) - k + 2 AS BIGINT))) AS i
        FROM w, (SELECT DISTINCT k FROM win) WHERE len(ws) >= k)),
hit AS (SELECT doc_id, dg.k, i, item_id FROM dg JOIN win ON dg.g = win.g AND dg.k = win.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
        FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
