"""Shared pieces: staged tables, byte buffers of Arrow batches and rolling hashes."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor sees; where it is unset and the master local (tests),
    one of our own. A cluster without the setting is refused, as its executors share no folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "prefscale-checkpoints")
    return path.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors.

    The files are removed when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _staged:
        atexit.register(unstage_all)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def unstage_all() -> None:
    while _staged:
        spark, path = _staged.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores after it, that no column of df has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_groups(batches, key: str):
    """Tables of whole groups of a partition that is sorted by key, as many groups at a time as a batch ends with."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1]))
        if held and (cut or held[-1].column(key)[0].as_py() != int(k[0])):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)]).combine_chunks()
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- byte buffers


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string or binary array; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or off[0] == off[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Cut a batch so that each piece has at most about ``most`` bytes of ``column`` (one row at least)."""
    if not batch.num_rows:
        return
    _, off = buffer_of(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


# ---------------------------------------------------------------- rolling hashes

_M = 0x9E3779B97F4A7C15
_INV = pow(_M, -1, 1 << 64)
_T = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW = np.ones(1, np.uint64)
_IPOW = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _POW, _IPOW
    if len(_POW) < n:
        n = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            a = np.full(n, _M, np.uint64)
            b = np.full(n, _INV, np.uint64)
            a[0] = b[0] = 1
            _POW, _IPOW = np.cumprod(a), np.cumprod(b)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over bytes, or over 64-bit hashes."""
    n = len(values)
    _grow(n + 1)
    out = np.zeros(n + 1, np.uint64)
    terms = _T[values] if values.dtype == np.uint8 else values
    np.cumsum(terms * _POW[:n], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end), the same wherever the span stands."""
    return mix((prefix[end] - prefix[start]) * _IPOW[start])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def word_spans(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each row): maximal runs of word bytes that stay within a row of ``off``."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = is_word[buf]
    head, tail = w.copy(), w.copy()
    head[1:] &= ~w[:-1]
    tail[:-1] &= ~w[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    head[edge] = w[edge]
    tail[edge - 1] = w[edge - 1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return start, end, np.searchsorted(start, off)


SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False

ALNUM_WORD = np.ones(256, bool)
ALNUM_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
