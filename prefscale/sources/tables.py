"""Reading annotations, and saving and loading a run, on any file system that Spark reads."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

VERSION = "1.0"
TABLES = ("data", "pairwise", "scored", "pairs", "breakdowns")


class _Files:
    """The Hadoop file system of a path."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        # A path without a scheme is one of this machine, as for other Python calls.
        self.root = path.rstrip("/") if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path)
        self._fs = self._path(self.root).getFileSystem(conf)

    def at(self, name: str = "") -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(self.at(name)), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def make(self) -> None:
        self._fs.mkdirs(self._path(self.root))

    def move(self, old: str, new: str) -> None:
        self._fs.delete(self._path(self.at(new)), True)
        if not self._fs.rename(self._path(self.at(old)), self._path(self.at(new))):
            raise OSError(f"{self.at(old)} can't be renamed")

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name)), True)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, a Parquet table, or an Excel sheet where pandas has an engine for it."""
    low = path.lower()
    if not low.endswith((".csv", ".parquet", ".xlsx", ".xls")):
        raise ValueError(f"unsupported file format: {path}")
    files = _Files(spark, path)
    if not files.exists():
        raise FileNotFoundError(path)
    if low.endswith(".csv"):
        return spark.read.csv(files.at(), header=True, inferSchema=True)
    if low.endswith(".parquet"):
        return spark.read.parquet(files.at())
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path))


def save_run(path: str, metadata: dict, tables: dict[str, DataFrame | None], spark: SparkSession | None = None) -> None:
    """A Parquet table for each that there is, and metadata.json. Keys and addresses of models are never kept.

    All tables are written under new names before any takes its place, so that a run that was loaded from this folder,
    and is still read from there, can be saved to it. Tables that the run no longer has go."""
    some = {n: t for n, t in tables.items() if t is not None}
    files = _Files(spark or next(iter(some.values())).sparkSession, path)
    files.make()
    mark = uuid.uuid4().hex
    for name, table in some.items():
        table.write.parquet(files.at(f"{name}.{mark}"))
    for name in TABLES:
        if name in some:
            files.move(f"{name}.{mark}", f"{name}.parquet")
        else:
            files.remove(f"{name}.parquet")
    kept = {k: v for k, v in metadata.items() if k not in ("api_keys", "base_urls")}
    files.write("metadata.json", json.dumps({"version": VERSION} | kept, indent=2))


def load_run(spark: SparkSession, path: str, api_keys: list | None = None, base_urls: list | None = None) -> tuple[dict, dict[str, DataFrame | None]]:
    if path.endswith(".pkl"):
        raise ValueError("pickled runs can't be loaded")
    files = _Files(spark, path)
    if not files.exists("metadata.json") or not files.exists("data.parquet"):
        raise FileNotFoundError(f"no saved run in {path}")
    meta = json.loads(files.read("metadata.json"))
    models = meta.get("models", [])
    for name, own in (("providers", meta.get("providers")), ("reasoning", meta.get("reasoning")), ("api_keys", api_keys), ("base_urls", base_urls)):
        if own is not None and len(own) != len(models):
            raise ValueError(f"{name} are {len(own)} for {len(models)} models")
    return meta, {n: spark.read.parquet(files.at(f"{n}.parquet")) if files.exists(f"{n}.parquet") else None for n in TABLES}
