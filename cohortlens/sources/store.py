"""Materialised canonical tables ("load once, report many").

A canonical table is evaluated once, by ``materialize`` or when a query first asks for it, and written as parquet
under the cluster's shared checkpoint folder (``spark.checkpoint.dir``), so that:

* reports scan compact, already-joined tables instead of re-deriving them from the
  sources (e.g. lineitem x orders) on every query;
* a query writes the tables it reads and no others;
* the written tables cut lineage: a lost executor re-reads files instead of
  recomputing the source joins.

Layout: ``<checkpoint root>/cohortlens/canonical/<key>/<table>`` where ``key`` hashes the
source directory, the source files' sizes and mtimes and the binding code, so a changed
input or binding never reuses stale tables.  A table is written to a private folder and
then renamed into place, so concurrent writers never expose half-written tables.
"""

from __future__ import annotations

import hashlib
import os
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from . import bindings
from ..session import ensure_checkpoint_dir, scratch_path


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _root(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/cohortlens/canonical"


def _fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Path, size and time of every source file, nested folders included."""
    parts = []
    for name in bindings.SOURCE_TABLES:
        fs, p = _fs(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")
        if fs.exists(p):
            files = fs.listFiles(p, True)
            while files.hasNext():
                st = files.next()
                parts.append(f"{st.getPath().toString()}:{st.getLen()}:{st.getModificationTime()}")
    return "|".join(sorted(parts))


def store_key(spark: SparkSession, sf_dir: str) -> str:
    fp = _fingerprint(spark, sf_dir)
    with open(bindings.__file__, "rb") as f:
        code = f.read()
    h = hashlib.sha1()
    for part in (os.path.abspath(sf_dir).encode(), fp.encode(), code):
        h.update(part)
        h.update(b"\0")
    return h.hexdigest()[:20]


def write_table(df: DataFrame, path: str) -> None:
    """A5: replace-table write.  ``rebalance`` deals the rows evenly whatever the keys, and AQE
    splits and merges the parts to its advisory size, from one file to any number."""
    df.hint("rebalance").write.mode("overwrite").parquet(path)


def _write_once(spark: SparkSession, df: DataFrame, folder: str, name: str, force: bool = False) -> None:
    """Write ``folder/name`` unless it is there: to a private folder, then renamed into place, so a table that is there
    is whole.  Files follow the scan's splits or, after a join, AQE's partitions: no shuffle of its own."""
    fs, final = _fs(spark, f"{folder}/{name}")
    if fs.exists(final) and not force:
        return
    _, tmp = _fs(spark, f"{folder}-tmp-{uuid.uuid4().hex}/{name}")
    try:
        df.write.parquet(tmp.toString())
        fs.mkdirs(final.getParent())
        if force:
            fs.delete(final, True)
        if fs.exists(final) or not fs.rename(tmp, final):
            if not fs.exists(final):
                raise OSError(f"could not publish {name} at {folder}")  # else another writer won the race
    finally:
        fs.delete(tmp.getParent(), True)


def materialize(spark: SparkSession, sf_dir: str, root: str | None = None,
                force: bool = False) -> str:
    """Write all canonical tables that are not there yet; return the store folder."""
    folder = f"{root or _root(spark)}/{store_key(spark, sf_dir)}"
    tables = bindings.load_tables(spark, sf_dir)
    # independent Spark jobs submitted concurrently: the small tables' jobs use the slots
    # the big fact-table job leaves idle (largest first)
    names = ["participant_charge", *(n for n in bindings.BUILDERS if n != "participant_charge")]
    plans = [(spark, tables[n], folder, n, force) for n in names]
    with ThreadPoolExecutor(max_workers=min(4, len(plans))) as pool:
        for f in [pool.submit(_write_once, *p) for p in plans]:
            f.result()
    return folder


class StoredTables(dict):
    """name -> DataFrame reading the materialised canonical table, which is written when it is first asked for:
    a query pays for the tables it reads."""

    def __init__(self, spark: SparkSession, folder: str, sf_dir: str):
        super().__init__()
        self.spark, self.folder, self.sf_dir = spark, folder, sf_dir
        self._writing = {name: threading.Lock() for name in bindings.BUILDERS}

    def source(self, name: str) -> DataFrame:
        return bindings.read_source(self.spark, self.sf_dir, name)

    def __missing__(self, name: str) -> DataFrame:
        if name not in bindings.BUILDERS:
            raise KeyError(name)
        with self._writing[name]:  # reports that run side by side wait for the first to write it
            if name not in self:
                _write_once(self.spark, bindings.load_tables(self.spark, self.sf_dir)[name], self.folder, name)
                self[name] = self.spark.read.parquet(f"{self.folder}/{name}")
        return self[name]


class RunTables(dict):
    """Tables for a run of many reports: what several of them derive from the canonical tables is written once
    (``once``), under a scratch folder of the run, and so is what one derives with large shuffles.  These tables are
    written one at a time, so that the disk holds the shuffles of one of them."""

    def __init__(self, spark: SparkSession, tables):
        super().__init__()
        self.spark, self.tables, self.kept = spark, tables, {}
        self._writing = threading.RLock()  # what a table is built of may be written first

    def __missing__(self, name: str) -> DataFrame:
        return self.tables[name]

    def source(self, name: str) -> DataFrame:
        return self.tables.source(name)

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.kept:
            with self._writing:  # reports that run side by side wait for the first to write it
                if name not in self.kept:
                    df, path = build(), scratch_path(self.spark, "run", name)
                    df.write.parquet(path)
                    self.kept[name] = self.spark.read.schema(df.schema).parquet(path)
        return self.kept[name]


def once(tables, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``build()``, which a run of many reports (``RunTables``) writes at its first use and then reads."""
    return tables.once(name, build) if hasattr(tables, "once") else build()


_CACHE: dict = {}


def stored_tables(spark: SparkSession, sf_dir: str) -> StoredTables:
    """Canonical tables for ``sf_dir``, each materialised at its first use when the files are new or changed."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), store_key(spark, sf_dir))
    if key not in _CACHE:
        _CACHE[key] = StoredTables(spark, f"{_root(spark)}/{key[-1]}", sf_dir)
    return _CACHE[key]
