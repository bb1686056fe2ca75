"""Layers that several queries of a session share: written once, found again by what they were made from.

A layer's key is its name and the state of its source files: names, sizes and times of change. As long as these are the same, the next
query reads what the first one wrote; after a change it is made anew. ``kept`` bounds their life: layers made within the block are deleted at
its end, so results must have been taken by then. Outside of a block they stay until ``drop``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .tables import shared_path, transactions

#: (application, key) -> path of a layer that has been written.
_WRITTEN: dict[tuple[str, str], str] = {}


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def content_key(spark: SparkSession, path: str) -> str:
    """A hash of the names, sizes and times of change of the files of a table, a file or a folder."""
    where, fs = _files(spark, path)
    seen, files = hashlib.sha256(), fs.listFiles(where, True)
    rows = []
    while files.hasNext():
        f = files.next()
        rows.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    seen.update("\n".join(sorted(rows)).encode())
    return seen.hexdigest()


def layer(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The layer ``name`` of the table at ``source``: as ``make`` returns it, written once a session and content."""
    key = (spark.sparkContext.applicationId, f"{name}-{content_key(spark, source)}")
    path = _WRITTEN.get(key)
    if path is not None:
        where, fs = _files(spark, f"{path}/_SUCCESS")
        if not fs.exists(where):
            path = None
    if path is None:
        path = shared_path(spark, f"layer-{name}")
        make().write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(path)


def drop(spark: SparkSession, keep: frozenset = frozenset()) -> None:
    """Deletes this session's layers, but for those whose keys are in ``keep``."""
    for key in [k for k in _WRITTEN if k[0] == spark.sparkContext.applicationId and k not in keep]:
        where, fs = _files(spark, _WRITTEN.pop(key))
        fs.delete(where, True)


@contextmanager
def kept(spark: SparkSession) -> Iterator[None]:
    """Layers that queries make within the block are shared by them and deleted when it ends."""
    before = frozenset(_WRITTEN)
    try:
        yield
    finally:
        drop(spark, before)


def transaction_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions of ``events``, written once: their source isn't scanned again for each use."""
    return layer(spark, f"{sf_dir}/events.parquet", "transactions", lambda: transactions(spark, sf_dir))
