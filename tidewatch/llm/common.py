"""Helpers shared by the corpus operators: the shared scratch folder and written tables."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and Spark runs on one machine, as in tests, a temporary folder is used; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="tidewatch-"))


#: Folders of the enclosing ``temporary`` blocks, the innermost last.
_WITHIN: ContextVar[tuple[str, ...]] = ContextVar("within", default=())


def new_path(spark: SparkSession, name: str, outside: bool = False) -> str:
    """A path in the shared folder that no other call uses, within the innermost ``temporary`` block or (``outside``) the one around it."""
    within = _WITHIN.get()[: -1 if outside else None]
    return f"{within[-1] if within else scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def temporary(spark: SparkSession, name: str):
    """What ``written`` writes in this block is deleted when it ends, but for tables written ``outside``; so only those may be used after."""
    folder = new_path(spark, name)
    token = _WITHIN.set((*_WITHIN.get(), folder))
    try:
        yield
    finally:
        _WITHIN.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, outside: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back, so that its lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name, outside)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], *names: str) -> list[str]:
    """A column name for each of ``names`` that ``columns`` don't have, in any case of letters."""
    have, out = {c.lower() for c in columns}, []
    for n in names:
        while (n := f"_{n}") in have:
            pass
        out.append(n)
    return out
