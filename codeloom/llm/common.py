"""Shared helpers: the cluster's shared folder, written tables, null-safe joins, Arrow text access."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import ship_package


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` as the cluster sets it.

    Only a local[*] session without that setting gets a folder of its own (tests); a cluster without
    one is an error, since a machine-local folder would not be seen by the other machines.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    existing = context.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes inside are removed at the end: for work whose result is stored elsewhere by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    A lost executor then costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipped(df: DataFrame) -> DataFrame:
    """``df``, once the executors have the package, which functions of ``mapInArrow`` over any frame need."""
    ship_package(df.sparkSession)
    return df


def same(left: Column, right: Column) -> Column:
    """Equality in which null equals null."""
    return left.eqNullSafe(right)


#: Rows (an id and a hash) up to which a set of rows is broadcast.
BROADCAST_ROWS = 500_000


def without_rows(docs: DataFrame, bad: DataFrame, name: str) -> DataFrame:
    """``docs`` without the rows in ``bad`` (doc_id, mark_: hash of the text): rows that share a doc_id or have none are told apart by it.

    Few such rows are broadcast, so the texts that stay do not move; more are joined by shuffle.
    """
    bad = written(bad.select(F.col("doc_id").alias("bad_id_"), F.col("mark_").alias("bad_mark_")).distinct(), name)
    side = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return docs.join(side, same(docs["doc_id"], side["bad_id_"]) & (F.xxhash64(docs["text"]) == side["bad_mark_"]), "left_anti")


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[str]:
    """The strings of an Arrow column one by one; null counts as empty."""
    for x in column:
        yield x.as_py() or ""


def hex64(fingerprint: Column) -> Column:
    """A signed long as 16 lower-case hex digits of its 64 bits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
