"""Snapshots of the graph's tables by bucket, metadata, and JSON answers."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.schema import EDGE_COLUMNS, EDGE_TEXTS, INDEX_SCHEMAS, LIGHT, META, SCHEMAS, Graph, ImportIndex, empty_graph, light, whole
from codeloom.sources.commits import Head, commit, head

#: Buckets of files in a folder of snapshots, unless its first snapshot is given another number; of them, a change rewrites those of its files.
BUCKETS = 64
#: Rows of a side (paths, say) up to which it is broadcast, so that what it is joined with stays where it is.
BROADCAST_SIDE = 100_000
#: Spark's setting by which an execution removes its shuffles.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What snapshots hold in place of ids (``light``) and besides, and the names of those that do.
LIGHT_SCHEMAS = {"nodes": "id_ binary", "edges": "source_ binary, target_ binary, source_file string, source_text string, target_text string"}
LIGHT_SNAPSHOT = "snapshot-light-"
#: The path that decides about the bucket of a row of the index.
INDEX_KEYS = {"imports": "path", "listing": "entry", "probes": "candidate"}


def work_dir(spark: SparkSession) -> str:
    """The folder driver and executors share, from ``spark.checkpoint.dir``; its own only in a local session without that setting."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What a write in here shuffles is removed as it ends; else it stays until the driver happens to collect garbage."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` in the shared work folder: short lineage, and a lost executor re-reads it."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid4().hex}"
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once, for joins of a large table with them: up to BROADCAST_SIDE of them are broadcast, more are shuffled."""
    out = written(rows, name)
    return F.broadcast(out) if out.count() <= BROADCAST_SIDE else out


def bucketed(rows: DataFrame, name: str, by: list[str], keys: list[str], sums: list[Column]) -> DataFrame:
    """(keys, sums over the rows that have them) in the shared work folder, in buckets by ``by``: joins on these columns shuffle the other side only."""
    spark, own = rows.sparkSession, f"{name.replace('-', '_')}_{uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(n, *by).groupBy(*keys).agg(*sums).write.format("parquet").bucketBy(n, *by).option("path", f"{work_dir(spark)}/{own}").saveAsTable(own)
    return spark.table(own)


def by_file(graph: Graph) -> Graph:
    """The graph for reading, in tables bucketed by file: edges get source_file, the file of their source (its id where that is no node).

    Per-file views, deletions and importers then join edges on source_file where they lie, without a shuffle of edges or nodes. So do cross-file views where edges
    have target_file; else these join on two columns, and keep edges in place with ``spark.sql.requireAllClusterKeysForCoPartition`` off.
    """
    spark, n = graph.meta.sparkSession, int(graph.meta.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = graph.edges
    if "source_file" not in edges.columns:
        homes = graph.nodes.groupBy(F.col("id").alias("source_id")).agg(F.min("file_path").alias("source_file"))
        edges = edges.join(homes, "source_id", "left").withColumn("source_file", F.coalesce("source_file", "source_id"))

    def laid(rows: DataFrame, column: str) -> DataFrame:
        # a large file's rows are written by several tasks, each into the file's bucket: a task that held them all would have to spill them
        name = f"by_{column}_{uuid4().hex}"
        with shuffles_freed(spark):
            light(rows).hint("rebalance", column).write.format("parquet").option("compression", "zstd").bucketBy(n, column).option("path", f"{work_dir(spark)}/{name}").saveAsTable(name)
        return whole(spark.table(name), rows.columns)

    return graph.with_tables(files=laid(graph.files, "path"), nodes=laid(graph.nodes, "file_path"), edges=laid(edges, "source_file"))


def bucket_of(path: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(n)).cast("int")


def _bucketed(graph: Graph, n: int) -> dict[str, DataFrame]:
    """The tables but meta with the bucket of each row's file; an edge lies with its source and knows its file, one without a source node lies by its source's id."""
    edges = graph.edges
    if "source_file" not in edges.columns:
        homes = graph.nodes.groupBy(F.col("id").alias("home_")).agg(F.min("file_path").alias("source_file"))
        edges = edges.join(homes, F.col("source_id") == F.col("home_"), "left")
    kept = [*EDGE_COLUMNS, "source_file", *(c for c in EDGE_TEXTS if c in edges.columns)]
    return {
        "files": graph.files.withColumn("bucket", bucket_of(F.col("path"), n)),
        "nodes": graph.nodes.withColumn("bucket", bucket_of(F.col("file_path"), n)),
        "edges": edges.select(*kept, bucket_of(F.coalesce("source_file", "source_id"), n).alias("bucket")),
    }


def _written(rows: DataFrame, folder: str, name: str, table: str, only: list[int] | None) -> list[int]:
    """Writes the buckets ``only`` of a table, or all; those that hold rows."""
    mine = rows if only is None else rows.where(F.col("bucket").isin(*only))
    moved = light(mine)
    by = ["bucket", *(c for c in ("source_",) if c in moved.columns and "source_text" not in moved.columns)]  # equal ids side by side
    moved.hint("rebalance", "bucket").sortWithinPartitions(*by).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/{name}/{table}")
    path = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/{table}")
    names = [x.getPath().getName() for x in path.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).listStatus(path)]
    return sorted(int(x.removeprefix("bucket=")) for x in names if x.startswith("bucket="))


def _with_index(index: ImportIndex, n: int) -> dict[str, DataFrame]:
    return {table: getattr(index, table).withColumn("bucket", bucket_of(F.col(key), n)) for table, key in INDEX_KEYS.items()}


def save_graph(graph: Graph, folder: str, n_buckets: int = BUCKETS, index: ImportIndex | None = None, base: Head | None = None) -> Head:
    """Write a whole new snapshot beside the older ones, then commit it; readers see the old snapshot until then.

    With ``base``, the entry that the graph was loaded from, any commit since then is a Conflict; without, the snapshot counts whatever was there.
    """
    spark, name = graph.meta.sparkSession, f"{LIGHT_SNAPSHOT}{uuid4().hex}"
    parts = _bucketed(graph, n_buckets) | (_with_index(index, n_buckets) if index else {})
    with shuffles_freed(spark):
        full = {table: _written(rows, folder, name, table, None) for table, rows in parts.items()}
    graph.meta.write.parquet(f"{folder}/{name}/meta")
    return commit(spark, folder, name, {table: list(range(n_buckets)) for table in parts} | {"meta": [0]}, full | {"meta": [0]}, base, n_buckets)


def save_buckets(graph: Graph, folder: str, buckets: list[int], index: dict[str, tuple[DataFrame, list[int]]] | None = None, base: Head | None = None) -> Head:
    """Write these buckets of files anew, and meta if it has changed; all others stay as they are. ``graph`` holds every row of the buckets.

    ``index``: of tables of the import index, the rows of some buckets and these buckets. ``base`` is the entry that all this was read from (the last
    one by default); if a later one wrote a bucket of these, it is a Conflict.
    """
    spark, name = graph.meta.sparkSession, f"{LIGHT_SNAPSHOT}{uuid4().hex}"
    base = base or head(spark, folder)
    parts = {table: (rows, sorted(buckets)) for table, rows in _bucketed(graph, base.n_buckets).items()}
    for table, (rows, own) in (index or {}).items():
        if own:
            parts[table] = (rows.withColumn("bucket", bucket_of(F.col(INDEX_KEYS[table]), base.n_buckets)), sorted(own))
    with shuffles_freed(spark), ThreadPoolExecutor(len(parts)) as pool:  # small jobs of their own: side by side
        full = dict(zip(parts, pool.map(lambda table: _written(parts[table][0], folder, name, table, parts[table][1]), parts)))
    wrote = {table: own for table, (_, own) in parts.items()}
    old = load_table(spark, folder, "meta", at=base)
    if sorted(map(tuple, old.collect())) != sorted(map(tuple, graph.meta.collect())):  # a few rows
        graph.meta.write.parquet(f"{folder}/{name}/meta")
        wrote["meta"] = full["meta"] = [0]
    return commit(spark, folder, name, wrote, full, base)


def load_table(spark: SparkSession, folder: str, table: str, buckets: list[int] | None = None, at: Head | None = None, with_homes: bool = False) -> DataFrame:
    """The latest rows of a table, or of these buckets of it. With ``with_homes`` edges have source_file (null without a source node) and the texts of their ids,
    as they were saved; not if a snapshot that counts was written before these were."""
    at, schema = at or head(spark, folder), (SCHEMAS | INDEX_SCHEMAS)[table]
    live = at.buckets(table) if at else {}
    if table == "meta":
        paths = [f"{folder}/{name}/meta" for name in live]
    else:
        paths = [f"{folder}/{name}/{table}/bucket={b}" for name, own in live.items() for b in own if buckets is None or b in buckets]
    if not paths:
        return spark.createDataFrame([], schema)
    if table not in LIGHT_SCHEMAS:
        return spark.read.schema(schema).parquet(*paths)
    rows = spark.read.schema(f"{schema}, {LIGHT_SCHEMAS[table]}").parquet(*paths)
    names = [column.split()[0] for column in schema.split(", ")]
    old = {c: f"{c}_old" for c in LIGHT if c in names}  # older snapshots hold ids as they are
    more = ["source_file", *EDGE_TEXTS] if with_homes and table == "edges" and all(name.startswith(LIGHT_SNAPSHOT) for name in live) else []
    found = whole(rows.withColumnsRenamed(old), [*names, *more, *old.values()])
    return found.select(*(F.coalesce(c, old[c]).alias(c) if c in old else c for c in names), *more)


def load_graph(spark: SparkSession, folder: str, buckets: list[int] | None = None, at: Head | None = None, with_homes: bool = False) -> Graph:
    """The latest rows of every bucket, or of these buckets only; an empty graph where there is no snapshot. ``with_homes``: see ``load_table``."""
    at = at or head(spark, folder)
    return Graph(**{table: load_table(spark, folder, table, buckets, at, with_homes) for table in SCHEMAS}) if at else empty_graph(spark)


def buckets_of(paths: DataFrame, folder: str, at: Head | None = None) -> list[int]:
    """The buckets of paths (path) in a folder that has a snapshot: no more than it has buckets."""
    n = (at or head(paths.sparkSession, folder)).n_buckets
    return [r[0] for r in paths.select(bucket_of(F.col("path"), n).alias("bucket")).distinct().orderBy("bucket").collect()]


def prune_snapshots(spark: SparkSession, folder: str) -> int:
    """Remove the snapshots of which no bucket counts any more, and say how many; for when no reader or writer from an older entry is left."""
    last = head(spark, folder)
    if last is None:
        return 0
    kept = {name for names in last.live.values() for name in names}
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [x.getPath() for x in system.listStatus(path) if x.getPath().getName().startswith("snapshot-") and x.getPath().getName() not in kept]
    return sum(system.delete(x, True) for x in gone)


def upsert_meta(meta: DataFrame, values: dict[str, object]) -> DataFrame:
    """Replace by key; lists are kept as JSON text."""
    rows = [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in values.items()]
    new = meta.sparkSession.createDataFrame(rows, META)
    return meta.join(F.broadcast(new), "key", "left_anti").unionByName(new)  # as many rows as arguments


def get_meta(meta: DataFrame, key: str) -> str | None:
    row = meta.where(F.col("key") == key).first()
    return row["value"] if row else None


def to_json_result(df: DataFrame, by: str, summary: Column, columns: list[str], name: str) -> DataFrame:
    """(by, json): for each value of ``by``, an object with a summary (over the grouped ``n``) and the list of rows."""
    grouped = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    return grouped.select(by, F.to_json(F.struct(summary.alias("summary"), name)).alias("json"))
