"""Change detection by content hash, and the incremental index pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.extract import Parsed
from codeloom.operators.store import clear_graph, delete_files, replace_files
from codeloom.schema import Graph
from codeloom.sources.tables import get_meta, upsert_meta, written

VERSION_KEY = "parser_version"


def content_hash(scan: DataFrame) -> DataFrame:
    """(path, content, ...) -> adds content_hash, SHA-256 of the UTF-8 text."""
    return scan.withColumn("content_hash", F.sha2("content", 256))


def diff_snapshot(files: DataFrame, scan: DataFrame) -> DataFrame:
    """Stored files and scan (path, content_hash, error: boolean[, force: boolean]) -> (path, content_hash, status: updated, skipped or error).

    A file of ``force`` is updated though its hash is the stored one.
    """
    force = F.coalesce("force", F.lit(False)) if "force" in scan.columns else F.lit(False)
    scan = scan.select("path", "content_hash", "error", force.alias("force"))
    old = files.select("path", F.col("content_hash").alias("old_"))
    same = F.col("content_hash").eqNullSafe(F.col("old_")) & F.col("old_").isNotNull() & ~F.col("force")
    status = F.when(F.coalesce("error", F.lit(False)) | F.col("content_hash").isNull(), "error").when(same, "skipped").otherwise("updated")
    return scan.join(old, "path", "left").select("path", "content_hash", status.alias("status"))


def index_stats(statuses: DataFrame, duration_ms: int | None = None) -> DataFrame:
    """One row: files_scanned, files_updated, files_skipped, files_errored; and duration_ms, if the caller says how long its run took."""
    count = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("long")), F.lit(0))
    out = statuses.agg(F.count(F.lit(1)).alias("files_scanned"), count("updated").alias("files_updated"), count("skipped").alias("files_skipped"), count("error").alias("files_errored"))
    return out if duration_ms is None else out.withColumn("duration_ms", F.lit(duration_ms).cast("long"))


def missing_files(files: DataFrame, scan: DataFrame) -> DataFrame:
    return files.join(scan.select("path"), "path", "left_anti").select("path")


def version_gate(graph: Graph, version: str) -> Graph:
    """A graph of another parser version, or of none, is cleared first."""
    return graph if get_meta(graph.meta, VERSION_KEY) == version else clear_graph(graph)


def index_project(graph: Graph, scan: DataFrame, extract: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]], version: str, now_ms: int, delete_missing: bool = False) -> tuple[Graph, DataFrame]:
    """Scan (path, content, error[, force]) -> (graph, statuses). Only updated files are extracted; files in error keep their old rows and hash.

    ``extract``: (path, content) -> nodes (with ord), edges, errors (path); a file that it reports is in error too. Files that the scan lacks
    stay unless ``delete_missing``. Of a ``Parsed`` the edges are made when they are asked for. The statuses by hash are written once, so contents are hashed and scanned only.
    """
    graph = version_gate(graph, version)
    scan = content_hash(scan)
    statuses = written(diff_snapshot(graph.files, scan.drop("content")), "statuses")
    changed = statuses.where("status = 'updated'").select("path")
    found = extract(scan.join(changed, "path", "left_semi").select("path", "content"))
    nodes, edges, errors = found.for_index() if isinstance(found, Parsed) else found
    bad = errors.select(F.col("path").alias("bad_")).distinct()
    statuses = statuses.join(bad, F.col("path") == F.col("bad_"), "left").select("path", "content_hash", F.when(F.col("bad_").isNotNull(), "error").otherwise(F.col("status")).alias("status"))
    files = statuses.where("status = 'updated'").select("path", "content_hash", F.lit(now_ms).cast("long").alias("indexed_at"))
    out = replace_files(graph, files, nodes, edges)
    if delete_missing:
        out = delete_files(out, missing_files(out.files, scan))
    return out.with_tables(meta=upsert_meta(out.meta, {VERSION_KEY: version})), statuses
