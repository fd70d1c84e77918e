"""Counts, top lists and entry points of a graph; aggregates run before the joins that name their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.schema import Graph


def overview_counts(graph: Graph) -> DataFrame:
    """One row: n_files, n_nodes, n_edges; zeros for an empty graph."""
    rows = [getattr(graph, t).select(F.lit(t).alias("table")) for t in ("files", "nodes", "edges")]
    count = lambda t: F.coalesce(F.sum((F.col("table") == t).cast("long")), F.lit(0)).alias(f"n_{t}")
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).agg(count("files"), count("nodes"), count("edges"))


def node_kinds(graph: Graph) -> DataFrame:
    return graph.nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")


def edge_types(graph: Graph) -> DataFrame:
    return graph.edges.groupBy("relationship_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "relationship_type")


def summary_line(counts: DataFrame) -> DataFrame:
    """``overview_counts`` -> (summary): one sentence of the three numbers."""
    return counts.select(F.format_string("Codebase has %d file(s), %d symbol(s), and %d edge(s).", "n_files", "n_nodes", "n_edges").alias("summary"))


def _targets(graph: Graph, relationship: str) -> DataFrame:
    return graph.edges.where(F.col("relationship_type") == relationship).groupBy("target_id").agg(F.count(F.lit(1)).alias("n"))


def called(graph: Graph) -> DataFrame:
    own = graph.nodes.select("id", "name", "kind", "file_path")
    return _targets(graph, "CALLS").join(own, F.col("target_id") == F.col("id")).select("id", "name", "kind", "file_path", F.col("n").alias("caller_count"))


def top_called(graph: Graph, k: int = 10) -> DataFrame:
    return called(graph).orderBy(F.desc("caller_count"), "id").limit(k)


def top_imported(graph: Graph, k: int = 10) -> DataFrame:
    """Importers by file of the node that an IMPORTS edge names; edges that name a path match no node."""
    hits = _targets(graph, "IMPORTS").join(graph.nodes.select("id", "file_path"), F.col("target_id") == F.col("id"))
    return hits.groupBy("file_path").agg(F.sum("n").alias("importer_count")).orderBy(F.desc("importer_count"), "file_path").limit(k)


def imported_files(graph: Graph) -> DataFrame:
    return _targets(graph, "IMPORTS").join(graph.files.select("path"), F.col("target_id") == F.col("path")).select("path", F.col("n").alias("importer_count"))


def top_imported_files(graph: Graph, k: int = 10) -> DataFrame:
    return imported_files(graph).orderBy(F.desc("importer_count"), "path").limit(k)


def entries(graph: Graph) -> DataFrame:
    exported = graph.nodes.where("exported = 1")
    return exported.join(_targets(graph, "CALLS"), F.col("id") == F.col("target_id"), "left_anti").select("id", "name", "kind", "file_path")


def entry_points(graph: Graph, k: int = 20) -> DataFrame:
    return entries(graph).orderBy("file_path", "name", "id").limit(k)


def codebase_overview(graph: Graph) -> dict[str, DataFrame]:
    return {f.__name__: f(graph) for f in (overview_counts, node_kinds, edge_types, top_called, top_imported, top_imported_files, entry_points)}


def overview_by_project(graph: Graph, project: Column, k: int = 3, k_entries: int = 3) -> DataFrame:
    """(project, item, key, n): counts, kinds, types and top lists of each project; ``project`` is computed from ``file_path``."""
    nodes = graph.nodes.withColumn("project", project)
    edges = graph.edges.join(nodes.select(F.col("id").alias("source_id"), "project"), "source_id")
    files = graph.files.select("path", F.col("path").alias("file_path")).withColumn("project", project)
    count = lambda df, item, key: df.groupBy("project", key.alias("key")).agg(F.count(F.lit(1)).alias("n")).select("project", F.lit(item).alias("item"), "key", "n")

    def top(df: DataFrame, item: str, n: int, *order) -> DataFrame:
        ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy("project").orderBy(*order))).where(F.col("rank") <= n)
        return ranked.select("project", F.lit(item).alias("item"), "key", "n")

    calls = called(graph).withColumn("project", project).select("project", F.col("id").alias("key"), F.col("caller_count").alias("n"))
    starts = entries(graph).withColumn("project", project).select("project", F.col("id").alias("key"), F.lit(1).cast("long").alias("n"), "file_path", "name")
    parts = [count(files, "files", F.lit("")), count(nodes, "nodes", F.lit("")), count(edges, "edges", F.lit("")), count(nodes, "kind", F.col("kind")), count(edges, "type", F.col("relationship_type")), top(calls, "top_called", k, F.desc("n"), "key"), top(starts, "entry_point", k_entries, "file_path", "name", "key")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
