"""Set semantics of writes to the graph: replace, ignore repeats, cascade, integrity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import maybe_listed, path_filter
from codeloom.schema import EDGE_COLUMNS, EDGE_TEXTS, KINDS, NODE_COLUMNS, RELATIONSHIPS, Graph, LateGraph, edge_hash, empty_graph, light, packed, unpacked, whole
from codeloom.sources.tables import small_side, written


def put_files(files: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace by path; in ``new`` the latest indexed_at wins."""
    own = new.groupBy("path").agg(F.max_by("content_hash", F.struct("indexed_at", "content_hash")).alias("content_hash"), F.max("indexed_at").alias("indexed_at"))
    return files.join(own, "path", "left_anti").unionByName(own)


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or ignore by id: a stored row wins; in ``new`` (node columns and ord) the one with the least ord. New rows are made and written once."""
    row = F.struct("ord", *(c for c in NODE_COLUMNS if c != "id"))
    first = written(new.groupBy("id").agg(F.min(row).alias("r")).select("id", *(F.col(f"r.{c}") for c in NODE_COLUMNS if c != "id")), "new-nodes")
    stored = maybe_listed(nodes.select("id"), "id", path_filter(first.select(F.col("id").alias("entry"))))  # ids that none of the new ones has stay where they are
    return nodes.unionByName(first.join(stored, "id", "left_anti").select(*NODE_COLUMNS))


def add_edges(edges: DataFrame, new: DataFrame, spelt: bool = False) -> DataFrame:
    """Insert or ignore by source, target and type: a row of the edges by its 128-bit hash, so of what is stored hashes are shuffled and no ids, and of these only what a filter of the new ones lets pass.

    The file of the source stays where both have it. With ``spelt``, for many new edges and tables that both have the text of every id that is a digest, rows are told
    apart by their texts, and of what is stored those of the new ones' types are shuffled: neither ids nor hashes are moved.
    """
    home = [c for c in ("source_file",) if c in edges.columns and c in new.columns]
    keys = [*EDGE_COLUMNS, *home]
    if spelt:
        types = F.broadcast(new.select(F.col("relationship_type").alias("type_")).distinct())  # as many rows as relationships
        stored = edges.join(types, F.col("relationship_type").eqNullSafe(F.col("type_")), "left_semi")
        row = [*EDGE_COLUMNS, *EDGE_TEXTS]
        known = light(stored.select(*row)).select("*", *(F.lit(None).cast("string").alias(c) for c in home), F.lit(True).alias("stored_"))
        rows = light(new.select(*row)) if not home else light(new.select(*row, F.col("source_file").alias("home_"))).withColumnRenamed("home_", "source_file")
        rows = rows.withColumn("stored_", F.lit(False)).unionByName(known)
        by = [c for c in rows.columns if c not in (*home, "stored_")]
        # dealt by one end, the same of an edge and its reverse: neighbours in a shuffle share most of their texts, which takes a quarter less than edges dealt alone;
        # so the edges of a hub meet in one task if its text is the greater one
        end = F.greatest(*(F.coalesce(text, F.col(short).cast("string")) for text, short in zip(EDGE_TEXTS, ("source_", "target_"))))
        once = rows.repartition(end).withColumn("end_", end).groupBy("end_", *by).agg(F.bool_or("stored_").alias("stored_"), *(F.min(c).alias("home_") for c in home)).where("NOT stored_")
        fresh = whole(once, [*EDGE_COLUMNS, *("home_" for _ in home)]).withColumnsRenamed({"home_": c for c in home})
        return edges.select(*keys).unionByName(fresh)
    once = new.select(packed("source_id"), packed("target_id"), "relationship_type", *home, *edge_hash()).dropDuplicates(["hash_", "hash2_"])
    stored = maybe_listed(edges.select(*edge_hash()), "hash_", path_filter(new.select(edge_hash()[0].alias("entry"))))
    fresh = once.join(stored.hint("merge"), ["hash_", "hash2_"], "left_anti")
    return edges.select(*keys).unionByName(fresh.select(unpacked("source_id"), unpacked("target_id"), "relationship_type", *home))


def delete_files(graph: Graph, paths: DataFrame, send_few: bool = False) -> Graph:
    """Remove files (path), their nodes, and the edges whose source is one of those; edges that point to them stay and dangle.

    With ``send_few``, for tables that ``by_file`` has not laid, few paths are written once and broadcast.
    """
    gone = paths.select(F.col("path").alias("path_")).distinct()
    gone = small_side(gone, "gone") if send_few else gone
    if "source_file" in graph.edges.columns:  # as by_file lays them
        edges = graph.edges.join(gone, F.col("source_file") == F.col("path_"), "left_anti")
    else:
        lost = graph.nodes.join(gone, F.col("file_path") == F.col("path_"), "left_semi").select(F.col("id").alias("id_"))
        edges = graph.edges.join(lost, F.col("source_id") == F.col("id_"), "left_anti")
    return graph.with_tables(
        files=graph.files.join(gone, F.col("path") == F.col("path_"), "left_anti"),
        nodes=graph.nodes.join(gone, F.col("file_path") == F.col("path_"), "left_anti"),
        edges=edges,
    )


def clear_graph(graph: Graph) -> Graph:
    """Drop files, nodes and edges; keep meta."""
    return empty_graph(graph.meta.sparkSession).with_tables(meta=graph.meta)


def replace_files(graph: Graph, files: DataFrame, nodes: DataFrame, edges: DataFrame | Callable[[], DataFrame]) -> Graph | LateGraph:
    """Replace what the graph holds of ``files`` (file columns) by ``nodes`` (with ord) and ``edges``, all at once; a function makes its edges when they are asked for."""
    kept = delete_files(graph, files.select("path"), send_few=True)
    late = LateGraph(put_files(kept.files, files), add_nodes(kept.nodes, nodes), kept.meta, lambda: add_edges(kept.edges, edges() if callable(edges) else edges))
    return late if callable(edges) else late.with_tables(edges=late.edges)


def check_integrity(graph: Graph) -> DataFrame:
    """(rule, n): the number of rows that break each rule; all zero in a sound graph."""
    n = F.count(F.lit(1)).alias("n")
    broken = {
        "node_without_file": graph.nodes.join(graph.files, F.col("file_path") == F.col("path"), "left_anti"),
        "edge_without_source": graph.edges.join(graph.nodes, F.col("source_id") == F.col("id"), "left_anti"),
        "unknown_kind": graph.nodes.where(~F.col("kind").isin(*KINDS)),
        "unknown_type": graph.edges.where(~F.col("relationship_type").isin(*RELATIONSHIPS)),
        "repeated_id": graph.nodes.groupBy("id").count().where("count > 1"),
    }
    out = None
    for rule, rows in broken.items():
        one = rows.agg(n).select(F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def dangling_edges(graph: Graph) -> DataFrame:
    """Edges whose target is no node, with the reason: file (an indexed path), symbol (an id of an absent symbol) or module (anything else)."""
    loose = graph.edges.join(graph.nodes.select("id"), F.col("target_id") == F.col("id"), "left_anti")
    paths = graph.files.select(F.col("path").alias("path_"))
    reason = F.when(F.col("path_").isNotNull(), "file").when(F.col("target_id").rlike("^[0-9a-f]{64}$"), "symbol").otherwise("module")
    return loose.join(paths, F.col("target_id") == F.col("path_"), "left").select(*EDGE_COLUMNS, reason.alias("reason"))
