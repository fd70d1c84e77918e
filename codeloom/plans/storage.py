"""Queries over the graph's stores: snapshots, metadata, settings, file rows, the version gate, change batches and the change stream."""

from __future__ import annotations

import math
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import extract, incremental, neighbors, overview, store
from codeloom.plans.corpus import corpus, surroundings
from codeloom.schema import META, empty_graph
from codeloom.sources import files, tables
from codeloom.sources.testgraph import PRELUDE, SNAPSHOTS, change_events, derived_graph, snapshots, table
from codeloom.streaming import changes

#: Files that a task writes of a source tree.
FILES_PER_TASK = 500
GAP, DELAY = "6 hours", "1 minute"


def _items(**parts: DataFrame) -> DataFrame:
    """(item, key): the rows of several one-column frames."""
    out = None
    for item, rows in parts.items():
        one = rows.select(F.lit(item).alias("item"), F.col(rows.columns[0]).alias("key"))
        out = one if out is None else out.unionByName(one)
    return out


def graph_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph written, then written again without its nation files, then read back: the keys of every row."""
    folder = f"{tables.work_dir(spark)}/graph-{uuid4().hex}"
    g = derived_graph(spark, sf_dir)
    tables.save_graph(g, folder)
    stored = tables.load_graph(spark, folder, with_homes=True)
    tables.save_graph(store.delete_files(stored, stored.files.where("path LIKE '/src/nation_1%'").select("path"), send_few=True), folder)
    last = tables.load_graph(spark, folder)
    return _items(files=last.files.select("path"), nodes=last.nodes.select("id"), edges=last.edges.select(F.concat("source_id", "target_id", "relationship_type")))


def file_views_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, key) over the graph laid out by file: cross-file edges, importers, and what is left once the nations' files that begin with 1 are gone."""
    g = tables.by_file(derived_graph(spark, sf_dir))
    cross = neighbors.file_edges(g.nodes, g.edges, g.files, include_internal=False)
    importers = neighbors.importers_of(g.nodes, g.edges, g.files)
    left = store.delete_files(g, g.files.where("path LIKE '/src/nation_1%'").select("path"))
    keys = lambda *columns: F.concat_ws(" ", *columns)
    return _items(cross=cross.select(keys("file_path", "source_id", "target_id", "relationship_type")), importers=importers.select(keys("path", "importer")), left=left.edges.select(keys("source_id", "target_id", "relationship_type")))


def meta_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A meta row per customer, of which one is replaced and two are new."""
    meta = table(spark, sf_dir, "customer").select(F.concat(F.lit("c_"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("value"))
    return tables.upsert_meta(meta, {"c_1": "changed", "globs": ["**/*.ts", "*.js"], "version": "2"})


def source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(folder, content_hash) of source files, one per supplier, that Spark writes to seven folders, of which two are ignored or do not fit."""
    root = f"{tables.work_dir(spark)}/tree-{uuid4().hex}"
    k = F.col("s_suppkey")
    text = F.concat(F.lit("export const s_"), k.cast("string"), F.lit(' = "'), "s_name", F.lit('";'))
    rows = table(spark, sf_dir, "supplier").select(text.alias("value"), F.concat(F.when(k % 7 == 5, "x").otherwise("d"), (k % 7).cast("string")).alias("at"))
    spread = rows.repartition(max(spark.sparkContext.defaultParallelism, math.ceil(rows.count() / FILES_PER_TASK)))  # a small table is one split
    spread.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("at").text(root)
    found = files.read_source_tree(spark, root, ["at=d*/*.txt"], ["**/at=d3/**"])
    return incremental.content_hash(found).select(F.regexp_extract("path", "/at=([^/]*)/", 1).alias("folder"), "content_hash")


def path_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of a project per part, with comments; those of every fifth hold a URL, which ends them as a comment would."""
    p = F.col("p_partkey")
    s = p.cast("string")
    lines = [F.concat(F.lit('{"compilerOptions": {"baseUrl": "./b_'), (p % 7).cast("string"), F.lit('", // base')), F.concat(F.lit('"paths": {"@z'), s, F.lit('/*": ["x/*", "w/*"], "@none": [],')), F.concat(F.lit('"@a": ["y_'), s, F.lit('"]')), F.when(p % 5 == 0, F.lit(', "u": ["http://x"]')).otherwise(""), F.lit("}}}")]
    settings = table(spark, sf_dir, "part").select(F.concat(F.lit("p_"), s).alias("project"), F.lit("/r").alias("dir"), F.concat_ws("\n", *lines).alias("text"))
    return files.load_path_aliases(settings)


def put_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored files replaced by those of the scan; a later row of one path wins over an earlier one."""
    old, scan = snapshots(spark, sf_dir)
    new = incremental.content_hash(scan).select("path", "content_hash", F.lit(1).cast("long").alias("indexed_at"))
    later = new.where("path LIKE '%7.txt'").select("path", F.lit("late").alias("content_hash"), F.lit(2).cast("long").alias("indexed_at"))
    return store.put_files(old, new.unionByName(later))


def version_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(version, item, n): rows of the graph's tables behind the gate for its own parser version and for another one."""
    g = derived_graph(spark, sf_dir)
    g = g.with_tables(meta=spark.createDataFrame([(incremental.VERSION_KEY, "1")], META))
    out = None
    for version in ("1", "2"):
        gated = incremental.version_gate(g, version)
        for item in ("files", "nodes", "edges", "meta"):
            one = getattr(gated, item).agg(F.count(F.lit(1)).alias("n")).select(F.lit(version).alias("version"), F.lit(item).alias("item"), "n")
            out = one if out is None else out.unionByName(one)
    return out


def codebase_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, key, n): every part of the overview in one frame; entry points count 1."""
    parts = overview.codebase_overview(derived_graph(spark, sf_dir))
    counts = parts.pop("overview_counts").unpivot([], ["n_files", "n_nodes", "n_edges"], "key", "n").withColumn("item", F.lit("overview_counts"))
    keys = {"node_kinds": ("kind", "n"), "edge_types": ("relationship_type", "n"), "top_called": ("id", "caller_count"), "top_imported": ("file_path", "importer_count"), "top_imported_files": ("path", "importer_count"), "entry_points": ("id", None)}
    out = counts.select("item", "key", "n")
    for item, rows in parts.items():
        key, n = keys[item]
        out = out.unionByName(rows.select(F.lit(item).alias("item"), F.col(key).alias("key"), (F.col(n) if n else F.lit(1)).cast("long").alias("n")))
    return out


def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, n_nodes) after a batch on the indexed corpus: every fourth source unlinked, odd ones changed, some of these unreadable."""
    sources = corpus(spark, sf_dir)
    around = surroundings(spark, sources)
    number = F.regexp_extract("path", "([0-9]+)", 1).cast("long")
    parse = lambda df: extract.parse_corpus(df, *around)
    first = incremental.index_project(empty_graph(spark), sources.where(number % 3 != 0).withColumn("error", F.lit(False)), parse, "1", 1)[0]
    folder = f"{tables.work_dir(spark)}/graph-{uuid4().hex}"
    tables.save_graph(first, folder)
    op = F.when(number % 4 == 0, "unlink").when(number % 2 == 1, "change")
    text = F.when(number % 6 != 5, F.concat("content", F.lit("\nexport const added = 1;")))
    batch = sources.select("path", op.alias("op"), text.alias("content")).where("op is not null")
    after = changes.apply_changes(tables.load_graph(spark, folder), batch, parse, "1", 2)
    return after.nodes.groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("n_nodes"))


def change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, key) of the files, and their imports, in the graph once the change stream has taken in the events table, a third of its time after the other.

    Each file imports the next one, whose coming and going in later batches moves the import.
    """
    folder = f"{tables.work_dir(spark)}/stream-{uuid4().hex}"
    tables.save_graph(empty_graph(spark), f"{folder}/graph", 8)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ends = events.agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    part = F.least(F.lit(2), F.floor(3 * (F.unix_micros("ts") - F.unix_micros("first")) / (F.unix_micros("last") - F.unix_micros("first") + 1)))
    dated = events.withColumn("ts", F.col("ts").cast("timestamp")).crossJoin(F.broadcast(ends.select(*(F.col(c).cast("timestamp").alias(c) for c in ends.columns)))).withColumn("part", part)
    number = F.regexp_extract("path", "([0-9]+)", 1).cast("long")
    content = F.concat(F.lit("import './u_"), (number + 1).cast("string"), F.lit(".js';\nexport const of = '"), "path", F.lit("';"))
    aliases = spark.createDataFrame([], "root string, base_dir string, ord int, pattern string, replacement string")
    for k in range(3):
        dated.where(F.col("part") == k).select(*events.columns).write.mode("append").parquet(f"{folder}/events")
        raw = spark.readStream.schema(dated.select(*events.columns).schema).parquet(f"{folder}/events")
        query = changes.run_change_stream(spark, change_events(spark, sf_dir, raw), f"{folder}/graph", f"{folder}/check", lambda df: df.withColumn("content", content), lambda df, listing: extract.parse_corpus(df, listing, aliases), "1", GAP, DELAY)
        query.awaitTermination()
    g = tables.load_graph(spark, f"{folder}/graph")
    imports = g.edges.where("relationship_type = 'IMPORTS'").join(g.nodes, F.col("source_id") == F.col("id"))
    return _items(files=g.files.select(F.concat_ws(" ", "path", "content_hash")), imports=imports.select(F.concat_ws(" ", "file_path", "target_id")))


CALLED = "SELECT n.id AS key, count(*) AS n FROM edges e JOIN nodes n ON n.id = e.target_id WHERE relationship_type = 'CALLS' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"
IMPORTED = "SELECT path AS key, count(*) AS n FROM edges JOIN files ON target_id = path WHERE relationship_type = 'IMPORTS' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"
ENTRIES = "SELECT id AS key FROM nodes WHERE exported = 1 AND id NOT IN (SELECT target_id FROM edges WHERE relationship_type = 'CALLS') ORDER BY file_path, name, id LIMIT 20"
SQL = {
    "graph_snapshot": PRELUDE + """, left_ AS (SELECT * FROM nodes WHERE file_path NOT LIKE '/src/nation\\_1%' ESCAPE '\\')
SELECT 'files' AS item, path AS key FROM files WHERE path NOT LIKE '/src/nation\\_1%' ESCAPE '\\' UNION ALL SELECT 'nodes', id FROM left_
UNION ALL SELECT 'edges', source_id || target_id || relationship_type FROM edges WHERE source_id IN (SELECT id FROM left_)""",
    "file_views_by_file": PRELUDE + """SELECT 'cross' AS item, concat_ws(' ', a.file_path, source_id, target_id, relationship_type) AS key FROM edges e JOIN nodes a ON a.id = source_id LEFT JOIN nodes b ON b.id = target_id WHERE b.id IS NULL OR b.file_path <> a.file_path
UNION ALL SELECT DISTINCT 'importers', target_id || ' ' || file_path FROM edges JOIN nodes ON id = source_id WHERE relationship_type = 'IMPORTS' AND target_id IN (SELECT path FROM files)
UNION ALL SELECT 'left', concat_ws(' ', source_id, target_id, relationship_type) FROM edges JOIN nodes ON id = source_id WHERE file_path NOT LIKE '/src/nation\\_1%' ESCAPE '\\'""",
    "meta_values": """SELECT 'c_' || c_custkey AS key, c_name AS value FROM customer WHERE c_custkey <> 1
UNION ALL SELECT * FROM (VALUES ('c_1', 'changed'), ('globs', '["**/*.ts", "*.js"]'), ('version', '2'))""",
    "path_aliases": """WITH p AS (SELECT p_partkey AS p, 'p_' || p_partkey AS project, '/r/b_' || (p_partkey % 7) AS base_dir FROM part WHERE p_partkey % 5 <> 0)
SELECT project, '/r' AS root, base_dir, 0 AS ord, '@z' || p || '/*' AS pattern, 'x/*' AS replacement FROM p UNION ALL SELECT project, '/r', base_dir, 2, '@a', 'y_' || p FROM p""",
    "source_tree": """SELECT 'd' || (s_suppkey % 7) AS folder, sha256('export const s_' || s_suppkey || ' = "' || s_name || '";' || chr(10)) AS content_hash FROM supplier WHERE s_suppkey % 7 NOT IN (3, 5)""",
    "put_files": SNAPSHOTS + """SELECT path, CASE WHEN path LIKE '%7.txt' THEN 'late' ELSE sha256(content) END AS content_hash, CASE WHEN path LIKE '%7.txt' THEN 2 ELSE 1 END::BIGINT AS indexed_at FROM scan
UNION ALL SELECT path, content_hash, 0 FROM old WHERE path NOT IN (SELECT path FROM scan)""",
    "version_gate": PRELUDE + "".join(f"{'UNION ALL ' if k else ''}SELECT '{v}' AS version, '{t}' AS item, {n} AS n " for k, (v, t, n) in enumerate([("1", t, f"(SELECT count(*) FROM {t})") for t in ("files", "nodes", "edges")] + [("1", "meta", 1), ("2", "files", 0), ("2", "nodes", 0), ("2", "edges", 0), ("2", "meta", 1)])),
    "codebase_overview": PRELUDE + f"""SELECT 'overview_counts' AS item, 'n_files' AS key, (SELECT count(*) FROM files) AS n UNION ALL SELECT 'overview_counts', 'n_nodes', (SELECT count(*) FROM nodes) UNION ALL SELECT 'overview_counts', 'n_edges', (SELECT count(*) FROM edges)
UNION ALL SELECT 'node_kinds', kind, count(*) FROM nodes GROUP BY 2 UNION ALL SELECT 'edge_types', relationship_type, count(*) FROM edges GROUP BY 2
UNION ALL SELECT 'top_called', key, n FROM ({CALLED}) UNION ALL SELECT 'top_imported_files', key, n FROM ({IMPORTED}) UNION ALL SELECT 'entry_points', key, 1 FROM ({ENTRIES})""",
    "apply_changes": """WITH p AS (SELECT p_partkey AS p, 9 + (p_partkey % 7 = 0)::INT AS k FROM part WHERE p_partkey % 97 <> 0 AND p_partkey % 4 <> 0)
SELECT '/c/p_' || p || '.ts' AS path, (k + (p % 2 = 1 AND p % 6 <> 5)::INT)::BIGINT AS n_nodes FROM p WHERE p % 3 <> 0 OR p % 2 = 1""",
    "change_stream": """WITH ev AS (SELECT event_id, '/src/u_' || user_id || '.ts' AS path, event_type, ts FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY path ORDER BY ts, event_id)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts, event_id) AS burst FROM g),
s AS (SELECT path, arg_max(event_type, (ts, event_id)) AS kind, max(ts) AS last_ts FROM b GROUP BY path, burst),
done AS (SELECT path, arg_max(kind, last_ts) AS kind FROM s WHERE last_ts + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE GROUP BY 1),
fin AS (SELECT path, regexp_extract(path, '([0-9]+)', 1)::BIGINT + 1 AS nxt FROM done WHERE kind <> 'error')
SELECT 'files' AS item, path || ' ' || sha256('import ''./u_' || nxt || '.js'';' || chr(10) || 'export const of = ''' || path || ''';') AS key FROM fin
UNION ALL SELECT 'imports', path || ' /src/u_' || nxt || CASE WHEN '/src/u_' || nxt || '.ts' IN (SELECT path FROM fin) THEN '.ts' ELSE '.js' END FROM fin""",
}


def queries() -> dict:
    return {f.__name__: f for f in (graph_snapshot, file_views_by_file, meta_values, source_tree, path_aliases, put_files, version_gate, codebase_overview, apply_changes, change_stream)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
