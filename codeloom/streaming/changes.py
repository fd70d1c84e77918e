"""File change events: filtering, debouncing, re-indexing and the importers of what changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators.import_index import came_or_went, counted_listing, listing_after, probes_of, retargeted, tried_imports
from codeloom.operators.incremental import VERSION_KEY, index_project
from codeloom.operators.neighbors import importers_of
from codeloom.operators.store import clear_graph, delete_files
from codeloom.schema import INDEX_SCHEMAS, Graph, ImportIndex
from codeloom.sources.commits import Head, transact
from codeloom.sources.tables import BUCKETS, buckets_of, get_meta, load_graph, load_table, save_buckets, save_graph, written

RIPPLE_CAP = 20


def filter_changes(events: DataFrame, globs: list[str], ignore: list[str]) -> DataFrame:
    """Drops paths with a name that begins with a dot, with an ignored folder, or of another extension; globs without one let all pass."""
    endings = [name.rpartition(".")[2] for name in (glob.rpartition("/")[2] for glob in globs) if "*." in name]
    extensions = sorted({"." + x for x in endings if x.isalpha()})
    folders = sorted({parts[1] for glob in ignore if len(parts := glob.split("/")) == 3 and parts[0] == parts[2] == "**" and "*" not in parts[1]})
    parts = F.split("path", "/")
    keep = ~F.exists(parts, lambda p: p.startswith(".") | (p.isin(*folders) if folders else F.lit(False)))
    if extensions:
        keep &= F.regexp_extract("path", "(\\.[^./]*)$", 1).isin(*extensions)
    return events.where(keep)


def debounce(events: DataFrame, gap: str = "500 milliseconds", delay: str = "1 minute") -> DataFrame:
    """(path, op, event_ts, event_id) -> (path, op, first_ts, last_ts, n_events): the last state of each burst, batch or streaming.

    A burst ends when the path has been quiet for ``gap``; of events at one time the larger event_id is later. Streaming drops events that are
    later than ``delay``.
    """
    timed = events.withWatermark("event_ts", delay) if events.isStreaming else events
    bursts = timed.groupBy("path", F.session_window("event_ts", gap)).agg(F.max_by("op", F.struct("event_ts", "event_id")).alias("op"), F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts"), F.count(F.lit(1)).alias("n_events"))
    return bursts.select("path", "op", "first_ts", "last_ts", "n_events")


def importer_counts(graph: Graph, changed: DataFrame) -> DataFrame:
    """Changed files (path) -> (path, n_importers) for those with importers."""
    return importers_of(graph.nodes, graph.edges, changed).groupBy("path").agg(F.count(F.lit(1)).alias("n_importers"))


def ripple_targets(graph: Graph, changed: DataFrame, cap: int = RIPPLE_CAP) -> DataFrame:
    """(importer): files to index again, one level; a changed file with more than ``cap`` importers has none. Counts come before rows."""
    few = importer_counts(graph, changed).where(F.col("n_importers") <= cap).select("path")
    return importers_of(graph.nodes, graph.edges, few).select("importer").distinct()


def ripple_skipped(graph: Graph, changed: DataFrame, cap: int = RIPPLE_CAP) -> DataFrame:
    return importer_counts(graph, changed).where(F.col("n_importers") > cap)


def apply_changes(graph: Graph, batch: DataFrame, extract: Callable, version: str, now_ms: int) -> Graph:
    """Batch (path, op, content[, force]), a row per path -> the graph after it.

    Unlinked files go with their rows; others are indexed if their hash differs, and those of ``force`` whatever their hash.
    """
    return _applied(graph, batch, extract, version, now_ms)[0]


def _applied(graph: Graph, batch: DataFrame, extract: Callable, version: str, now_ms: int) -> tuple[Graph, DataFrame]:
    graph = delete_files(graph, batch.where("op = 'unlink'").select("path"))
    force = F.coalesce("force", F.lit(False)) if "force" in batch.columns else F.lit(False)
    scan = batch.where("op <> 'unlink'").select("path", "content", F.col("content").isNull().alias("error"), force.alias("force"))
    return index_project(graph, scan, extract, version, now_ms)


def run_change_stream(spark: SparkSession, events: DataFrame, graph_dir: str, checkpoint: str, read_content: Callable[[DataFrame], DataFrame], extract: Callable, version: str, gap: str = "500 milliseconds", delay: str = "1 minute", **trigger) -> StreamingQuery:
    """Debounced events re-index the graph in ``graph_dir``: each batch reads and writes the buckets that it concerns; a restart resumes from ``checkpoint``.

    ``read_content``: (path, op, force) -> adds content. ``extract``: (sources, listing) -> nodes, edges, errors and imports, as ``parse_corpus``
    gives them; the listing finds the paths that are there after the batch. Files whose imports lead elsewhere since a target came or went are extracted
    again though their own text is the same, however many they are. A graph of another parser version is cleared first. A batch whose
    buckets another writer has committed meanwhile starts anew.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        own = written(batch.groupBy("path").agg(F.max_by("op", "last_ts").alias("op"), F.max("last_ts").alias("last_ts")), "batch")
        now_ms = own.agg(F.unix_millis(F.max("last_ts"))).first()[0]
        if now_ms is not None:
            transact(spark, graph_dir, lambda at: take_in(spark, own.select("path", "op"), graph_dir, read_content, extract, version, now_ms, at))

    return debounce(events, gap, delay).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(step).trigger(**(trigger or {"availableNow": True})).start()


def take_in(spark: SparkSession, own: DataFrame, graph_dir: str, read_content: Callable, extract: Callable, version: str, now_ms: int, at: Head | None) -> Head:
    """One batch (path, op), a row per path, on the graph as of entry ``at``; see ``run_change_stream``."""
    nothing = {table: spark.createDataFrame([], schema) for table, schema in INDEX_SCHEMAS.items()}
    if at is None or get_meta(load_table(spark, graph_dir, "meta", at=at), VERSION_KEY) != version:
        graph = load_graph(spark, graph_dir, at=at)
        at = save_graph(clear_graph(graph), graph_dir, at.n_buckets if at else BUCKETS, ImportIndex(**nothing), at)
    if at.buckets("files") and not at.buckets("listing"):
        raise ValueError("a graph that is changed by a stream is saved with its index of imports (built_index)")
    stored = lambda table, buckets: load_table(spark, graph_dir, table, buckets, at)
    where = lambda paths, column: buckets_of(paths.select(F.col(column).alias("path")), graph_dir, at)

    # paths that come and go, and the folders above them
    known = stored("listing", where(own, "path")).where("not is_dir").select(F.col("entry").alias("path"))
    came = own.where("op <> 'unlink'").join(known, "path", "left_anti")
    went = own.where("op = 'unlink'").join(known, "path", "left_semi")
    counts = written(counted_listing(came).unionByName(counted_listing(went, -1)), "listing-changes")
    listed = where(counts, "entry")
    before = stored("listing", listed)
    moved = written(came_or_went(before, counts), "came-or-went")

    def listing(entries: DataFrame) -> DataFrame:
        return listing_after(stored("listing", where(entries, "entry")), counts).select("entry", "is_dir")

    # imports that try these paths, and of them those that lead elsewhere now
    asked = own.withColumn("force", F.lit(False))
    if probed := where(moved, "entry"):
        tried = written(tried_imports(stored("probes", probed), moved), "tried")
        if importers := where(tried, "path"):
            affected = written(stored("imports", importers).join(tried, ["path", "specifier"], "left_semi"), "affected")
            there = listing(affected.select(F.explode("tries").alias("entry")))
            forced = retargeted(affected, there).withColumn("force", F.lit(True))
            both = own.join(forced, "path", "full")
            asked = written(both.select("path", F.coalesce("op", F.lit("change")).alias("op"), F.coalesce("force", F.lit(False)).alias("force")), "changes")
    touched = where(asked, "path")
    parsed: list = []

    def run(sources: DataFrame):
        parsed.append(extract(sources, listing))
        return parsed[-1]

    after, statuses = _applied(load_graph(spark, graph_dir, touched, at), read_content(asked), run, version, now_ms)

    # the index of the files that were extracted or are gone
    updated = statuses.where("status = 'updated'").select("path")
    anew = written(updated.withColumn("here", F.lit(True)).unionByName(asked.where("op = 'unlink'").select("path", F.lit(False).alias("here"))), "replaced")
    old, new = stored("imports", touched), parsed[0].imports.join(anew.where("here"), "path", "left_semi").select("path", "specifier", "target", "tries")
    lost = old.join(anew, "path", "left_semi").join(new, ["path", "specifier"], "left_anti").withColumn("lost", F.lit(True))
    found = new.join(old, ["path", "specifier"], "left_anti").withColumn("lost", F.lit(False))
    changed = written(lost.unionByName(found), "changed-imports")
    less, more = probes_of(changed.where("lost")), probes_of(changed.where("not lost"))
    probed = where(probes_of(changed), "candidate")
    index = {
        "imports": (old.join(anew, "path", "left_anti").unionByName(new), touched),
        "listing": (listing_after(before, counts), listed),
        "probes": (stored("probes", probed).join(less, ["candidate", "importer", "specifier"], "left_anti").unionByName(more), probed),
    }
    return save_buckets(after, graph_dir, touched, index, at)
