"""Reverse reachability and dependency paths for many seeds at once, by level-synchronous joins on 64-bit keys."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import maybe_listed, path_filter
from codeloom.schema import NODE_COLUMNS, Graph
from codeloom.sources.tables import bucketed, written


# Bounds and default of a traversal's depth.
LEAST_DEPTH, MOST_DEPTH, DEFAULT_DEPTH = 1, 10, 5


def check_depth(max_depth: int) -> int:
    if not LEAST_DEPTH <= max_depth <= MOST_DEPTH:
        raise ValueError(f"max_depth lies between {LEAST_DEPTH} and {MOST_DEPTH}")
    return max_depth


def checked_depths(requests: DataFrame) -> DataFrame:
    """Requests (request, max_depth or null) -> (request, max_depth, status): the default depth for null; out_of_range and null outside the bounds, else ok."""
    depth = F.coalesce("max_depth", F.lit(DEFAULT_DEPTH))
    fits = depth.between(LEAST_DEPTH, MOST_DEPTH)
    return requests.select("request", F.when(fits, depth).alias("max_depth"), F.when(fits, "ok").otherwise("out_of_range").alias("status"))


#: Callers of one target in a task: the adjacency of a target with more of them, a hub, is dealt into blocks of about so many.
HUB_BLOCK = 20_000
#: Hubs up to which their numbers of blocks are broadcast.
BROADCAST_HUBS = 100_000


@dataclass(frozen=True)
class Hops:
    """Distinct pairs of an edge's ends under 64-bit keys, as a table bucketed by the target, so a level of a traversal shuffles its frontier only."""

    key: Callable[[Column], Column]
    pairs: DataFrame  # (t, s, types: of parallel edges, m: their number)
    hubs: DataFrame | None  # (t, blocks)
    hub_pairs: DataFrame | None  # (t, block_, s, types, m)

    def from_(self, frontier: DataFrame) -> DataFrame:
        """Rows with a key ``at`` -> a row for each pair whose target it is, with s and m."""
        out = frontier.join(self.pairs.drop("types"), F.col("at") == F.col("t")).drop("t")
        if self.hubs is None:
            return out
        dealt = frontier.join(self.hubs, F.col("at") == F.col("t")).withColumn("block_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("t", "blocks")
        wide = dealt.join(self.hub_pairs.drop("types"), (F.col("at") == F.col("t")) & (dealt["block_"] == self.hub_pairs["block_"])).drop("t", "block_")
        return out.unionByName(wide)

    def types(self) -> DataFrame:
        """(t, s, types) of all pairs."""
        out = self.pairs.select("t", "s", "types")
        return out if self.hub_pairs is None else out.unionByName(self.hub_pairs.select("t", "s", "types"))


def hops(edges: DataFrame, hub_block: int = HUB_BLOCK, *, near: Callable | None = None) -> Hops:
    """Ids become 64-bit hashes whose seed is moved on until no two ids of the edges share one; self-loops are left out.

    ``near``: from the keys of edges (t, s, relationship_type, t2, s2), the function of keys and that of second hashes, those of the edges that are
    needed, and further ids (k, a) that must not share a key with theirs.
    """
    ends = edges.where("source_id <> target_id")
    kind = F.col("relationship_type") if "relationship_type" in edges.columns else F.lit("").alias("relationship_type")
    other = lambda c: F.xxhash64(c, F.lit(-1))
    for seed in range(8):
        key = lambda c, seed=seed: F.xxhash64(F.lit(seed), c)
        raw = written(ends.select(key(F.col("target_id")).alias("t"), key(F.col("source_id")).alias("s"), kind, other(F.col("target_id")).alias("t2"), other(F.col("source_id")).alias("s2")), "keys")
        raw, more = near(raw, key, other) if near else (raw, None)
        both = raw.select(F.inline(F.array(F.struct(F.col("t").alias("k"), F.col("t2").alias("a")), F.struct(F.col("s").alias("k"), F.col("s2").alias("a")))))
        both = both if more is None else both.unionByName(more)
        if both.groupBy("k").agg(F.min("a").alias("a"), F.max("a").alias("b")).where("a <> b").isEmpty():
            break
    else:
        raise RuntimeError("no seed tells the ids apart")
    raw = raw.select("t", "s", "relationship_type")
    types = [F.collect_list("relationship_type").alias("types"), F.count(F.lit(1)).alias("m")]
    hubs = written(raw.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hub_block).select("t", F.ceil(F.col("n") / hub_block).alias("blocks")), "hubs")
    n_hubs = hubs.count()
    if not n_hubs:
        return Hops(key, bucketed(raw, "hops", ["t"], ["t", "s"], types), None, None)
    hubs = F.broadcast(hubs) if n_hubs <= BROADCAST_HUBS else hubs
    wide = raw.join(hubs, "t").withColumn("block_", F.pmod(F.xxhash64("s"), F.col("blocks")))
    return Hops(key, bucketed(raw.join(hubs, "t", "left_anti"), "hops", ["t"], ["t", "s"], types), hubs, bucketed(wide, "hub-hops", ["t", "block_"], ["t", "block_", "s"], types))


def near_hops(graph: Graph, seeds: DataFrame, max_depth: int, bridge_imports: bool = False) -> tuple[Hops, DataFrame | None]:
    """The hops that a traversal from ``seeds`` may follow in ``max_depth`` steps, and with ``bridge_imports`` the homes of nodes.

    Keys of edges are read once a step and meet a broadcast filter of what is reached so far, so only edges that lead to it (and the few that the filter
    does not rule out) are shuffled, told apart and bucketed. A full filter lets all pass, with equal results.
    """
    homes = []

    def merged(*words: DataFrame) -> DataFrame:
        return written(reduce(DataFrame.unionByName, words).groupBy("word").agg(F.bit_or("bits").alias("bits")), "reached-words")

    def with_homes(words: DataFrame) -> DataFrame:
        return merged(words, path_filter(maybe_listed(homes[-1], "at", words).select(F.col("path").alias("entry")))) if bridge_imports else words

    def near(raw: DataFrame, key: Callable[[Column], Column], other: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
        homes.append(_homes(graph, key) if bridge_imports else None)
        words = with_homes(merged(path_filter(seeds.select(key(F.col("seed_id")).alias("entry")))))
        for _ in range(max_depth - 1):
            words = with_homes(merged(words, path_filter(maybe_listed(raw, "t", words).select(F.col("s").alias("entry")))))
        own = written(maybe_listed(raw, "t", words), "near-keys")
        ends = merged(words, path_filter(own.select(F.col("s").alias("entry"))))
        return own, maybe_listed(graph.nodes.select(key(F.col("id")).alias("k"), other(F.col("id")).alias("a")), "k", ends)

    return hops(graph.edges, near=near), homes[-1]


def _levels(found: Hops, seeds: DataFrame, max_depth: int, homes: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(at, block, bits, depth) of what is reached, and (seed_id, block, bit) of the seeds: 64 seeds share a row of a node.

    ``homes`` (at, path: keys): a reached node reaches its path in no step, so that edges to the path are followed too.
    """
    marks = seeds.select("seed_id").distinct().withColumn("n", F.monotonically_increasing_id())
    marks = written(marks.select("seed_id", F.shiftright("n", 6).alias("block"), F.col("n").bitwiseAND(F.lit(63)).cast("int").alias("bit")), "seeds")
    merged = lambda rows: rows.groupBy("at", "block").agg(F.bit_or("bits").alias("bits"))

    def fresh(rows: DataFrame, seen: DataFrame | None) -> DataFrame:
        rows = merged(rows)
        if seen is None:
            return rows
        old = merged(seen).withColumnRenamed("bits", "old")
        left = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long"))))
        return rows.join(old, ["at", "block"], "left").select("at", "block", left.alias("bits")).where("bits <> 0")

    def with_paths(rows: DataFrame, seen: DataFrame | None) -> DataFrame:
        if homes is None:
            return rows
        rows = written(rows, "level-nodes")
        return rows.unionByName(fresh(rows.join(homes, "at").select(F.col("path").alias("at"), "block", "bits"), seen))

    one = F.expr("shiftleft(1L, bit)")
    start = marks.select(found.key(F.col("seed_id")).alias("at"), "block", one.alias("bits"))
    level = written(with_paths(merged(start), None).withColumn("depth", F.lit(0)), "level-0")
    seen = level
    for depth in range(1, max_depth + 1):
        ahead = found.from_(level.select("at", "block", "bits")).select(F.col("s").alias("at"), "block", "bits")
        level = written(with_paths(fresh(ahead, seen), seen).withColumn("depth", F.lit(depth)), f"level-{depth}")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen.where("depth > 0"), marks


def _pairs(levels: DataFrame, marks: DataFrame) -> DataFrame:
    """(seed_id, at, depth)."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("bit_get", F.col("bits"), k) == 1)
    return levels.select("at", "block", F.explode(bits).alias("bit"), "depth").join(marks, ["block", "bit"]).select("seed_id", "at", "depth")


def reached(edges: DataFrame, seeds: DataFrame, max_depth: int = 5) -> DataFrame:
    """Seeds (seed_id) -> (seed_id, id, depth): what reaches the seed along edges, with the least number of steps, the seed left out.

    A shortest walk repeats no node, so breadth-first levels give the depth over simple paths. A node carries its seeds as bits, 64 to a row,
    and what was seen is taken away before the next level; hubs are dealt into blocks. Pairs of seed and node are made last.
    """
    check_depth(max_depth)
    found = hops(edges)
    names = edges.select(F.col("source_id").alias("id")).distinct().withColumn("at", found.key(F.col("id")))
    return _pairs(*_levels(found, seeds, max_depth, None)).join(names, "at").select("seed_id", "id", "depth")


def _homes(graph: Graph, key: Callable[[Column], Column]) -> DataFrame:
    """(at, path): keys of the nodes of files that are imported, and of these files."""
    imported = graph.edges.where("relationship_type = 'IMPORTS'").select(F.col("target_id").alias("file_path")).distinct()
    return written(graph.nodes.join(imported, "file_path", "left_semi").select(key(F.col("id")).alias("at"), key(F.col("file_path")).alias("path")), "homes")


def explain_impact(graph: Graph, seeds: DataFrame, max_depth: int = 5, bridge_imports: bool = False, found: Hops | None = None) -> DataFrame:
    """Seeds (seed_id) -> (seed_id, node columns, depth) of every existing node that depends on the seed.

    Imports lead to paths, so by default they end a way. With ``bridge_imports`` an import of a file is a step from the importer to each node of that file.
    """
    check_depth(max_depth)
    found, homes = (found, _homes(graph, found.key) if bridge_imports else None) if found else near_hops(graph, seeds, max_depth, bridge_imports)
    pairs = _pairs(*_levels(found, seeds, max_depth, homes))
    return pairs.join(graph.nodes.withColumn("at", found.key(F.col("id"))), "at").select("seed_id", *NODE_COLUMNS, "depth")


def why_is_this_used(graph: Graph, seeds: DataFrame, max_depth: int = 5, max_rows: int = 50_000_000, bridge_imports: bool = False, found: Hops | None = None) -> DataFrame:
    """Seeds (seed_id) -> a row for each step of each simple reverse path: both ends, the relationship and the depth.

    Parallel edges multiply; rows repeat as often as paths do. A level that may have more than ``max_rows`` rows raises an error before it is made; none is cut.
    A step holds its parent step, its node and 64 bits of the nodes on its path: a node whose bit is not set is new to the path, and the
    few others are looked for up the parents. Parallel edges are one step with a multiplicity until the end.
    With ``bridge_imports`` an import of a file is a step to each node of that file.
    """
    check_depth(max_depth)
    found, homes = (found, _homes(graph, found.key) if bridge_imports else None) if found else near_hops(graph, seeds, max_depth, bridge_imports)
    bit = lambda at: F.expr(f"shiftleft(1L, cast({at} & 63 as int))")
    begin = seeds.select("seed_id").distinct().withColumn("at", found.key(F.col("seed_id")))
    levels = [written(begin.select("seed_id", "at", F.monotonically_increasing_id().alias("step"), F.lit(None).cast("long").alias("parent"), bit("at").alias("mask"), F.lit(1).cast("long").alias("ways")), "paths-0")]
    steps = None
    for depth in range(1, max_depth + 1):
        now = levels[-1].select("seed_id", F.col("step").alias("parent"), "at", F.col("at").alias("to"), "mask", "ways")
        if homes is not None:
            now = written(now.unionByName(now.join(homes, "at").withColumn("at", F.col("path")).drop("path")), "bridged")
        _check_rows(now, found, depth, max_rows)
        ahead = found.from_(now).withColumnsRenamed({"at": "over", "s": "at"}).withColumn("step", F.monotonically_increasing_id())
        ahead = written(ahead.withColumn("known", F.col("mask").bitwiseAND(bit("at")) != 0), f"ahead-{depth}")
        twice = _on_their_path(ahead.where("known").select("step", "at", "parent"), levels)
        new = ahead.join(twice, "step", "left_anti")
        level = written(new.select("seed_id", "at", "over", "to", "step", "parent", F.col("mask").bitwiseOR(bit("at")).alias("mask"), (F.col("ways") * F.col("m")).alias("ways"), F.col("ways").alias("before")), f"paths-{depth}")
        own = level.select("seed_id", F.col("at").alias("from"), "over", "to", "before", F.lit(depth).alias("depth"))
        steps = own if steps is None else steps.unionByName(own)
        if level.isEmpty():
            break
        levels.append(level)
    # the names and types of distinct steps, of which there are fewer than paths
    times = written(steps.groupBy("seed_id", "from", "over", "to", "depth").agg(F.sum("before").alias("times")), "steps")
    ends = graph.nodes.select(found.key(F.col("id")).alias("k"), "id", "name", "kind")
    used = times.select(F.explode(F.array("from", "to")).alias("k")).distinct()
    ends = written(ends.join(used, "k", "left_semi"), "ends")
    named = lambda end: ends.select(F.col("k").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ("id", "name", "kind")))
    typed = times.join(found.types(), (F.col("over") == F.col("t")) & (F.col("from") == F.col("s"))).withColumn("relationship_type", F.explode("types"))
    rows = typed.join(named("from"), "from").join(named("to"), "to").withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return rows.select("seed_id", "from_id", "from_name", "from_kind", "relationship_type", "to_id", "to_name", "to_kind", "depth")


def _check_rows(now: DataFrame, found: Hops, depth: int, max_rows: int) -> None:
    """How many rows the next level may have, from the paths at each node and the node's degree, before any is made."""
    count = lambda n: F.sum(n.cast("decimal(38,0)"))
    at = now.groupBy("at").agg(count(F.col("ways")).alias("paths"))
    n = found.from_(at).agg(count(F.col("paths") * F.col("m"))).first()[0] or 0
    if n > max_rows:
        raise RuntimeError(f"up to {n} paths at depth {depth}; lower max_depth or raise max_rows")


def _on_their_path(asked: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Steps (step, at, parent) -> (step) of those whose node lies on the path that ends in the parent."""
    found = None
    for level in reversed(levels):
        up = level.select(F.col("step").alias("parent"), F.col("at").alias("there"), F.col("parent").alias("next"))
        met = asked.join(up, "parent")
        hit = met.where("at = there").select("step")
        found = hit if found is None else found.unionByName(hit)
        asked = met.where("at <> there").select("step", "at", F.col("next").alias("parent"))
    return found


def impact_with_paths(graph: Graph, seeds: DataFrame, max_depth: int = 5, include_paths: bool = True) -> tuple[DataFrame, DataFrame | None]:
    found = hops(graph.edges)  # both walk the same pairs
    return explain_impact(graph, seeds, max_depth, found=found), why_is_this_used(graph, seeds, max_depth, found=found) if include_paths else None


def impact_summary(seeds: DataFrame, affected: DataFrame, paths: DataFrame) -> DataFrame:
    """(seed_id, n_affected, n_path_rows), a row for each seed."""
    n = affected.groupBy("seed_id").agg(F.count(F.lit(1)).alias("n_affected"))
    m = paths.groupBy("seed_id").agg(F.count(F.lit(1)).alias("n_path_rows"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return seeds.select("seed_id").distinct().join(n, "seed_id", "left").join(m, "seed_id", "left").select("seed_id", zero("n_affected"), zero("n_path_rows"))


def impact_views(graph: Graph) -> None:
    """The views ``nodes`` and ``edges`` of ``impact_sql``. Ends of edges are written once, since each level of the query reads the view again."""
    graph.nodes.createOrReplaceTempView("nodes")
    written(graph.edges.where("source_id <> target_id").select("source_id", "target_id"), "ends").createOrReplaceTempView("edges")


def impact_sql(seed: str, max_depth: int = 5) -> str:
    """What ``explain_impact`` gives for one seed, as one query over views ``nodes`` and ``edges`` (see ``impact_views``); for few hops, as it follows all walks.

    The least length of a walk is that of a simple path, so no path is kept. Edges meet the level as they are: to tell parallel ones apart would shuffle
    them all at each level, while here the level is sent to them: Spark ends a recursion of more than a million rows (``spark.sql.cteRecursionRowLimit``) with an error.
    """
    check_depth(max_depth)
    name = "'" + seed.replace("'", "''") + "'"
    reach = f"reach(here, far) AS (SELECT {name}, 0 UNION ALL SELECT /*+ BROADCAST(reach) */ source_id, far + 1 FROM reach JOIN edges ON target_id = here WHERE source_id <> target_id AND far < {max_depth})"
    return f"WITH RECURSIVE {reach} SELECT nodes.*, depth FROM (SELECT here, min(far) AS depth FROM reach GROUP BY here) JOIN nodes ON id = here WHERE here <> {name}"


def reexport_chain(graph: Graph, files: DataFrame, max_depth: int = 5) -> DataFrame:
    """Files (path) -> (path, origin, depth): the files that its re-exports lead to, hop by hop over files that re-export."""
    where_ = graph.nodes.select("id", "file_path")
    passing = graph.edges.where("relationship_type = 'EXPORTS'").join(where_, F.col("source_id") == F.col("id"), "left_semi").select("source_id").distinct()
    imports = graph.edges.where("relationship_type = 'IMPORTS'").join(passing, "source_id", "left_semi")
    hops = imports.join(where_, F.col("source_id") == F.col("id")).select(F.col("target_id").alias("source_id"), F.col("file_path").alias("target_id"))
    return reached(hops, files.select(F.col("path").alias("seed_id")), max_depth).select(F.col("seed_id").alias("path"), F.col("id").alias("origin"), "depth")


def resolve_reexports(graph: Graph) -> DataFrame:
    """(source_id, target_id, id, name, kind): re-exported ids of unknown kind matched to the symbols of that file and name."""
    known = graph.nodes.select("id", "name", "kind", F.sha2(F.concat_ws(":", "file_path", "name", F.lit("unknown")), 256).alias("target_id"))
    return graph.edges.where("relationship_type = 'EXPORTS'").join(known, "target_id").select("source_id", "target_id", "id", "name", "kind")
