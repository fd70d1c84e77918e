"""Impact and paths of many seeds on random graphs with parallel edges, against plain walks; hubs in blocks; imports as bridges."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from codeloom.operators import traverse
from codeloom.schema import EDGES, FILES, META, NODES, Graph

TYPES = ["CALLS", "REFERENCES", "EXTENDS"]


def random_graph(spark, seed, n=40, m=90):
    r = random.Random(seed)
    nodes = [(f"n{k}", f"name{k % 7}", "function", f"/f{k % 9}.ts", k, k, 0) for k in range(n)]
    edges = {(f"n{r.randrange(n)}", r.choice([f"n{r.randrange(n)}", "n0", "gone"]), r.choice(TYPES)) for _ in range(m)}
    edges |= {(f"n{k}", f"/f{r.randrange(12)}.ts", "IMPORTS") for k in range(0, n, 4)}
    files = [(f"/f{k}.ts", "h", 0) for k in range(9)]
    return Graph(spark.createDataFrame(files, FILES), spark.createDataFrame(nodes, NODES), spark.createDataFrame(sorted(edges), EDGES), spark.createDataFrame([], META)), nodes, sorted(edges)


def plain_paths(nodes, edges, seeds, depth, bridged):
    """(seed, from, type, to, depth) of each step of each simple path, and the least depths."""
    into, inside = defaultdict(list), defaultdict(list)
    for k, *_, path, _, _, _ in nodes:
        inside[path].append(k)
    for s, t, kind in edges:
        if s != t:
            into[t].append((s, kind))
            if bridged and kind == "IMPORTS":
                for k in inside[t]:
                    if k != s:
                        into[k].append((s, kind))
    known, steps, least = {k for k, *_ in nodes}, Counter(), {}

    def walk(seed, path):
        if len(path) > depth:
            return
        for s, kind in into[path[-1]]:
            if s not in path:
                if s in known and path[-1] in known:
                    steps[seed, s, kind, path[-1], len(path)] += 1
                if s in known:
                    least[seed, s] = min(least.get((seed, s), 99), len(path))
                walk(seed, [*path, s])

    for seed in seeds:
        walk(seed, [seed])
    return steps, least


@pytest.mark.parametrize("bridged", [False, True])
def test_random_graphs(spark, monkeypatch, bridged):
    for seed, hub in ((1, 20_000), (2, 3)):
        monkeypatch.setattr(traverse.hops, "__defaults__", (hub,))
        g, nodes, edges = random_graph(spark, seed)
        seeds = [*(f"n{k}" for k in range(0, 40, 3)), "gone", "/f3.ts", "absent"]
        asked = spark.createDataFrame([(x,) for x in seeds + seeds[:3]], "seed_id string")
        steps, least = plain_paths(nodes, edges, seeds, 3, bridged)
        got = traverse.explain_impact(g, asked, 3, bridge_imports=bridged).collect()
        assert {(x["seed_id"], x["id"]): x["depth"] for x in got} == least and len(got) == len(least)
        why = traverse.why_is_this_used(g, asked, 3, bridge_imports=bridged).collect()
        assert Counter((x["seed_id"], x["from_id"], x["relationship_type"], x["to_id"], x["depth"]) for x in why) == steps


def test_more_seeds_than_bits_of_a_row(spark):
    edges = [(f"b{k}", f"a{k}", "CALLS") for k in range(200)] + [("top", f"b{k}", "CALLS") for k in range(200)]
    frame = spark.createDataFrame(edges, EDGES)
    got = traverse.reached(frame, spark.createDataFrame([(f"a{k}",) for k in range(200)], "seed_id string").repartition(2)).collect()
    assert sorted(map(tuple, got)) == sorted([(f"a{k}", f"b{k}", 1) for k in range(200)] + [(f"a{k}", "top", 2) for k in range(200)])


def test_a_hub_is_dealt_into_blocks(spark):
    n = 100_000
    callers = spark.range(n).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("source_id"), F.lit("hub").alias("target_id"), F.lit("CALLS").alias("relationship_type"))
    edges = callers.unionByName(spark.createDataFrame([("hub", "base", "CALLS")], EDGES))
    found = traverse.hops(edges)
    blocks = [x["count"] for x in found.hub_pairs.groupBy("t", "block_").count().collect()]
    assert sum(blocks) == n and max(blocks) <= 1.1 * traverse.HUB_BLOCK and found.pairs.count() == 1
    got = traverse.reached(edges, spark.createDataFrame([("base",)], "seed_id string"), 2)
    assert {x["depth"]: x["count"] for x in got.groupBy("depth").count().collect()} == {1: 1, 2: n}


def test_a_level_shuffles_its_frontier_only(spark):
    g, _, _ = random_graph(spark, 3)
    found = traverse.hops(g.edges)
    frontier = spark.range(1000).select(F.col("id").alias("at")).hint("merge")
    plan = found.from_(frontier)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
