"""Ids that are digests of a text in their row are neither moved nor stored."""

import hashlib
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from codeloom.operators import neighbors, store
from codeloom.plans import registry
from codeloom.schema import EDGE_COLUMNS, EDGES, NODES, empty_graph, light, node_id, whole
from codeloom.sources import tables, testgraph
from codeloom.sources.testgraph import derived_graph
from tests.test_shuffles import IDS

SMALL = "/root/testdata/sf0.001"
TEXTS = f"{EDGES}, source_text string, target_text string"
FILES = f"{TEXTS}, source_file string, target_file string"
needs_tables = pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the driver's tables")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_light_rows_come_back_as_they_were(spark):
    r = random.Random(8)
    texts = ["/src/a.ts:A:class", "/src/ü.ts:b:method", "", None]
    ends = [(x, None) for x in IDS] + [(digest(t), t) for t in texts[:3]] + [(digest(t), None) for t in texts[:3]]
    edges = [(s, t, r.choice(("CALLS", None)), st, tt) for s, st in ends for t, tt in ends]
    frame = spark.createDataFrame(edges, TEXTS)
    assert rows(whole(light(frame), frame.columns)) == sorted(edges, key=repr)
    assert all(len(row["source_"]) == 1 for row in light(frame).where("source_text IS NOT NULL").collect())
    filed = [(*e, f, g) for e in edges for f, g in (("/src/a.ts", "/src/ü.ts"), (None, "/src/a.ts"), ("", "/src"), ("/src/a.ts:A", None))]
    frame = spark.createDataFrame(filed, FILES)
    assert rows(whole(light(frame), frame.columns)) == sorted(filed, key=repr)
    assert {row["source_text"] for row in light(frame).where("source_file = '/src/a.ts' AND source_text LIKE '%A%'").collect()} == {"A:class"}
    plain = frame.select("source_id", "target_id", "relationship_type")
    assert rows(whole(light(plain), plain.columns)) == rows(plain)
    parts = [("/src/a.ts", "A", "class"), ("/src/a.ts", "A", None), (None, None, None), ("/src/a.ts:A", "", "class")]
    nodes = [(id_, name, kind, path, 1, None, 0) for path, name, kind in parts for id_ in [*IDS, digest(":".join(x for x in (path, name, kind) if x is not None))]]
    frame = spark.createDataFrame(nodes, NODES)
    assert rows(whole(light(frame), frame.columns)) == sorted(nodes, key=repr)
    made = frame.where(F.col("id") == node_id(F.col("file_path"), F.col("name"), F.col("kind")))
    assert made.count() >= 4 and all(len(row["id_"]) == 1 for row in light(made).collect())


@needs_tables
def test_derived_edges_know_the_files_of_their_ends_and_their_texts(spark, monkeypatch):
    g = derived_graph(spark, SMALL)
    homes = {r["id"]: r["file_path"] for r in g.nodes.collect()}
    edges = g.edges.collect()
    assert all(e["source_id"] == digest(e["source_text"]) and homes[e["source_id"]] == e["source_file"] and homes.get(e["target_id"]) == e["target_file"] for e in edges)
    assert all(e["target_id"] == digest(e["target_text"]) for e in edges if e["target_text"] is not None) and {e["relationship_type"] for e in edges if e["target_text"] is None} == {"IMPORTS"}
    monkeypatch.setattr(testgraph, "FEW_NAMES", 0)  # as with many suppliers
    assert rows(derived_graph(spark, SMALL).edges) == rows(g.edges)


@needs_tables
def test_cross_file_edges_are_told_apart_where_they_lie(spark):
    g = derived_graph(spark, SMALL)
    paths = g.files.where("path LIKE '/src/nation_1%' OR path LIKE '/src/B%'").select("path")
    for asked in (g.files, paths):
        got = neighbors.file_edges(g.nodes, g.edges, asked, False, send_few=True)
        assert rows(got) == rows(neighbors.file_edges(g.nodes, g.edges.drop("target_file"), asked, False)) and got.count()
        assert "LeftAnti" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_lines_without_a_part_still_refer_to_their_supplier(spark, tmp_path):
    tables = {
        "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", [(1, "C1", 0, 1.0, "S")]),
        "orders": ("o_orderkey long, o_custkey long", [(1, 1), (2, 9)]),
        "part": ("p_partkey long, p_brand string, p_size int", [(0, "B#1", 1), (3, "nation_0", 1), (3, "nation_0", 1)]),
        "supplier": ("s_suppkey long, s_name string", [(0, "S0"), (5, "S5")]),
        "nation": ("n_nationkey int", [(0,)]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long", [(1, 7, 5), (1, None, 5), (1, 3, 8), (1, 3, None), (2, 3, 5), (None, 3, 5)]),
    }
    for name, (schema, values) in tables.items():
        spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    g = derived_graph(spark, str(tmp_path))
    used = g.edges.where("source_text LIKE '%:order_1:method'").select("source_text", "target_text", "relationship_type")
    order = "/src/nation_0.ts:order_1:method"
    assert rows(used) == sorted([(order, "/src/suppliers.ts:S5:interface", "REFERENCES"), (order, "/src/nation_0.ts:part_3:function", "CALLS")], key=repr)
    cross = neighbors.file_edges(g.nodes, g.edges, g.files, False, send_few=True).select("target_id")
    assert digest("/src/nation_0.ts:part_3:function") not in {r["target_id"] for r in cross.collect()}  # a part in the file of its caller


@needs_tables
def test_a_graph_by_file_holds_texts_and_is_read_without_a_shuffle(spark):
    g = derived_graph(spark, SMALL)
    before = {name: spark.conf.get(name) for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    for name, value in zip(before, ("-1", "10000")):
        spark.conf.set(name, value)
    try:
        laid = tables.by_file(g)
        assert rows(laid.edges) == rows(g.edges) and rows(laid.nodes) == rows(g.nodes) and rows(laid.files) == rows(g.files)
        cross = neighbors.file_edges(laid.nodes, laid.edges, laid.files.hint("merge"), False)
        assert "Exchange" not in cross._jdf.queryExecution().executedPlan().toString()
        assert rows(cross) == rows(neighbors.file_edges(g.nodes, g.edges.drop("target_file"), g.files, False))
        (stored,) = {str(Path(f).parent) for f in laid.edges.inputFiles()}
        kept = spark.read.parquet(stored)
        assert kept.where("source_ = X'03'").count() == kept.count() and "source_id" not in kept.columns
        homes = kept.select("source_file", F.input_file_name().alias("at")).groupBy("source_file").agg(F.countDistinct("at").alias("n"))
        assert homes.agg(F.max("n")).first()[0] > 1  # a large file's edges are written by several tasks
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_spelt_edges_are_told_apart_by_their_texts(spark):
    r = random.Random(9)
    ends = [(digest(t), t) for t in ("/a.ts:A:class", "/a.ts:b:method", "/b.ts:C:class", "")] + [(x, None) for x in ("/a.ts", "pkg-é", "", None)]
    pick = lambda: (r.choice(ends), r.choice(ends), r.choice(("CALLS", "IMPORTS", None)))
    row = lambda e: (e[0][0], e[1][0], e[2], e[0][1], e[1][1])
    edges, new = sorted({pick() for _ in range(60)}, key=repr), [pick() for _ in range(120)]
    frame, more = (spark.createDataFrame(list(map(row, part)), TEXTS) for part in (edges, new))
    got = store.add_edges(frame, more, spelt=True)
    want = sorted({row(e)[:3] for e in [*edges, *new]}, key=repr)
    assert rows(got) == want and len(want) > len(edges)
    assert rows(store.add_edges(frame, more.where("relationship_type = 'CALLS'"), spelt=True)) == sorted({row(e)[:3] for e in edges} | {row(e)[:3] for e in new if e[2] == "CALLS"}, key=repr)
    homed = [df.withColumn("source_file", F.coalesce(F.split("source_text", ":")[0], F.lit("?"))) for df in (frame, more)]
    assert rows(store.add_edges(*homed, spelt=True)) == sorted({(*row(e)[:3], "?" if e[0][1] is None else e[0][1].split(":")[0]) for e in [*edges, *new]}, key=repr)
    plan = store.add_edges(frame, more, spelt=True)._jdf.queryExecution().executedPlan().toString()
    assert "xxhash64" not in plan and plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition") <= 2  # one for types, one for edges


@needs_tables
def test_added_edges_of_the_query_move_no_ids(spark):
    out = registry.queries()["add_edges"](spark, SMALL)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    moved = [line for line in plan.splitlines() if "RepartitionByExpression" in line or "Join LeftAnti" in line]
    assert len(moved) == 1 and "hash_" not in plan
    g = derived_graph(spark, SMALL)
    calls = g.edges.where("relationship_type = 'CALLS'").select("source_id", "target_id", "relationship_type")
    turned = calls.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "relationship_type")
    assert rows(out) == rows(store.add_edges(g.edges.select(*calls.columns), turned.unionByName(calls)))


@needs_tables
def test_snapshots_hold_texts_and_give_edges_with_their_files(spark, tmp_path):
    g, folder = derived_graph(spark, SMALL), f"file://{tmp_path}/graph"
    tables.save_graph(g, folder, 4)
    kept = spark.read.parquet(f"{folder}/snapshot-*/edges/*")
    assert "source_id" not in kept.columns and kept.where("length(source_) + length(target_) = 2").count() == kept.where("target_text IS NOT NULL").count() > 0
    assert spark.read.parquet(f"{folder}/snapshot-*/nodes/*").where("id_ = X'02'").count() == g.nodes.count()
    plain, stored = tables.load_graph(spark, folder), tables.load_graph(spark, folder, with_homes=True)
    assert tuple(plain.edges.columns) == EDGE_COLUMNS and rows(plain.edges) == rows(g.edges.select(*EDGE_COLUMNS)) and rows(plain.nodes) == rows(g.nodes)
    more = [*EDGE_COLUMNS, "source_file", "source_text", "target_text"]
    assert rows(stored.edges.select(*more)) == rows(g.edges.select(*more))
    gone = g.files.where("path LIKE '/src/nation_1%'").select("path")
    left = store.delete_files(stored, gone, send_few=True)
    assert "(source_id" not in left.edges._jdf.queryExecution().optimizedPlan().toString()
    assert rows(left.edges.select(*EDGE_COLUMNS)) == rows(store.delete_files(plain, gone).edges)
    tables.save_graph(left, folder, 4)
    assert rows(tables.load_graph(spark, folder).edges) == rows(left.edges.select(*EDGE_COLUMNS))


def test_snapshots_of_any_ids_and_of_before_are_read(spark, tmp_path, monkeypatch):
    nodes = [(id_, "n", "class", f"/{k % 3}.ts", 1, 2, 0) for k, id_ in enumerate([*IDS[:-1], digest("/0.ts:n:class")])]
    edges = [(a[0], b[0], "CALLS") for a in nodes for b in nodes] + [("lost", "/0.ts", "IMPORTS")]
    parts = {"nodes": spark.createDataFrame(nodes, NODES), "edges": spark.createDataFrame(edges, EDGES)}
    g = empty_graph(spark).with_tables(**parts, files=spark.createDataFrame([(f"/{k}.ts", "", 0) for k in range(3)], "path string, content_hash string, indexed_at long"))
    for name, before in (("old", True), ("new", False)):
        folder = f"file://{tmp_path}/{name}"
        with monkeypatch.context() as patch:
            if before:  # ids as they are, and no files of edges to rely on
                patch.setattr(tables, "light", lambda rows: rows)
                patch.setattr(tables, "LIGHT_SNAPSHOT", "snapshot-")
            tables.save_graph(g, folder, 4)
        found = tables.load_graph(spark, folder, with_homes=True)
        assert rows(found.edges.select(*EDGE_COLUMNS)) == sorted(edges, key=repr) and rows(found.nodes) == sorted(nodes, key=repr)
        assert ("source_file" in found.edges.columns) != before
        gone = spark.createDataFrame([("/1.ts",), ("lost",)], "path string")
        assert rows(store.delete_files(found, gone).edges.select(*EDGE_COLUMNS)) == rows(store.delete_files(g, gone).edges)


def test_shuffles_of_a_written_table_are_removed(spark):
    blocks = lambda: {str(b) for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()) if str(b).startswith("shuffle_")}
    before, setting = blocks(), spark.conf.get(tables.FREE_SHUFFLES)
    sums = spark.range(1000).groupBy(F.col("id") % 7).count()
    sums.write.format("noop").mode("overwrite").save()
    assert blocks() - before
    before = blocks()
    made = tables.written(sums, "sums")
    deadline = time.time() + 20
    while blocks() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not blocks() - before and made.count() == 7 and spark.conf.get(tables.FREE_SHUFFLES) == setting
