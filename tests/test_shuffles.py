"""What graph operators move: ids as bytes, ends that a filter lets pass, pairs that are made once."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from codeloom.functions.paths import _filter_bits, dirname, filter_blocks, listing_with_dirs, maybe_listed, normalize_path, path_filter
from codeloom.operators import extract, incremental, neighbors, store, traverse
from codeloom.plans import corpus, storage
from codeloom.schema import EDGE_COLUMNS, EDGES, empty_graph, packed, unpacked
from codeloom.sources import tables
from codeloom.sources.tables import work_dir
from codeloom.sources.testgraph import derived_graph
from tests.test_graph import graph, node, seeds

SMALL = "/root/testdata/sf0.001"
IDS = ["ab" * 32, "AB" * 32, "ab", "abc", "", "/src/a.ts", "pkg-é", "\x01ab", "0" * 64, None]


def test_ids_come_back_from_bytes_and_digests_are_half_as_long(spark):
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(IDS)], "k int, id string")
    got = frame.select("k", packed("id")).select("k", F.length("id").alias("n"), unpacked("id")).orderBy("k").collect()
    assert [r["id"] for r in got] == IDS and got[0]["n"] == 33
    assert frame.select(packed("id")).distinct().count() == len(IDS)


def test_operators_agree_with_plain_ones_on_ids_of_any_form(spark):
    r = random.Random(4)
    edges = sorted({(r.choice(IDS[:-1]), r.choice(IDS[:-1]), r.choice(("CALLS", "IMPORTS"))) for _ in range(60)})
    frame, asked = spark.createDataFrame(edges, EDGES), ["ab" * 32, "ab", "", "pkg-é", "none"]
    for direction in ("outgoing", "incoming", "both"):
        plain = [(s, *e) for s in asked for e in edges for at in ("outgoing", "incoming") if direction in (at, "both") and e[at == "incoming"] == s]
        assert sorted(map(tuple, neighbors.neighbor_edges(frame, seeds(spark, *asked), direction).collect())) == sorted(plain)
    new = edges[:10] + [(b, a, "CALLS") for a, b, _ in edges] * 2
    assert sorted(map(tuple, store.add_edges(frame, spark.createDataFrame(new, EDGES)).collect())) == sorted({*edges, *new})


def test_impact_with_paths_makes_its_pairs_once(spark, monkeypatch):
    made, plain = [], traverse.hops
    monkeypatch.setattr(traverse, "hops", lambda edges: made.append(1) or plain(edges))
    g = graph(spark, [node(n) for n in "ABC"], [("B", "A", "CALLS"), ("C", "B", "CALLS")])
    affected, paths = traverse.impact_with_paths(g, seeds(spark, "A"), 3)
    assert affected.count() == 2 and paths.count() == 2 and len(made) == 1


def test_impact_as_sql_sends_its_level_to_written_edges(spark):
    g = graph(spark, [node(n) for n in "ABCD"], [("B", "A", "CALLS"), ("B", "A", "REFERENCES"), ("C", "B", "CALLS"), ("A", "C", "CALLS"), ("A", "A", "CALLS"), ("D", "C", "CALLS")])
    traverse.impact_views(g)
    assert g.edges.inputFiles() == [] and spark.table("edges").inputFiles()
    found = spark.sql(traverse.impact_sql("A", 2))
    assert sorted((r["id"], r["depth"]) for r in found.collect()) == [("B", 1), ("C", 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [target_id" not in plan and "Aggregate [source_id" not in plan and "strategy=broadcast" in plan


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the driver's tables")
def test_derived_edges_know_their_file_and_are_not_joined_on_ids(spark):
    g = derived_graph(spark, SMALL)
    homes = {r["id"]: r["file_path"] for r in g.nodes.collect()}
    assert all(homes[r["source_id"]] == r["source_file"] for r in g.edges.collect())
    plan = neighbors.file_edges(g.nodes, g.edges, g.files)._jdf.queryExecution().optimizedPlan().toString()
    assert "(source_id" not in plan and "= source_id" not in plan


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the driver's tables")
def test_files_of_a_source_tree_are_written_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(storage, "FILES_PER_TASK", 2, raising=False)
    folder = Path(work_dir(spark).removeprefix("file:"))
    before = set(folder.glob("tree-*"))
    assert storage.source_tree(spark, SMALL).count() == 8
    (root,) = set(folder.glob("tree-*")) - before
    files = [f.name for f in root.rglob("part-*.txt")]
    assert len(files) == 10 and len({name.split("-")[1] for name in files}) > 1


def test_edges_of_one_relationship_leave_out_what_others_need(spark, monkeypatch):
    texts = {"/c/a.ts": "import { B } from './b.js';\nexport class A extends B { run(x: B): B { return this.go(x); } go(x: B) { return x; } }\nexport { B as C } from './b.js';", "/c/b.ts": "export class B {}"}
    files = spark.createDataFrame(list(texts.items()), "path string, content string")
    aliases = spark.createDataFrame([], "root string, base_dir string, ord int, pattern string, replacement string")
    parsed = extract.parse_corpus(files, listing_with_dirs(files), aliases)
    whole = sorted(map(tuple, parsed.edges.collect()))
    kinds = sorted({kind for *_, kind in whole})
    assert kinds == ["CALLS", "CONTAINS", "EXPORTS", "EXTENDS", "IMPORTS", "REFERENCES"]
    assert sorted(tuple(row) for kind in kinds for row in parsed.edges_of([kind]).collect()) == whole
    monkeypatch.setattr(extract, "import_targets", None)
    monkeypatch.setattr(extract, "symbol_table", None)
    alone = extract.parse_corpus(files, listing_with_dirs(files), aliases).edges_of(["CONTAINS"])
    assert sorted(map(tuple, alone.collect())) == [row for row in whole if row[2] == "CONTAINS"]


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the driver's tables")
def test_sources_are_dealt_evenly_whatever_the_tables_splits(spark, monkeypatch):
    monkeypatch.setattr(corpus, "SOURCES_PER_TASK", 4, raising=False)
    for made, most in ((corpus.more_sources, 4), (corpus.module_sources, 4), (corpus.corpus, 5)):
        sizes = [r["count"] for r in made(spark, SMALL).groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) <= most + 1


def test_folder_of_a_path(spark):
    paths = ["/a/b.ts", "/a", "/", "a", "", "a/b", "/a/b/", "//x", "/é/ü.ts", "/a/b\n"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", dirname(F.col("p")).alias("d")).collect()
    assert [r["d"] for r in rows] == ["/" if p.startswith("/") and p.count("/") == 1 else p.rpartition("/")[0] if "/" in p else p for p in paths]


def test_counts_of_neighbours_shuffle_no_edges(spark):
    r = random.Random(5)
    ids = IDS[:-1]
    edges = sorted({(r.choice(ids), r.choice(ids), r.choice(("CALLS", "IMPORTS"))) for _ in range(80)})
    frame, asked = spark.createDataFrame(edges, EDGES), seeds(spark, "ab" * 32, "ab", "", "pkg-é", "none")
    counts = neighbors.neighbor_counts(frame, asked)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, neighbors.neighbor_summary(neighbors.neighbor_edges(frame, asked)).collect()))
    many = spark.range(0, 20000, 1, 2).select(F.lit("A").alias("source_id"), F.lit("B").alias("target_id"), F.lit("CALLS").alias("relationship_type"))
    rows = neighbors.neighbor_counts(many, seeds(spark, "A", "B")).collect()
    assert sorted(map(tuple, rows)) == [("A", 20000, 0), ("B", 0, 20000)]
    plan = counts._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("SortMergeJoin") < plan.index("HashAggregate")  # counted before the join


def test_few_paths_are_sent_to_edges_which_stay_where_they_are(spark, monkeypatch):
    g = graph(spark, [node(n, path=f"/{n}.ts") for n in "ABC"], [("A", "B", "CALLS"), ("B", "C", "CALLS")])
    laid = g.edges.withColumn("source_file", F.concat(F.lit("/"), "source_id", F.lit(".ts")))
    paths = spark.createDataFrame([("/A.ts",), ("/A.ts",)], "path string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, wide in ((100_000, False), (0, True)):
            monkeypatch.setattr(tables, "BROADCAST_SIDE", most)
            asked = neighbors.file_edges(g.nodes, laid, paths, send_few=True)
            left = store.delete_files(g.with_tables(edges=laid), paths, send_few=True).edges
            assert [r["target_id"] for r in asked.collect()] == ["B"] and [r["target_id"] for r in left.collect()] == ["C"]
            for rows in (asked, left):
                assert ("BroadcastHashJoin" not in rows._jdf.queryExecution().sparkPlan().toString()) == wide
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stored_rows_that_no_new_one_equals_are_not_shuffled(spark):
    g = graph(spark, [node(n) for n in "ABC"], [("A", "B", "CALLS"), ("B", "C", "CALLS")])
    new = spark.createDataFrame([("A", "B", "CALLS"), ("C", "A", "CALLS"), ("C", "A", "CALLS")], EDGES)
    out = store.add_edges(g.edges, new)
    assert sorted(map(tuple, out.collect())) == [("A", "B", "CALLS"), ("B", "C", "CALLS"), ("C", "A", "CALLS")]
    assert "BroadcastHashJoin" in out._jdf.queryExecution().sparkPlan().toString()


def test_hops_of_a_traversal_are_those_within_its_reach(spark):
    names = [f"n{k}" for k in range(60)]
    r = random.Random(6)
    edges = sorted({(r.choice(names), r.choice(names[:40]), r.choice(("CALLS", "REFERENCES"))) for _ in range(150)} | {("n1", "/n2.ts", "IMPORTS"), ("n50", "/n1.ts", "IMPORTS")})
    g = graph(spark, [node(n, path=f"/{n}.ts") for n in names], edges)
    into = lambda at: [e for e in edges if e[1] in at and e[0] != e[1]]
    for bridged, query in ((False, traverse.why_is_this_used), (True, traverse.explain_impact)):
        here = {"n2", "/n2.ts"} if bridged else {"n2"}
        here |= {x for s, *_ in into(here) for x in ((s, f"/{s}.ts") if bridged else (s,))}
        found, homes = traverse.near_hops(g, seeds(spark, "n2"), 2, bridged)
        types = sum(len(row["types"]) for row in found.types().collect())
        assert len(into(here)) <= types < len(edges) and (homes is not None) == bridged
        got, want = (query(g, seeds(spark, "n2"), 2, bridge_imports=bridged, found=f) for f in (None, traverse.hops(g.edges)))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_full_filter_is_broadcast_by_blocks_of_words(spark):
    listing = spark.range(50_000).select(F.concat(F.lit("/s/f"), F.col("id").cast("string")).alias("entry"))
    tried = spark.range(60_000).select(F.concat(F.lit("/s/f"), F.col("id").cast("string")).alias("try"))
    for n_words in (1, 63, 64, 65, 1 << 12):
        words = path_filter(listing, n_words)
        own = {r["word"]: r["bits"] for r in words.collect()}
        kept = maybe_listed(tried, "try", words, n_words)
        word, bits = _filter_bits(F.col("try"), n_words)
        want = sorted(r["try"] for r in tried.select("try", word.alias("w"), bits.alias("b")).collect() if own.get(r["w"], 0) & r["b"] == r["b"])
        assert sorted(r["try"] for r in kept.collect()) == want and len(want) >= 50_000
        plan = kept._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "block_bits" in plan and filter_blocks(words).count() == -(-n_words // 64)
    some = path_filter(listing.limit(40), 1 << 12)  # words that nothing uses are left out
    assert maybe_listed(tried, "try", some, 1 << 12).count() < 100
    assert sum(len(r["block_bits"]) for r in filter_blocks(some).collect()) == some.count() <= 40


def test_an_index_makes_edges_when_they_are_asked_for_and_joins_nothing_with_an_empty_graph(spark, monkeypatch):
    texts = {"/c/a.ts": "import { B } from './b.js';\nexport class A extends B { run(x: B): B { return this.go(x); } go(x: B) { return x; } }\nexport { B as C } from './b.js';", "/c/b.ts": "export class B {}\nclass B {}"}
    files = spark.createDataFrame(list(texts.items()), "path string, content string")
    aliases = spark.createDataFrame([], "root string, base_dir string, ord int, pattern string, replacement string")
    parse = lambda df: extract.parse_corpus(df, listing_with_dirs(files), aliases)
    made, plain = [], extract.symbol_table
    monkeypatch.setattr(extract, "symbol_table", lambda *parts: made.append(1) or plain(*parts))
    first = incremental.index_project(empty_graph(spark), files.withColumn("error", F.lit(False)), parse, "1", 1)[0]
    want = parse(files)
    assert sorted(map(tuple, first.nodes.collect())) == sorted(map(tuple, want.nodes.drop("ord").collect())) and not made
    edges, homes = first.edges, {r["id"]: r["file_path"] for r in first.nodes.collect()}
    assert made and sorted(map(tuple, edges.select(*EDGE_COLUMNS).collect())) == sorted(map(tuple, want.edges.collect()))
    assert all(homes[r["source_id"]] == r["source_file"] for r in edges.collect())
    for rows in (first.nodes, first.edges):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "block_bits" not in plan and "LeftAnti" not in plan


def test_paths_are_folded_as_by_parts(spark):
    def fold(base, relative):
        out = []
        for part in (relative if relative.startswith("/") else f"{base}/{relative}").split("/"):
            out = out if part in ("", ".") else out[:-1] if part == ".." else [*out, part]
        return "/" + "/".join(out)

    r = random.Random(7)
    pairs = [(r.choice(("/", "/c", "c/d", "", "/c/../d", "/.x")), "/".join(r.choice(("", ".", "..", "...", ".a", "b.", "é", "b\n")) for _ in range(r.randrange(1, 6)))) for _ in range(400)]
    rows = spark.createDataFrame(pairs, "b string, r string").select("b", "r", normalize_path(F.col("b"), F.col("r")).alias("p")).collect()
    assert [row["p"] for row in rows] == [fold(row["b"], row["r"]) for row in rows]
