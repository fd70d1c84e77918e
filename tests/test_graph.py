"""Graph operators on seeded mini graphs."""

import pytest
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.operators import extract, facts, incremental, lookup, neighbors, overview, store, traverse
from codeloom.schema import EDGES, FILES, META, NODES, Graph
from codeloom.sources import files as sources
from codeloom.sources import tables
from codeloom.streaming import changes


def graph(spark, nodes, edges):
    rows = [(n, n, *rest) if len(rest) == 5 else (n, *rest) for n, *rest in nodes]
    made = [(r[0], r[1], r[2], r[3], r[4], r[5], r[6]) for r in rows]
    paths_ = sorted({r[3] for r in made})
    return Graph(spark.createDataFrame([(p, "h", 0) for p in paths_], FILES), spark.createDataFrame(made, NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame([], META))


def node(name, path="/a.ts", kind="function", exported=0, line=1, id_=None):
    return (id_ or name, name, kind, path, line, line + 1, exported)


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "seed_id string")


def depths(df):
    return sorted((r["seed_id"], r["id"], r["depth"]) for r in df.collect())


def test_impact_on_chain_cycle_diamond_and_self_loop(spark):
    g = graph(spark, [node(n) for n in "ABCD"], [("B", "A", "CALLS"), ("C", "B", "CALLS"), ("D", "C", "CALLS")])
    assert depths(traverse.explain_impact(g, seeds(spark, "A"))) == [("A", "B", 1), ("A", "C", 2), ("A", "D", 3)]
    assert depths(traverse.explain_impact(g, seeds(spark, "A", "C"), 2)) == [("A", "B", 1), ("A", "C", 2), ("C", "D", 1)]
    ring = g.with_tables(edges=spark.createDataFrame([("B", "A", "CALLS"), ("C", "B", "CALLS"), ("A", "C", "CALLS"), ("A", "A", "CALLS")], EDGES))
    assert depths(traverse.explain_impact(ring, seeds(spark, "A"), 10)) == [("A", "B", 1), ("A", "C", 2)]
    diamond = g.with_tables(edges=spark.createDataFrame([("B", "A", "CALLS"), ("C", "A", "CALLS"), ("D", "B", "CALLS"), ("D", "C", "CALLS")], EDGES))
    assert depths(traverse.explain_impact(diamond, seeds(spark, "A"))) == [("A", "B", 1), ("A", "C", 1), ("A", "D", 2)]
    steps = traverse.why_is_this_used(diamond, seeds(spark, "A")).collect()
    assert sorted((r["from_name"], r["depth"]) for r in steps) == [("B", 1), ("C", 1), ("D", 2), ("D", 2)]
    parallel = g.with_tables(edges=spark.createDataFrame([("B", "A", "CALLS"), ("B", "A", "REFERENCES")], EDGES))
    assert traverse.explain_impact(parallel, seeds(spark, "A")).count() == 1 and traverse.why_is_this_used(parallel, seeds(spark, "A")).count() == 2
    with pytest.raises(ValueError):
        traverse.explain_impact(g, seeds(spark, "A"), 11)


def test_lookup_and_resolution(spark):
    g = graph(spark, [node("alpha"), node("beta"), node("beta", kind="class", id_="beta2"), node("alphabetical", kind="variable")], [])
    ask = lambda *rows: spark.createDataFrame(list(rows), "request string, name string, kind string")
    found = lambda r, exact=True: sorted(x["id"] for x in lookup.find_symbol(g.nodes, r, exact).collect())
    assert found(ask(("q", "alpha", None))) == ["alpha"] and found(ask(("q", "ALPHA", None)), False) == ["alpha", "alphabetical"]
    assert found(ask(("q", "beta", "class"))) == ["beta2"] and found(ask(("q", "alpha", "interface"))) == [] and found(ask(("q", "_eta", None)), False) == ["beta", "beta2"]
    assert found(ask(("q", "%PH_b", None)), False) == ["alphabetical"] and found(ask(("q", "__", None)), False) == sorted(r["id"] for r in g.nodes.collect()) and found(ask(("q", "__ph", None), ("r", "b", "class")), False) == ["alpha", "alphabetical", "beta2"]
    assert "CartesianProduct" not in (plan := lookup.find_symbol(g.nodes, ask(("q", "get_x", None)), False)._jdf.queryExecution().toString()) and "NestedLoop" not in plan
    many = graph(spark, [node("twin", f"/{k:02}.ts", id_=f"t{k}") for k in range(25)], [])
    one = lookup.resolve_node(many.nodes, spark.createDataFrame([("q", None, "twin", None)], "request string, node_id string, name string, kind string")).first()
    assert one["n_matches"] == 25 and one["message"].endswith("(function in /19.ts), and 5 more")
    requests = spark.createDataFrame([("id", "beta", "alpha", None), ("one", None, "alpha", None), ("none", None, "zeta", None), ("empty", None, "", None), ("two", None, "beta", None)], "request string, node_id string, name string, kind string")
    got = {r["request"]: (r["status"], r["id"]) for r in lookup.resolve_node(g.nodes, requests).collect()}
    assert got == {"id": ("ok", "beta"), "one": ("ok", "alpha"), "none": ("not_found", None), "empty": ("nothing_given", None), "two": ("ambiguous", None)}
    text = spark.createDataFrame([("/f", "1\n2\n3"), ("/e", "")], "path string, content string")
    ranges = spark.createDataFrame([("a", "/f", 2, 2, 1), ("b", "/f", 9, 9, 0), ("c", "/e", 1, 1, 5)], "request string, path string, start_line int, end_line int, padding int")
    assert {r["request"]: (r["first"], r["last"], r["snippet"]) for r in lookup.snippets(text, ranges).collect()} == {"a": (1, 3, "1\n2\n3"), "b": (9, 3, ""), "c": (1, 1, "")}


def test_prefixes_are_intervals_of_sorted_names(spark, monkeypatch):
    import random
    import re

    monkeypatch.setattr(lookup, "NAME_BLOCK", 4)
    r = random.Random(7)
    names = [*{"".join(r.choices("abAB_é\U0010ffff", k=r.randint(0, 5))) for _ in range(150)}, *["same"] * 40, None]
    g = spark.createDataFrame([(f"i{k}", x) for k, x in enumerate(names)], "id string, name string")
    patterns = [*{"".join(r.choices("abA_%é\\", k=r.randint(0, 4))) for _ in range(60)}, "sa", "SAME", "same!", "", "\U0010ffff", None]
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    fits = lambda p, t: re.match("".join({"_": "(?s:.)", "%": "(?s:.*)"}.get(c, re.escape(c)) for c in low(p)), low(t))
    expected = sorted((p, f"i{k}") for p in set(patterns) - {None} for k, t in enumerate(names) if t is not None and fits(p, t))
    got = lookup.prefix_matches(g.repartition(3), spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    assert sorted(map(tuple, got.collect())) == expected


def test_neighbours_files_and_overview(spark):
    g = graph(spark, [node("A"), node("B"), node("C", "/b.ts")], [("A", "B", "CALLS"), ("C", "A", "IMPORTS"), ("A", "gone", "CALLS"), ("A", "A", "CALLS")])
    count = lambda d, types=(): neighbors.neighbor_edges(g.edges, seeds(spark, "A"), d, types).count()
    assert (count("outgoing"), count("incoming"), count("both"), count("both", ["IMPORTS"])) == (3, 2, 5, 1)
    both = neighbors.neighbor_edges(g.edges, seeds(spark, "A"))
    assert sorted(r["id"] for r in neighbors.neighbor_nodes(g.nodes, both).collect()) == ["A", "B", "C"]
    files = spark.createDataFrame([("/a.ts",), ("/b.ts",), ("/none",)], "path string")
    assert neighbors.file_edges(g.nodes, g.edges, files).count() == 4 and neighbors.file_edges(g.nodes, g.edges, files, False).count() == 2
    h = graph(spark, [node("foo"), node("bar"), node("baz", "/b.ts", exported=1), node("My", "/b.ts", "class", 1)], [("bar", "foo", "CALLS"), ("baz", "foo", "CALLS"), ("bar", "My", "CALLS")])
    assert overview.overview_counts(h).first().asDict() == {"n_files": 2, "n_nodes": 4, "n_edges": 3}
    assert [(r["name"], r["caller_count"]) for r in overview.top_called(h).collect()] == [("foo", 2), ("My", 1)]
    assert [r["name"] for r in overview.entry_points(h).collect()] == ["baz"]
    many = graph(spark, [node(f"n{k}", exported=1) for k in range(25)], [])
    assert overview.entry_points(many).count() == 20


def test_views_by_file_leave_edges_where_they_lie(spark):
    g = graph(spark, [node("A"), node("B"), node("C", "/b.ts")], [("A", "B", "CALLS"), ("C", "A", "CALLS"), ("C", "/a.ts", "IMPORTS"), ("A", "gone", "CALLS"), ("lost", "A", "CALLS")])
    laid = tables.by_file(g)
    files_ = laid.files.hint("merge")
    columns = ["source_id", "target_id", "relationship_type"]
    rows = lambda df: sorted(map(tuple, df.collect()))
    for internal in (True, False):
        assert rows(neighbors.file_edges(laid.nodes, laid.edges, laid.files, internal)) == rows(neighbors.file_edges(g.nodes, g.edges, g.files, internal))
    assert rows(neighbors.importers_of(laid.nodes, laid.edges, laid.files)) == [("/a.ts", "/b.ts")]
    gone = g.files.where("path = '/b.ts'").select("path")
    assert rows(store.delete_files(laid, gone).edges.select(*columns)) == rows(store.delete_files(g, gone).edges)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (neighbors.file_edges(laid.nodes, laid.edges, files_), neighbors.file_edges(laid.nodes, laid.edges, files_, False), store.delete_files(laid, files_.where("path > '/b'").select("path")).edges):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_store_cascade_and_integrity(spark):
    g = graph(spark, [node("A"), node("B", "/b.ts")], [("A", "gone", "CALLS"), ("B", "A", "CALLS")])
    out = store.delete_files(g, spark.createDataFrame([("/a.ts",)], "path string"))
    assert (out.files.count(), out.nodes.count(), [r["source_id"] for r in out.edges.collect()]) == (1, 1, ["B"])
    assert all(r["n"] == 0 for r in store.check_integrity(g).collect())
    broken = g.with_tables(edges=spark.createDataFrame([("lost", "A", "CALLS")], EDGES))
    assert {r["rule"] for r in store.check_integrity(broken).where("n > 0").collect()} == {"edge_without_source"}
    cleared = store.clear_graph(g.with_tables(meta=tables.upsert_meta(g.meta, {"k": ["x"]})))
    assert cleared.nodes.count() == 0 and tables.get_meta(cleared.meta, "k") == '["x"]'


def test_snapshots_and_sources(spark, tmp_path):
    g = graph(spark, [node("A")], [])
    folder = f"file://{tmp_path}/graph"
    assert tables.load_graph(spark, folder).nodes.count() == 0
    tables.save_graph(g, folder)
    tables.save_graph(store.clear_graph(g), folder)
    assert tables.load_graph(spark, folder).nodes.count() == 0
    tables.save_graph(g, folder)
    assert tables.load_graph(spark, folder).nodes.count() == 1
    for name in ("src/a.ts", "src/b.txt", "node_modules/x/c.ts", "build/d.ts"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("export const a = 1;")
    (tmp_path / "src/odd.js").write_bytes(b"// \xff\xfe\nexport const b = 1;")
    assert [(r["path"], r["content"]) for r in sources.read_source_tree(spark, str(tmp_path)).orderBy("path").collect()] == [(f"{tmp_path}/src/a.ts", "export const a = 1;"), (f"{tmp_path}/src/odd.js", "// \ufffd\ufffd\nexport const b = 1;")]
    assert (sources.name_filter(["**/*.ts", "a/*.js"]), sources.name_filter(["src/*"])) == ("*.{js,ts}", None)
    assert [r["path"] for r in sources.read_source_tree(spark, str(tmp_path), ["**/*.ts", "src/*"], ["**/node_modules/**", "**/*.txt"]).orderBy("path").collect()] == [f"{tmp_path}/{name}" for name in ("build/d.ts", "src/a.ts", "src/odd.js")]
    settings = spark.createDataFrame([("p", "/r", '{"compilerOptions": {"baseUrl": "./s", // c\n "paths": {"@b/*": ["x/*"], "@a": [], "@c": ["y", "z"]}}}'), ("q", "/r", "{bad"), ("n", "/r", '{"compilerOptions": {"paths": {"u": ["http://x"]}}}')], "project string, dir string, text string")
    assert [(r["base_dir"], r["pattern"], r["replacement"]) for r in sources.load_path_aliases(settings).orderBy("ord").collect()] == [("/r/s", "@b/*", "x/*"), ("/r/s", "@c", "y")]


SOURCES = {
    "/s/simple.ts": "export interface User { id: string }\nexport class Base { log(m: string): void { console.error(m); } }\nexport class Svc extends Base implements User {\n  constructor(private readonly r: User) { super(); }\n  create(u: User): User { this.log('x'); return u; }\n}\nexport const helper = (x: number) => x * 2;\n",
    "/s/alias.ts": "import { createUser as make } from './simple.js';\nexport function reg(n: string) { return make(n); }\n",
    "/s/again.ts": "export { a as b } from './simple.js';\nfunction q() {}\nexport { q };\nexport default class {}\n",
    "/s/inst.ts": "import { Svc } from './simple.js';\nconst s = new Svc();\nexport function go() { s.create(); new Svc(); }\nclass L { log(m) {} }\nconst l = new L();\nexport function work() { l.log(`a${l.log('}')}`); /re[/]{/.test('x'); }\n",
    "/s/broken.ts": "function ( {",
    "/s/empty.ts": "",
}


def test_aliases_belong_to_their_project(spark):
    rules = [("/a", "/a", 0, "@lib/*", "lib/*"), ("/b", "/b", 0, "@lib/*", "vendor/*"), ("/a/sub", "/a/sub", 0, "@lib/deep/*", "d/*"), ("/", "/", 1, "tool", "bin/tool.ts")]
    aliases = spark.createDataFrame(rules, "root string, base_dir string, ord int, pattern string, replacement string")
    listing = paths.listing_with_dirs(spark.createDataFrame([("/a/lib/x.ts",), ("/b/vendor/x.ts",), ("/a/sub/d/x/index.ts",), ("/bin/tool.ts",)], "path string"))
    asked = [("/a/src/m.ts", "@lib/x"), ("/b/m.ts", "@lib/x"), ("/a/sub/m.ts", "@lib/deep/x"), ("/a/sub/m.ts", "@lib/x"), ("/c/m.ts", "tool"), ("/a/m.ts", "tool"), ("/ab/m.ts", "@lib/x"), ("/b/m.ts", "@lib/y/z")]
    out = paths.resolve_imports(spark.createDataFrame(asked, "from_file string, specifier string"), listing, aliases)
    got = {(r["from_file"], r["specifier"]): r["target"] for r in out.collect()}
    assert [got[x] for x in asked] == ["/a/lib/x.ts", "/b/vendor/x.ts", "/a/sub/d/x/index.ts", "@lib/x", "/bin/tool.ts", "tool", "@lib/x", "/b/vendor/y/z"]
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_symbol_tables_fold_in_order(spark):
    text = "import { A, B as C } from './x.js';\nconst early = new Late();\nclass Late {}\nconst a = new A();\nconst late = new Late();\nconst A2 = 1;\nfunction f(p: C, q: Nothing, r: Late) {}\nconst g = (p: A) => p;\n"
    rows = extract.written_facts(spark.createDataFrame([("/s/t.ts", text)], "path string, content string"))
    targets = spark.createDataFrame([("/s/t.ts", "./x.js", "/s/x.ts")], "path string, specifier string, target string")
    got = {r["local_name"]: (r["resolved_name"], r["source_file"]) for r in extract.symbol_table(rows, targets).collect()}
    here = "/s/t.ts"
    assert got == {"A": ("A", "/s/x.ts"), "C": ("B", "/s/x.ts"), "early": ("early", here), "Late": ("Late", here), "a": ("A", "/s/x.ts"), "late": ("Late", here), "A2": ("A2", here), "f": ("f", here), "g": ("g", here), "p": ("A", "/s/x.ts"), "r": ("Late", here)}


def test_many_bindings_of_one_name(spark):
    n = 100_000
    facts_ = spark.range(n).selectExpr("'/g.ts' path", "if(id % 2 = 0, 'bind', 'param') fact", "if(id % 2 = 0, 'A', concat('p', id)) name", "if(id % 2 = 0, concat('B', id), 'A') kind", "if(id % 2 = 0, './x.js', null) specifier", "cast(id as int) ord")
    targets = spark.createDataFrame([("/g.ts", "./x.js", "/x.ts")], "path string, specifier string, target string")
    got = extract.symbol_table(facts_, targets)
    assert got.count() == n // 2 + 1 and got.where("local_name <> 'A' and resolved_name <> concat('B', cast(substring(local_name, 2) as int) - 1)").count() == 0


def test_paths_stop_before_a_level_too_large(spark):
    g = graph(spark, [node("A"), *(node(f"n{k}") for k in range(30))], [(f"n{k}", "A", "CALLS") for k in range(30)])
    with pytest.raises(RuntimeError, match="up to 30 paths"):
        traverse.why_is_this_used(g, seeds(spark, "A"), max_rows=20)
    for max_depth in (0, 11):
        with pytest.raises(ValueError):
            traverse.why_is_this_used(g, seeds(spark, "A"), max_depth)


def test_extraction(spark):
    corpus = spark.createDataFrame(list(SOURCES.items()), "path string, content string")
    aliases = spark.createDataFrame([], "base_dir string, ord int, pattern string, replacement string")
    nodes, edges, errors = extract.parse_corpus(corpus, paths.listing_with_dirs(corpus), aliases)
    names = {(r["file_path"][3:-3], r["name"], r["kind"], r["exported"]) for r in nodes.collect()}
    assert [r["path"] for r in errors.collect()] == ["/s/broken.ts"]
    assert ("again", "q", "function", 1) in names and ("again", "again", "namespace", 0) in names and ("inst", "s", "variable", 0) in names
    label = {r["id"]: f"{r['file_path'][3:-3]}.{r['name']}" for r in nodes.collect()}
    got = {(label.get(r["source_id"]), label.get(r["target_id"], r["target_id"][:9]), r["relationship_type"]) for r in edges.collect()}
    assert {("simple.Svc", "simple.Base", "EXTENDS"), ("simple.create", "simple.log", "CALLS"), ("inst.go", "simple.create", "CALLS"), ("inst.work", "inst.log", "CALLS"), ("again.again", "/s/simple", "IMPORTS"), ("simple.create", "simple.User", "REFERENCES"), ("simple.constructor", "simple.User", "REFERENCES")} <= got
    assert sum(t == "EXPORTS" for *_, t in got) == 1 and sum(s == "alias.reg" and t == "CALLS" for s, _, t in got) == 1
    assert facts.file_facts("p", None)[0][1] == "error" and facts.file_facts("p", "'open")[0][1] == "error"


def test_incremental_index_and_versions(spark):
    corpus = spark.createDataFrame(list(SOURCES.items()), "path string, content string")
    aliases = spark.createDataFrame([], "base_dir string, ord int, pattern string, replacement string")
    run = lambda df: extract.parse_corpus(df, paths.listing_with_dirs(corpus), aliases)
    from codeloom.schema import empty_graph

    scan = corpus.withColumn("error", F.lit(False))
    first, statuses = incremental.index_project(empty_graph(spark), scan, run, "1", 5)
    first = Graph(*(tables.written(t, "first") for t in (first.files, first.nodes, first.edges, first.meta)))
    assert incremental.index_stats(statuses).first().asDict() == {"files_scanned": 6, "files_updated": 5, "files_skipped": 0, "files_errored": 1}
    assert incremental.index_stats(incremental.index_project(first, scan, run, "1", 6)[1]).first()["files_skipped"] == 5
    assert incremental.index_stats(incremental.index_project(first, scan, run, "2", 6)[1]).first()["files_updated"] == 5
    assert store.check_integrity(first).where("n > 0").count() == 0


def test_ripple_and_streaming_debounce(spark, tmp_path):
    importers = [node(f"f{k}", f"/i{k}.ts") for k in range(25)]
    g = graph(spark, [node("base", "/base.ts"), node("b2", "/b2.ts"), *importers], [(f"f{k}", "/base.ts", "IMPORTS") for k in range(25)] + [("f0", "/b2.ts", "IMPORTS"), ("f1", "/b2.ts", "IMPORTS")])
    changed = spark.createDataFrame([("/base.ts",), ("/b2.ts",)], "path string")
    assert sorted(r["importer"] for r in changes.ripple_targets(g, changed).collect()) == ["/i0.ts", "/i1.ts"]
    assert [(r["path"], r["n_importers"]) for r in changes.ripple_skipped(g, changed).collect()] == [("/base.ts", 25)]
    schema = "path string, op string, event_ts timestamp, event_id long"
    rows = [("/a.ts", "add", "2024-01-01 00:00:00", 1), ("/a.ts", "unlink", "2024-01-01 00:00:05", 2), ("/a.ts", "add", "2024-01-01 00:01:00", 3), ("/b.ts", "change", "2024-01-01 00:00:02", 4), ("/z.ts", "change", "2025-01-01 00:00:00", 9)]
    made = spark.createDataFrame(rows, "path string, op string, t string, event_id long").selectExpr("path", "op", "cast(t as timestamp) event_ts", "event_id")
    made.write.parquet(f"{tmp_path}/events")
    batch = {(r["path"], r["op"], r["n_events"]) for r in changes.debounce(made, "10 seconds").collect()}
    stream = changes.debounce(spark.readStream.schema(schema).parquet(f"{tmp_path}/events"), "10 seconds")
    for _ in range(2):  # the watermark of the first run closes the sessions in the second
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r["path"], r["op"], r["n_events"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {x for x in batch if x[0] != "/z.ts"} == {("/a.ts", "unlink", 2), ("/a.ts", "add", 1), ("/b.ts", "change", 1)}
    kept = changes.filter_changes(spark.createDataFrame([("/a/b.ts",), ("/a/.git/b.ts",), ("/a/dist/b.ts",), ("/a/b.md",)], "path string"), ["**/*.ts"], ["**/dist/**"])
    assert [r["path"] for r in kept.collect()] == ["/a/b.ts"]


def test_change_stream_re_indexes(spark, tmp_path):
    from codeloom.schema import empty_graph

    folder = f"file://{tmp_path}/graph"
    tables.save_graph(empty_graph(spark), folder)
    texts = spark.createDataFrame([("/s/a.ts", "export const a = 1;"), ("/s/b.ts", "import './a.js';")], "path string, content string")
    rows = [("/s/a.ts", "add", "2024-01-01 00:00:00", 1), ("/s/b.ts", "add", "2024-01-01 00:00:01", 2), ("/z.ts", "unlink", "2025-01-01 00:00:00", 9)]
    spark.createDataFrame(rows, "path string, op string, t string, event_id long").selectExpr("path", "op", "cast(t as timestamp) event_ts", "event_id").write.parquet(f"{tmp_path}/events")
    aliases = spark.createDataFrame([], "base_dir string, ord int, pattern string, replacement string")
    run = lambda df, listing: extract.parse_corpus(df, listing, aliases)
    for _ in range(2):
        events = spark.readStream.schema("path string, op string, event_ts timestamp, event_id long").parquet(f"{tmp_path}/events")
        q = changes.run_change_stream(spark, events, folder, f"{tmp_path}/check", lambda df: df.join(texts, "path", "left"), run, "1", "10 seconds")
        q.awaitTermination()
    g = tables.load_graph(spark, folder)
    assert sorted(r["path"] for r in g.files.collect()) == ["/s/a.ts", "/s/b.ts"]
    assert [r["importer"] for r in neighbors.importers_of(g.nodes, g.edges, g.files).collect()] == ["/s/b.ts"]
    # a change of a.ts comes with a file that its importer's specifier names first: the importer's own text is the same, its edge is not
    more = spark.createDataFrame([("/s/a.ts", "export const a = 2;"), ("/s/a.js", "exports.a = 1;")], "path string, content string")
    both = texts.where("path = '/s/b.ts'").unionByName(more)
    later = [("/s/a.ts", "change", "2025-02-01 00:00:00", 11), ("/s/a.js", "add", "2025-02-01 00:00:01", 12), ("/z.ts", "unlink", "2026-01-01 00:00:00", 19)]
    spark.createDataFrame(later, "path string, op string, t string, event_id long").selectExpr("path", "op", "cast(t as timestamp) event_ts", "event_id").write.mode("append").parquet(f"{tmp_path}/events")
    for _ in range(2):
        events = spark.readStream.schema("path string, op string, event_ts timestamp, event_id long").parquet(f"{tmp_path}/events")
        changes.run_change_stream(spark, events, folder, f"{tmp_path}/check", lambda df: df.join(both, "path", "left"), run, "1", "10 seconds").awaitTermination()
    g = tables.load_graph(spark, folder)
    assert [r["target_id"] for r in g.edges.where("relationship_type = 'IMPORTS'").collect()] == ["/s/a.js"]


def test_snapshots_by_bucket(spark, tmp_path):
    folder = f"file://{tmp_path}/graph"
    paths_ = [f"/f{k}.ts" for k in range(6)]
    g = graph(spark, [node(f"n{k}", p) for k, p in enumerate(paths_)], [("n0", "n1", "CALLS"), ("n1", "n2", "CALLS"), ("stray", "n1", "CALLS")])
    tables.save_graph(g, folder, 4)
    ids = lambda t: sorted(r["id"] for r in t.nodes.collect())
    ends = lambda t: sorted((r["source_id"], r["target_id"]) for r in t.edges.collect())
    assert ids(tables.load_graph(spark, folder)) == ids(g) and ends(tables.load_graph(spark, folder)) == ends(g)
    gone = spark.createDataFrame([(paths_[1],)], "path string")
    touched = tables.buckets_of(gone, folder)
    part = tables.load_graph(spark, folder, touched)
    tables.save_buckets(store.delete_files(part, gone), folder, touched)
    after = tables.load_graph(spark, folder)
    expected = store.delete_files(g, gone)
    assert len(touched) == 1 and ids(after) == ids(expected) and ends(after) == ends(expected) and tables.prune_snapshots(spark, folder) == 0
    tables.save_graph(after, folder, 2)  # a whole snapshot, of another number of buckets: nothing of the two before counts
    assert tables.prune_snapshots(spark, folder) == 2 and ids(tables.load_graph(spark, folder)) == ids(expected)
    assert [r["id"] for r in lookup.in_reading_order(expected.nodes).collect()] == ids(expected)
    line = overview.summary_line(overview.overview_counts(expected)).first()["summary"]
    assert line.startswith("Codebase has ") and " 5 symbol(s), and 2 edge(s)." in line
