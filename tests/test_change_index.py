"""The change stream's index of imports, batch after batch, against the whole corpus parsed anew; and two writers of one graph."""

import pytest
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.operators import extract, import_index
from codeloom.schema import empty_graph
from codeloom.sources import commits, tables
from codeloom.streaming import changes

RULES = [("/p", "/p", 0, "@l/*", "lib/*"), ("/p", "/p", 1, "tool", "bin/tool")]
BATCHES = [
    {"/p/b.ts": "import './a.js';\nimport { x } from '@l/x';\nexport { t } from 'tool';", "/p/c.ts": "import { a } from './a.js';\nexport function f() { return a(); }", "/q/d.ts": "import '@l/x'; import './e';"},
    {"/p/a.ts": "export function a() {}", "/p/lib/x/index.ts": "export const x = 1;", "/p/a.js": "export function a() {}"},  # targets of b and c appear
    {"/p/lib/x.ts": "export const x = 2;", "/p/c.ts": "export const none = 1;", "/p/a.js": None, "/p/lib/x/index.ts": None, "/p/bin/tool/index.tsx": "export const t = 1;", "/q/e/z.ts": "export const z = 1;"},  # a folder appears
    {"/p/a.ts": None, "/p/lib/x.ts": None, "/q/d.ts": None, "/p/bad.ts": "function ( {"},  # all targets are gone
]


def test_targets_that_come_and_go(spark, tmp_path):
    folder, there = f"file://{tmp_path}/graph", {}
    tables.save_graph(empty_graph(spark), folder, 4)
    aliases = spark.createDataFrame(RULES, "root string, base_dir string, ord int, pattern string, replacement string")
    for k, batch in enumerate(BATCHES):
        there = {p: t for p, t in (there | batch).items() if t is not None}
        own = spark.createDataFrame([(p, "unlink" if t is None else "change") for p, t in batch.items()], "path string, op string")
        texts = spark.createDataFrame(list(there.items()) or [("", "")], "path string, content string")
        commits.transact(spark, folder, lambda at: changes.take_in(spark, own, folder, lambda df: df.join(texts, "path", "left"), lambda df, listing: extract.parse_corpus(df, listing, aliases), "1", k, at))  # noqa: B023
        now = spark.createDataFrame([(p,) for p in there], "path string")
        whole = extract.parse_corpus(texts.where("path <> ''"), paths.listing_with_dirs(now), aliases)
        rows = lambda df: sorted(map(tuple, df.collect()))
        g = tables.load_graph(spark, folder)
        assert rows(g.edges) == rows(whole.edges), k
        assert rows(g.nodes.select("id", "end_line")) == rows(whole.nodes.select("id", "end_line"))
        expected = import_index.built_index(now, whole.imports, aliases)
        for table in ("imports", "listing", "probes"):
            assert rows(tables.load_table(spark, folder, table)) == rows(getattr(expected, table)), (k, table)
    assert tables.prune_snapshots(spark, folder) > 0 and rows(tables.load_graph(spark, folder).edges) == rows(g.edges)


def test_a_batch_reads_and_writes_the_buckets_that_it_concerns(spark, tmp_path):
    folder = f"file://{tmp_path}/graph"
    aliases = spark.createDataFrame([], "base_dir string, ord int, pattern string, replacement string")
    tables.save_graph(empty_graph(spark), folder, 512)
    for k, batch in enumerate([{f"/s/f{n}.ts": f"import './f{n + 1}.js';" for n in range(60)}, {"/s/f60.ts": "export const last = 1;"}]):
        own = spark.createDataFrame([(p, "change") for p in batch], "path string, op string")
        texts = spark.createDataFrame([(p, t) for known in (BATCHES[0], batch, {"/s/f59.ts": "import './f60.js';"}) for p, t in known.items()], "path string, content string").dropDuplicates(["path"])
        at = commits.transact(spark, folder, lambda at: changes.take_in(spark, own, folder, lambda df: df.join(texts, "path", "left"), lambda df, listing: extract.parse_corpus(df, listing, aliases), "1", k, at))  # noqa: B023
    wrote = commits.entry(spark, folder, at.serial)["wrote"]
    assert len(wrote["nodes"]) == 2 and len(wrote["listing"]) <= 3 and "meta" not in wrote and "probes" not in wrote
    assert "/s/f60.ts" in {r["target_id"] for r in tables.load_graph(spark, folder).edges.collect()}


def test_two_writers(spark, tmp_path):
    folder, n = f"file://{tmp_path}/graph", 8
    files = spark.createDataFrame([(f"/f{k}.ts", "h", 0) for k in range(40)], "path string, content_hash string, indexed_at long")
    g = empty_graph(spark).with_tables(files=files)
    tables.save_graph(g, folder, n)
    bucket = {r["path"]: r["b"] for r in files.select("path", tables.bucket_of(F.col("path"), n).alias("b")).collect()}
    one = next(iter(bucket))
    same = next(p for p in bucket if p != one and bucket[p] == bucket[one])
    other = next(p for p in bucket if bucket[p] != bucket[one])

    def marked(path, at):
        part = tables.load_graph(spark, folder, [bucket[path]], at)
        return part.with_tables(files=part.files.withColumn("content_hash", F.when(F.col("path") == path, "new").otherwise(F.col("content_hash"))))

    hashes = lambda: {r["path"] for r in tables.load_graph(spark, folder).files.where("content_hash = 'new'").collect()}
    at = commits.head(spark, folder)
    tables.save_buckets(marked(one, at), folder, [bucket[one]], base=at)
    tables.save_buckets(marked(other, at), folder, [bucket[other]], base=at)  # from the same entry, of another bucket
    assert hashes() == {one, other}
    with pytest.raises(commits.Conflict):
        tables.save_buckets(marked(same, at), folder, [bucket[same]], base=at)
    starts = []

    def change(head):
        starts.append(head.serial)
        stale = at if len(starts) == 1 else head  # as if the other writers had come between
        return tables.save_buckets(marked(same, stale), folder, [bucket[same]], base=stale)

    commits.transact(spark, folder, change)
    assert hashes() == {one, other, same} and len(starts) == 2
    with pytest.raises(commits.Conflict):
        tables.save_graph(g, folder, n, base=at)
    taken = commits.serials(spark, folder)[-1]
    assert not commits._created(spark, folder, taken, {}) and commits.serials(spark, folder)[-1] == taken
