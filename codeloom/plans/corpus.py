"""Queries over a corpus of sources that Spark writes from the part table, with the expected rows by key arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.paths import listing_with_dirs
from codeloom.operators import extract, incremental
from codeloom.schema import RELATIONSHIPS, Graph, empty_graph
from codeloom.sources.tables import written
from codeloom.sources.testgraph import table


#: Sources that a task makes and scans.
SOURCES_PER_TASK = 20_000


def spread(spark: SparkSession, sf_dir: str, name: str, key: str) -> tuple[DataFrame, int]:
    """The keys of a table, dealt to tasks of even numbers whatever the table's splits are, and how many there are. Texts are made where they are scanned."""
    keys = table(spark, sf_dir, name).select(key)
    n = keys.count()
    return keys.repartition(max(spark.sparkContext.defaultParallelism, math.ceil(n / SOURCES_PER_TASK))), n


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a source for each part p, with imports of the parts a and b; every 97th does not scan."""
    part, n = spread(spark, sf_dir, "part", "p_partkey")
    p = F.col("p_partkey")
    s, a, b = p.cast("string"), ((p * 7 + 3) % n).cast("string"), ((p * 11 + 1) % n).cast("string")
    lines = [
        ("import { f_", a, " as imported, K_", a, " as Base } from './p_", a, ".js';"),
        ("import type { T_", b, " } from '@lib/p_", b, "';"),
        ("export interface T_", s, " { id: string; next(x: T_", b, "): T_", b, "; }"),
        ("export class K_", s, " extends Base implements T_", s, " {"),
        ("  constructor() { super(); } // it's"),
        ("  run(x: T_", s, "): T_", b, " { this.step(); return imported(`a ${x} }`); }"),
        ("  step() {}"),
        ("}"),
        ("export function f_", s, "(svc: K_", s, ") { svc.run(1); return imported(2); }"),
        ("export const g_", s, " = (x: number) => f_", s, "(x);"),
        (F.when(p % 5 == 0, F.concat(F.lit("export { f_"), a, F.lit(" as again } from './p_"), a, F.lit(".js';"))).otherwise(""),),
        (F.when(p % 7 == 0, F.concat(F.lit("export const lazy_"), s, F.lit(" = async () => import('./p_"), b, F.lit(".js');"))).otherwise(""),),
        (F.when(p % 97 == 0, F.lit("function broken( {")).otherwise("const q = /[}'\"]/;"),),
    ]
    text = lambda line: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in ((line,) if isinstance(line, str) else line)))
    return part.select(F.concat(F.lit("/c/p_"), s, F.lit(".ts")).alias("path"), F.concat_ws("\n", *map(text, lines)).alias("content"))


def more_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a source for each supplier s, with what those of the parts lack: enums, aliases, new instances, later and default exports."""
    n = table(spark, sf_dir, "part").count()
    k = F.col("s_suppkey")
    s, a, b = k.cast("string"), ((k * 3 + 1) % n).cast("string"), ((k * 5 + 2) % n).cast("string")
    lines = [
        ("import { K_", a, " } from './p_", a, ".js';"),
        ("import * as tools from '@lib/p_", b, "';"),
        ("enum Mode_", s, " { On, Off }"),
        ("export type Alias_", s, " = K_", a, " | Mode_", s, ";"),
        ("const made = new K_", a, "();"),
        ("function inner_", s, "(m: K_", a, ") { made.run(1); m.step(); return tools.f(2); }"),
        ("export { inner_", s, ", made };"),
        ("export default function main_", s, "() { return inner_", s, "(made); }"),
    ]
    text = lambda line: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in line))
    return spread(spark, sf_dir, "supplier", "s_suppkey")[0].select(F.concat(F.lit("/c/s_"), s, F.lit(".ts")).alias("path"), F.concat_ws("\n", *map(text, lines)).alias("content"))


def module_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a module source for each supplier m, .mts or .cts, that imports another by its .mjs or .cjs name and exports all of a part."""
    (suppliers, n), n_parts = spread(spark, sf_dir, "supplier", "s_suppkey"), table(spark, sf_dir, "part").count()
    m, t, c = F.col("s_suppkey"), (F.col("s_suppkey") * 3 + 1) % n, (F.col("s_suppkey") * 13 + 4) % n_parts
    either = lambda key, even, odd: F.when(key % 2 == 0, even).otherwise(odd)
    lines = [
        F.concat(F.lit("import { v_"), t.cast("string"), F.lit(" } from './m_"), t.cast("string"), either(t, ".mjs';", ".cjs';")),
        F.concat(F.lit("export * from './p_"), c.cast("string"), F.lit(".js';")),
        F.concat(F.lit("export const v_"), m.cast("string"), F.lit(" = 1;")),
    ]
    return suppliers.select(F.concat(F.lit("/c/m_"), m.cast("string"), either(m, ".mts", ".cts")).alias("path"), F.concat_ws("\n", *lines).alias("content"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).unionByName(more_sources(spark, sf_dir)).unionByName(module_sources(spark, sf_dir))


def surroundings(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    rule = {"root": "/", "base_dir": "/", "ord": 0, "pattern": "@lib/*", "replacement": "./c/*"}
    aliases = spark.range(0, 1, 1, 1).select(*(F.lit(value).alias(name) for name, value in rule.items()))  # without Python tasks
    return listing_with_dirs(files), aliases


def parsed(spark: SparkSession, sf_dir: str) -> extract.Parsed:
    files = sources(spark, sf_dir)
    return extract.parse_corpus(files, *surroundings(spark, files))


def extract_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).nodes.drop("ord")


def extract_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).edges


def edges_of(kind: str):
    return lambda spark, sf_dir: parsed(spark, sf_dir).edges_of([kind])


def symbol_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = sources(spark, sf_dir)
    rows = extract.written_facts(files)
    return extract.symbol_table(rows, extract.import_targets(rows, *surroundings(spark, files)))


def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).errors


def index_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index all but every third source, then the whole with every second one changed: (path, status, n_nodes)."""
    files = corpus(spark, sf_dir)
    around = surroundings(spark, files)
    number = F.regexp_extract("path", "([0-9]+)", 1).cast("long")
    scan = files.withColumn("error", F.lit(False))
    run = lambda g, s, now: incremental.index_project(g, s, lambda df: extract.parse_corpus(df, *around), "1", now)
    first = run(empty_graph(spark), scan.where(number % 3 != 0), 1)[0]
    first = Graph(*(written(t, "indexed") for t in (first.files, first.nodes, first.edges, first.meta)))
    changed = scan.withColumn("content", F.when(number % 2 == 0, F.concat("content", F.lit("\nexport const added = 1;"))).otherwise(F.col("content")))
    graph, statuses = run(first, changed, 2)
    count = graph.nodes.groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("n_nodes"))
    return statuses.select("path", "status").join(count, "path", "left").select("path", "status", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"))


BASE = """
WITH c AS (SELECT p_partkey AS p, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) AS a, (p_partkey * 11 + 1) % (SELECT count(*) FROM part) AS b FROM part),
x AS (SELECT *, '/c/p_' || p || '.ts' AS f, '/c/p_' || a || '.ts' AS fa, '/c/p_' || b || '.ts' AS fb FROM c WHERE p % 97 <> 0),
i AS (SELECT *, sha256(f || ':p_' || p || ':namespace') AS file, sha256(f || ':T_' || p || ':interface') AS t, sha256(f || ':K_' || p || ':class') AS k, sha256(f || ':constructor:constructor') AS co,
  sha256(f || ':run:method') AS run, sha256(f || ':step:method') AS step, sha256(f || ':f_' || p || ':function') AS fn, sha256(f || ':g_' || p || ':arrow_function') AS g, sha256(f || ':lazy_' || p || ':arrow_function') AS lazy,
  sha256(fa || ':f_' || a || ':function') AS ifn, sha256(fb || ':T_' || b || ':interface') AS it FROM x),
y AS (SELECT s_suppkey AS s, (s_suppkey * 3 + 1) % (SELECT count(*) FROM part) AS a, (s_suppkey * 5 + 2) % (SELECT count(*) FROM part) AS b FROM supplier),
z AS (SELECT *, '/c/s_' || s || '.ts' AS f, '/c/p_' || a || '.ts' AS fa, '/c/p_' || b || '.ts' AS fb FROM y),
j AS (SELECT *, sha256(f || ':s_' || s || ':namespace') AS file, sha256(f || ':Mode_' || s || ':enum') AS mode, sha256(f || ':Alias_' || s || ':type_alias') AS al, sha256(f || ':inner_' || s || ':function') AS inn, sha256(f || ':main_' || s || ':function') AS main_, sha256(f || ':made:variable') AS made FROM z),
v AS (SELECT s_suppkey AS m, (s_suppkey * 3 + 1) % (SELECT count(*) FROM supplier) AS t, (s_suppkey * 13 + 4) % (SELECT count(*) FROM part) AS c FROM supplier),
w AS (SELECT *, '/c/m_' || m || CASE WHEN m % 2 = 0 THEN '.mts' ELSE '.cts' END AS f, '/c/m_' || t || CASE WHEN t % 2 = 0 THEN '.mts' ELSE '.cts' END AS ft, '/c/p_' || c || '.ts' AS fc FROM v),
u AS (SELECT *, sha256(f || ':m_' || m || ':namespace') AS file, sha256(f || ':v_' || m || ':variable') AS val FROM w)
"""
NODES = BASE + """
SELECT file AS id, 'p_' || p AS name, 'namespace' AS kind, f AS file_path, 1 AS start_line, 13 AS end_line, 0 AS exported FROM i
UNION ALL SELECT t, 'T_' || p, 'interface', f, 3, 3, 1 FROM i UNION ALL SELECT k, 'K_' || p, 'class', f, 4, 8, 1 FROM i
UNION ALL SELECT co, 'constructor', 'constructor', f, 5, 5, 0 FROM i UNION ALL SELECT run, 'run', 'method', f, 6, 6, 0 FROM i UNION ALL SELECT step, 'step', 'method', f, 7, 7, 0 FROM i
UNION ALL SELECT fn, 'f_' || p, 'function', f, 9, 9, 1 FROM i UNION ALL SELECT g, 'g_' || p, 'arrow_function', f, 10, 10, 1 FROM i
UNION ALL SELECT lazy, 'lazy_' || p, 'arrow_function', f, 12, 12, 1 FROM i WHERE p % 7 = 0 UNION ALL SELECT sha256(f || ':q:variable'), 'q', 'variable', f, 13, 13, 0 FROM i
UNION ALL SELECT file, 's_' || s, 'namespace', f, 1, 8, 0 FROM j UNION ALL SELECT mode, 'Mode_' || s, 'enum', f, 3, 3, 0 FROM j UNION ALL SELECT al, 'Alias_' || s, 'type_alias', f, 4, 4, 1 FROM j
UNION ALL SELECT made, 'made', 'variable', f, 5, 5, 1 FROM j UNION ALL SELECT inn, 'inner_' || s, 'function', f, 6, 6, 1 FROM j UNION ALL SELECT main_, 'main_' || s, 'function', f, 8, 8, 1 FROM j
UNION ALL SELECT file, 'm_' || m, 'namespace', f, 1, 3, 0 FROM u UNION ALL SELECT val, 'v_' || m, 'variable', f, 3, 3, 1 FROM u
"""
EDGES = {
    "IMPORTS": "SELECT file AS source_id, fa AS target_id FROM i UNION SELECT file, fb FROM i UNION SELECT file, fa FROM j UNION SELECT file, fb FROM j UNION SELECT file, ft FROM u UNION SELECT file, fc FROM u",
    "EXPORTS": "SELECT file AS source_id, sha256(fa || ':f_' || a || ':unknown') AS target_id FROM i WHERE p % 5 = 0",
    "CONTAINS": "SELECT k AS source_id, unnest([co, run, step]) AS target_id FROM i",
    "EXTENDS": "SELECT k AS source_id, sha256(fa || ':K_' || a || ':class') AS target_id FROM i",
    "IMPLEMENTS": "SELECT k AS source_id, t AS target_id FROM i",
    "CALLS": "SELECT run AS source_id, unnest([step, ifn]) AS target_id FROM i UNION SELECT fn, unnest([run, ifn]) FROM i UNION SELECT g, fn FROM i UNION SELECT inn, unnest([sha256(fa || ':run:method'), sha256(fa || ':step:method'), sha256(fb || ':f:method')]) FROM j UNION SELECT main_, inn FROM j",
    "REFERENCES": "SELECT t AS source_id, it AS target_id FROM i UNION SELECT run, unnest([t, it]) FROM i UNION SELECT fn, k FROM i UNION SELECT al, unnest([mode, sha256(fa || ':K_' || a || ':interface')]) FROM j UNION SELECT inn, sha256(fa || ':K_' || a || ':interface') FROM j",
}
TYPED = {kind: f"SELECT source_id, target_id, '{kind}' AS relationship_type FROM ({sql})" for kind, sql in EDGES.items()}
SYMBOLS = BASE + """
, s AS (SELECT f AS path, 1 AS o, 'imported' AS local_name, 'f_' || a AS resolved_name, fa AS source_file FROM i UNION ALL SELECT f, 1, 'Base', 'K_' || a, fa FROM i UNION ALL SELECT f, 1, 'T_' || b, 'T_' || b, fb FROM i
UNION ALL SELECT f, 2, unnest(['T_' || p, 'K_' || p, 'f_' || p, 'g_' || p, 'q']), unnest(['T_' || p, 'K_' || p, 'f_' || p, 'g_' || p, 'q']), f FROM i UNION ALL SELECT f, 2, 'lazy_' || p, 'lazy_' || p, f FROM i WHERE p % 7 = 0
UNION ALL SELECT f, 3, 'svc', 'K_' || p, f FROM i
UNION ALL SELECT f, 1, unnest(['K_' || a, 'made', 'm']), 'K_' || a, fa FROM j UNION ALL SELECT f, 1, 'tools', '*', fb FROM j UNION ALL SELECT f, 2, unnest(['Mode_' || s, 'Alias_' || s, 'inner_' || s]), unnest(['Mode_' || s, 'Alias_' || s, 'inner_' || s]), f FROM j
UNION ALL SELECT f, 1, 'v_' || t, 'v_' || t, ft FROM u UNION ALL SELECT f, 2, 'v_' || m, 'v_' || m, f FROM u)
SELECT path, local_name, arg_max(resolved_name, o) AS resolved_name, arg_max(source_file, o) AS source_file FROM s GROUP BY 1, 2
"""
INDEXED = """
SELECT '/c/p_' || p_partkey || '.ts' AS path, CASE WHEN p_partkey % 97 = 0 THEN 'error' WHEN p_partkey % 3 = 0 OR p_partkey % 2 = 0 THEN 'updated' ELSE 'skipped' END AS status,
CASE WHEN p_partkey % 97 = 0 THEN 0 ELSE 9 + (p_partkey % 7 = 0)::INT + (p_partkey % 2 = 0)::INT END::BIGINT AS n_nodes FROM part
"""


def queries() -> dict:
    own = {f.__name__: f for f in (extract_nodes, extract_edges, symbol_table, parse_errors, index_project)}
    return own | {f"extract_edges_{kind.lower()}": edges_of(kind) for kind in RELATIONSHIPS}


def oracle_sql() -> dict[str, str]:
    own = {"extract_nodes": NODES, "extract_edges": BASE + " UNION ALL ".join(TYPED.values()), "symbol_table": SYMBOLS, "parse_errors": "SELECT '/c/p_' || p_partkey || '.ts' AS path FROM part WHERE p_partkey % 97 = 0", "index_project": INDEXED}
    return own | {f"extract_edges_{kind.lower()}": BASE + TYPED[kind] for kind in RELATIONSHIPS}
