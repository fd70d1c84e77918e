"""From facts to nodes and edges: symbol tables, import targets and ids are joins on (path, name)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cache, cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.paths import Listing, first_existing, resolve_imports, stem, with_tries
from codeloom.operators.facts import scan_facts
from codeloom.schema import EDGE_COLUMNS, NODE_COLUMNS, RELATIONSHIPS, node_id
from codeloom.sources.tables import written


def declarations(facts: DataFrame) -> DataFrame:
    """(id, path, name, kind, ord, owner, exported, start, end); a name marked by a later ``export {..}`` is exported."""
    own = facts.where("fact = 'decl'").withColumn("id", node_id(F.col("path"), F.col("name"), F.col("kind")))
    marks = facts.where("fact = 'mark'").select("path", "name", F.col("ord").alias("mark_"))
    latest = own.join(marks, ["path", "name"]).where("ord < mark_").groupBy("path", "name", "mark_").agg(F.max("ord").alias("ord"))
    marked = latest.select("path", "ord", F.lit(1).alias("marked_")).distinct()
    out = own.join(marked, ["path", "ord"], "left")
    return out.select("id", "path", "name", "kind", "ord", "owner", F.greatest("exported", F.coalesce("marked_", F.lit(0))).alias("exported"), "start", "end")


def file_nodes(facts: DataFrame) -> DataFrame:
    """A namespace node, before all others, for each file that imports or re-exports something."""
    needed = facts.where("fact = 'import'").select("path").distinct()
    name = stem(F.col("path"))
    return facts.where("fact = 'end'").join(needed, "path", "left_semi").select(node_id(F.col("path"), name, F.lit("namespace")).alias("id"), name.alias("name"), F.lit("namespace").alias("kind"), F.col("path").alias("file_path"), F.lit(1).alias("start_line"), F.col("end").alias("end_line"), F.lit(0).alias("exported"), F.lit(-1).alias("ord"))


def extract_nodes(facts: DataFrame, decls: DataFrame | None = None) -> DataFrame:
    """Node columns and ord, one row per id: of equal ids in a file the first emitted wins. ``decls``: the declarations, where they are made already."""
    rows = (decls or declarations(facts)).select("id", "name", "kind", F.col("path").alias("file_path"), F.col("start").alias("start_line"), F.col("end").alias("end_line"), "exported", "ord").unionByName(file_nodes(facts))
    rest = [c for c in rows.columns if c not in ("id", "ord")]
    first = rows.groupBy("id").agg(F.min(F.struct("ord", *rest)).alias("r"))
    return first.select("id", *(F.col(f"r.{c}") for c in NODE_COLUMNS if c != "id"), "r.ord")


def import_targets(facts: DataFrame, listing: Listing, aliases: DataFrame) -> DataFrame:
    """(path, specifier, target) of every specifier that a file names; with a function as ``listing``, tries as well."""
    named = facts.where("specifier is not null and fact in ('import', 'export_from', 'bind')").select(F.col("path").alias("from_file"), "specifier").distinct()
    if not callable(listing):
        return resolve_imports(named, listing, aliases).select(F.col("from_file").alias("path"), "specifier", "target")
    asked = written(with_tries(named, aliases), "tries")
    there = listing(asked.select(F.explode("tries").alias("entry")))
    return first_existing(asked, there).select(F.col("from_file").alias("path"), "specifier", "target", "tries")


def _latest_before(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows (path, name, kind, ord) -> (path, name, ord, meaning) of the latest of ``entries`` (path, name, ord, meaning) of the name ``kind`` before each.

    An as-of merge: entries and askers of a name lie in one order, and each asker sees the last entry before it.
    """
    asked = rows.select("path", F.col("kind").alias("key"), "ord", "name", F.lit(None).cast(entries.schema["meaning"].dataType).alias("meaning"))
    told = entries.select("path", F.col("name").alias("key"), "ord", F.lit(None).cast("string").alias("name"), "meaning")
    earlier = Window.partitionBy("path", "key").orderBy("ord").rangeBetween(Window.unboundedPreceding, -1)
    merged = asked.unionByName(told).withColumn("meaning", F.last("meaning", ignorenulls=True).over(earlier))
    return merged.where("name is not null and meaning is not null").select("path", "name", "ord", "meaning")


def symbol_table(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """(path, local_name, resolved_name, source_file): what each top-level name of a file means; a later entry overwrites an earlier one.

    Imports, then declarations, then typed parameters. A variable that holds a new instance, and a parameter of a class type, mean what
    the class's name means at that point; without such a meaning the variable means itself and the parameter nothing.
    """
    rows = facts.where("fact in ('bind', 'local', 'param')").select("path", "fact", "name", "kind", "specifier", "ord")
    meaning = lambda resolved, specifier: F.struct(resolved.alias("resolved"), specifier.alias("specifier")).alias("meaning")
    nothing = F.lit(None).cast("string")
    bound = rows.where("fact = 'bind'").select("path", "name", "ord", meaning(F.col("kind"), F.col("specifier")))
    local = rows.where("fact = 'local'").select("path", "name", "kind", "ord", meaning(F.col("name"), nothing))
    made = _latest_before(local.where("kind is not null"), bound.unionByName(local.drop("kind"))).withColumnRenamed("meaning", "made")
    held = local.join(made, ["path", "name", "ord"], "left").select("path", "name", "ord", F.coalesce("made", "meaning").alias("meaning"))
    entries = bound.unionByName(held)
    entries = entries.unionByName(_latest_before(rows.where("fact = 'param'"), entries))
    last = entries.groupBy("path", "name").agg(F.max_by("meaning", "ord").alias("m")).select("path", F.col("name").alias("local_name"), F.col("m.resolved").alias("resolved_name"), F.col("m.specifier").alias("specifier"))
    return last.join(targets, ["path", "specifier"], "left").select("path", "local_name", "resolved_name", F.coalesce("target", "path").alias("source_file"))


def extract_edges(facts: DataFrame, targets: DataFrame | None, kinds: Sequence[str] = RELATIONSHIPS, decls: Callable[[], DataFrame] | None = None, distinct: bool = True) -> DataFrame:
    """Edge columns, distinct; of these relationships only, which leaves out what others are made of. CONTAINS alone needs no ``targets``.

    ``decls`` gives the declarations, written. Not ``distinct``: edges as they are emitted, with the file of their source (source_file).
    """
    path, name = F.col("path"), F.col("name")
    decls = decls or cache(lambda: written(declarations(facts), "declarations"))
    symbols = cache(lambda: written(symbol_table(facts, targets), "symbols"))
    owners = cache(lambda: decls().select("path", F.col("ord").alias("owner"), F.col("id").alias("owner_id")))
    local = cache(lambda: decls().groupBy("path", "name").agg(F.max_by(F.struct("id", "kind"), "ord").alias("l")).select("path", F.col("name").alias("resolved_name"), F.col("l.id").alias("local_id"), F.col("l.kind").alias("local_kind")))

    def edge(df: DataFrame, source: Column, target: Column, kind: str) -> DataFrame:
        return df.select(source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("relationship_type"), *([] if distinct else [path.alias("source_file")]))

    def of(fact: str) -> DataFrame:
        return facts.where(F.col("fact") == fact).drop("ord").join(owners(), ["path", "owner"])

    def known(df: DataFrame, column: str, how: str = "inner") -> DataFrame:
        return df.join(symbols().withColumnRenamed("local_name", column), ["path", column], how)

    def named(fact: str) -> DataFrame:
        return facts.where(F.col("fact") == fact).select("path", "name", "specifier").join(targets, ["path", "specifier"])

    def heritage(kind: str, relationship: str) -> list[DataFrame]:
        rows = known(of("heritage").where(F.col("kind") == kind), "name", "left")
        return [edge(rows, F.col("owner_id"), node_id(F.coalesce("source_file", "path"), F.coalesce("resolved_name", "name"), F.col("kind")), relationship)]

    def calls() -> list[DataFrame]:
        rows = of("call").drop("start", "end", "exported")
        direct = known(rows.where("kind = 'direct'"), "name").join(local(), ["path", "resolved_name"], "left")
        member = known(rows.where("kind = 'member'"), "specifier")
        classes = symbols().select("path", F.col("local_name").alias("resolved_name"), F.col("source_file").alias("class_file"))
        mapped = member.where("source_file = path and resolved_name <> specifier").join(classes, ["path", "resolved_name"], "left")
        method = F.lit("method")
        return [
            edge(direct, F.col("owner_id"), node_id(F.col("source_file"), F.col("resolved_name"), F.coalesce("local_kind", F.lit("function"))), "CALLS"),
            edge(rows.where("kind = 'this'").join(local().withColumnRenamed("resolved_name", "name"), ["path", "name"]), F.col("owner_id"), F.col("local_id"), "CALLS"),
            edge(member.where("source_file <> path"), F.col("owner_id"), node_id(F.col("source_file"), name, method), "CALLS"),
            edge(mapped, F.col("owner_id"), node_id(F.coalesce("class_file", "path"), name, method), "CALLS"),
        ]

    def references() -> list[DataFrame]:
        rows = known(of("typeref"), "name").join(local(), ["path", "resolved_name"], "left")
        return [edge(rows, F.col("owner_id"), F.coalesce("local_id", node_id(F.col("source_file"), F.col("resolved_name"), F.lit("interface"))), "REFERENCES")]

    file_id = node_id(path, stem(path), F.lit("namespace"))
    made = {
        "IMPORTS": lambda: [edge(named("import"), file_id, F.col("target"), "IMPORTS")],
        "EXPORTS": lambda: [edge(named("export_from"), file_id, node_id(F.col("target"), name, F.lit("unknown")), "EXPORTS")],
        "CONTAINS": lambda: [edge(decls().join(owners(), ["path", "owner"]), F.col("owner_id"), F.col("id"), "CONTAINS")],
        "EXTENDS": lambda: heritage("class", "EXTENDS"),
        "IMPLEMENTS": lambda: heritage("interface", "IMPLEMENTS"),
        "CALLS": calls,
        "REFERENCES": references,
    }
    parts = [part for kind in kinds for part in made[kind]()]
    out = reduce(DataFrame.unionByName, parts)
    return out.dropDuplicates(list(EDGE_COLUMNS)) if distinct else out


def written_facts(files: DataFrame) -> DataFrame:
    """The facts of sources, scanned once and written; what is derived from them reads these rows."""
    return written(scan_facts(files), "facts")


class Parsed:
    """What sources hold: nodes (with ord), edges, errors (path) and imports (path, specifier, target[, tries]), each made when it is asked for, from facts that are written once."""

    def __init__(self, facts: DataFrame, listing: Listing, aliases: DataFrame):
        self.facts, self._listing, self._aliases = facts, listing, aliases

    def __iter__(self) -> Iterator[DataFrame]:
        return iter((self.nodes, self.edges, self.errors))

    @cached_property
    def declarations(self) -> DataFrame:
        return written(declarations(self.facts), "declarations")

    @cached_property
    def nodes(self) -> DataFrame:
        return extract_nodes(self.facts)

    @cached_property
    def imports(self) -> DataFrame:
        return written(import_targets(self.facts, self._listing, self._aliases), "imports")

    @cached_property
    def edges(self) -> DataFrame:
        return self.edges_of(RELATIONSHIPS)

    def edges_of(self, kinds: Sequence[str], distinct: bool = True) -> DataFrame:
        """The edges of some relationships, without what others need."""
        targets = None if set(kinds) <= {"CONTAINS"} else self.imports.select("path", "specifier", "target")
        return extract_edges(self.facts, targets, kinds, lambda: self.declarations, distinct)

    def for_index(self) -> tuple[DataFrame, Callable[[], DataFrame], DataFrame]:
        """Nodes and errors, and a function for edges as they are emitted, which ``add_edges`` tells apart. Declarations are made once for nodes and edges."""
        return extract_nodes(self.facts, self.declarations), lambda: self.edges_of(RELATIONSHIPS, False), self.errors

    @cached_property
    def errors(self) -> DataFrame:
        return self.facts.where("fact = 'error'").select("path")


def parse_corpus(files: DataFrame, listing: Listing, aliases: DataFrame) -> Parsed:
    """Sources (path, content) -> their nodes, edges, errors and imports. Facts are written once: the scan of texts is the costly step."""
    return Parsed(written_facts(files), listing, aliases)
