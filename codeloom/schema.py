"""The graph's tables, their schemas and closed domains, and the identity of a symbol."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, content_hash string, indexed_at long"
NODES = "id string, name string, kind string, file_path string, start_line int, end_line int, exported int"
EDGES = "source_id string, target_id string, relationship_type string"
META = "key string, value string"
SCHEMAS = {"files": FILES, "nodes": NODES, "edges": EDGES, "meta": META}
# what change streams keep besides: specifiers of files, where they lead and what they try in order, counted existing paths, and what is tried by path
INDEX_SCHEMAS = {"imports": "path string, specifier string, target string, tries array<string>", "listing": "entry string, is_dir boolean, n long", "probes": "candidate string, rank int, importer string, specifier string"}

# The closed domains of two columns.
KINDS = ("function", "class", "interface", "type_alias", "enum", "namespace", "method", "constructor", "arrow_function", "variable")
RELATIONSHIPS = ("IMPORTS", "EXPORTS", "CALLS", "EXTENDS", "IMPLEMENTS", "CONTAINS", "REFERENCES")

NODE_COLUMNS = ("id", "name", "kind", "file_path", "start_line", "end_line", "exported")
EDGE_COLUMNS = ("source_id", "target_id", "relationship_type")
#: Columns that edges may have: what the ids of their ends are the digests of.
EDGE_TEXTS = ("source_text", "target_text")


@dataclass(frozen=True)
class Graph:
    files: DataFrame
    nodes: DataFrame
    edges: DataFrame
    meta: DataFrame

    def with_tables(self, **tables: DataFrame) -> Graph:
        return replace(self, **tables)


class LateGraph:
    """A graph whose edges are made when they are asked for."""

    def __init__(self, files: DataFrame, nodes: DataFrame, meta: DataFrame, make_edges: Callable[[], DataFrame]):
        self.files, self.nodes, self.meta, self._make_edges = files, nodes, meta, make_edges

    @cached_property
    def edges(self) -> DataFrame:
        return self._make_edges()

    def with_tables(self, **tables: DataFrame) -> Graph | LateGraph:
        parts = {name: tables[name] if name in tables else getattr(self, name) for name in ("files", "nodes", "meta")}
        return Graph(**parts, edges=tables["edges"]) if "edges" in tables else LateGraph(**parts, make_edges=lambda: self.edges)


@dataclass(frozen=True)
class ImportIndex:
    imports: DataFrame
    listing: DataFrame
    probes: DataFrame


def node_text(file_path: Column, name: Column, kind: Column) -> Column:
    """What the id of a symbol is the digest of."""
    return F.concat_ws(":", file_path, name, kind)


def node_id(file_path: Column, name: Column, kind: Column) -> Column:
    return F.sha2(node_text(file_path, name, kind), 256)


def packed(name: str) -> Column:
    """An id in bytes under its own name, to be shuffled: half as many behind a one for lower-case hex digits, as of digests, else its text behind a zero."""
    id_ = F.col(name)
    return F.when(F.lower(F.hex(F.unhex(id_))) == id_, F.concat(F.lit(b"\1"), F.unhex(id_))).otherwise(F.concat(F.lit(b"\0"), id_.cast("binary"))).alias(name)


def unpacked(name: str) -> Column:
    rest = F.substring(F.col(name), 2, 1 << 30)
    return F.when(F.substring(F.col(name), 1, 1) == F.lit(b"\1"), F.lower(F.hex(rest))).otherwise(rest.cast("string")).alias(name)


#: Ids and the columns in which ``light`` has them in bytes.
LIGHT = {"id": "id_", "source_id": "source_", "target_id": "target_"}
#: In place of the bytes of an id that is the digest of a text in its row, as it is or behind the file of the same end.
BY_TEXT, IN_FILE = b"\2", b"\3"


def light(rows: DataFrame) -> DataFrame:
    """Nodes or edges as they travel and are stored: an id goes if it is the digest of a text in its row, else it is ``packed``.

    A node's text is made from its columns. Edges may have source_text and target_text: what their ids are the digests of, null where that is not known.
    Of a text that begins with the file of its end (source_file, target_file) the rest stays.
    """
    first, last = [], []
    for name in (c for c in LIGHT if c in rows.columns):
        if name == "id":
            known = F.col(name).eqNullSafe(node_id(F.col("file_path"), F.col("name"), F.col("kind"))) if {"file_path", "name", "kind"} <= set(rows.columns) else F.lit(False)
            first.append(F.when(known, F.lit(BY_TEXT)).otherwise(packed(name)).alias(LIGHT[name]))
            continue
        text, file = (name.replace("_id", x) for x in ("_text", "_file"))
        if text not in rows.columns:
            first.append(packed(name).alias(LIGHT[name]))
            continue
        inside = F.coalesce(F.startswith(F.col(text), F.concat(file, F.lit(":"))), F.lit(False)) if file in rows.columns else F.lit(False)
        first.append(F.when(inside, F.lit(IN_FILE)).when(F.col(text).isNotNull(), F.lit(BY_TEXT)).otherwise(packed(name)).alias(LIGHT[name]))
        last.append(F.when(inside, F.substr(F.col(text), F.length(file) + 2)).otherwise(F.col(text)).alias(text) if file in rows.columns else F.col(text))
    texts = [name.replace("_id", "_text") for name in LIGHT]
    return rows.select(*first, *(c for c in rows.columns if c not in LIGHT and c not in texts), *last)


def whole(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """These columns of ``light`` rows, with their ids and texts again."""

    def text_of(name: str) -> Column | None:
        if name == "id":
            return node_text(F.col("file_path"), F.col("name"), F.col("kind")) if {"file_path", "name", "kind"} <= set(rows.columns) else None
        text, file = (name.replace("_id", x) for x in ("_text", "_file"))
        if text not in rows.columns or file not in rows.columns:
            return F.col(text) if text in rows.columns else None
        return F.when(F.col(LIGHT[name]) == F.lit(IN_FILE), F.concat(file, F.lit(":"), text)).otherwise(F.col(text))

    def again(name: str) -> Column:
        id_ = name.replace("_text", "_id")
        if LIGHT.get(id_) not in rows.columns:
            return F.col(name)
        text, short = text_of(id_), LIGHT[id_]
        if name != id_:
            return text.alias(name)
        made = unpacked(short) if text is None else F.when(F.col(short).isin(BY_TEXT, IN_FILE), F.sha2(text, 256)).otherwise(unpacked(short))
        return made.alias(name)

    return rows.select(*map(again, columns))


def edge_hash() -> tuple[Column, Column]:
    """Two 64-bit hashes of an edge's columns: no two of 10^9 edges share both, but for one chance in 10^20. An id is itself a hash."""
    return F.xxhash64(F.lit(0), *EDGE_COLUMNS).alias("hash_"), F.xxhash64(*EDGE_COLUMNS, F.lit(1)).alias("hash2_")


def nothing(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, in a way that the optimizer sees: joins with them are left out."""
    columns = (column.split() for column in schema.split(", "))
    return spark.range(1).select(*(F.lit(None).cast(kind).alias(name) for name, kind in columns)).where(F.lit(False))


def empty_graph(spark: SparkSession) -> Graph:
    """Tables without rows; edges that are added to them keep the file of their source, where it is known."""
    return Graph(**{name: nothing(spark, schema + (", source_file string" if name == "edges" else "")) for name, schema in SCHEMAS.items()})
