"""Exact duplicates of whole texts: length-and-hash partitions own compressed radix (Patricia) tries of full byte strings.

Each scan task first gathers equal texts in a trie of its own and hands on one row for each of them, so a text that a third of
all rows share leaves each task once. Keys that many tasks hand on are first dealt over about the square root of as many
partitions, whose tries join them again, so neither these nor the owner receive one row per task. An owner partition inserts
the byte strings into its trie; a terminal node keeps the smallest identifier, and a subtree that no longer fits in memory is
spilled and finished later.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import same, shipped, texts, written

#: Bytes that a node costs besides its label.
NODE_BYTES = 200
#: Bytes that each row costs that shares a text.
VALUE_BYTES = 150
#: Rows of one length and hash above which these are joined in a salted round before they go to their owner.
HOT_ROWS = 64
#: Memory of a task's trie, labels and nodes, before it flushes (map side) or spills (owners).
TRIE_BYTES = 48 << 20


def normalised(text: str) -> bytes:
    """UTF-8 of the text with each run of U+0020, U+0009 to U+000D as one space."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return b" " if raw else b""
    edge = b" \t\n\r\x0b\x0c"
    return b" " * (raw[0] in edge) + b" ".join(words) + b" " * (raw[-1] in edge)


@dataclass(slots=True)
class Node:
    label: bytes
    kids: dict[int, Node] = field(default_factory=dict)
    value: object = None  # set on terminals
    weight: int = 0  # bytes that the value counts
    spill: object = None  # file with what lies below


class PatriciaTrie:
    """Byte strings to values; ``merge`` joins the values of equal strings. ``limit`` bytes of memory, then subtrees spill.

    Each string that is added counts its label, node and ``value_bytes``. What stays in memory whatever the limit: the strings up to the first fork,
    so one string, with its values, and 256 single bytes.
    """

    def __init__(self, merge: Callable[[object, object], object], limit: int = TRIE_BYTES, spilling: bool = True, value_bytes: int = VALUE_BYTES):
        self.root, self.merge, self.limit, self.spilling, self.value_bytes, self.bytes = Node(b""), merge, limit, spilling, value_bytes, 0

    def add(self, key: bytes, value: object, weight: int | None = None) -> None:
        """``weight``: what the value counts, if it was joined from several already."""
        node, at, weight = self.root, 0, weight or self.value_bytes
        while True:
            if node.spill is not None:
                pickle.dump((key[at:], value, weight), node.spill)
                return
            if at == len(key):
                node.value = value if node.value is None else self.merge(node.value, value)
                node.weight += weight
                self._grow(weight)
                return
            kid = node.kids.get(key[at])
            if kid is None:
                node.kids[key[at]] = Node(key[at:], value=value, weight=weight)
                self._grow(len(key) - at + NODE_BYTES + weight)
                return
            if not key.startswith(kid.label, at):
                size = common_prefix(kid.label, key[at:])
                fork = Node(kid.label[:size], {kid.label[size]: kid})
                kid.label = kid.label[size:]
                node.kids[key[at]] = kid = fork
                self.bytes += NODE_BYTES  # no spill before the string has its place
            node, at = kid, at + len(kid.label)

    def _grow(self, size: int) -> None:
        self.bytes += size
        if self.spilling and self.bytes > self.limit:
            self._spill()

    def _walk(self, top: Node) -> Iterator[tuple[Node, bytes]]:
        """The nodes below and with ``top``, with their strings from the end of ``top``'s label on."""
        stack = [(top, b"")]
        while stack:
            node, path = stack.pop()
            yield node, path
            stack += [(kid, path + kid.label) for kid in node.kids.values()]

    def _spill(self) -> None:
        """Move the largest subtrees below the first fork, single strings too, to files until half of the limit is free.

        A file (in the task's own temp folder; gone when it is closed) holds the strings of one next byte, so fewer than the trie does.
        """
        top = self.root
        while top.value is None and len(top.kids) == 1 and next(iter(top.kids.values())).spill is None:
            top = next(iter(top.kids.values()))
        sizes = {byte: sum(len(x.label) + NODE_BYTES + x.weight for x, _ in self._walk(kid)) for byte, kid in top.kids.items() if kid.spill is None}
        for byte in sorted(sizes, key=sizes.get, reverse=True):
            if self.bytes <= self.limit // 2:
                break
            self._move(top.kids[byte])
            self.bytes -= sizes[byte] - 1 - NODE_BYTES

    def _move(self, kid: Node) -> None:
        """A subtree to a file, but for the first byte of its label."""
        out = tempfile.TemporaryFile()
        rest = kid.label[1:]
        for node, path in self._walk(kid):
            if node.spill is not None:
                node.spill.seek(0)
                for below, *held in stored(node.spill):
                    pickle.dump((rest + path + below, *held), out)
                node.spill.close()
            elif node.value is not None:
                pickle.dump((rest + path, node.value, node.weight), out)
        kid.label, kid.kids, kid.value, kid.weight, kid.spill = kid.label[:1], {}, None, 0, out

    def items(self) -> Iterator[tuple[bytes, object]]:
        """Each string once with its value; spilled subtrees one after the other, each in a trie of its own."""
        pending: list[tuple[bytes, PatriciaTrie | object]] = [(b"", self)]
        while pending:
            above, trie = pending.pop()
            if not isinstance(trie, PatriciaTrie):
                file, trie = trie, PatriciaTrie(self.merge, self.limit, self.spilling, self.value_bytes)
                file.seek(0)
                for held in stored(file):
                    trie.add(*held)
                file.close()
            for node, path in trie._walk(trie.root):
                if node.spill is not None:
                    pending.append((above + path, node.spill))
                elif node.value is not None:
                    yield above + path, node.value

    def values(self) -> Iterator[object]:
        return (value for _, value in self.items())


def common_prefix(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def stored(file) -> Iterator[tuple[bytes, object, int]]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def extended(a: list, b: list) -> list:
    """``a`` with ``b`` behind it, in place: a text that many rows share costs each of them once."""
    a.extend(b)
    return a


def _rank(doc_id, uid: int) -> tuple:
    """Order of the rows that hold a text: by doc_id, rows without one last, then by place in the table."""
    return (doc_id is None, 0 if doc_id is None else doc_id, uid)


def _gathered(docs: DataFrame, limit: int) -> DataFrame:
    """A row for each input row: (doc_id, uid, rep, sha256), where rep is the uid of the first row with that text in its task's
    trie; rep rows also have copies, n_bytes, hash and body (the normalised bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "uid", "rep", "sha256", "copies", "n_bytes", "hash", "body"]
        kinds: list = []
        trie = PatriciaTrie(extended, limit, spilling=False)

        def flush() -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            held = 0
            for body, members in trie.items():
                sha = hashlib.sha256(body).hexdigest()
                ranked = sorted(members, key=lambda x: _rank(*x))
                rep = ranked[0][1]
                rows.append((ranked[0][0], rep, rep, sha, len(ranked), len(body), xxhash.xxh64_intdigest(body) - (1 << 63), body))
                rows += [(doc_id, uid, rep, sha, None, None, None, None) for doc_id, uid in ranked[1:]]
                held += len(body)
                if held > 8 << 20 or len(rows) > 50_000:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            kinds = [batch.column(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            for doc_id, uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
                trie.add(normalised(text), [(doc_id, uid)])
                if trie.bytes > limit:
                    yield from flush()
                    trie = PatriciaTrie(trie.merge, limit, spilling=False)
        yield from flush()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), "text")
    return shipped(rows).mapInArrow(run, f"doc_id {kind}, uid long, rep long, sha256 string, copies long, n_bytes long, hash long, body binary")


def _merged(a: tuple, b: tuple) -> tuple:
    """Of (rank of the first row, copies, uids handed on) for equal texts."""
    return (min(a[0], b[0]), a[1] + b[1], extended(a[2], b[2]))


def _joined(rows: DataFrame, limit: int, salted: bool) -> DataFrame:
    """Rows (doc_id, uid, copies, n_bytes, hash, body[, salt]) dealt by length and hash, equal texts joined by each partition's trie.

    Owners (not salted) give (rep, keep_id, keep_uid, group_size) for each uid handed on; a salted round gives (rep, doc_id, uid, copies,
    n_bytes, hash, body) for each, where uid is that of the first of the joined rows, whose row alone has copies and body.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    result = f"rep long, doc_id {kind}, uid long, copies long" + (", n_bytes long, hash long, body binary" if salted else "")
    names = [c.split()[0] for c in result.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, types = PatriciaTrie(_merged, limit), []
        for batch in batches:
            types = [pa.int64(), batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: len(names)]
            for doc_id, uid, copies, body in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                trie.add(body.as_py(), (_rank(doc_id, uid), copies, [uid]))
        out: list[tuple] = []
        held = 0
        for body, ((missing, doc_id, uid), size, reps) in trie.items():
            first = (None if missing else doc_id, uid)
            if salted:
                out.append((uid, *first, size, len(body), xxhash.xxh64_intdigest(body) - (1 << 63), body))
                out += [(rep, *first, None, None, None, None) for rep in reps if rep != uid]
                held += len(body)
            else:
                out += [(rep, *first, size) for rep in reps]
            if len(out) > 50_000 or held > 8 << 20:
                yield batch_of(out, types)
                out, held = [], 0
        if out:
            yield batch_of(out, types)

    def batch_of(out: list[tuple], types: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, k) for column, k in zip(zip(*out), types)], names=names)

    dealt = rows.repartition("n_bytes", "hash", *(["salt"] if salted else [])).select("doc_id", "uid", "copies", "body")
    out = dealt.mapInArrow(run, result)
    return out if salted else out.toDF("rep", "keep_id", "keep_uid", "group_size")


def _owned(reps: DataFrame, limit: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rep rows -> (rep, keep_id, keep_uid, group_size), by the tries of the partitions that own them."""
    columns = ["doc_id", "uid", "copies", "n_bytes", "hash", "body"]
    reps = reps.select(*columns)
    hot = written(reps.groupBy("n_bytes", "hash").agg(F.count(F.lit(1)).alias("rows_")).where(F.col("rows_") > hot_rows), "hot-texts")
    if hot.isEmpty():
        return _joined(reps, limit, salted=False)
    key = ["n_bytes", "hash"]
    salts = F.ceil(F.sqrt("rows_")).cast("long")
    dealt = reps.join(hot, key).withColumn("salt", F.pmod(F.xxhash64("uid"), salts)).select(*columns, "salt")
    halfway = written(_joined(dealt, limit, salted=True), "salted-texts")
    rest = reps.join(hot, key, "left_anti").select(*columns)
    owners = written(_joined(rest.unionByName(halfway.where("copies is not null").select(*columns)), limit, salted=False), "owners")
    behind = halfway.where("copies is null").select(F.col("rep").alias("rep_"), F.col("uid").alias("via_"))
    return owners.unionByName(behind.join(owners, F.col("via_") == F.col("rep")).select(F.col("rep_").alias("rep"), "keep_id", "keep_uid", "group_size"))


def exact_groups(docs: DataFrame, limit: int = TRIE_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Texts are equal when their normalised bytes are. Of equal texts the row with the smallest doc_id is kept; of rows that
    repeat that doc_id just one; rows without doc_id come last. Null text counts as empty. An empty table gives an
    empty result; further columns are ignored.
    """
    rows = written(_gathered(docs, limit), "text-owners")
    owners = _owned(rows.where("copies is not null"), limit, hot_rows)
    members = rows.select("doc_id", "uid", "rep", "sha256")
    joined = members.join(owners, "rep")
    return joined.select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.col("sha256").alias("text_sha256"))


def op9(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per document."""
    return exact_groups(docs)


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat doc_id and text, one."""
    groups = written(exact_groups(docs), "exact-groups")
    kept = groups.where("kept").select(F.col("doc_id").alias("kept_")).distinct()
    out = docs.join(kept, same(docs["doc_id"], kept["kept_"]), "left_semi")
    repeated = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("int")).alias("k")).where("n > 1")
    if repeated.isEmpty():
        return out
    # doc_id does not tell these rows apart: decide by the text itself
    odd = repeated.select(F.col("doc_id").alias("kept_"))
    sure = out.join(odd, same(out["doc_id"], odd["kept_"]), "left_anti")
    held = groups.where("kept").select(F.col("doc_id").alias("kept_"), "text_sha256")
    normal = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " "), 256)
    sha = "sha_" + "_" * max(map(len, docs.columns))  # no column of ``docs``
    open_ = out.join(odd, same(out["doc_id"], odd["kept_"]), "left_semi").withColumn(sha, normal)
    open_ = open_.join(held, same(open_["doc_id"], held["kept_"]) & (open_[sha] == held["text_sha256"]), "left_semi").dropDuplicates(["doc_id", sha]).drop(sha)
    return sure.unionByName(open_)
