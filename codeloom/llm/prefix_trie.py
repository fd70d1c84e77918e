"""The trie of conversations' turns: every distinct sequence of first turns is a node, with its members and sums over its subtree.

Turns become 128-bit digests early, and a prefix the exclusive-or of the digests of its (place, turn) pairs, so prefixes of a very long conversation
are running sums that segments of it find apart. A count-min sketch over all prefix digests screens them: an estimate of one proves that no other
conversation has the prefix; such a tail's nodes are emitted where they are. Only prefixes that may be shared are shuffled and grouped exactly.

A node's owner is its least member. Members shrink with the depth, so a conversation owns the nodes of its path from some depth on; with that
depth each member adds its own share to a node's children, leaves and saved characters, and sums over subtrees are plain sums over members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import shipped, written

FAMILY, HEADS = 100, 6
#: Places of a conversation that are summed up in one group.
SEGMENT = 4096
#: Rows of the sketch; cells of a row: four for each prefix, a power of two up to this many (a bit each, once it is merged).
DEPTH, MAX_CELLS, BLOCK = 3, 1 << 26, 1 << 16
#: Tasks that make a sketch each, and prefixes that one adds at once.
SKETCHES, SKETCH_ROWS = 256, 1_000_000
#: Parents that are broadcast at most: those of more than 1 in so many of all prefixes.
HOT_PARENTS = 10_000
#: Bytes of joined ids in one row.
CHUNK_BYTES = 1 << 16


# --- turns and their places ----------------------------------------------------------------------------------


def placed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (c, pos from 0, hi, lo: digest of role and text, n: code points of the text).

    Turns of one number are in the order of role, then text. Rows are dealt by ranges of (conv_id, turn); a conversation that
    spans several ranges, of which there are fewer than ranges, has its places moved on by what lies in the ranges before.
    """

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, k = TaskContext.get().partitionId(), None, 0
        for batch in arrow:
            conv = batch.column(0).to_pylist()
            places, parts, sizes = [], [], []
            for c, role, text in zip(conv, batch.column(1), batch.column(2)):
                k, last = (k + 1 if c == last else 0), c
                role, text = role.as_py().encode("utf-8", "surrogatepass"), text.as_py()
                parts.append(xxhash.xxh3_128_digest(len(role).to_bytes(8, "little") + role + text.encode("utf-8", "surrogatepass")))
                places.append(k)
                sizes.append(len(text))
            both = np.frombuffer(b"".join(parts), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(conv), own, np.int32)), pa.array(places, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(sizes, pa.int64())], names=["c", "part", "k", "hi", "lo", "n"])

    filled = lambda name: F.coalesce(F.col(name), F.lit("")).alias(name)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), "turn", filled("role"), filled("text"))
    dealt = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "c", "turn").sortWithinPartitions("c", "turn", "role", "text")
    turns = written(shipped(dealt).select("c", "role", "text").mapInArrow(run, "c long, part int, k long, hi long, lo long, n long"), "turns")
    sizes = turns.groupBy("c", "part").agg((F.max("k") + 1).alias("size"))
    spanning = sizes.groupBy("c").agg(F.count(F.lit(1)).alias("parts"), F.array_sort(F.collect_list(F.struct("part", "size"))).alias("sizes")).where("parts > 1")
    spread = spanning.select("c", F.posexplode("sizes").alias("at", "of"), "sizes")
    moved = spread.select("c", F.col("of.part").alias("part"), F.aggregate(F.slice("sizes", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda acc, x: acc + x["size"]).alias("moved"))
    return turns.join(F.broadcast(moved), ["c", "part"], "left").select("c", (F.col("k") + F.coalesce("moved", F.lit(0))).alias("pos"), "hi", "lo", "n")


def family_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns -> (c, pos, hi, lo, n) of rebuilt conversations, and (c, depth) of each, those without turns too.

    A conversation begins with the first h turns of its family's first one (c - c % 100), with h = crc32(c) % 6, and goes on with its own from h on.
    """
    head, first = F.crc32(F.col("c").cast("string")) % HEADS, F.col("c") - F.col("c") % FAMILY
    convs = written(turns.groupBy("c").agg(F.count(F.lit(1)).alias("size")).select("c", "size", head.alias("h"), first.alias("first")), "conversations")
    sizes = convs.where("c = first").select("first", F.col("size").alias("first_size"))
    taken = F.least("h", F.coalesce("first_size", F.lit(0)))
    convs = convs.join(sizes, "first", "left").select("c", "first", "h", taken.alias("taken"), (taken + F.greatest(F.lit(0), F.col("size") - F.col("h"))).alias("depth"))
    own = turns.where(F.col("pos") >= head)
    short = convs.where("taken < h").select("c", (F.col("h") - F.col("taken")).alias("back"))
    own = own.join(short, "c", "left").select("c", (F.col("pos") - F.coalesce("back", F.lit(0))).alias("pos"), "hi", "lo", "n")
    heads = turns.where((F.col("c") == first) & (F.col("pos") < HEADS - 1)).withColumnRenamed("c", "first")
    given = heads.join(convs.select("c", "first", "h"), "first").where("pos < h").select("c", "pos", "hi", "lo", "n")
    return own.unionByName(given), convs.select("c", "depth")


def prefixes(turns: DataFrame, depths: DataFrame) -> DataFrame:
    """(c, depth, hi, lo, up_hi, up_lo, n, before, total, length): a row for each prefix of each conversation, the empty one included.

    hi, lo: digest of the prefix; up_*: that of the one before; n: code points of the last turn; before: those of the turns before it;
    total, length: code points and turns of the conversation.
    """
    pair = turns.withColumn("segment", F.floor(F.col("pos") / SEGMENT)).withColumn("e_hi", F.xxhash64("pos", "hi", "lo")).withColumn("e_lo", F.xxhash64("lo", F.lit(1), "hi", "pos"))
    inside = Window.partitionBy("c", "segment").orderBy("pos")
    sums = written(pair.groupBy("c", "segment").agg(F.bit_xor("e_hi").alias("s_hi"), F.bit_xor("e_lo").alias("s_lo"), F.sum("n").alias("s_n")), "segments")
    whole, earlier = Window.partitionBy("c"), Window.partitionBy("c").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    carried = sums.select("c", "segment", zero(F.bit_xor("s_hi").over(earlier)).alias("c_hi"), zero(F.bit_xor("s_lo").over(earlier)).alias("c_lo"), zero(F.sum("s_n").over(earlier)).alias("c_n"), F.sum("s_n").over(whole).alias("total"))
    carried = written(carried.join(depths.withColumnRenamed("depth", "length"), "c"), "carried")
    running = pair.select("c", "segment", "pos", "n", "e_hi", "e_lo", F.bit_xor("e_hi").over(inside).alias("r_hi"), F.bit_xor("e_lo").over(inside).alias("r_lo"), F.sum("n").over(inside).alias("r_n"))
    hi, lo = F.col("r_hi").bitwiseXOR(F.col("c_hi")), F.col("r_lo").bitwiseXOR(F.col("c_lo"))
    rows = running.join(carried, ["c", "segment"]).select("c", (F.col("pos") + 1).alias("depth"), hi.alias("hi"), lo.alias("lo"), hi.bitwiseXOR(F.col("e_hi")).alias("up_hi"), lo.bitwiseXOR(F.col("e_lo")).alias("up_lo"), "n", (F.col("c_n") + F.col("r_n") - F.col("n")).alias("before"), "total", "length")
    none, nought = F.lit(None).cast("long"), F.lit(0).cast("long")
    totals = carried.where("segment = 0").select("c", "total")
    roots = depths.join(totals, "c", "left").select("c", nought.alias("depth"), nought.alias("hi"), nought.alias("lo"), none.alias("up_hi"), none.alias("up_lo"), nought.alias("n"), nought.alias("before"), zero(F.col("total")).alias("total"), F.col("depth").alias("length"))
    return rows.unionByName(roots)


# --- screening -----------------------------------------------------------------------------------------------


def sketch_cells(hi: np.ndarray, lo: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each digest in each row of the sketch."""
    a, b = lo.view(np.uint64), hi.view(np.uint64) | np.uint64(1)
    shift = np.uint64(64 - (cells.bit_length() - 1))
    with np.errstate(over="ignore"):
        return [((a + np.uint64(k) * b) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64) for k in range(1, DEPTH + 1)]


def sketch(rows: DataFrame, cells: int) -> np.ndarray:
    """(DEPTH, cells / 8) bytes of rows (hi, lo): a bit for each cell that two digests or more have hit.

    A task counts up to two in each cell and hands on the cells by block as sorted offsets, of 2 bytes; blocks are merged apart.
    """
    block = min(BLOCK, cells)

    def offsets(counts: list[dict]) -> Iterator[pa.RecordBatch]:
        out = []
        for k, (at, n) in enumerate(counts):
            cuts = np.searchsorted(at, np.arange(0, cells, block))
            for own, own_at, own_n in zip(range(len(cuts)), np.split(at, cuts[1:]), np.split(n, cuts[1:])):
                if len(own_at):
                    inner = (own_at - own * block).astype("<u2")
                    out.append((k * (cells // block) + own, inner.tobytes(), inner[own_n > 1].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["block", "once", "more"])

    def count(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            hi, lo = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            yield from offsets([np.unique(at, return_counts=True) for at in sketch_cells(hi, lo, cells)])

        for batch in arrow:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= SKETCH_ROWS:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    def merge(table):
        seen = np.zeros(block, np.int64)
        for once, more in zip(table.column("once"), table.column("more")):
            seen[np.frombuffer(once.as_py(), "<u2")] += 1
            seen[np.frombuffer(more.as_py(), "<u2")] += 1
        return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([np.packbits(seen > 1, bitorder="little").tobytes()], pa.binary())})

    parts = rows.select("hi", "lo").coalesce(SKETCHES).mapInArrow(count, "block int, once binary, more binary")
    out = np.zeros(DEPTH * cells // 8, np.uint8)
    for row in parts.groupBy("block").applyInArrow(merge, "block int, bits binary").collect():  # of bounded size: DEPTH * MAX_CELLS bits
        out[row["block"] * block // 8 : (row["block"] + 1) * block // 8] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(DEPTH, -1)


def screened(rows: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """Adds shared and up_shared: whether the sketch's estimate leaves room for another conversation with the prefix, and with the one before.

    Beyond ``max_cells`` / 4 prefixes the sketch fills up: more singletons then go through the exact grouping, with the same results.
    """
    cells = 1 << 9
    n = rows.count()
    while cells < min(4 * n, max_cells):
        cells *= 2
    bits = rows.sparkSession.sparkContext.broadcast(sketch(rows, cells).tobytes())
    fields = rows.schema.simpleString().removeprefix("struct<").removesuffix(">")

    def estimate(table: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        hit = np.ones(len(hi), bool)
        for own, at in zip(table, sketch_cells(hi, lo, cells)):
            hit &= (own[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return hit

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, np.uint8).reshape(DEPTH, -1)
        for batch in arrow:
            value = lambda name: np.ascontiguousarray(batch.column(name).fill_null(0).to_numpy(zero_copy_only=False))
            own, up = estimate(table, value("hi"), value("lo")), estimate(table, value("up_hi"), value("up_lo"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(up)], names=[*batch.schema.names, "shared", "up_shared"])

    return shipped(rows).mapInArrow(run, f"{fields}, shared boolean, up_shared boolean")


# --- nodes ---------------------------------------------------------------------------------------------------

KEY = ["depth", "hi", "lo"]


def with_parents(nodes: DataFrame, groups: DataFrame, n_rows: int) -> DataFrame:
    """Adds parent_conv_id: the owner of the group that is one up; the node's own conversation where there is none such, null for the root.

    Groups with more than 1 in HOT_PARENTS of all prefixes, at most so many, are broadcast; the others are joined, none of them with more rows than that.
    """
    up = groups.select((F.col("depth") + 1).alias("depth"), F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("parent"), "n_convs")
    often = F.col("n_convs") * HOT_PARENTS > n_rows
    on = ["depth", "up_hi", "up_lo"]
    hot = nodes.join(F.broadcast(up.where(often).drop("n_convs").withColumnRenamed("parent", "hot_parent")), on, "left")
    known = hot.where("hot_parent is not null").withColumn("parent", F.col("hot_parent"))
    cold = hot.where("hot_parent is null").join(up.where(~often).drop("n_convs"), on, "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id")
    return known.unionByName(cold).select(*nodes.columns, parent)


def member_hashes(ends: DataFrame) -> DataFrame:
    """(depth, hi, lo, c) -> (depth, hi, lo, ends): SHA-256 of each node's ids, ascending and comma-joined.

    Ids are dealt by ranges of (node, id), so those of a large node fill several tasks, which join them to strings; the node's hash then reads
    the strings one by one.
    """

    def join(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size = None, None, [], 0
        out: list[tuple] = []
        for batch in arrow:
            for *at, c in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if at != key or size >= CHUNK_BYTES:
                    if held:
                        out.append((*key, first, ",".join(held)))
                    key, first, held, size = at, c, [], 0
                held.append(str(c))
                size += len(held[-1]) + 1
            yield chunks(out)
            out = []
        if held:
            yield chunks([(*key, first, ",".join(held))])

    def chunks(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], names=[*KEY, "first", "ids"])

    def hashed(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def rows(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate([pa.int64()] * 3 + [pa.string()])], names=[*KEY, "ends"])

        for batch in arrow:
            done = []
            for *at, ids in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if at != key:
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = at, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield rows(done)
        if key:
            yield rows([(*key, state.hexdigest())])

    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = shipped(ends.select(*KEY, "c").repartitionByRange(n, *KEY, "c").sortWithinPartitions(*KEY, "c")).mapInArrow(join, "depth long, hi long, lo long, first long, ids string")
    return joined.repartition(*KEY).sortWithinPartitions(*KEY, "first").select(*KEY, "ids").mapInArrow(hashed, "depth long, hi long, lo long, ends string")


def prefix_trie(conversations: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """(conv_id, turn, role, text) -> the nodes of the trie of rebuilt conversations.

    (conv_id: least member, depth, parent_conv_id: the parent's, null for the root, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).
    Null roles and texts count as empty, turns without a number come first, turns of one number in the order of role and text, repeated
    rows are turns of their own. Rows without conv_id belong to no conversation. Further columns are ignored; an empty table has no node.
    """
    turns = written(placed_turns(conversations), "placed-turns")
    rebuilt, depths = family_heads(turns)
    depths = written(depths, "depths")
    rows = written(screened(written(prefixes(written(rebuilt, "rebuilt"), depths), "prefixes"), max_cells), "screened")
    n_rows = rows.count()
    ended, text = F.col("length") == F.col("depth"), lambda x: F.sha2(x.cast("string"), 256)
    shared, tails = rows.where("shared"), rows.where("not shared")

    groups = written(shared.groupBy(*KEY).agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(ended.cast("long")).alias("n_ends"), F.min("before").alias("before")), "groups")
    owned = groups.select(F.col("conv_id").alias("c"), F.col("depth").alias("from"), F.col("before").alias("from_before"), (F.col("n_ends") == F.col("n_convs")).alias("leaf"))
    owned = owned.unionByName(tails.select("c", F.col("depth").alias("from"), F.col("before").alias("from_before"), ended.alias("leaf")))
    owners = written(owned.groupBy("c").agg(F.min("from").alias("from"), F.min_by("from_before", "from").alias("from_before"), F.max("leaf").alias("leaf")), "owners")

    # what each member adds to the nodes on its path
    rest, mine = F.col("total") - F.col("before"), F.col("from").isNotNull()
    counted_once = F.when(mine, F.when(F.col("depth") >= F.col("from"), rest).otherwise(F.col("total") - F.col("from_before"))).otherwise(0)
    child = (mine & (F.col("depth") + 1 >= F.col("from")) & (F.col("depth") < F.col("length"))).cast("long")
    each = shared.join(owners, "c", "left").select(*KEY, "c", "up_hi", "up_lo", child.alias("child"), F.coalesce("leaf", F.lit(False)).cast("long").alias("leaf"), (rest - counted_once).alias("saved"), ended.cast("long").alias("end"))
    sums = each.groupBy(*KEY).agg(F.min("c").alias("conv_id"), F.min("up_hi").alias("up_hi"), F.min("up_lo").alias("up_lo"), F.count(F.lit(1)).alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.sum("end").alias("n_ends"))
    hashes = member_hashes(shared.where(ended))
    nodes = sums.join(hashes, KEY, "left").withColumn("ends_sha256", F.coalesce("ends", text(F.lit("")))).drop("ends", "n_ends")

    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = F.when(ended, text(F.col("c"))).otherwise(text(F.lit("")))
    alone = tails.select(*KEY, F.col("c").alias("conv_id"), "up_hi", "up_lo", one.alias("n_convs"), (~ended).cast("long").alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), ends.alias("ends_sha256"), "up_shared")
    local = alone.where("depth > 0 and not up_shared").withColumn("parent_conv_id", F.col("conv_id"))
    asked = nodes.unionByName(alone.where("depth = 0 or up_shared").drop("up_shared"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return with_parents(written(asked, "asked"), groups, n_rows).select(*columns).unionByName(local.select(*columns))


def op12(conversations: DataFrame) -> DataFrame:
    """The contract's columns."""
    return prefix_trie(conversations)
