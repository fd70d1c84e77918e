"""SimHash fingerprints and their near-duplicate groups by bit-sliced comparison.

Fingerprints are compared inside buckets of equal key bits. 64 bits in radius + 2 blocks: two fingerprints
that differ in at most ``radius`` bits agree on two whole blocks at least, so a key for each pair of blocks finds
every link. Inside a bucket the fingerprints lie as 64 bit planes; lane i of the planes shifted by d holds the row
d places further, so a handful of word operations update 64 distances at once in carry-save counters, and a
word of lanes is abandoned once all its distances exceed the radius or its rows are connected already.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import hex64, shipped, texts, written
from codeloom.llm.components import connected_components

BITS = 64
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Hashes whose bits are unpacked at once: 64 bytes each.
HASH_BLOCK = 200_000
#: Bytes of a text whose words are held at once.
PART_BYTES, BLANK = 1 << 20, re.compile(rb"[\x20\x09-\x0D]")
#: Rows above which a bucket is compared in tiles of at most twice this many rows.
TILE_ROWS = 8192


def shingle_hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included; of all words if there are fewer; none: no hash. A long text goes in parts."""
    raw = text.encode("utf-8", "surrogatepass").lower()  # bytes: only A-Z and ASCII white space
    digest, out, carried, begin = xxhash.xxh64_intdigest, [], [], 0
    while begin < len(raw):
        blank = BLANK.search(raw, begin + PART_BYTES)
        end = blank.start() if blank else len(raw)
        w = carried + raw[begin:end].split()
        out.append(np.array([digest(b" ".join(x), seed) for x in zip(*(w[k:] for k in range(words)))], np.uint64))
        carried, begin = w[-(words - 1) :] if words > 1 else [], end
    if carried and not any(map(len, out)):
        out.append(np.array([digest(b" ".join(carried), seed)], np.uint64))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes: the bits set in over half of them; an empty run gives zero."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        starts = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
        sums = np.zeros((len(full), BITS), np.int64)
        for k in range(0, len(hashes), HASH_BLOCK):  # a text's hashes may span blocks
            bits = np.unpackbits(hashes[k : k + HASH_BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            first = np.searchsorted(starts, k, side="right") - 1
            last = np.searchsorted(starts, k + len(bits), side="left")
            sums[first:last] += np.add.reduceat(bits, np.maximum(starts[first:last] - k, 0), axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * sums > counts[full][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp: the fingerprint's 64 bits as a signed long). Null text counts as empty: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, hashes, counts, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [], 0
            for text in texts(batch.column(1)):
                hashes.append(shingle_hashes(text, words))
                counts.append(len(hashes[-1]))
                held += counts[-1]
                if held >= HASH_BLOCK:
                    prints.append(majority_bits(np.concatenate(hashes), np.array(counts, np.int64)))
                    hashes, counts, held = [np.zeros(0, np.uint64)], [], 0
            prints.append(majority_bits(np.concatenate(hashes), np.array(counts, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(prints).view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return shipped(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


# --- comparison inside buckets -------------------------------------------------------------------------------


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(64, words) uint64: bit i of plane p is bit p of value i; two spare words let shifts read past the end."""
    words = -(-len(values) // 64)
    planes = np.zeros((BITS, (words + 2) * 8), np.uint8)
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    planes[:, : packed.shape[1]] = packed
    return planes.view(np.uint64)


def lanes_within(planes: np.ndarray, lag: int, wanted: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Compare rows i and i + lag for each lane set in ``wanted`` (words).

    Returns the words still alive and in them the lanes whose distance is at most ``radius``. Counters are
    bit-sliced: plane k of the counter holds bit k of 64 running distances; an overflow is sticky.
    """
    step, shift = divmod(lag, 64)
    alive = np.flatnonzero(wanted)
    want = wanted[alive]
    width = radius.bit_length()
    counter = np.zeros((width, len(alive)), np.uint64)
    over = np.zeros(len(alive), np.uint64)
    last = planes.shape[1] - 1
    for p in range(BITS):
        plane = planes[p]
        there = plane[np.minimum(alive + step, last)]
        if shift:
            there = (there >> np.uint64(shift)) | (plane[np.minimum(alive + step + 1, last)] << np.uint64(64 - shift))
        carry = plane[alive] ^ there
        for k in range(width):
            carry, counter[k] = counter[k] & carry, counter[k] ^ carry
        over |= carry
        if p % 8 == 7:
            keep = (want & ~over) != 0
            if not keep.all():
                alive, want, over, counter = alive[keep], want[keep], over[keep], counter[:, keep]
                if not len(alive):
                    break
    above, equal = over, ~over
    for k in reversed(range(width)):
        if radius >> k & 1:
            equal = equal & counter[k]
        else:
            above, equal = above | (equal & counter[k]), equal & ~counter[k]
    return alive, want & ~above


def bucket_links(values: np.ndarray, runs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (row, root) that connect, within each run of equal ``runs``, what links of at most ``radius`` connect.

    Rows that are connected already are not compared again, so a dense group costs a few lags, not its square.
    """
    n = len(values)
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def closed_up(rows: np.ndarray, more_than: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows of runs longer than ``more_than``, and for each the number of rows of its run that follow it."""
        own = runs[rows]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        size = np.diff(np.r_[first, len(own)])
        keep = np.repeat(size > more_than, size)
        after = np.repeat(first + size - 1, size) - np.arange(len(own))
        return rows[keep], after[keep]

    rows, after = closed_up(root.copy(), 1) if n else (root, root)
    planes, lag = bit_planes(values[rows]), 1
    while (after >= lag).any():
        m, ahead, label = len(rows), after >= lag, root[rows]
        wanted = ahead[: m - lag] & (label[: m - lag] != label[lag:])
        if wanted.any():
            words = np.zeros(-(-m // 64) * 8, np.uint8)
            packed = np.packbits(wanted, bitorder="little")
            words[: len(packed)] = packed
            alive, hits = lanes_within(planes, lag, words.view(np.uint64), radius)
            word, lane = np.nonzero(np.unpackbits(hits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(-1, 64))
            for i in alive[word] * 64 + lane:
                a, b = find(rows[i]), find(rows[i + lag])
                if a != b:
                    root[max(a, b)] = min(a, b)
            while len(word) and not np.array_equal(up := root[root], root):
                root[:] = up
        lag += 1
        if m > 256 and 4 * ahead.sum() < m:
            rows, after = closed_up(rows, lag)
            planes = bit_planes(values[rows])
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def block_keys(fp, radius: int) -> list:
    """A key (long) for each pair of the radius + 2 blocks of the fingerprint: number of the pair, then its bits."""
    blocks = radius + 2
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    part = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
    width = max(b - a for a, b in zip(cuts, cuts[1:]))
    return [F.shiftleft(F.lit(k).cast("long"), 2 * width).bitwiseOR(F.shiftleft(part[i], width)).bitwiseOR(part[j]) for k, (i, j) in enumerate(combinations(range(blocks), 2))]


def near_links(distinct: DataFrame, radius: int = 3, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(fp: long, distinct; id: long) -> (a, b): ids whose links have the same components as all pairs within ``radius``.

    A bucket of more than ``tile_rows`` rows is dealt into blocks and each pair of blocks is a tile of its own.
    """
    rows = distinct.select("fp", "id", F.explode(F.array(*block_keys(F.col("fp"), radius))).alias("key"))
    hot = written(rows.groupBy("key").count().where(F.col("count") > tile_rows), "hot-buckets")
    if hot.isEmpty():
        cells = rows.withColumn("cell", F.lit(0).cast("long"))
    else:
        blocks = F.ceil(F.col("count") / tile_rows).cast("long")
        own = F.pmod(F.xxhash64("fp"), blocks)
        other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
        cold = rows.join(hot, "key", "left_anti").withColumn("cell", F.lit(0).cast("long"))
        tiles = rows.join(hot, "key").select("fp", "id", "key", blocks.alias("blocks"), own.alias("own"), other.alias("other"))
        cells = cold.unionByName(tiles.select("fp", "id", "key", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other") + 1).alias("cell")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(block: np.ndarray) -> pa.RecordBatch:
            change = np.r_[False, (block[2, 1:] != block[2, :-1]) | (block[3, 1:] != block[3, :-1])]
            row, to = bucket_links(block[0].view(np.uint64), np.cumsum(change), radius)
            return pa.RecordBatch.from_arrays([pa.array(block[1][row]), pa.array(block[1][to])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([batch.column(k).to_numpy() for k in range(4)]))
            block = np.concatenate(held, axis=1) if len(held) > 1 else held[0]
            last = np.flatnonzero((block[2] != block[2, -1]) | (block[3] != block[3, -1]))
            cut = last[-1] + 1 if len(last) else 0  # the last bucket may go on
            if cut:
                yield links(np.ascontiguousarray(block[:, :cut]))
            held = [np.ascontiguousarray(block[:, cut:])]
        if held:
            yield links(held[0])

    dealt = cells.select("fp", "id", "key", "cell").repartition("key", "cell").sortWithinPartitions("key", "cell")
    return shipped(dealt).mapInArrow(run, "a long, b long").distinct()


def simhash_groups(docs: DataFrame, words: int = 3, radius: int = 3, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id: long, text, ...) -> (doc_id, fp, component_id), one row per input row.

    component_id is the least doc_id that can be reached over links of at most ``radius`` differing bits, itself
    included. Null and empty texts have fingerprint zero and link like any other. Repeated rows and ties share a
    fingerprint. Links join fingerprints, not doc_ids: rows of one doc_id with different texts belong each to the
    component of their own text, whose least doc_id they show. A row without doc_id links nothing; it shows the component of
    its fingerprint, or null.
    Further columns are ignored; an empty table gives an empty result.
    """
    own = written(fingerprints(docs, words), "fingerprints")
    distinct = written(own.where("doc_id is not null").groupBy("fp").agg(F.min(F.col("doc_id").cast("long")).alias("id")), "distinct-fingerprints")
    roots = connected_components(near_links(distinct.select("fp", F.col("fp").alias("id")), radius, tile_rows))
    grouped = distinct.join(roots.select(F.col("id").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("id").alias("component_id"))
    by_print = grouped.join(least, "root").select(F.col("fp").alias("fp_"), "component_id")
    return own.join(by_print, own.fp == by_print.fp_, "left").select("doc_id", "fp", "component_id")


def op5(docs: DataFrame) -> DataFrame:
    """The contract's columns: fingerprints of three-word shingles, linked at three or fewer bits."""
    return simhash_groups(docs).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
