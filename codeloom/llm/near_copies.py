"""Near copies by the Jaccard similarity of word shingles: SimHash groups and MinHash bands give candidates, the shingle sets decide.

Sets whose SimHash fingerprints a bit-sliced comparison connects at RADIUS or fewer bits are one bucket of candidates (see ``simhash``). Few of the pairs
of similarity 0.8 lie so near, so the bands of MinHash find the others.
A text's set of shingle hashes has BANDS keys of BAND_ROWS least values each; texts of similarity s share a key with probability
1 - (1 - s^BAND_ROWS)^BANDS, 0.9996 at 0.8. The number of keys grows with the texts and not with their pairs, as the candidates
of a wide SimHash radius would. Only sets that share a key with another are read again, and compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import shipped, texts, without_rows, written
from codeloom.llm.components import connected_components
from codeloom.llm.simhash import HASH_BLOCK, majority_bits, shingle_hashes
from codeloom.llm.simhash import near_links as print_links

WORDS, LEAST = 5, 0.8
#: Differing bits up to which fingerprints link.
RADIUS = 3
BANDS, BAND_ROWS = 20, 5
#: Sets above which a bucket is compared in tiles of at most about twice this many sets.
TILE_ROWS = 4096
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def set_hash(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes())


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS) uint64 keys of sets that are not empty."""
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    r = np.random.default_rng(11)
    keys = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), np.uint64(band))
        for flip, factor in r.integers(0, 1 << 32, (BAND_ROWS, 2), dtype=np.uint32):
            key = (key ^ np.minimum.reduceat((values ^ flip) * (factor | np.uint32(1)), starts)) * MIX
            key ^= key >> np.uint64(29)
        keys[:, band] = key
    return keys


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text) -> (doc_id, mark_: hash of the text, set: hash of the shingle set, bands: its keys, none for a text without words, fp: its SimHash fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, bands, fps, held, n = [], [], [], [], 0

            def flush() -> None:
                keys = iter(band_keys(full).view(np.int64).tolist() if (full := [x for x in held if len(x)]) else [])
                bands.extend(next(keys) if len(x) else [] for x in held)
                fps.extend(majority_bits(np.concatenate([np.zeros(0, np.uint64), *held]), np.array([len(x) for x in held], np.int64)).view(np.int64).tolist())

            for text in texts(batch.column(1)):
                held.append(shingle_set(text, words))
                prints.append(set_hash(held[-1]))
                n += len(held[-1])
                if n >= HASH_BLOCK:
                    flush()
                    held, n = [], 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(fps, pa.int64())], names=["doc_id", "mark_", "set", "bands", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return shipped(docs).select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, f"doc_id {kind}, mark_ long, set long, bands array<long>, fp long")


def set_links(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """(row, root) pairs that connect what the pairs of at least ``least`` similarity connect; no set is empty.

    Found rows leave the comparison, so a group of near copies costs a few passes, not its square.
    """
    sizes = np.array([len(x) for x in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    parts = np.split(flat, np.cumsum(sizes)[:-1])
    mark = np.zeros(flat.max() + 1, bool)
    rows, open_, links = np.arange(len(sets)), np.ones(len(sets), bool), []
    starts = np.cumsum(sizes) - sizes
    for first in range(len(sets)):
        if not open_[first]:
            continue
        open_[first] = False
        queue = [first]
        while queue and open_.any():
            k = queue.pop()
            if 2 * open_.sum() < len(rows):
                rows = np.flatnonzero(open_)
                flat = np.concatenate([parts[x] for x in rows])
                starts = np.cumsum(sizes[rows]) - sizes[rows]
            mark[parts[k]] = True
            common = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[parts[k]] = False
            hits = rows[(common / (sizes[k] + sizes[rows] - common) >= least) & open_[rows]].tolist()
            open_[hits] = False
            links += [(x, first) for x in hits]
            queue += hits
    return links


def near_links(docs: DataFrame, sets: DataFrame, words: int, least: float, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``sets`` (set, first: a row (doc_id, mark_) that has it, bands) of ``docs`` -> (a, b): sets whose links connect what similar pairs that share a key connect.

    Keys with the same members count once. A bucket of more than ``tile_rows`` sets is dealt into blocks and each pair of blocks is a
    tile of its own.
    """
    rows = sets.select("set", F.explode("bands").alias("band"))
    members = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("set").alias("first"), F.bit_xor(F.xxhash64("set")).alias("mark")).where("n > 1")
    buckets = written(members.groupBy("n", "first", "mark").agg(F.min("band").alias("band")).select("band", "n"), "shared-bands")
    blocks = F.ceil(F.col("n") / tile_rows).cast("long")
    dealt = rows.join(buckets, "band").select("set", "band", blocks.alias("blocks"), F.pmod(F.xxhash64("set"), blocks).alias("own"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    cells = dealt.select("*", other).select("set", "band", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("cell"))
    cells = written(cells, "candidate-copies")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(x, words) for x in texts(batch.column(1))]
            prints = np.array([set_hash(x) for x in own], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(prints), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], names=["set", "shingles"])

    wanted = sets.join(cells.select("set").distinct(), "set", "left_semi").select(F.col("first.doc_id").alias("id_"), F.col("first.mark_").alias("of_"))
    again = docs.join(wanted, (docs["doc_id"] == wanted["id_"]) & (F.xxhash64(docs["text"]) == wanted["of_"]), "left_semi")
    full = again.select("doc_id", "text").mapInArrow(shingles, "set long, shingles array<long>").dropDuplicates(["set"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, held = None, [], []

        def links() -> pa.RecordBatch:
            pairs = set_links(held, least) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            set_, band, cell = (batch.column(k).to_pylist() for k in range(3))
            for k, at in enumerate(zip(band, cell)):
                if at != key:
                    if held:
                        yield links()
                    key, ids, held = at, [], []
                ids.append(set_[k])
                held.append(batch.column(3)[k].values.to_numpy())
        if held:
            yield links()

    ready = cells.join(full, "set").select("set", "band", "cell", "shingles").repartition("band", "cell").sortWithinPartitions("band", "cell")
    return shipped(ready).mapInArrow(run, "a long, b long").distinct()


def with_print_groups(sets: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``sets`` (set, first, bands, fp) -> (set, first, bands): adds a key of the group of fingerprints that links of at most ``radius`` bits connect."""
    prints = sets.where("size(bands) > 0").select("fp").distinct()
    roots = connected_components(print_links(prints.select("fp", F.col("fp").alias("id")), radius)).withColumnRenamed("id", "fp")
    key = F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp"))
    return sets.join(roots, "fp", "left").select("set", "first", F.when(F.size("bands") > 0, F.concat("bands", F.array(key))).otherwise(F.col("bands")).alias("bands"))


def without_near_copies(docs: DataFrame, words: int = WORDS, least: float = LEAST, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Of each group of near copies the row with the least doc_id, all columns kept; rows without doc_id stay.

    A group is what pairs of texts connect whose sets of ``words``-word shingles (lower case) have a Jaccard similarity of at least
    ``least``. Texts of fewer words are one shingle; texts without words are equal to each other. A row is its doc_id and its text:
    of rows that share a doc_id each is judged by its own text (of several in one group, one text stays), and rows that repeat both
    stay or go together.
    """
    own = written(signatures(docs, words), "signatures")
    named = own.where("doc_id is not null")
    sets = written(named.groupBy("set").agg(F.min(F.struct("doc_id", "mark_")).alias("first"), F.first("bands").alias("bands"), F.first("fp").alias("fp")), "shingle-sets")
    candidates = written(with_print_groups(sets), "candidate-sets")
    roots = connected_components(near_links(docs, candidates, words, least, tile_rows)).withColumnRenamed("id", "set")
    groups = sets.join(roots, "set", "left").select("set", "first", F.coalesce("root", "set").alias("group"))
    kept = groups.groupBy("group").agg(F.min("first").alias("kept"))
    by_set = written(groups.join(kept, "group").select("set", "kept"), "kept-copies")
    gone = named.select("set", "doc_id", "mark_").join(by_set, "set").where(F.struct("doc_id", "mark_") != F.col("kept"))
    return without_rows(docs, gone, "near-copies")
