"""Lines that many documents share: levelled sorted runs of line hashes hold how many documents have each line.

A run is a table of (hash, number of documents), bucketed and sorted by the hash. A batch of documents adds its own run; two runs of a
level are merged into one of the next level. All runs have the same buckets, so merging two of them is a full outer merge join without
a shuffle, and what is kept of a batch is an anti-join with the runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import remove, shared_dir, shipped, written

MIN_DOCS, MIN_CHARS = 10, 1
#: Batches in which a whole table is taken in, by the number of the scan's task.
BATCHES = 4
#: Hashes that a task holds before it hands them on, 150 bytes each.
HELD_KEYS = 300_000
#: Shared lines that are broadcast at most, 16 bytes each: those that make up more than 1 in so many of all (document, line) pairs.
BROADCAST_KEYS = 1_000_000


def line_keys(raw: bytes) -> list[bytes]:
    """The key of each line of UTF-8 text: U+0020 and U+0009 to U+000D stripped at both ends, A-Z in lower case."""
    return [line.strip() for line in raw.lower().split(b"\n")]  # of bytes, both know ASCII only


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


def digests(raw: bytes, min_chars: int) -> list[bytes | None]:
    """XXH3's 128 bits of each line's key; None for keys of fewer than ``min_chars`` code points."""
    digest, least = xxhash.xxh3_128_digest, max(1, min_chars)
    return [digest(key) if long_enough(key, least) else None for key in line_keys(raw)]


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = 1) -> DataFrame:
    """(text, ...) -> (batch, hi, lo, n): of each scan task, the hashes of its lines and the number of its rows that have them."""

    def rows(held: dict[bytes, int], own: int) -> pa.RecordBatch:
        parts = np.frombuffer(b"".join(held), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(held), own, np.int32)), pa.array(parts[:, 0]), pa.array(parts[:, 1]), pa.array(list(held.values()), pa.int64())], names=["batch", "hi", "lo", "n"])

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = TaskContext.get().partitionId() % batches, {}
        for batch in arrow:
            for raw in batch.column(0):
                for key in set(digests(raw.as_py() or b"", min_chars)):
                    if key is not None:
                        held[key] = held.get(key, 0) + 1
                if len(held) >= HELD_KEYS:
                    yield rows(held, own)
                    held = {}
        if held:
            yield rows(held, own)

    return shipped(docs).select(F.col("text").cast("binary")).mapInArrow(run, "batch int, hi long, lo long, n long")


class LineRuns:
    """The runs by level, at most one on each. They lie in the shared folder; ``close`` removes them."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark, self.levels = spark, []
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = f"{shared_dir(spark)}/line-runs-{uuid4().hex}"

    def add(self, counts: DataFrame) -> None:
        """Add a run of (hi, lo, n); hashes may repeat. A full level hands its run on, merged with the new one."""
        run, level = self._stored(counts.groupBy("hi", "lo").agg(F.sum("n").alias("n"))), 0
        while level < len(self.levels) and self.levels[level]:
            run, self.levels[level], level = self._merged(self.levels[level], run), None, level + 1
        self.levels += [None] * (level + 1 - len(self.levels))
        self.levels[level] = run

    def compact(self) -> None:
        """Merge all runs into one, the smaller ones first."""
        live = [name for name in self.levels if name]
        while len(live) > 1:
            live = [self._merged(live[1], live[0]), *live[2:]]
        self.levels = [None] * (len(self.levels) - 1) + live

    def counts(self) -> DataFrame:
        """(hi, lo, n), each hash once."""
        self.compact()
        live = [name for name in self.levels if name]
        return self.spark.table(live[0]) if live else self.spark.createDataFrame([], "hi long, lo long, n long")

    def _stored(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid4().hex}"
        rows.write.format("parquet").bucketBy(self.buckets, "hi", "lo").sortBy("hi", "lo").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _merged(self, a: str, b: str) -> str:
        count = lambda side: F.coalesce(side, F.lit(0))
        name = self._stored(merge_join(self.spark.table(a), self.spark.table(b).withColumnRenamed("n", "m")).select("hi", "lo", (count(F.col("n")) + count(F.col("m"))).alias("n")))
        self._drop([a, b])
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            remove(self.spark, f"{self.folder}/{name}")

    def close(self) -> None:
        self._drop([name for name in self.levels if name])
        self.levels = []


def merge_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """What two runs of equal buckets hold, bucket by bucket."""
    return a.join(b.hint("merge"), ["hi", "lo"], "full")


def clean(docs: DataFrame, runs: LineRuns, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, text without lines that ``min_docs`` documents of the runs have, n_lines, n_dropped).

    Very common lines go by a broadcast set: a line with more than total / ``broadcast_keys`` of all pairs of document and line, so there are
    at most ``broadcast_keys`` of them. No other line has more rows than that share; these are found by a merge join of the documents'
    hashes with the runs, by the hash of the text, and texts then meet their lines. Without such other lines texts do not move.
    """
    spark = docs.sparkSession
    total = runs.counts().agg(F.sum("n")).first()[0] or 0
    least = max(min_docs, -(-total // broadcast_keys))
    hot = runs.counts().where(F.col("n") >= least).select("hi", "lo").toArrow()
    packed = np.stack([hot.column(k).to_numpy() for k in (0, 1)], axis=1).astype("<i8").tobytes()
    common = spark.sparkContext.broadcast(packed)

    def known() -> set[bytes]:
        return {common.value[k : k + 16] for k in range(0, len(common.value), 16)}

    def others(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop = known() | {None}
        for batch in arrow:
            marks, held = [], []
            for raw, mark in zip(batch.column(0), batch.column(1).to_pylist()):
                own = set(digests(raw.as_py() or b"", min_chars)) - drop
                held += own
                marks += [mark] * len(own)
            parts = np.frombuffer(b"".join(held), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), pa.array(parts[:, 0]), pa.array(parts[:, 1])], names=["mark_", "hi", "lo"])

    def kept(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop = known()
        for batch in arrow:
            texts, n, gone = [], [], []
            for raw, hits in zip(batch.column(1), batch.column(2)):
                raw = raw.as_py() or b""
                also = {x["hi"].to_bytes(8, "little", signed=True) + x["lo"].to_bytes(8, "little", signed=True) for x in hits.as_py() or ()}
                lines, keys = raw.split(b"\n"), digests(raw, min_chars)
                stay = [line for line, key in zip(lines, keys) if key not in drop and key not in also]
                texts.append(b"\n".join(stay).decode("utf-8", "replace"))
                n.append(len(lines))
                gone.append(len(lines) - len(stay))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])

    raw = shipped(docs).select("doc_id", F.col("text").cast("binary").alias("raw_"), F.xxhash64("text").alias("mark_"))
    if least == min_docs:
        found = raw.withColumn("hits_", F.lit(None).cast("array<struct<hi:long,lo:long>>"))
    else:
        rest = runs.counts().where((F.col("n") >= min_docs) & (F.col("n") < least)).select("hi", "lo")
        pairs = raw.select("raw_", "mark_").mapInArrow(others, "mark_ long, hi long, lo long").join(rest.hint("merge"), ["hi", "lo"])
        hits = pairs.groupBy("mark_").agg(F.collect_set(F.struct("hi", "lo")).alias("hits_"))
        found = raw.join(hits, "mark_", "left")  # two texts of one mark only look up each other's common lines as well
    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "raw_", "hits_").mapInArrow(kept, f"doc_id {kind}, text string, n_lines long, n_dropped long")


def take_batch(docs: DataFrame, runs: LineRuns, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """A new batch: its lines are added to the runs, then those that ``min_docs`` documents of all batches so far have are dropped from it."""
    runs.add(line_counts(docs, min_chars).drop("batch"))
    return clean(docs, runs, min_docs, min_chars)


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    r"""(doc_id, text, ...) -> (doc_id, text, n_lines, n_dropped): lines of a key that ``min_docs`` rows have are dropped from every row.

    Lines end at \n; a line's key is the line stripped of ASCII white space with A-Z in lower case; keys of fewer than ``min_chars`` code points
    (1 at least) stay. A null or empty text is one empty line. Each row is a document of its own, whatever its doc_id: repeated rows count each,
    rows without doc_id too. Other lines stay as they are, joined by \n. An empty table gives an empty result; further columns are ignored.
    """
    counts = written(line_counts(docs, min_chars, batches), "line-counts")
    runs = LineRuns(docs.sparkSession)
    for row in counts.select("batch").distinct().orderBy("batch").collect():  # as many rows as batches
        runs.add(counts.where(F.col("batch") == row["batch"]).drop("batch"))
    return clean(docs, runs, min_docs, min_chars, broadcast_keys)


def op11(docs: DataFrame) -> DataFrame:
    """The contract's columns: lines of at least one code point that ten documents have."""
    return drop_common_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
