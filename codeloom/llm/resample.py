"""Importance resampling towards a target: bucketed features of words, gains of buckets, and a draw by Gumbel noise.

Words come from an untrained ``Split`` of the tokenizers library over the ASCII-lowered text, with their offsets; a window over the offset pairs
gives a feature, its CRC-32 the bucket. Bucket numbers of a text are kept (two bytes a feature while they fit), so texts are split once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from codeloom.llm.common import shipped, written

BUCKETS, LONGEST, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Characters of a text that are split at once, up to the next character that is in no word.
PART_CHARS = 1 << 18


def parts(text: str, inner, size: int = PART_CHARS) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters that end where ``inner`` (a character is part of a word) fails."""
    begin = 0
    while begin < len(text):
        end = min(len(text), begin + size)
        while end < len(text) and inner(text[end]):
            end += 1
        yield text[begin:end]
        begin = end


def in_word(c: str) -> bool:
    return "0" <= c <= "9" or "a" <= c <= "z" or c > "\x7f"


def text_buckets(text: str, split, longest: int, buckets: int, seen: dict[str, int]) -> tuple[np.ndarray, int]:
    """(bucket of each run of 1 to ``longest`` words, number of words); ``seen`` remembers buckets of single words."""
    out, carried, n_words = [], [], 0
    bucket = lambda feature: zlib.crc32(feature.encode("utf-8", "surrogatepass")) % buckets
    for part in parts(text.translate(LOWER), in_word):
        words = [part[a:b] for _, (a, b) in split.pre_tokenize_str(part)]
        n_words += len(words)
        for word in words:
            if word not in seen:
                if len(seen) >= 200_000:
                    seen.clear()
                seen[word] = bucket(word)
            out.append(seen[word])
        if longest > 1:
            words, fresh = carried + words, len(carried)
            out += [bucket(" ".join(words[k : k + size])) for size in range(2, longest + 1) for k in range(max(0, fresh - size + 1), len(words) - size + 1)]
            carried = words[-(longest - 1) :]
    return np.array(out, np.uint32), n_words


def features(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, key: str = "doc_id") -> DataFrame:
    """(key, text, ...) -> (key, n_words, n_features, features: the buckets as little-endian integers of 2 bytes, or of 4 beyond 65,536 buckets)."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = pre_tokenizers.Split(Regex(WORD), "removed", True), {}
        for batch in arrow:
            own = [text_buckets(x.as_py() or "", split, longest, buckets, seen) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in own], pa.int64()), pa.array([len(b) for b, _ in own], pa.int64()), pa.array([b.astype(width).tobytes() for b, _ in own], pa.binary())], names=["key", "n_words", "n_features", "features"])

    kind = docs.schema[key].dataType.simpleString()
    return shipped(docs).select(F.col(key).alias("key"), "text").mapInArrow(run, f"key {kind}, n_words long, n_features long, features binary")


def histogram(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in the rows of ``features``: a task hands on a count for each bucket, not for each feature."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in arrow:
            for x in batch.column(0):
                sums += np.bincount(np.frombuffer(x.as_py(), width), minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in rows.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row per bucket
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of each bucket's smoothed share of the target to that of the source."""
    n, s, t = float(len(source)), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the hash of seed and id; an id that is null counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def importance(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Documents (doc_id, text, ...) and target (text, ...) -> (doc_id, n_words, n_features, weight, score).

    weight is the sum of the gains of the document's features, score adds the noise. Null and empty texts have no words and weigh 0;
    repeated rows count each; an empty target or table is an empty histogram. Further columns are ignored.
    """
    width = "<u2" if buckets <= 1 << 16 else "<u4"
    own = written(features(docs, longest, buckets), "features")
    wanted = features(target.select("text", F.lit(0).alias("key_")), longest, buckets, "key_")
    gains = bucket_gains(histogram(own, buckets), histogram(wanted, buckets))

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            weight = [int(gains[np.frombuffer(x.as_py(), width)].sum()) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    weighed = own.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")
    return weighed.select("*", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))


def ranked(scores: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """Adds rank: 1, 2, 3 ... by score, ties to the smaller doc_id, for the first ``percent`` of rows with ``min_words`` words; null for others.

    Rows are dealt by ranges of (score, doc_id, row), so equal ones spread too; a row's rank is its place in its range and the number of rows in the ranges before, so no task
    sees more than a range.
    """
    scores = written(scores, "scores")
    asked = scores.where(F.col("n_words") >= min_words).withColumn("row_", F.monotonically_increasing_id())
    order = [F.col("score").desc(), F.col("doc_id").asc(), F.col("row_").asc()]
    dealt = written(asked.repartitionByRange(int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("range_", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("range_").agg(F.count(F.lit(1)).alias("n_")).collect()  # a row per range
    before, total = [], 0
    for row in sorted(sizes):
        before.append((row["range_"], total))
        total += row["n_"]
    starts = scores.sparkSession.createDataFrame(before, "range_ int, before_ long")
    place = F.row_number().over(Window.partitionBy("range_").orderBy(*order)) + F.col("before_")
    rank = F.when(place <= percent * total // 100, place).cast("long")
    drawn = dealt.join(F.broadcast(starts), "range_").select(*scores.columns, rank.alias("rank"))
    return drawn.unionByName(scores.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def draw(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; those with a rank are the draw."""
    return ranked(importance(docs, target, longest, buckets, seed), min_words, percent)


def op13(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns: single words, 10,000 buckets, a tenth of the documents of 20 words or more."""
    return draw(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")
