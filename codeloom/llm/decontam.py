"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is a window of words of which a fixed mask leaves some out, so a substituted word in such a place does not break the hit. Texts are
dealt into chunks of words; the seeds of documents are kept where the benchmark has them too and joined to the benchmark's.
Each side of a hit carries the words around its seed, so the join itself compares them place by place: a span counts if a window of
WINDOW words that holds the seed (the whole item, if that is shorter) agrees in at least a share AGREE of its words.

The masks miss no such window: for every way to substitute words that leaves the share, one mask fits between the substituted words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import same, without_rows, written

#: Fixed masks: 1 compares the word, 0 leaves it out. For items of at least WINDOW words, and for shorter ones.
MASKS = ("11101011", "11001111")
SHORT_MASKS = ("1111", "11011", "10111", "11101")
#: Words of the window that must agree, in at least this share.
WINDOW, AGREE = 13, 0.8
#: Items of fewer words are no evidence.
LEAST_WORDS = 5
#: Words of a chunk, without those that it shares with its neighbours.
CHUNK = 256
#: Distinct seeds (8 bytes each) that are broadcast at once; a larger benchmark is searched in blocks of its seeds, a pass over the documents each.
BLOCK_SEEDS = 2_000_000
#: Parts that the hits of one seed are dealt into, so that a passage that many documents share is not one task's.
SALTS = 16


def word_hashes(text: Column) -> Column:
    """Hashes of the words, runs of letters and digits in lower case; null text has none."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))


def with_mark(rows: DataFrame) -> DataFrame:
    """Adds ``mark_``, a hash of the text: rows that share a doc_id, or have none, are told apart by it."""
    return rows.withColumn("mark_", F.xxhash64("text"))


def seeds(rows: DataFrame, keys: list[str], masks: dict[int, str], window: int) -> DataFrame:
    """(keys, words) -> (keys, place, seed, chunk, offset): each seed of each mask, at the place of its first word.

    A chunk holds the words that the windows around its places need, null beyond the text's ends; ``around`` cuts them out.
    """
    left = window - min(map(len, (*MASKS, *SHORT_MASKS)))
    lead = F.array_repeat(F.lit(None).cast("long"), left)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - 1), F.lit(CHUNK))
    padded = rows.where(F.size("words") > 0).select(*keys, starts.alias("starts_"), F.concat(lead, "words").alias("padded_"))
    chunks = padded.select(*keys, F.explode(F.transform("starts_", lambda s: F.struct(s.alias("start"), F.slice("padded_", s + 1, F.lit(CHUNK + left + window)).alias("words")))).alias("c_"))
    chunks = chunks.select(*keys, F.col("c_.start").alias("start_"), F.col("c_.words").alias("chunk"))
    used = sorted({k for mask in masks.values() for k, c in enumerate(mask) if c == "1"})
    laid = F.arrays_zip(*(F.slice("chunk", F.lit(left + 1 + k), F.lit(CHUNK)).alias(f"w{k}") for k in used))
    places = chunks.select(*keys, "start_", "chunk", F.posexplode(laid).alias("offset", "z"))
    every = []
    for number, mask in masks.items():
        words = [F.col(f"z.w{k}") for k, c in enumerate(mask) if c == "1"]
        every.append(F.when(words[-1].isNotNull(), F.xxhash64(F.lit(number), *words)))
    each = places.select(*keys, "start_", "chunk", "offset", F.explode(F.array(*every)).alias("seed")).where("seed is not null")
    return each.select(*keys, (F.col("start_") + F.col("offset")).alias("place"), "seed", "chunk", "offset")


def around(window: int) -> Column:
    """The words that lie in any window of ``window`` words which holds the seed."""
    return F.slice("chunk", F.col("offset") + 1, F.lit(2 * window - min(map(len, SHORT_MASKS))))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, agree: float = AGREE, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """(doc_id, text) and (item_id, text) -> (doc_id, mark_, item_id, place, agreeing): verified overlaps of items with documents.

    ``place``: the word of the document at which the item's first word lies (negative if it begins before the document);
    ``agreeing``: equal words of the best window. Documents are told apart by doc_id and text (``mark_``), so rows that share a doc_id
    or have none are judged by their own texts. Rows that share an item_id are items of their own. Items of fewer than LEAST_WORDS
    words, null and empty texts overlap with nothing. Further columns are ignored. No window is missed at the default window and share.
    """
    items = written(benchmark.select("item_id", word_hashes(F.col("text")).alias("words")).where(F.size("words") >= LEAST_WORDS).distinct(), "benchmark-items")
    long_masks = dict(enumerate(MASKS))
    short_masks = dict(enumerate(SHORT_MASKS, len(MASKS)))
    sized = items.select("item_id", F.size("words").alias("n_words"), "words")
    keys = ["item_id", "n_words"]
    own = seeds(sized.where(F.col("n_words") >= window), keys, long_masks, window)
    few = sized.where(F.col("n_words") < window)
    any_short = not few.isEmpty()
    if any_short:
        own = own.unionByName(seeds(few, keys, short_masks, window))
    own = written(own.select(*keys, F.col("place").alias("item_place"), "seed", around(window).alias("mine")).distinct(), "benchmark-seeds")
    distinct = written(own.select("seed").distinct(), "distinct-seeds")
    blocks = max(1, -(-distinct.count() // block_seeds))
    tokens = with_mark(docs.select("doc_id", "text")).select("doc_id", "mark_", word_hashes(F.col("text")).alias("words"))
    theirs = seeds(tokens, ["doc_id", "mark_"], long_masks | (short_masks if any_short else {}), window)
    hits = None
    for block in range(blocks):
        part = distinct.where(F.pmod("seed", F.lit(blocks)) == block)
        found = theirs.join(F.broadcast(part), "seed", "left_semi").select("doc_id", "mark_", "place", "seed", around(window).alias("theirs"))
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.withColumn("salt", F.pmod(F.xxhash64("mark_", "place"), F.lit(SALTS)))
    dealt = own.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    equal = F.zip_with("mine", "theirs", lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    pairs = hits.join(dealt, ["seed", "salt"]).select("doc_id", "mark_", "item_id", "n_words", (F.col("place") - F.col("item_place")).alias("place"), equal.alias("equal"))
    sums = [sum((F.coalesce(F.get("equal", k), F.lit(0)) for k in range(j, j + window)), F.lit(0)) for j in range(window - min(map(len, SHORT_MASKS)) + 1)]
    pairs = pairs.withColumn("agreeing", F.greatest(*sums)).where(F.col("agreeing") >= F.least(F.lit(window), F.col("n_words")) * agree)
    return pairs.groupBy("doc_id", "mark_", "item_id", "place").agg(F.max("agreeing").alias("agreeing"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, mark_, item_ids: sorted list, n_spans, longest) for each document with a verified overlap."""
    by_item = find_overlaps(docs, benchmark).groupBy("doc_id", "mark_", "item_id").agg(F.count(F.lit(1)).alias("n"), F.max("agreeing").alias("agreeing"))
    return by_item.groupBy("doc_id", "mark_").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"), F.sum("n").alias("n_spans"), F.max("agreeing").cast("long").alias("longest"))


def op7(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, item_ids, n_spans), one row per row of ``docs``; a row without doc_id is judged by its own text."""
    found = contaminated(docs, benchmark).withColumnsRenamed({"doc_id": "found_id_", "mark_": "found_mark_"})
    rows = with_mark(docs.select("doc_id", "text")).select("doc_id", "mark_")  # texts stay where they are
    rows = rows.join(found, same(rows["doc_id"], found["found_id_"]) & (rows["mark_"] == found["found_mark_"]), "left")
    listed = F.array_join(F.transform("item_ids", lambda x: x.cast("string")), ",")
    return rows.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce(listed, F.lit("")).alias("item_ids"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"))


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a verified overlap, with all their columns; null and empty texts stay."""
    return without_rows(docs, find_overlaps(docs, benchmark), "contaminated")
