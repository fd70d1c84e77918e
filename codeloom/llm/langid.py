"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Each language gets a model of character 4-grams. The models of all languages share arrays of n-gram hashes, sorted, with a row of log
probabilities per n-gram; a lookup is one binary search for all languages at once, and an n-gram that none has seen backs off
through the contexts' weights. A text goes to the language of the lowest cross-entropy per character. For the rejection each block of
MIXED characters takes its best language, so a text that mixes known ones is no stranger; the text is rejected if the mean of
its blocks lies above a limit for its length. The limit lies midway between what held-back texts of known languages reach and what these
texts cost without their own language's model, which is what a stranger costs. Length here is Kish's effective sample size of the text's
4-grams: a word or line that is repeated a thousand times says no more than once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import shipped, texts, without_rows, written

ORDER = 4
#: Labelled documents that a language's model learns from, at most; as many again calibrate the rejection.
FIT_DOCS = 300
#: Characters of a block that takes its best language by itself.
MIXED = 100
#: Effective lengths from which on a limit of its own holds; one with fewer than LEAST_HELD held-back texts and pieces takes the limit of all.
#: Texts of fewer characters than the second are too short to be told from strangers and are not rejected.
LENGTHS, LEAST_HELD = (0, 20, 50, 100, 200), 20
#: A length of which fewer than ENOUGH whole texts are held back is measured by pieces of longer ones too: up to PIECES, evenly spaced, of each of these
#: sizes. A piece may lie wholly in a foreign passage, so whole texts are the better measure where there are enough.
ENOUGH = 100
PIECE_SIZES, PIECES = (35, 75, 150, 300), 4
#: The quantiles, of known texts' excess over their language's median and of strangers', between which a limit lies.
KNOWN_QUANTILE, STRANGER_QUANTILE = 0.997, 0.05
#: A limit is at least this many times the known excess, where strangers cost no more than known texts (wrong labels do that).
LEAST_SLACK = 1.25
#: Ids of a sample up to which they are broadcast.
BROADCAST_IDS = 500_000
#: Characters an unseen character is one of.
ALPHABET = 1 << 14
SPACE = 32
#: Characters scored at once (a multiple of MIXED), and characters of texts that are held at once.
BLOCK, HELD_CHARS = 400_000, 2_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def classes() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and which are letters or numbers."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return letter, letter | np.fromiter((chr(c).isnumeric() for c in range(0x110000)), bool, 0x110000)


def characters(text: str) -> np.ndarray:
    """Lower-case letters as code points, each run of anything else as one space, with spaces around; empty if no letter.

    Words that hold digits (keys, hashes) are no language and count as anything else, unless there are no others.
    """
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letters, alphanumeric = classes()
    letter = letters[code]
    if not letter.any():
        return np.zeros(0, np.uint64)
    inside = alphanumeric[code]
    word = np.cumsum(~inside)
    coded = np.zeros(word[-1] + 1, bool)
    coded[word[inside & ~letter]] = True
    plain = letter & ~coded[word]
    letter = plain if plain.any() else letter
    line = np.full(len(code) + 2, SPACE, np.uint64)
    line[1:-1][letter] = code[letter]
    blank = line == SPACE
    return line[~(blank & np.r_[False, blank[:-1]])]


def gram_hashes(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of the n-grams whose k-th characters are in ``columns[k]``."""
    out = np.full(len(columns[0]), np.uint64(len(columns)))
    for column in columns:
        out = (out ^ column) * MIX
        out ^= out >> np.uint64(29)
    return out


def windows(line: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """Columns of the n-grams that end at each character but the first space; spaces stand before the text."""
    padded = np.r_[np.full(order - 2, SPACE, np.uint64), line]
    return [padded[k : len(padded) - order + 1 + k] for k in range(order)]


@dataclass
class Level:
    """The n-grams of one order that any language has seen, and the contexts of that length less one."""

    keys: np.ndarray  # sorted hashes
    log_p: np.ndarray  # (n-grams, languages)
    contexts: np.ndarray  # sorted hashes
    log_back: np.ndarray  # (contexts, languages): weight of the lower order, 0 where the language hasn't seen the context


@dataclass
class Model:
    languages: list[str]
    levels: list[Level]  # by order, from 1
    floor: float
    median: np.ndarray  # of held-back texts' block entropies, by language
    known: np.ndarray  # what held-back texts' excess over the median reaches, by length
    strange: np.ndarray  # what they cost at least without their own language's model, by length

    def log_probabilities(self, columns: list[np.ndarray]) -> np.ndarray:
        """(n, languages) for n-grams in columns, by the longest order that is seen."""
        n, order = len(columns[0]), len(columns)
        out = np.empty((n, len(self.languages)), np.float32)
        if not order:
            out[:] = self.floor
            return out
        level = self.levels[order - 1]
        at, hit = find(level.keys, gram_hashes(columns))
        out[:] = level.log_p[at] if len(level.keys) else 0
        miss = np.flatnonzero(~hit)
        if len(miss):
            rest = [c[miss] for c in columns]
            if order == 1:
                out[miss] = self.floor
            else:
                back, seen = find(level.contexts, gram_hashes(rest[:-1]))
                out[miss] = self.log_probabilities(rest[1:]) + np.where(seen[:, None], level.log_back[back] if len(level.contexts) else 0, 0)
        return out

    def excess(self, mixed: np.ndarray, language: np.ndarray) -> np.ndarray:
        return mixed - self.median[language]

    def rejects(self, mixed: np.ndarray, language: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of texts of ``n`` characters and effective ``sizes``. Below the least length that is measured, what known texts reach grows as chance does, by the root."""
        k = np.maximum(length_class(sizes), 1)
        known = self.known[k] * np.sqrt(LENGTHS[1] / np.clip(sizes, 1, LENGTHS[1]))
        limit = np.maximum((known + self.strange[k]) / 2, LEAST_SLACK * known)
        return (n >= LENGTHS[1]) & (self.excess(mixed, language) > limit)


def effective_size(line: np.ndarray) -> float:
    """Kish's effective sample size of the n-grams of a line: (sum of counts)^2 / sum of squared counts. Of a very long line, the largest of its parts'."""
    best = 0.0
    columns = windows(line) if len(line) else []
    for a in range(0, len(line) - 1, BLOCK):
        counts = np.unique(gram_hashes([c[a : a + BLOCK] for c in columns]), return_counts=True)[1].astype(np.float64)
        best = max(best, counts.sum() ** 2 / (counts**2).sum())
    return best


def pieces(line: np.ndarray) -> list[np.ndarray]:
    """Up to PIECES evenly spaced pieces of each size that is less than the line's."""
    return [line[a : a + size] for size in PIECE_SIZES if len(line) > size for a in sorted(set(np.linspace(0, len(line) - size, PIECES).astype(int).tolist()))]


def length_class(sizes: np.ndarray) -> np.ndarray:
    return np.searchsorted(LENGTHS, sizes, side="right") - 1


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def gathered(grams: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """Kneser-Ney's continuation counts: the number of distinct characters before each shorter n-gram."""
    return grams.groupby(["lang", *by], sort=False).size().rename("count").reset_index()


def build_levels(grams: pd.DataFrame, languages: list[str]) -> list[Level]:
    """``grams``: lang, c0..c3, count. Interpolated estimates for the union of all languages' n-grams, order by order."""
    names = [f"c{k}" for k in range(ORDER)]
    tables = {ORDER: grams}
    for order in range(ORDER - 1, 0, -1):
        tables[order] = gathered(tables[order + 1], names[ORDER - order :])
    levels: list[Level] = []
    for order in range(1, ORDER + 1):
        used = names[ORDER - order :]
        table = tables[order]
        key = gram_hashes([table[c].to_numpy(np.uint64) for c in used])
        keys, first = np.unique(key, return_index=True)
        columns = [table[c].to_numpy(np.uint64)[first] for c in used]
        context = gram_hashes(columns[:-1]) if order > 1 else np.zeros(len(keys), np.uint64)
        contexts = np.unique(context)
        lower = levels[-1].log_p[find(levels[-1].keys, gram_hashes(columns[1:]))[0]] if order > 1 else np.full((len(keys), len(languages)), -np.log(ALPHABET))
        log_p = np.empty((len(keys), len(languages)), np.float32)
        log_back = np.zeros((len(contexts), len(languages)), np.float32)
        place = np.searchsorted(contexts, context)
        for k, language in enumerate(languages):
            own = (table["lang"] == language).to_numpy()
            counts = np.zeros(len(keys))
            counts[np.searchsorted(keys, key[own])] = table["count"].to_numpy()[own]
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = ones / (ones + 2 * twos) if ones else 0.5
            total = np.bincount(place, counts, len(contexts))
            kinds = np.bincount(place, counts > 0, len(contexts))
            seen = total > 0
            back = np.where(seen, discount * kinds / np.maximum(total, 1), 1.0)
            p = np.maximum(counts - discount, 0) / np.maximum(total[place], 1) + back[place] * np.exp(lower[:, k])
            log_p[:, k] = np.log(np.maximum(p, 1e-12))
            log_back[:, k] = np.log(np.maximum(back, 1e-12))
        levels.append(Level(keys, log_p, contexts if order > 1 else np.zeros(0, np.uint64), log_back))
    return levels


def entropies(model: Model, lines: list[np.ndarray], without: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each line of characters: (lines, languages) mean cross-entropy; the mean with each block's best language; the number of characters.

    ``without``: a language for each line that its blocks may not take. All are 0 for an empty line.
    """
    sizes = np.array([max(0, len(x) - 1) for x in lines])
    total, mixed = np.zeros((len(lines), len(model.languages))), np.zeros(len(lines))
    held: list[tuple[int, list[np.ndarray]]] = []
    n = 0

    def score() -> None:
        rows = -model.log_probabilities([np.concatenate(c) for c in zip(*(w for _, w in held))])
        sizes_ = [len(w[0]) for _, w in held]
        begins = np.cumsum([0, *sizes_])[:-1]
        starts = np.concatenate([np.arange(a, a + size, MIXED) for a, size in zip(begins, sizes_)])
        line = np.repeat([k for k, _ in held], [-(-size // MIXED) for size in sizes_])
        sums = np.add.reduceat(rows, starts, axis=0, dtype=np.float64)
        np.add.at(total, line, sums)
        if without is not None:
            sums[np.arange(len(sums)), np.array(without)[line]] = np.inf
        np.add.at(mixed, line, sums.min(axis=1))

    for k, line in enumerate(lines):
        if not sizes[k]:
            continue
        columns = windows(line)
        for a in range(0, sizes[k], BLOCK):  # a very long text goes in parts
            part = [c[a : a + BLOCK] for c in columns]
            held.append((k, part))
            n += len(part[0])
            if n >= BLOCK:
                score()
                held, n = [], 0
    if held:
        score()
    return total / np.maximum(sizes, 1)[:, None], mixed / np.maximum(sizes, 1), sizes


def _sampled(docs: DataFrame, fit_docs: int) -> DataFrame:
    """(lang, text, fits): up to ``fit_docs`` labelled documents of each language to fit and as many to calibrate, by hash of the id.

    Rows per language are counted first, so that only rows with small hashes, some 8 * fit_docs of each language, are ranked; a
    common language is not gathered in one task. The sample's ids are broadcast if they are few, as fit_docs and a sane number
    of languages make them; else the join shuffles.
    """
    labelled = docs.where("lang is not null and doc_id is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return labelled.select("lang", "text", F.lit(True).alias("fits")).limit(0)
    share = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, 8 * fit_docs / n))))
    small = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * (1 << 30)
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id"))
    ids = labelled.select("doc_id", "lang").where(small).withColumn("rank", rank).where(F.col("rank") <= 2 * fit_docs)
    ids = written(ids.select(F.col("doc_id").alias("id_"), (F.col("rank") % 2 == 1).alias("fits")).dropDuplicates(["id_"]), "language-sample")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return labelled.join(side, F.col("doc_id") == F.col("id_")).select("lang", "text", "fits")


def fit_language_model(labelled: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """Learn from (doc_id, text, lang); rows without one of them teach nothing. The model is bounded by ``fit_docs`` a language."""
    sample = _sampled(labelled.select("doc_id", "text", "lang"), fit_docs)

    def grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, own in frame[frame["fits"]].groupby("lang"):
                lines = [x for x in map(characters, own["text"]) if len(x)]
                if lines:
                    columns = [np.concatenate(c).astype(np.int64) for c in zip(*map(windows, lines))]
                    out = pd.DataFrame(dict(zip(("c0", "c1", "c2", "c3"), columns))).groupby(["c0", "c1", "c2", "c3"]).size().rename("count").reset_index()
                    yield out.assign(lang=lang)[["lang", "c0", "c1", "c2", "c3", "count"]]

    counted = shipped(sample).mapInPandas(grams, "lang string, c0 int, c1 int, c2 int, c3 int, count long")
    table = counted.groupBy("lang", "c0", "c1", "c2", "c3").agg(F.sum("count").alias("count")).toPandas()
    languages = sorted(table["lang"].unique())
    model = Model(languages, build_levels(table, languages) if languages else [], -float(np.log(ALPHABET)) - 6, np.zeros(len(languages)), *np.full((2, len(LENGTHS)), np.inf))
    if languages:
        calibrate(model, sample)
    return model


def calibrate(model: Model, sample: DataFrame) -> None:
    """Set the medians and what limits are made of by the held-back texts; fitted texts serve for a language with fewer than five.

    A text measured without its own language's model is a stranger to the others: its excess is over the language it would then go to.
    """
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for frame in frames:
            frame = frame[frame["lang"].isin(own.languages)].reset_index(drop=True)
            for a in range(0, len(frame), 50):
                part = frame.iloc[a : a + 50]
                known = [(line, own.languages.index(lang), fits, line is whole) for text, lang, fits in zip(part["text"], part["lang"], part["fits"]) for whole in [characters(text)] for line in (whole, *pieces(whole))]
                lines, mine, fits, whole = map(list, zip(*known)) if known else ([], [], [], [])
                _, mixed, n = entropies(own, lines)
                h, strange, _ = entropies(own, lines, mine)
                h[np.arange(len(lines)), mine] = np.inf
                yield pd.DataFrame({"lang": mine, "fits": fits, "whole": whole, "mixed": mixed, "strange": strange, "other": h.argmin(axis=1), "n": n, "size": [effective_size(x) for x in lines]})

    # at most 2 * fit_docs texts a language, with PIECES pieces of each size
    columns = "lang int, fits boolean, whole boolean, mixed double, strange double, other int, n long, size double"
    seen = shipped(sample).mapInPandas(measure, columns).where("n > 0").toPandas()
    held = seen[~seen["fits"]]
    scarce = seen["lang"].map(held[held["whole"]]["lang"].value_counts()).fillna(0) < 5
    held = seen[~seen["fits"] | scarce]
    for k, own in held[held["whole"]].groupby("lang"):
        model.median[k] = own["mixed"].median()
    known = model.excess(held["mixed"].to_numpy(), held["lang"].to_numpy())
    strange = model.excess(held["strange"].to_numpy(), held["other"].to_numpy())
    kind, whole = length_class(held["size"].to_numpy()), held["whole"].to_numpy(bool)
    for k in range(1, len(LENGTHS)):
        own = next((x for x, least in ((whole & (kind == k), ENOUGH), (kind == k, LEAST_HELD)) if x.sum() >= least), whole)
        if own.any():
            model.known[k] = float(np.quantile(known[own], KNOWN_QUANTILE))
            model.strange[k] = float(np.quantile(strange[own], STRANGER_QUANTILE)) if len(model.languages) > 1 else model.known[k]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, lang_pred, score, rejected), one row per input row.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learnt. Of equal cross-entropies the first language in
    order of name wins. ``score``: the winner's share among the languages' likelihoods of ten characters. ``rejected``: no language fits
    the text, or ``und``. Each row is judged alone; further columns are ignored. No shuffle; texts are held HELD_CHARS at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            pred, score, rejected = [], [], []

            def judge(lines: list[np.ndarray]) -> None:
                h, mixed, n = entropies(own, lines)
                best = h.argmin(axis=1) if own.languages else np.zeros(len(lines), np.int64)
                share = 1 / np.exp(10 * (h.min(axis=1, keepdims=True) - h)).sum(axis=1) if own.languages else mixed
                strange = own.rejects(mixed, best, n, np.array([effective_size(x) for x in lines])) if own.languages else n == 0
                pred.extend(own.languages[k] if size else "und" for k, size in zip(best.tolist(), n.tolist()))
                score.extend(np.where(n > 0, share, 0.0).tolist())
                rejected.extend((strange | (n == 0)).tolist())

            lines, size = [], 0
            for text in texts(batch.column(1)):
                lines.append(characters(text) if own.languages else np.zeros(0, np.uint64))
                size += len(lines[-1])
                if size >= HELD_CHARS or len(lines) >= 200:
                    judge(lines)
                    lines, size = [], 0
            if lines:
                judge(lines)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return shipped(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op3(docs: DataFrame) -> DataFrame:
    """The contract's columns and ``rejected``, by a model of the documents that are not held out."""
    predicted = identify(docs, fit_language_model(docs.where(~held_out())))
    return predicted.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def in_known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns.

    Rows that share a doc_id, or have none, are judged by their own texts. Null texts and those without a letter go. The rejected
    rows, few by intent, are what is joined.
    """
    judged = identify(docs.select(F.struct("doc_id", F.xxhash64("text").alias("mark")).alias("doc_id"), "text"), fit_language_model(docs.where(~held_out())))
    return without_rows(docs, judged.where("rejected").select("doc_id.doc_id", F.col("doc_id.mark").alias("mark_")), "rejected")
