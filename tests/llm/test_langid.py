"""Language models against a plain interpolated Kneser-Ney in dictionaries, and the rejection of strangers."""

import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from codeloom.llm import langid

SMALL = "/root/testdata/sf0.01"


class PlainKneserNey:
    """Continuation counts, one discount an order, interpolation down to the uniform distribution; by the book, with dictionaries."""

    def __init__(self, texts, seen_by_any, order=langid.ORDER):
        self.order, self.seen = order, seen_by_any
        counts = Counter(gram for text in texts for gram in grams_of(text, order))
        self.counts = {order: counts}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(gram[1:] for gram in self.counts[k + 1])
        self.total, self.kinds, self.discount = defaultdict(Counter), defaultdict(Counter), {}
        for k, own in self.counts.items():
            ones, twos = (sum(v == x for v in own.values()) for x in (1, 2))
            self.discount[k] = ones / (ones + 2 * twos) if ones else 0.5
            for gram, n in own.items():
                self.total[k][gram[:-1]] += n
                self.kinds[k][gram[:-1]] += 1

    def back(self, gram):
        k, total = len(gram), self.total[len(gram)][gram[:-1]]
        return self.discount[k] * self.kinds[k][gram[:-1]] / total if total else 1.0

    def p(self, gram):
        k = len(gram)
        lower = self.p(gram[1:]) if k > 1 else 1 / langid.ALPHABET
        if k == 1 and gram not in self.seen[1]:
            return math.exp(-math.log(langid.ALPHABET) - 6)
        total = self.total[k][gram[:-1]]
        direct = max(self.counts[k][gram] - self.discount[k], 0) / total if total else 0.0
        return direct + self.back(gram) * lower


def grams_of(text, order):
    line = [chr(c) for c in langid.characters(text)]
    if not line:
        return []
    padded = [" "] * (order - 2) + line
    return [tuple(padded[k : k + order]) for k in range(len(padded) - order + 1)]


def made_texts(r):
    sounds = {"xx": "aba bab abba baab aabb bab", "yy": "nono onon noon onno nnoo ono", "zz": "liri riri liil rill irli lir"}
    return [(k, " ".join(r.choices(sounds[lang].split(), k=r.randint(3, 60))), lang) for k in range(120) for lang in [r.choice(sorted(sounds))]]


def test_entropies_and_winners_are_those_of_a_plain_model(spark):
    r = random.Random(5)
    rows = made_texts(r)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit_language_model(frame, fit_docs=10_000)
    fitted = {(row["lang"], row["text"]) for row in langid._sampled(frame, 10_000).where("fits").collect()}
    by_lang = defaultdict(list)
    for lang, text in [(row["lang"], row["text"]) for row in langid._sampled(frame, 10_000).where("fits").collect()]:
        by_lang[lang].append(text)
    assert sorted(by_lang) == model.languages == ["xx", "yy", "zz"] and fitted
    seen = {1: {gram[-1:] for texts in by_lang.values() for text in texts for gram in grams_of(text, langid.ORDER)}}
    plain = [PlainKneserNey(by_lang[lang], seen) for lang in model.languages]
    asked = ["abba noon", "liri bab", "nono onno riri", "q", "Zebra aba", "ono " * 300]
    h, mixed, n = langid.entropies(model, [langid.characters(x) for x in asked])
    for k, text in enumerate(asked):
        grams = grams_of(text, langid.ORDER)
        own = [[-math.log(m.p(g)) for g in grams] for m in plain]
        assert n[k] == len(grams) and all(abs(h[k][i] - sum(x) / len(x)) < 1e-3 for i, x in enumerate(own))
        blocks = [min(sum(x[a : a + langid.MIXED]) for x in own) for a in range(0, len(grams), langid.MIXED)]
        assert abs(mixed[k] - sum(blocks) / len(grams)) < 1e-3
    got = {row["doc_id"]: row for row in langid.identify(frame, model).collect()}
    for k, text, _ in rows:
        own = [sum(-math.log(m.p(g)) for g in grams_of(text, langid.ORDER)) for m in plain]
        assert got[k]["lang_pred"] == model.languages[own.index(min(own))]


def test_rows_without_id_long_texts_and_clashing_columns(spark):
    r = random.Random(6)
    rows = [(k, t, lang, 1.0, True, "x") for k, t, lang in made_texts(r)]
    odd = [(None, "noon onno nono onon", "yy", 1.0, True, "x"), (None, "12 - 34", None, 1.0, True, "x"), (None, None, None, 1.0, True, "x"), (3, "ю" * 500, None, 1.0, True, "x"), (500, "aba bab " * 200_000, None, 1.0, True, "x"), rows[0]]
    frame = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double, rejected boolean, lang_pred string").repartition(3)
    kept = langid.in_known_language(frame)
    ids = [row["doc_id"] for row in kept.collect()]
    assert kept.columns == frame.columns and ids.count(None) == 1 and 500 in ids and ids.count(3) == 1 and len(ids) == len(rows) + 3
    assert langid.in_known_language(frame.limit(0)).count() == 0


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the driver's tables")
def test_a_language_that_was_not_learnt_is_rejected(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    known = langid.identify(docs, langid.fit_language_model(docs.where(~langid.held_out()))).join(docs, "doc_id")
    counts = known.selectExpr("count(*) n", "count_if(rejected) bad", "count_if(lang = lang_pred) right").first()
    assert counts["bad"] == 0 and counts["right"] / counts["n"] > 0.98
    for left_out in ("en", "de"):
        model = langid.fit_language_model(docs.where(f"lang <> '{left_out}'"))
        share = langid.identify(docs.where(f"lang = '{left_out}'"), model).selectExpr("avg(int(rejected))").first()[0]
        assert share > 0.9, (left_out, share)


def test_effective_size_counts_repeated_words_once():
    once = langid.characters("abba noon liri")
    assert abs(langid.effective_size(langid.characters("abba noon liri " * 500)) - len(once)) < 2
    assert langid.effective_size(langid.characters("abba")) == 5 and langid.effective_size(langid.characters("12")) == 0


def test_short_and_repetitive_texts_of_a_known_language_stay(spark):
    r = random.Random(9)
    frame = spark.createDataFrame(made_texts(r), "doc_id long, text string, lang string").repartition(3)
    model = langid.fit_language_model(frame, fit_docs=10_000)
    asked = [(1, "aba bab abba baab aabb"), (2, "onno " * 900), (3, "riri liil rill irli lir\n" * 300), (4, "щука ждёт " * 40), (5, "ждёт щука у реки давно")]
    got = {row["doc_id"]: row["rejected"] for row in langid.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert got == {1: False, 2: False, 3: False, 4: True, 5: True}
