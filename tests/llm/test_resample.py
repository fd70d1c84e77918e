"""Importance resampling against a plain version: features, gains, noise, ranks."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from tokenizers import Regex, pre_tokenizers

from codeloom.llm import resample

SCHEMA = "doc_id long, text string, score string, weight int, key string, range_ int"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, longest):
    words = WORD.findall((text or "").translate(ASCII))
    return words, [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def plain(rows, target, longest=1, buckets=10_000, min_words=20, percent=10, seed=2024):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = Counter(), Counter()
    own = [plain_features(text, longest) for _, text in rows]
    for _, fs in own:
        s.update(map(bucket, fs))
    for text in target:
        t.update(map(bucket, plain_features(text, longest)[1]))
    n, m = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (n + buckets) / ((s[b] + 1.0) * (m + buckets))))
    out = []
    for (doc_id, _), (words, fs) in zip(rows, own):
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        out.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    asked = sorted((x for x in out if x[5] >= min_words), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for k, x in enumerate(asked[: percent * len(asked) // 100]):
        x[4] = k + 1
    return Counter(tuple(x[:5]) for x in out)


def sources():
    r = random.Random(1)
    words = [f"w{k}" for k in range(300)] + ["É", "ß", "x_y", "İ", "don't", "12", "中文"]
    rows = [(k, " ".join(r.choices(words, k=r.randint(0, 90)))) for k in range(300)]
    return rows + [(None, None), (None, " ".join(words[:30])), rows[5], rows[5], (1000, ""), (1001, "A" * 30_000), (1002, "\x7f\x80a"), (1003, " ".join(r.choices(words, k=30_000)))]


def frame(spark, rows):
    return spark.createDataFrame([(*x, "clash", 1, "k", 2) for x in rows], SCHEMA).repartition(3)


def test_scores_and_ranks(spark):
    rows, target = sources(), ["w1 w2 w3 W4 É", None, "", "w250 w251 " * 40]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = Counter(map(tuple, resample.op13(frame(spark, rows), bench).collect()))
    assert got == plain(rows, target)
    more = resample.draw(frame(spark, rows), bench, longest=3, buckets=100_000, min_words=5, percent=25, seed=7)
    assert Counter(map(tuple, more.drop("n_words").select("doc_id", "n_features", "weight", "score", "rank").collect())) == plain(rows, target, 3, 100_000, 5, 25, 7)


def test_words_are_those_of_the_pattern_in_any_part():
    split = pre_tokenizers.Split(Regex(resample.WORD), "removed", True)
    r = random.Random(2)
    for size in (1, 3, 50, 10_000):
        for _ in range(60):
            text = "".join(r.choices("ab9Z _-.\n\x00\x7f\x80é中", k=r.randint(0, 80))).translate(ASCII)
            words = [part[a:b] for part in resample.parts(text, resample.in_word, size) for _, (a, b) in split.pre_tokenize_str(part)]
            assert words == WORD.findall(text)


def test_empty_tables(spark):
    rows = [(1, "w1 w2"), (2, None)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert Counter(map(tuple, resample.op13(frame(spark, rows), none).collect())) == plain(rows, [])
    assert resample.op13(frame(spark, rows).limit(0), none).collect() == []
