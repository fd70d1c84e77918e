"""Decontamination against every alignment and window of every item with every document."""

import random
import re
from itertools import combinations

from codeloom.llm import decontam


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def overlaps(doc, item, window=decontam.WINDOW, agree=decontam.AGREE):
    """Whether any window of the item, at any place of the document, agrees in the share of its words."""
    wide = min(window, len(item))
    if len(item) < decontam.LEAST_WORDS or sum(map(set(item).__contains__, doc)) < agree * wide:
        return False
    for at in range(-len(item) + 1, len(doc)):
        equal = [0 <= at + k < len(doc) and doc[at + k] == w for k, w in enumerate(item)]
        if any(sum(equal[k : k + wide]) >= agree * wide for k in range(len(item) - wide + 1)):
            return True
    return False


def test_every_document_and_item(spark):
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(40)]  # few words, so that seeds hit by chance as well
    line = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = {k: line(n) for k, n in enumerate((3, 5, 6, 8, 10, 12, 13, 14, 20, 30, 60))}
    docs = {}
    for k in range(150):
        text = line(r.choice((0, 3, 15, 60, 400)))
        piece = list(r.choice(list(items.values())))
        for _ in range(r.randint(0, 4)):
            piece[r.randrange(len(piece))] = r.choice(vocabulary + ["new"])
        a = r.randrange(len(piece))
        text[(at := r.randint(0, len(text))) : at] = piece[a // 2 : len(piece) - a // 3]
        docs[k] = " ".join(text)
    expected = {k: sorted(i for i, x in items.items() if overlaps(words(t), x)) for k, t in docs.items()}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in items.items()], "item_id long, text string")
    got = {row["doc_id"]: sorted(map(int, filter(None, row["item_ids"].split(",")))) for row in decontam.op7(frame, bench).collect()}
    assert got == expected and 20 < sum(map(bool, expected.values())) < 150
    in_blocks = decontam.find_overlaps(frame, bench, block_seeds=7).select("doc_id", "item_id").distinct().collect()
    assert {(row["doc_id"], row["item_id"]) for row in in_blocks} == {(k, i) for k, found in expected.items() for i in found}


def test_no_tolerated_substitution_is_missed(spark):
    docs = []
    for n in range(decontam.LEAST_WORDS, 15):
        wide = min(n, decontam.WINDOW)
        spared = wide - next(k for k in range(wide + 1) if k >= decontam.AGREE * wide)
        for changed in combinations(range(n), spared):
            piece = ["zz" if k in changed else f"i{n}x{k}" for k in range(n)]
            docs.append((len(docs), n, " ".join([f"d{len(docs)}x{k}" for k in range(9)] + piece + ["end"])))
    frame = spark.createDataFrame(docs, "doc_id long, n int, text string")
    bench = spark.createDataFrame([(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in range(5, 15)], "item_id int, text string")
    got = {row["doc_id"]: row["item_ids"] for row in decontam.op7(frame, bench).collect()}
    assert [k for k, n, _ in docs if got[k] != str(n)] == []


def test_rows_without_id_repeats_long_texts_and_clashing_columns(spark):
    r = random.Random(4)
    item = [f"i{k}" for k in range(30)]
    long = [f"w{r.randint(0, 10**6)}" for _ in range(60_000)]
    long[50_000:50_020] = item[5:25]
    schema = "doc_id long, text string, seed long, words string, chunk string, found_id_ long, item_id long"
    rows = [(None, "a clean text of some words", 1, "", "", 1, 0), (None, " ".join(item), 1, "", "", 1, 0), (None, None, 1, "", "", 1, 0), (7, "clean", 1, "", "", 1, 0), (7, "x " + " ".join(item), 1, "", "", 1, 0), (8, " ".join(long), 1, "", "", 1, 0), (9, "", 1, "", "", 1, 0)]
    frame = spark.createDataFrame([*rows, rows[1]], schema).repartition(3)
    bench = spark.createDataFrame([(1, " ".join(item), "x"), (1, " ".join(item), "y"), (None, "six words of no use here", "z"), (3, None, "")], "item_id long, text string, seed string")
    got = sorted((str(x["doc_id"]), x["contaminated"], x["n_spans"]) for x in decontam.op7(frame, bench).collect())
    assert got == sorted([("None", False, 0), ("None", True, 1), ("None", True, 1), ("None", False, 0), ("7", False, 0), ("7", True, 1), ("8", True, 1), ("9", False, 0)])
    left = decontam.clean_rows(frame, bench)
    assert left.columns == frame.columns and sorted(str(x["text"]) for x in left.collect()) == sorted(["a clean text of some words", "None", "clean", ""])
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontam.clean_rows(frame, nothing).count() == 8 and decontam.op7(frame.limit(0), bench).count() == 0
