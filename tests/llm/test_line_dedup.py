"""Line dedup against a plain version: nulls, repeats, ties at the limit, very common lines, batches one after the other."""

import hashlib
import random
from collections import Counter

import pytest

from codeloom.llm import line_dedup

SCHEMA = "doc_id long, text string, n_lines string, hi int, mark_ string"
BLANK = " \t\n\x0b\x0c\r"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(BLANK).translate(ASCII)


def plain(rows, min_docs, min_chars=1, known=()):
    counts = Counter(known)
    for _, text in rows:
        counts.update({key(x) for x in (text or "").split("\n")})
    drop = {k for k, n in counts.items() if n >= min_docs and len(k) >= min_chars}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in drop]
        out.append((str(doc_id), "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


def sources():
    r = random.Random(4)
    lines = [f"Line {k} ÉÄ" for k in range(60)]
    rows = [(k, "\n".join(r.choice((x, f"  {x}\t", x.upper().replace("É", "é"), f"only {k} {r.random()}")) for x in r.choices(lines, k=r.randint(0, 12)))) for k in range(150)]
    rows += [(k, "Everywhere\r\n" + (t or "")) for k, t in rows[:80]]
    return rows + [(None, None), (None, "everywhere"), (7, ""), (7, "\n\n"), rows[3], rows[3], (9, "x" * 50_000 + "\neverywhere"), (10, "\xa0everywhere"), (11, "İ\nı")]


@pytest.fixture(scope="module")
def rows():
    return sources()


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*row, "clash", 1, "m") for row in rows], SCHEMA).repartition(parts)


def result(df):
    return Counter((str(x["doc_id"]), x["text"], x["n_lines"], x["n_dropped"]) for x in df.collect())


def test_lines_of_ten_documents_go(spark, rows):
    docs = frame(spark, rows)
    expected = plain(rows, 10)
    assert result(line_dedup.drop_common_lines(docs)) == expected
    got = Counter((str(x["doc_id"]), x["kept_sha256"]) for x in line_dedup.op11(docs).collect())
    assert got == Counter({(k, hashlib.sha256(t.encode()).hexdigest()): 0 for k, t, _, _ in expected}) + Counter((k, hashlib.sha256(t.encode()).hexdigest()) for (k, t, _, _), n in expected.items() for _ in range(n))


def test_lines_beyond_the_broadcast_are_found_by_a_merge_join(spark, rows):
    docs = frame(spark, rows)
    out = line_dedup.drop_common_lines(docs, min_docs=4, min_chars=3, batches=4, broadcast_keys=20)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert result(out) == plain(rows, 4, 3)


def test_runs_are_merged_by_level_without_a_shuffle(spark, rows):
    runs = line_dedup.LineRuns(spark, buckets=4)
    for k in range(11):
        runs.add(line_dedup.line_counts(frame(spark, rows[k::11], 2)).drop("batch"))
    assert [name is not None for name in runs.levels] == [True, True, False, True]  # 11 batches: 1 + 2 + 8
    low, high = (spark.table(name) for name in runs.levels[:2])
    plan = line_dedup.merge_join(high, low.withColumnRenamed("n", "m"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    counts = runs.counts()
    assert [name is not None for name in runs.levels] == [False, False, False, True]
    expected = Counter()
    for _, text in rows:
        expected.update({key(x) for x in (text or "").split("\n")} - {""})
    assert sorted(x["n"] for x in counts.collect()) == sorted(expected.values())
    runs.close()
    assert runs.counts().count() == 0


def test_batches_one_after_the_other(spark, rows):
    runs, known = line_dedup.LineRuns(spark, buckets=4), Counter()
    for part in (rows[:90], rows[90:170], rows[170:]):
        assert result(line_dedup.take_batch(frame(spark, part), runs)) == plain(part, 10, known=known)
        for _, text in part:
            known.update({key(x) for x in (text or "").split("\n")})
    runs.close()


def test_empty_table(spark):
    empty = frame(spark, [(1, "a")]).limit(0)
    assert line_dedup.op11(empty).collect() == []
