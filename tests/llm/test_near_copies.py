"""The pipeline's near-dedup stage against all pairs of five-word shingle sets."""

import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from codeloom.llm import near_copies
from tests.llm.test_operators import plain_fingerprint


def plain_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def plain_left(texts):
    """Least key of each group that Jaccard similarities of 0.8 or more connect; equal sets, empty ones too, are one."""
    sets, root = {k: plain_set(t) for k, t in texts.items()}, {k: k for k in texts}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(sorted(texts), 2):
        both = len(sets[a] | sets[b])
        if sets[a] == sets[b] or (both and len(sets[a] & sets[b]) / both >= 0.8):
            root[max(top(a), top(b))] = min(top(a), top(b))
    return {k for k in texts if top(k) == k}


def test_near_dedup_stage_drops_what_all_pairs_connect(spark):
    r = random.Random(8)
    line = lambda n: [f"w{r.randint(0, 5000)}" for _ in range(n)]
    texts = {0: None, 1: "", 2: " \t", 3: "One  two", 4: "one two", 5: "one two three"}
    for group in range(30):
        base = line(r.choice((30, 120, 300)))
        for _ in range(r.randint(1, 5)):
            w = list(base)
            for _ in range(r.choice((0, 1, 1, 2, 6)) * len(w) // 120):
                w[r.randrange(len(w))] = "changed"
            texts[len(texts)] = " ".join(w)
    base = line(200)
    for _ in range(40):  # a chain of copies of copies in one large bucket
        base[r.randrange(200)] = f"x{r.randint(0, 99)}"
        texts[len(texts)] = " ".join(base)
    expected = plain_left(texts)
    far = [(a, b) for a, b in combinations(sorted(texts), 2) if len(x := plain_set(texts[a])) and len(x & (y := plain_set(texts[b]))) / len(x | y) >= 0.8 and bin(plain_fingerprint(texts[a]) ^ plain_fingerprint(texts[b])).count("1") > 3]
    assert far
    frame = spark.createDataFrame([*texts.items(), (None, texts[10]), (7, texts[7])], "doc_id long, text string").repartition(3)
    for left in (corpus_pipeline.near_dedup(spark, frame, ""), near_copies.without_near_copies(frame, tile_rows=4)):
        ids = [row["doc_id"] for row in left.collect()]
        assert {k for k in ids if k is not None} == expected and ids.count(None) == 1 and left.columns == frame.columns


def test_rows_that_share_a_doc_id_are_judged_by_their_texts(spark):
    r = random.Random(2)
    a, b, c, alone = (" ".join(f"w{r.randint(0, 5000)}" for _ in range(200)) for _ in range(4))
    for rows in ([(3, a), (5, a + " x"), (5, b), (1, c), (7, c + " x"), (7, alone)], [(3, a), (3, b + " x"), (1, b), (4, a + " x")], [(2, a), (2, a + " x"), (2, b), (2, b)]):
        left = [tuple(row) for row in near_copies.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()]
        texts = dict(enumerate(t for _, t in rows))
        close = lambda s, t: len(plain_set(s) & plain_set(t)) / len(plain_set(s) | plain_set(t)) >= 0.8
        for n, t in texts.items():
            group = {rows[k] for k, u in texts.items() if close(t, u)}
            kept = [row for row in left if row in group]
            assert len(set(kept)) == 1 and kept[0][0] == min(group)[0]


def test_set_links_connect_what_brute_force_connects():
    r = np.random.default_rng(3)
    for _ in range(40):
        base = [r.integers(0, 1 << 60, 40, dtype=np.uint64) for _ in range(4)]
        sets = [np.unique(np.r_[(x := base[r.integers(4)])[r.random(40) < 0.95], r.integers(0, 1 << 60, r.integers(1, 4), dtype=np.uint64)]) for _ in range(r.integers(1, 60))]
        near = [(a, b) for a, b in combinations(range(len(sets)), 2) if len(c := np.intersect1d(sets[a], sets[b])) / (len(sets[a]) + len(sets[b]) - len(c)) >= 0.8]

        def roots(pairs):
            root = list(range(len(sets)))
            top = lambda k: k if root[k] == k else top(root[k])
            for a, b in pairs:
                root[max(top(a), top(b))] = min(top(a), top(b))
            return [top(k) for k in range(len(sets))]

        assert roots(near_copies.set_links(sets, 0.8)) == roots(near)


def test_fingerprint_groups_give_candidates(spark):
    r = random.Random(6)
    base = [" ".join(f"w{r.randint(0, 5000)}" for _ in range(900)) for _ in range(6)]
    texts = {k: t for k, t in enumerate([*base, *(t + " end" for t in base), "", None])}
    frame = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    bare = near_copies.signatures(frame, 5).selectExpr("set", "named_struct('doc_id', doc_id, 'mark_', mark_) as first", "transform(bands, x -> cast(doc_id as long)) as bands", "fp")
    got = {row["first"]["doc_id"]: row for row in near_copies.with_print_groups(bare).collect()}
    prints = {k: plain_print(texts[k]) for k in range(12)}
    assert any(bin(prints[k] ^ prints[k + 6]).count("1") in (1, 2, 3) for k in range(6)) and not got[12]["bands"] and not got[13]["bands"]
    for a, b in combinations(range(12), 2):
        if bin(prints[a] ^ prints[b]).count("1") <= near_copies.RADIUS:
            assert got[a]["bands"][-1] == got[b]["bands"][-1]


def plain_print(text):
    hashes = [int(x) for x in near_copies.shingle_set(text, 5)]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))
