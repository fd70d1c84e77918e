"""What a trie of whole texts holds in memory, and that spilling changes no result."""

import random

from codeloom.llm import exact_dedup
from codeloom.llm.exact_dedup import NODE_BYTES, PatriciaTrie, extended


def held(trie):
    """Bytes of labels, nodes and values in memory, counted anew."""
    return sum(len(node.label) + NODE_BYTES * (node is not trie.root) + node.weight for node, _ in trie._walk(trie.root))


def joined(a, b):
    return (min(a[0], b[0]), a[1] + b[1], extended(a[2], b[2]))


def test_single_long_texts_spill():
    limit, dice = 1 << 20, random.Random(1)
    trie, texts = PatriciaTrie(joined, limit), [dice.randbytes(1 << 20) for _ in range(200)]
    for n, text in enumerate(texts):
        trie.add(text, (n, 1, [n]))
        assert held(trie) <= limit + 256 * (NODE_BYTES + 1) and trie.bytes == held(trie)
    assert trie.limit == limit
    assert sorted(value for _, value in trie.items()) == [(n, 1, [n]) for n in range(200)]


def test_values_of_a_text_count_and_spill():
    limit = 1 << 20
    trie = PatriciaTrie(joined, limit)
    for n in range(30_000):
        trie.add(b"common" if n % 3 else b"other", (n, 1, [n]))
        assert held(trie) <= limit and trie.bytes == held(trie)
    got = {key: (value[0], value[1], sorted(value[2])) for key, value in trie.items()}
    assert got == {key: (rows[0], len(rows), rows) for key, rows in ((b"common", [n for n in range(30_000) if n % 3]), (b"other", list(range(0, 30_000, 3))))}


def test_one_text_stays_whole():
    """A trie of one string has no fork to spill at; its values stay, and nothing recurs without end."""
    trie = PatriciaTrie(joined, 1000)
    for n in range(5_000):
        trie.add(b"x" * 5_000, (n, 1, [n]))
    assert [(key, value[:2]) for key, value in trie.items()] == [(b"x" * 5_000, (0, 5_000))]


def test_spilling_at_any_limit_gives_each_string_once():
    dice = random.Random(2)
    for limit in (1, 700, 3_000, 20_000, 1 << 20):
        trie, want = PatriciaTrie(joined, limit), {}
        for n in range(3_000):
            key = bytes(dice.choice(b"ab") for _ in range(dice.randrange(14))) + b"tail" * dice.randrange(3)
            trie.add(key, (n, 1, [n]))
            want.setdefault(key, []).append(n)
            if limit > 700:
                assert held(trie) <= limit + 256 * (NODE_BYTES + 1)
        got = [(key, (value[0], value[1], sorted(value[2]))) for key, value in trie.items()]
        assert len(got) == len(want) and dict(got) == {key: (rows[0], len(rows), rows) for key, rows in want.items()}


def test_groups_are_equal_at_a_small_limit(spark):
    dice = random.Random(3)
    rows = [(n, dice.choice(["a" * 3000, "b c", "b  c", "", None, "ab" * dice.randrange(40)])) for n in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs, 5_000, 2).collect()}
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(exact_dedup.normalised(text or ""), []).append(doc_id)
    assert got == {doc_id: (min(ids), len(ids), doc_id == min(ids)) for ids in groups.values() for doc_id in ids}
