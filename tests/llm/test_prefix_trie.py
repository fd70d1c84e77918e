"""The trie of conversations against a plain one: families, shared prefixes, long conversations, full sketches, odd rows."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

from codeloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, c int, depth string, shared boolean"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        turns = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
        ends[turns].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += (len(members[node]) - 1) * len(node[-1][1]) if node else 0
    sha = lambda node: hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
    return sorted((min(members[x]), len(x), min(members[x[:-1]]) if x else -1, len(members[x]), kids[x], leaves[x], saved[x], sha(x)) for x in list(members))


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*row, 1, "clash", True) for row in rows], SCHEMA).repartition(parts)


def result(df):
    return sorted((*(-1 if x[c] is None else x[c] for c in COLUMNS),) for x in df.collect())


def conversations():
    r = random.Random(6)
    texts = ["hi", "Hi", "", "héllo 😀", "how are you", "fine"]
    rows = []
    for c in [*range(40), *range(95, 130), *range(700, 720), 10_001]:
        for turn in range(r.randint(1, 7)):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", r.choice(texts[: 1 + turn % 5 + (c % 3)])))
    rows += [(c, turn, "user", f"same {turn}") for c in range(300, 340) for turn in range(4)]  # a hot group
    rows += [(200, k, "user", f"t{k % 7}") for k in range(300)] + [(201, k, "user", f"t{k % 7}") for k in range(299)]  # long ones
    rows += [(1, None, None, None), (2, None, "user", "first"), (5, 0, "user", "tie"), (5, 0, "user", "another tie"), (5, 0, "assistant", "x"), rows[7], (None, 0, "user", "lost"), (777, 0, "user", None), (778, 9, "user", "end")]
    return rows


def test_nodes_are_those_of_a_plain_trie(spark):
    rows = conversations()
    assert result(prefix_trie.op12(frame(spark, rows))) == plain(rows)


def test_full_sketches_segments_and_cold_parents_change_nothing(spark, monkeypatch):
    rows, expected = conversations(), plain(conversations())
    monkeypatch.setattr(prefix_trie, "SEGMENT", 16)
    monkeypatch.setattr(prefix_trie, "HOT_PARENTS", 3)
    monkeypatch.setattr(prefix_trie, "CHUNK_BYTES", 8)
    assert result(prefix_trie.prefix_trie(frame(spark, rows, 7), max_cells=1 << 9)) == expected
    monkeypatch.setattr(prefix_trie, "HOT_PARENTS", 10**9)
    assert result(prefix_trie.prefix_trie(frame(spark, rows, 2))) == expected


def test_screening_keeps_most_singletons_from_the_shuffle(spark):
    rows = [(k, turn, "user", f"{k} {turn}") for k in range(200) for turn in range(5)]
    turns, depths = prefix_trie.family_heads(prefix_trie.placed_turns(frame(spark, rows)))
    screened = prefix_trie.screened(prefix_trie.prefixes(turns, depths)).select("c", "depth", "hi", "lo", "shared").collect()
    members = defaultdict(set)
    for x in screened:
        members[x["hi"], x["lo"]].add(x["c"])
    single = [x for x in screened if len(members[x["hi"], x["lo"]]) == 1]
    assert all(x["shared"] for x in screened if len(members[x["hi"], x["lo"]]) > 1)
    assert sum(x["shared"] for x in single) <= 0.05 * len(single)


def test_small_tables(spark):
    assert prefix_trie.op12(frame(spark, [(1, 0, "a", "b")]).limit(0)).collect() == []
    for rows in ([(1, 0, "user", "one")], [(-5, 0, "user", "minus"), (-5, 1, "user", "two"), (0, 0, "user", "zero")], [(42, 0, None, None), (43, 0, None, None)]):
        assert result(prefix_trie.op12(frame(spark, rows))) == plain(rows)
