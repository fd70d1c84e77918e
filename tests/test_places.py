"""Snippets by a line index, and the filter of listed paths."""

import random

from pyspark.sql import functions as F

from codeloom.functions.paths import listing_with_dirs, maybe_listed, path_filter, resolve_imports
from codeloom.operators import lookup

RANGES = "request int, path string, start_line int, end_line int, padding int"


def plain(texts, rows):
    """request -> (first, last, snippet), by splitting whole texts."""
    out = {}
    for request, path, start, end, padding in rows:
        if path in texts:
            lines = (texts[path] or "").split("\n")
            first, last = max(0, start - 1 - padding), min(len(lines) - 1, end - 1 + padding)
            out[request] = (first + 1, last + 1, "\n".join(lines[first : last + 1]))
    return out


def test_snippets_equal_those_of_split_texts(spark):
    dice = random.Random(5)
    texts = {f"/{n}.ts": "\n".join("".join(dice.choice("aé𝄞 \r") for _ in range(dice.randrange(9))) for _ in range(size)) for n, size in enumerate([1, 2, 63, 64, 65, 128, 129, 500])}
    texts |= {"/empty.ts": "", "/null.ts": None, "/newline.ts": "\n", "/long.ts": "x" * 300_000 + "\ny"}
    rows = [(k, dice.choice([*texts, "/gone.ts"]), s := dice.randrange(0, 520), s + dice.randrange(-3, 140), dice.randrange(3)) for k in range(400)]
    files, ranges = spark.createDataFrame(list(texts.items()), "path string, content string"), spark.createDataFrame(rows, RANGES)
    want = plain(texts, rows)
    assert any(first > last for first, last, _ in want.values()) and any(last - first > 64 for first, last, _ in want.values())
    index = lookup.line_index(files, 64)
    for args in ({}, {"index": index}, {"index": lookup.line_index(files, 3), "broadcast_ranges": 0}, {"broadcast_ranges": 0}):
        got = {r["request"]: (r["first"], r["last"], r["snippet"]) for r in lookup.snippets(files, ranges.unionByName(ranges), **args).collect()}
        assert got == want
    many = files.unionByName(spark.range(16 * len(rows)).select(F.format_string("/other%d.ts", "id").alias("path"), F.lit("x").alias("content")))
    assert {r["request"]: (r["first"], r["last"], r["snippet"]) for r in lookup.snippets(many, ranges).collect()} == want
    marks = {r["path"]: (r["n_lines"], len(r["marks"]), r["marks"][-1]) for r in index.collect()}
    assert marks["/7.ts"] == (500, 9, len(texts["/7.ts"].encode()) + 1) and marks["/null.ts"] == (1, 2, 1)
    assert lookup.snippets(files.where("false"), ranges).count() == 0 and lookup.snippets(files, ranges.where("false")).count() == 0


def test_snippets_move_no_contents(spark):
    files = spark.range(lookup.FILES_PER_RANGE).select(F.format_string("/%d.ts", "id").alias("path"), F.lit("1\n2\n3").alias("content"))
    one, two = spark.createDataFrame([(1, "/1.ts", 1, 2, 0)], RANGES), spark.createDataFrame([(1, "/1.ts", 1, 2, 0), (2, "/2.ts", 1, 2, 0)], RANGES)
    hints = lambda ranges: lookup.snippets(files, ranges)._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in hints(one)
    assert "rightHint=(strategy=merge)" in hints(two)  # more than a range for FILES_PER_RANGE files: contents move once, by path
    exchanged = [line for line in lookup.line_index(files)._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanged) == 1  # bytes of blocks by path; their sums stay there


def test_a_filter_of_listed_paths_lets_few_others_pass(spark):
    listing = listing_with_dirs(spark.range(5_000).select(F.concat(F.lit("/s/f"), "id", F.lit(".ts")).alias("path")))
    tried = spark.range(40_000).select(F.concat(F.lit("/s/f"), "id", F.lit(".ts")).alias("try"))
    for n_words, rate in ((1 << 20, 0.001), (1 << 10, 0.05), (1, 1.0)):
        words = path_filter(listing, n_words)
        kept = maybe_listed(tried, "try", words, n_words)
        assert words.count() <= n_words
        assert kept.join(listing, F.col("try") == F.col("entry")).count() == 5_000
        assert kept.count() - 5_000 <= rate * 35_000


def test_resolution_is_equal_with_a_full_filter(spark):
    imports = spark.createDataFrame([("/s/a.ts", "./b.js"), ("/s/a.ts", "./gone.js"), ("/s/a.ts", "@l/c"), ("/s/a.ts", "@l/d"), ("/s/a.ts", "@l/none"), ("/s/a.ts", "react")], "from_file string, specifier string")
    listing = listing_with_dirs(spark.createDataFrame([("/s/b.ts",), ("/s/l/c.tsx",), ("/s/l/d/index.ts",)], "path string"))
    aliases = spark.createDataFrame([("/s", 0, "@l/*", "./l/*")], "base_dir string, ord int, pattern string, replacement string")
    want = {"./b.js": "/s/b.ts", "./gone.js": "/s/gone.js", "@l/c": "/s/l/c.tsx", "@l/d": "/s/l/d/index.ts", "@l/none": "/s/l/none", "react": "react"}
    for n_words in (1, 64, 1 << 20):
        assert {r["specifier"]: r["target"] for r in resolve_imports(imports, listing, aliases, n_words).collect()} == want
