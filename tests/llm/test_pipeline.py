"""The pipeline on the smallest table, stage by stage, against plain versions."""

import random
import re
from pathlib import Path

import numpy as np
import pytest

from codeloom.llm import bpe, langid
from tests.llm.test_decontam import overlaps
from tests.llm.test_near_copies import plain_left

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the driver's tables")
def test_pipeline_keeps_what_plain_versions_keep(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    known = {r["doc_id"] for r in langid.in_known_language(docs).collect()}
    first = {}
    for k in sorted(known):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[k]), k)
    left = plain_left({k: texts[k] for k in first.values()})
    items = [r["text"] or "" for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    tokens = {k: words(texts[k]) for k in left}

    clean = {k for k in left if not any(overlaps(tokens[k], words(x)) for x in items)}
    got = corpus_pipeline.run(spark, SMALL).collect()
    codec = bpe.codec(bpe.vocabulary_path(), bpe.default_pattern())
    assert all(codec.decode(np.array(r["ids"], "<u4").tobytes()).decode() == texts[r["doc_id"]] and len(r["ids"]) == r["n_tokens"] for r in got)
    assert {r["doc_id"] for r in got} == clean and len(got) == len(clean)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "byte_bpe"]


def test_pipeline_with_odd_rows(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(3)
    sounds = {"xx": ["aba", "bab", "abba", "baab", "aabb", "bob"], "yy": ["nono", "onon", "noon", "onno", "nnoo", "kin"]}
    line = lambda lang, n: " ".join("".join(r.choices(sounds[lang], k=2)) for _ in range(n))
    rows = [(k, line(lang, r.randint(30, 90)), lang) for k in range(150) for lang in [r.choice(("xx", "yy"))]]
    item, base = line("xx", 40), line("yy", 200)
    rows += [(1000, None, "xx"), (1001, "", "xx"), (1002, "12 !", None), (None, line("yy", 50), None), (None, item, None), rows[3], (1003, rows[5][1].replace(" ", "  "), rows[5][2]), (1004, base, "yy"), (1005, base + " noon", "yy"), (1006, "x " + item, None), (1007, "\u0436\u0434" * 300, None)]
    schema = "doc_id long, text string, lang string, source string, kept boolean, ids string, mark_ int, band long, component_id string"
    frame = spark.createDataFrame([(*row, "s", True, "", 1, 2, "c") for row in rows], schema)
    (folder := tmp_path / "tables").mkdir()
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item, "clash")], "item_id long, text string, doc_id string").write.parquet(f"{folder}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(folder)).collect()
    assert sorted(str(row["doc_id"]) for row in got) == sorted([*map(str, range(150)), "None", "1004"])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(folder))
        assert docs.columns == frame.columns, name
    frame.limit(0).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, str(folder)).collect() == []
