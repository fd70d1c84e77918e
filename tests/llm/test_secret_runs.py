"""Secrets in texts without blanks: every run of a word is judged."""

import json
import random
import re

from codeloom.llm import secrets


def test_every_run_of_a_word_is_judged_by_what_stands_before_it(spark):
    r = random.Random(9)
    long = lambda: "".join(r.choices("theandion", k=20))
    key = lambda: "".join(r.choices("0123456789abcdef", k=40))
    rows = [(k, f"some {long()} words and {long()}") for k in range(60)] + [(k, f'the token = "{key()}" is here {long()}') for k in range(60, 100)]
    kept = {k: [key() for _ in range(3)] for k in range(200, 204)}
    text = {200: "api_key={0};secret={1};id=" + long() + ";password={2};name=" + long(), 201: "x?auth={0}&access_key={1}&token={2}&page=" + long(), 202: "token:{0},secret:{1},credential:{2}," + long()}
    rows += [(k, t.format(*kept[k])) for k, t in text.items()]
    rows += [(203, json.dumps({"name": long(), "aws_secret_access_key": kept[203][0], "x": [{"token": kept[203][1]}, {"password": kept[203][2], "note": long()}]}, separators=(",", ":")))]
    rows += [(300, ",".join(f"{long()}:{long()}" for _ in range(5000)))]
    found = {row["doc_id"]: row for row in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for k, values in kept.items():
        assert [s["value"] for s in found[k]["secrets"]] == values and found[k]["n_secrets"] == 3
    assert [s["position"] for s in found[200]["secrets"]] == [0, 1, 3] and found[200]["n_candidates"] == 5
    assert (found[300]["n_candidates"], found[300]["n_secrets"]) == (10_000, 0)
    assert {row["secrets"] for row in secrets.op8(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id in (200, 201, 202)").collect()} == {"0"}
    labels = {(row["value"], row["label"]) for row in secrets.label_by_evidence(found_candidates(spark, "api_key=" + kept[200][0] + ";id=" + kept[200][1])).collect()}
    assert labels == {(kept[200][0], 1.0)}


def found_candidates(spark, text):
    words = secrets.find_words(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    words = words.selectExpr("row", "source", "explode(words) as w").select("row", "source", "w.*")
    return secrets.with_features(secrets.find_candidates(words), secrets.dictionary(words))


def luhn_number(r):
    digits = [r.randint(0, 9) for _ in range(15)]
    total = sum(x if k % 2 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(digits))
    return "".join(map(str, digits)) + str(-total % 10)


def test_planted_secrets_are_found_and_decoys_are_not(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choices("theandionrlsm", k=r.randint(2, 9)))
    key = lambda: "".join(r.choices("0123456789abcdef", k=40))
    long = lambda: "".join(r.choices("theandion", k=r.randint(16, 24)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, planted = [], {}
    for k in range(600):
        text, kind = prose(r.randint(3, 60)), k % 6
        if kind == 0:
            planted[k] = key()
            text += r.choice((f' token = "{planted[k]}" ', f" password: {planted[k]} ", f' {{"api_key":"{planted[k]}"}} ')) + prose(5)
        elif kind == 1:
            text += f" {luhn_number(r)} " + prose(5)
        elif kind == 2:
            text += f" {long()} " + prose(5)
        elif kind == 3:
            text += f" {key()[:8]}-{key()[:4]}-{key()[:4]}-{key()[:4]}-{key()[:12]} " + prose(3)
        rows.append((k, text, "x"))
    frame = spark.createDataFrame([(*row, "clash", 1.0, 2) for row in rows], "doc_id long, text string, source string, value string, keyword double, row int").repartition(3)
    got = {row["doc_id"]: [s["value"] for s in row["secrets"]] for row in secrets.find_secrets(frame).collect()}
    assert {k: v for k, v in got.items() if v} == {k: [v] for k, v in planted.items()}
    forest_columns = [f for f in secrets.FEATURES if f not in secrets.EVIDENCE]
    assert "keyword" not in forest_columns and len(got) == 600


def test_candidates_are_all_runs(spark):
    r = random.Random(2)
    texts = {k: "".join(r.choices(["a1B2", "xyz", "/", "-", "_", " ", "\n", "=", '"', ";", "é", "+"], k=r.randint(0, 120))) for k in range(200)} | {200: None, 201: "", 202: "word " * 30_000 + "k" * 20_000}
    got = {row["doc_id"]: row["n_candidates"] for row in secrets.find_secrets(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {k: len(re.findall(r"[A-Za-z0-9+/_-]{16,}", t or "")) for k, t in texts.items()}
