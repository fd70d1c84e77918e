"""Each operator against a plain version on small tables with nulls, empty and long texts, ties, repeats, and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import tiktoken
import xxhash

from codeloom.llm import bpe, decontam, exact_dedup, langid, pii, secrets, simhash, token_counts, url_filter, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id string, seed long, words string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def texts():
    r = random.Random(5)
    line = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    base = line(60)
    out = [None, "", " ", "\t\n", "a", "a  b", "a b", "a\tb\r\nc", " a b ", base, base, base.replace(" ", "  "), base + " end", base.upper(), line(20_000), "x" * 30_000, "é😀ß ²Ⅷ １２ 中文\x85 it's we'll", "\x1c\x1d a", "one two", line(300)]
    return out + [line(r.randint(1, 80)) for _ in range(25)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k * 3 % 101, t, "en", "s", 1, True, "c", 7, "w") for k, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[9], (None, "a b", None, None, None, None, None, None, None)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def test_empty_tables_give_empty_results(spark, empty):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (token_counts.op1(empty), pii.op2(empty), langid.op3(empty), warc.op4(pages), simhash.op5(empty), bpe.op6(empty), decontam.op7(empty, items), secrets.op8(empty), exact_dedup.op9(empty), url_filter.op10(pages, labels)):
        assert out.collect() == []


def test_token_counts_are_those_of_the_best_segmentation(docs):
    path, split = bpe.vocabulary_path(), bpe.pre_tokeniser(bpe.default_pattern())
    ranks = bpe.vocabulary(path)

    def segmented(word, scores):
        key, best = word.encode(), [(0.0, 0, 0)]
        for i in range(1, len(key) + 1):
            best.append(max((best[j][0] + scores[key[j:i]], best[j][1] - 1, j) for j in range(max(0, i - 200), i) if key[j:i] in scores))
        i, out = len(key), []
        while i:
            out.append(key[best[i][2] : i])
            i = best[i][2]
        return out

    rows = rows_of(docs)
    words = Counter(w for _, text in rows for w in split.findall(text) if len(w) < 5000)
    prior, uses = token_counts.prior_scores(path), Counter()
    for w, n in words.items():
        for piece in segmented(w, prior):
            uses[ranks[piece]] += n
    short = docs.where("text is null or text not like 'xxxxx%'")
    assert token_counts.piece_uses(short, path, bpe.default_pattern()) == Counter({k: n for k, n in uses.items()})
    scores = token_counts.fitted_scores(path, uses)
    known = {w: len(segmented(w, scores)) for w in words}
    assert abs(sum(math.exp(x) for x in scores.values()) - 1) < 1e-6
    # a piece gains by the fit where the texts use it more than the prior expects, and else loses
    assert all((scores[k] > prior[k]) == (uses[ranks[k]] > math.exp(prior[k]) * sum(uses.values())) for k in scores)
    expected = Counter((k, sum(known[w] for w in split.findall(t)), len(split.findall(t))) for k, t in rows if all(len(w) < 5000 for w in split.findall(t)))
    for limit in (600_000, 50):
        got = Counter(tuple(row) for row in token_counts.count_tokens(docs, max_nodes=limit, uses=uses).collect())
        assert all(got[k] == n for k, n in expected.items()) and sum(got.values()) == len(rows)
    trie = token_counts.UnigramTrie(token_counts.automaton(path), max_nodes=1000)
    trie.total([f"w{k}" for k in range(20_000)])  # one text of distinct words
    assert len(trie.best) <= 1000 + 10


PII = "Mail Bob.x+1@mail-1.example.co.uk, a@b@c.de; a@b. ip 10.0.0.255 256.1.1.1 1.2.3.4.5 card 4111 1111-1111 1111, 4111 1111 1111 1112 call +1 (555) 010-9999. +12 +1((((( IBAN DE89 3704 0044 0532 0130 00 x"


def plain_spans(text):
    out = []
    for kind, pattern, holds in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) < 256 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ):
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if holds(m[0])]
    return out


def test_personal_data_is_what_the_plain_patterns_find(spark):
    r = random.Random(3)
    pieces = ["a", "b.c", "@", "@", ".", "-", " ", "12", "4111111111111111", "+", "1.2.3.4", "(", ")", "é", "x@y.zz", "+49 30 1234567"]
    cases = [None, "", PII, "1" * 5000, "a" * 20000 + "@", *("".join(r.choices(pieces, k=30)) for _ in range(400))]
    frame = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    for row in pii.op2(frame).collect():
        expected = plain_spans(cases[row["doc_id"]] or "")
        assert row["base_sha256"] == hashlib.sha256(",".join(expected).encode()).hexdigest()
        assert [s for s in row["spans"].split(",") if s and not s.startswith("iban")] == expected
    assert [k for k, *_ in pii.find_spans(PII)] == ["email", "email", "ip", "ip", "card", "phone", "iban"]
    scores = {k: s for k, _, _, s in pii.find_spans("card 4111111111111111") if k == "card"} | {"far": next(pii.find_spans("4111111111111111"))[3]}
    assert scores["card"] > scores["far"]


def test_context_words_decide_about_added_kinds_and_are_returned(spark):
    def account(country, length):  # a number of that country with right check digits
        body = "".join(str(k % 10) for k in range(length - 4))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        return f"{country}{check:02d}{body}"

    fitting, odd = account("DE", 22), account("QQ", 20)
    rows = [fitting, odd, f"bank account {odd}", f"order {fitting}", f"order {fitting} of bank x", "version 1.2.3.4", "server 1.2.3.4", None, "", "word " * 50_000 + "a@b.de " + "ip 1.2.3.4 " * 2]
    frame = spark.createDataFrame([*((k, x, "clash", 1, 2.0) for k, x in enumerate(rows)), (None, "a@b.de", "", 0, 0.0), (5, rows[5], "", 0, 0.0)], "doc_id long, text string, spans string, n_ip int, score double").repartition(2)
    got = {row["doc_id"]: row for row in pii.op2(frame).collect()}
    assert [got[k]["n_iban"] for k in range(5)] == [1, 0, 1, 0, 1]
    assert [float(got[k]["scores"].split(",")[-1]) for k in (0, 2, 5, 6)] == [0.75, 0.85, 0.2, 0.85]
    assert [got[k]["n_likely"] for k in (0, 5, 6, 7, 8)] == [1, 0, 1, 0, 0] and got[5]["n_ip"] == 1 and pii.op2(frame).count() == 12
    assert got[9]["spans"] == "email:250000:250006,ip:250010:250017,ip:250021:250028" and got[None]["n_email"] == 1


def test_language_is_found_and_strangers_are_rejected(spark):
    r = random.Random(1)
    made = {"xx": "aba bab abba baab aabb bab", "yy": "nono onon noon onno nnoo ono", "zz": "liri riri liil rill irli lir"}
    rows = [(k, " ".join(r.choices(made[lang].split(), k=r.randint(3, 200))), lang) for k in range(300) for lang in [r.choice(sorted(made))]]
    odd = [(1000, None, "xx"), (1001, "12 !? ", "xx"), (1002, "абв где жзи " * 30, None), (1003, "A", None), (None, "noon onno", "yy"), rows[0]]
    frame = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").repartition(3)
    out = langid.op3(frame).collect()
    by_id = {row["doc_id"]: row for row in out}
    assert len(out) == len(rows) + len(odd)
    held = [row for row in out if row["held_out"] and (row["doc_id"] or 0) < 1000 and row["doc_id"] is not None]
    assert held and all(by_id[k]["lang_pred"] == lang and not by_id[k]["rejected"] for k, _, lang in rows)
    assert [by_id[k]["lang_pred"] for k in (1000, 1001)] == ["und", "und"] and by_id[1002]["rejected"]
    assert all(0 <= row["score"] <= 1 for row in out)
    kept = {row["doc_id"] for row in langid.in_known_language(frame).collect()}
    assert not kept & {1000, 1001, 1002} and {k for k, _, _ in rows} <= kept


def test_kneser_ney_sums_to_one_over_seen_characters():
    import pandas as pd

    line = langid.characters("the cat and the hat and the bat")
    columns = langid.windows(line)
    grams = pd.DataFrame({f"c{k}": c.astype(np.int64) for k, c in enumerate(columns)}).groupby(["c0", "c1", "c2", "c3"]).size().rename("count").reset_index().assign(lang="x")
    model = langid.Model(["x"], langid.build_levels(grams, ["x"]), -20.0, np.zeros(1), np.zeros(3), np.zeros(3))
    seen = np.unique(line)
    for context in zip(*(c[:5] for c in columns[:3])):
        every = [np.full(len(seen), c, np.uint64) for c in context] + [seen]
        total = np.exp(model.log_probabilities(every).astype(float)).sum()
        weight = model.levels[0].log_back[0, 0]  # what the orders hand down in the end is spread over the whole alphabet
        for order in (2, 3, 4):
            at, hit = langid.find(model.levels[order - 1].contexts, langid.gram_hashes([np.array([c], np.uint64) for c in context[4 - order :]]))
            weight += model.levels[order - 1].log_back[at[0], 0] if hit[0] else 0.0
        assert abs(total + np.exp(weight) * (1 - len(seen) / langid.ALPHABET) - 1) < 1e-4


def test_warc_round_trip(spark, tmp_path):
    r = random.Random(2)
    page = "<p>" + "".join(r.choice("abcdef <>") for _ in range(1500))
    rows = [(k, f"http://h/{k}\r\nX: y", page + str(k % 7)) for k in range(40)] + [(100, None, None), (101, "u", "short"), (102, "u", "short"), (None, "u", page + "1"), (103, "é", "é" * 600), (104, "", "é" * 600), (39, "again", page + str(39 % 7))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("url", "url").repartition(3)
    folder = f"file://{tmp_path}/warc"
    archives = warc.write_warc(pages, folder, archive_bytes=4_000)
    got = warc.read_warc(archives, folder, with_payload=True).collect()
    assert archives.count() > 3 and len(got) == len(rows)
    last = defaultdict(int)
    for k, _, html in rows:
        if k is not None and len((html or "").encode()) >= 1000:
            last[html] = max(last[html], k)
    html_of = defaultdict(list)
    for k, _, html in rows:
        html_of[k].append(html or "")
    for row in got:
        payload = html_of[row["page_id"]][0].encode()
        assert (row["payload_bytes"], row["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
        refers = last.get(payload.decode())
        revisit = row["page_id"] is not None and refers is not None and row["page_id"] != refers
        assert (row["record_type"], row["refers_to"]) == (("revisit", refers) if revisit else ("response", None))
        assert (bytes(row["payload"]) if row["payload"] is not None else None) == (None if revisit else payload)
    names = [warc.parsed(raw)[6] for row in archives.collect() for raw in warc.read_archive(folder, row["archive"])]
    assert len(set(names)) == len(rows)
    key = lambda row: (str(row["page_id"]), row["sha1"], row["record_type"], row["refers_to"], row["refers_url"])
    assert sorted(map(key, warc.plan_records(pages).collect())) == sorted(map(key, warc.plan_records(pages, broadcast_rows=-1).collect()))
    first = (tmp_path / "warc" / archives.first()["archive"]).read_bytes()
    assert first[:4] == (0x184D2A5D).to_bytes(4, "little")


def test_warc_with_a_third_of_one_payload_matches_sql(spark, tmp_path):
    import duckdb

    from codeloom.llm.oracles import OP4

    body = "<p>" + "one page in three " * 80
    rows = [(k, f"http://h/{k}", body if k % 3 == 0 else f"{body}{k % 50}" if k % 3 == 1 else f"short {k % 4}", "x", 1) for k in range(3000)]
    spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string, n int").repartition(6).write.parquet(f"{tmp_path}/pages")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    got = warc.op4(spark.read.parquet(f"{tmp_path}/pages"))
    expected = con.execute(f"SELECT {', '.join(got.columns)} FROM ({OP4})").fetchall()
    assert sorted(map(str, expected)) == sorted(str(tuple(row)) for row in got.collect())
    assert sum(row[3] == "revisit" for row in expected) > 1900


def plain_fingerprint(text, words=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    shingles = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, radius=3):
    root = {k: k for k in prints}
    for a, b in combinations(sorted(prints), 2):
        if bin(prints[a] ^ prints[b]).count("1") <= radius:
            ra, rb = (next(x for x in [k] if True) for k in (a, b))
            while root[ra] != ra:
                ra = root[ra]
            while root[rb] != rb:
                rb = root[rb]
            root[max(ra, rb)] = min(ra, rb)

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    return {k: top(k) for k in prints}


def test_simhash_groups(spark, docs):
    r = random.Random(4)
    own = {k: t for k, t in rows_of(docs) if k is not None}
    base = " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(400)).split()
    for k in range(200, 240):  # near copies of one text
        w = list(base)
        w[r.randrange(400)] = "changed"
        own[k] = " ".join(w)
    frame = spark.createDataFrame([*own.items(), (None, "a b")], "doc_id long, text string").repartition(3)
    prints = {k: plain_fingerprint(t) for k, t in own.items()}
    expected = {(k, f"{prints[k]:016x}", c) for k, c in plain_components(prints).items()}
    got = {(row["doc_id"], row["fingerprint"], row["component_id"]) for row in simhash.op5(frame).collect() if row["doc_id"] is not None}
    assert got == expected
    tiled = simhash.simhash_groups(frame, tile_rows=4).collect()
    assert {(row["doc_id"], row["component_id"]) for row in tiled if row["doc_id"] is not None} == {(k, c) for k, _, c in expected}


def test_simhash_links_texts_and_not_doc_ids(spark):
    r = random.Random(9)
    a, b, c = (" ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(300)) for _ in range(3))
    rows = [(5, a), (5, b), (6, a), (9, b), (5, c), (3, c), (5, None)]
    prints = [plain_fingerprint(t or "") for _, t in rows]
    near = plain_components(dict(enumerate(prints)))
    expected = sorted((k, f"{p:016x}", min(rows[m][0] for m in near if near[m] == near[n])) for n, ((k, _), p) in enumerate(zip(rows, prints)))
    got = simhash.op5(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == expected and {x[2] for x in expected} == {3, 5}


def test_bit_sliced_links_connect_what_brute_force_connects():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, radius = int(rng.integers(0, 200)), int(rng.integers(0, 8))
        values = rng.integers(0, 2**63, 4, dtype=np.uint64)[rng.integers(0, 4, n)]
        for _ in range(6):
            flip = rng.random(n) < 0.4
            values[flip] ^= np.uint64(1) << rng.integers(0, 64, flip.sum()).astype(np.uint64)
        runs = np.sort(rng.integers(0, 9, n))
        links = zip(*(x.tolist() for x in simhash.bucket_links(values, runs, radius)))

        def roots(pairs):
            root = list(range(n))

            def top(x):
                while root[x] != x:
                    x = root[x]
                return x

            for a, b in pairs:
                root[max(top(a), top(b))] = min(top(a), top(b))
            return [top(x) for x in range(n)]

        near = [(a, b) for a, b in combinations(range(n), 2) if runs[a] == runs[b] and bin(int(values[a] ^ values[b])).count("1") <= radius]
        assert roots(links) == roots(near)


def test_bpe_matches_the_library(docs):
    ranks, pattern = bpe.vocabulary(bpe.vocabulary_path()), bpe.default_pattern()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for chunk, overlap in ((32_768, 512), (40, 12)):
        got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_texts(docs, chunk=chunk, overlap=overlap).collect())
        expected = Counter()
        for doc_id, text in rows_of(docs):
            ids = library.encode_ordinary(text)
            expected[(doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
        assert got == expected
    ids = bpe.encode_texts(docs, with_ids=True, chunk=500).where("doc_id is not null").collect()
    texts_ = dict(rows_of(docs))
    assert all(r["ids"] == library.encode_ordinary(texts_[r["doc_id"]]) for r in ids)


def test_decontamination_tolerates_substitutions_and_leaves_clean_texts(spark):
    r = random.Random(7)
    vocabulary = ["".join(r.choices("abcdefghijklm", k=5)) for _ in range(3000)]
    line = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [line(n) for n in (40, 25, 13, 11, 8, 5, 4)] + [line(40)]
    docs, expected = [], {}
    for k in range(60):
        text, item = line(r.randint(0, 200)), k % 9
        if k % 2 and item < 6:
            piece = list(items[item])
            if item < 2 and k % 3:
                piece[7] = "other"  # one word substituted
            at = r.randrange(len(text) + 1)
            text[at:at] = piece
            expected[k] = str(item)
        if k % 2 and item == 8:
            text[3:3] = items[0][5:25]  # part of an item
            expected[k] = "0"
        docs.append((k, ", ".join(text).upper() if k % 4 == 1 else "\n".join(text), "clash"))
    docs += [(100, None, ""), (101, "", ""), (102, " ".join(items[6]), ""), (None, " ".join(items[1]), ""), docs[1]]
    expected[None] = "1"
    frame = spark.createDataFrame(docs, "doc_id long, text string, seed string").repartition(3)
    bench = spark.createDataFrame([*((k, " ".join(x)) for k, x in enumerate(items)), (50, None), (0, " ".join(items[0]))], "item_id long, text string")
    got = decontam.op7(frame, bench).collect()
    assert len(got) == len(docs)
    assert {row["doc_id"]: row["item_ids"] for row in got if row["contaminated"]} == expected
    assert {row["doc_id"] for row in decontam.clean_rows(frame, bench).collect()} == {d[0] for d in docs} - expected.keys()


def test_secrets_are_told_from_words(spark):
    r = random.Random(9)
    long = lambda: "".join(r.choices("theandion", k=20))
    key = lambda: "".join(r.choices("0123456789abcdef", k=40))
    rows = [(k, f"some {long()} words and {long()}", "src") for k in range(60)] + [(k, f'the token = "{key()}" is here {long()}', "src") for k in range(60, 100)]
    rows += [(200, None, None), (201, "", "x"), (202, "api_key=" + key(), None), (None, f'secret: "{key()}"', "s"), rows[70]]
    got = secrets.op8(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    assert len(got) == len(rows)
    found = {row["doc_id"] for row in got if row["n_secrets"]}
    assert found == {*range(60, 100), 202, None} and next(row for row in got if row["doc_id"] == 61)["secrets"] == "3"
    assert {row["n_secrets"] for row in secrets.op8(spark.createDataFrame(rows[:20], "doc_id long, text string, source string")).collect()} == {0}


def test_exact_groups(spark, docs):
    body = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    rows = rows_of(docs)
    groups = defaultdict(list)
    for k, t in rows:
        groups[body(t)].append(k)
    least = {b: min((k for k in ks if k is not None), default=None) for b, ks in groups.items()}
    for limit, hot_rows in ((1 << 26, 64), (3000, 64), (1 << 26, 0), (3000, 2)):
        got = exact_dedup.exact_groups(docs, limit, hot_rows).collect()
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == Counter((k, least[body(t)], len(groups[body(t)]), hashlib.sha256(body(t).encode()).hexdigest()) for k, t in rows)
        assert sum(r["kept"] for r in got) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    kept = exact_dedup.kept_rows(docs)
    assert kept.columns == docs.columns and sorted(body(r["text"] or "") for r in kept.collect()) == sorted(groups)


def test_trie_spills_by_subtree():
    r = random.Random(6)
    keys = ["".join(r.choices("ab", k=r.randint(0, 12))).encode() for _ in range(3000)]
    for limit in (1 << 20, 20_000, 2_000):
        trie = exact_dedup.PatriciaTrie(lambda a, b: (min(a[0], b[0]), a[1] + b[1]), limit)
        for k, key in enumerate(keys):
            trie.add(key, (k, 1))
        expected = Counter((keys.index(key), n) for key, n in Counter(keys).items())
        assert Counter(trie.items()) == Counter((keys[k], (k, n)) for k, n in expected)


def test_url_rules_and_reputation(spark):
    urls = [None, "", "nothing", "http://EXAMPLE.net/en/1?x", "x://a.example.net/enx", "http://net", "http://net/", "http://org/fr/", "http://a.org/fr?/", "https://b.example.com/de/#x", "https://b.example.com?/de/", "http://good.com/1", "http://bad.com/a/2", "//x"]
    urls += [f"http://bad.com/{k}" for k in range(100, 160)] + [f"http://good.com/{k}" for k in range(200, 260)]
    pages = spark.createDataFrame([*enumerate(urls), (None, "http://net/x")], "page_id long, url string").repartition(3)
    labels = spark.createDataFrame([(k, 0, 0) for k in range(100, 160)] + [(k, 1, 0) for k in range(200, 260)] + [(201, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {row["page_id"]: row for row in url_filter.op10(pages, labels).collect()}
    assert len(got) == len(urls) + 1
    pick = lambda k: (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"])
    assert [pick(k) for k in range(3)] == [("", "", None, "allow")] * 3
    assert pick(3) == ("example.net", "/en/1", "example.net/en/", "allow") and pick(4) == ("a.example.net", "/enx", "net/", "block")
    assert pick(5)[2:] == (None, "allow") and pick(6)[2:] == ("net/", "block") and pick(7)[2:] == ("org/fr/", "allow") and pick(8)[2] is None
    assert pick(9)[2:] == ("example.com/de/", "block") and pick(10)[1:3] == ("", None)
    assert pick(11)[3] == "allow" and pick(12)[3] == "block" and got[None]["rule"] == "net/"
    bounds = {r["host"]: (r["rate"], r["bound"]) for r in url_filter.host_reputation(url_filter.page_outcomes(pages, labels)).collect()}
    assert bounds["bad.com"][1] > 0.5 > bounds["good.com"][0] and not math.isnan(bounds["good.com"][1])
