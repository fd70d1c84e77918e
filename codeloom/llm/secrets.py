"""Secret scans: candidate strings by shape, false positives removed by a random forest; DataFrame functions and Spark ML only."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import written

LEAST_LENGTH = 16
#: Labelled findings of each class that the forest learns from, at most; by hash of the value.
FIT_FINDINGS = 4000
#: A candidate, and what ends the text that belongs to it.
RUN, SEPARATOR = f"[A-Za-z0-9+/_-]{{{LEAST_LENGTH},}}", "[;,&|(){}<>\\[\\]]"
TREES, DEPTH, SEED = 20, 6, 7
KEYWORDS = "(?i)(token|secret|passw(or)?d|passwd|api_?key|access_?key|private_?key|auth|credential)"
#: A word of a sentence.
ORDINARY = "^[A-Za-z]{2,15}[.,;:]?$"
ASSIGNED = KEYWORDS + "\\W{0,3}\\s*[=:]"
HARMLESS = "(?i)(sha(1|256)?|md5|commit|checksum|digest|hash|uuid|revision|http|www|href|src)"
PATHS = "(?i)(\\.env|conf|config|\\.ya?ml|\\.ini|secret|credential|deploy)"
FEATURES = ("length", "digits", "upper", "transitions", "distinct", "coverage", "ordinary", "keyword", "harmless", "path")
#: Features that ``label_by_evidence`` looks at; a forest that learns from its labels does without them.
EVIDENCE = ("keyword",)


def find_words(docs: DataFrame) -> DataFrame:
    """(doc_id, text, source, ...) -> (row, doc_id, source, words), one row per input row.

    ``words`` are those with a run of at least LEAST_LENGTH characters of keys, each with its number, the two words before and the one after.
    """
    words = F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+")
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", source.alias("source"), words.alias("words"))
    word = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    long = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: (F.length(F.get("words", i)) >= LEAST_LENGTH) & F.get("words", i).rlike(RUN))
    laid = F.transform(long, lambda i: F.struct(i.alias("index"), word(i).alias("word"), word(i - 2).alias("before2"), word(i - 1).alias("before"), word(i + 1).alias("after")))
    return rows.select("row", "doc_id", "source", laid.alias("words"))


def find_candidates(words: DataFrame) -> DataFrame:
    """(row, source, index, word, before2, before, after) -> (row, source, index, position, value, lead, key_before, ...), one row per run.

    Every run of a word is a candidate; ``position``: its number in the word. ``lead`` is what stands just before it since the last SEPARATOR,
    the run before included if nothing else separates them. The words before count for the runs up to the word's first separator
    after a letter or digit. What the words before say is found once per word, so a text without blanks costs no square of its length.
    """
    before = F.concat_ws(" ", "before2", "before")
    said = words.select("row", "source", "index", "word", before.rlike(KEYWORDS).alias("key_before"), before.rlike(HARMLESS).alias("harmless_before"), before.rlike(ASSIGNED).alias("assigned_before"), F.right(before, F.lit(40)).alias("tail"), (F.size(F.filter(F.array("before2", "before", "after"), lambda w: w.rlike(ORDINARY))) / 3).alias("ordinary"))
    runs, gaps, none = F.regexp_extract_all("word", F.lit(RUN), F.lit(0)), F.split("word", RUN, -1), F.array(F.lit(""))
    cut = F.transform(gaps, lambda gap, k: F.when(k == 0, gap.rlike("(?s)[A-Za-z0-9].*" + SEPARATOR)).otherwise(gap.rlike(SEPARATOR)))
    laid = F.arrays_zip(runs.alias("value"), F.slice(gaps, 1, F.size(runs)).alias("gap"), F.slice(F.concat(none, runs), 1, F.size(runs)).alias("run_before"), F.slice(F.concat(none, gaps), 1, F.size(runs)).alias("gap_before"))
    cuts = said.select("*", F.array_position(cut, True).alias("cut"), laid.alias("laid")).drop("word")  # once per word, before its runs are rows
    each = cuts.select("*", F.posexplode("laid").alias("position", "c")).drop("laid").select("*", "c.*").drop("c")
    whole = F.when(F.col("gap").rlike(SEPARATOR), F.col("gap")).otherwise(F.concat("gap_before", "run_before", "gap"))
    first = (F.col("cut") == 0) | (F.col("position") + 1 < F.col("cut"))
    kept = [(first & F.col(c)).alias(c) for c in ("key_before", "harmless_before", "assigned_before")]
    lead = F.regexp_extract(whole, f"(?s)([^{SEPARATOR[1:]}*)$", 1)
    return each.select("row", "source", "index", "position", "value", lead.alias("lead"), "ordinary", *kept, F.when(first, F.col("tail")).otherwise("").alias("tail"))


def trigrams(value: Column) -> Column:
    text = F.lower(value)
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - 2)), lambda i: F.substring(text, i, F.lit(3)))
    return F.filter(every, lambda g: g.rlike("^[a-z]{3}$"))


def dictionary(words: DataFrame) -> list[int]:
    """Three-letter sequences of the ordinary words beside those with candidates, as 26 * 26 numbers (the first two letters) of 26 bits (the third)."""
    beside = F.filter(F.array("before2", "before", "after"), lambda w: w.rlike(ORDINARY))
    grams = words.select(F.explode(beside).alias("word")).select(F.explode(trigrams(F.col("word"))).alias("gram"))
    code = lambda k: F.ascii(F.substring("gram", k, 1)) - ord("a")
    bits = grams.select((code(1) * 26 + code(2)).alias("pair"), F.expr("shiftleft(1, ascii(substring(gram, 3, 1)) - 97)").alias("bit"))
    out = [0] * (26 * 26)
    for row in bits.groupBy("pair").agg(F.bit_or("bit").alias("bits")).collect():  # 676 rows at most, by their form
        out[row["pair"]] = row["bits"]
    return out


def coverage(value: Column, grams_known: list[int]) -> Column:
    """The share of the value's three-letter sequences that are in the dictionary; 0 without any."""
    table = F.lit(grams_known)
    code = lambda g, k: F.ascii(F.substring(g, k, 1)) - ord("a")
    known = lambda g: F.call_function("shiftright", F.get(table, code(g, 1) * 26 + code(g, 2)), code(g, 3)).bitwiseAND(F.lit(1))
    grams = trigrams(value)
    return F.when(F.size(grams) > 0, F.aggregate(grams, F.lit(0), lambda n, g: n + known(g)) / F.size(grams)).otherwise(0.0)


def with_features(candidates: DataFrame, grams_known: list[int]) -> DataFrame:
    """Adds FEATURES (double), ``assigned`` and ``prose`` to what find_candidates gives. Row by row: no join, so no value is hot."""
    value, n = F.col("value"), F.length("value")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    key = F.regexp_extract("lead", "(?s)^(.*[=:])", 1)
    assigned = F.col("assigned_before") | F.concat_ws(" ", "tail", "lead").rlike(ASSIGNED)
    keyword = F.col("key_before") | key.rlike(KEYWORDS)
    prose = F.col("lead").rlike("^[(\"'\\[]*$") & ~F.col("tail").rlike("[=:]\\W*$") & ~keyword
    changes = "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"
    flags = {"keyword": keyword, "harmless": F.col("harmless_before") | key.rlike(HARMLESS), "path": F.coalesce(F.col("source").rlike(PATHS), F.lit(False))}
    shapes = {"length": n.cast("double"), "digits": share("[0-9]"), "upper": share("[A-Z]"), "transitions": share(changes), "distinct": F.size(F.array_distinct(F.split(value, ""))) / n, "coverage": coverage(value, grams_known)}
    return candidates.withColumns(shapes | {k: v.cast("double") for k, v in flags.items()} | {"assigned": assigned, "prose": prose})


def label_by_evidence(findings: DataFrame) -> DataFrame:
    """Labelled findings, by what is no feature of the value's own: its assignment, its place in a sentence, checksums and standard forms.

    0: a number that passes Luhn's check, a UUID, or a run in prose (no key, no assignment, no key word near); 1: assigned to a key word.
    Others drop out.
    """
    number = F.col("value").rlike("^[0-9]{13,19}$") & F.coalesce(F.call_function("luhn_check", F.col("value")), F.lit(False))
    uuid = F.col("value").rlike("(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    label = F.when(number | uuid | F.col("prose"), 0.0).when(F.col("assigned"), 1.0)
    return findings.withColumn("label", label).where("label is not null")


def fit_forest(labelled: DataFrame, features: tuple[str, ...] = FEATURES, fit_findings: int = FIT_FINDINGS) -> Model | None:
    """A forest over ``features`` from a bounded sample of each class; None if a class has no finding.

    A value counts once in a class, with the largest of each feature; the sample lies in one sorted partition, so the same
    findings give the same forest in every run.
    """
    values = labelled.groupBy("label", "value").agg(*(F.max(c).alias(c) for c in features))
    parts = [values.where(F.col("label") == k).orderBy(F.xxhash64("value"), "value").limit(fit_findings) for k in (0.0, 1.0)]
    sample = written(parts[0].unionByName(parts[1]), "labelled-findings").coalesce(1).sortWithinPartitions("label", "value")
    if sample.select("label").distinct().count() < 2:
        return None
    made = VectorAssembler(inputCols=list(features), outputCol="features").transform(sample)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird").fit(made)


def scored(findings: DataFrame, forest: Model | None, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Adds ``probability``; without a forest the evidence alone decides."""
    if forest is None:
        return findings.withColumn("probability", F.when((F.col("keyword") == 1) & (F.col("digits") > 0), 1.0).otherwise(0.0))
    made = VectorAssembler(inputCols=list(features), outputCol="features").transform(findings)
    return forest.transform(made).withColumn("probability", vector_to_array("probability")[1])


def find_secrets(docs: DataFrame, labelled: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """(doc_id, text[, source], ...) -> (doc_id, n_candidates, n_secrets, secrets: array of (index, position, value, probability)).

    One row per input row. ``index``: number of the word, ``position``: of the run in the word, from 0. ``labelled`` findings (FEATURES, value,
    label) train the forest; without them, those that ``label_by_evidence`` marks in ``docs``. Null and empty texts have no candidate; rows
    without doc_id and repeated rows are judged one by one. Further columns are ignored.
    """
    rows = written(find_words(docs), "secret-words")
    words = rows.where(F.size("words") > 0).select("row", "source", F.explode("words").alias("w")).select("row", "source", "w.*")
    each = written(find_candidates(words), "secret-candidates")
    findings = written(with_features(each, dictionary(words)), "secret-findings")
    features = FEATURES if labelled is not None else tuple(f for f in FEATURES if f not in EVIDENCE)
    forest = fit_forest(labelled if labelled is not None else label_by_evidence(findings), features)
    secret = F.when(F.col("probability") >= least, F.struct("index", "position", "value", "probability"))
    by_row = scored(findings, forest, features).select("row", secret.alias("s")).groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("s")).alias("secrets"))
    nothing = F.array().cast("array<struct<index:int,position:int,value:string,probability:double>>")
    return rows.join(by_row, "row", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_candidates"), F.coalesce(F.size("secrets"), F.lit(0)).cast("long").alias("n_secrets"), F.coalesce("secrets", nothing).alias("secrets"))


def op8(docs: DataFrame) -> DataFrame:
    """(doc_id, n_candidates, n_secrets, secrets): the numbers of the words that hold secrets, comma-joined; a word's secrets are counted one by one."""
    found = find_secrets(docs)
    return found.select("doc_id", "n_candidates", "n_secrets", F.array_join(F.array_distinct(F.transform("secrets", lambda s: s["index"].cast("string"))), ",").alias("secrets"))
