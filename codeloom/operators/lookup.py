"""Symbol lookup for tables of requests: by name, prefix, id; snippets of source text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.schema import NODE_COLUMNS
from codeloom.sources.tables import written


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Names in sorted order that a prefix meets at once, and matches that a message lists.
NAME_BLOCK, LISTED = 1024, 20
#: Lines for each mark of a line index; ranges of lines (some 100 bytes each) up to which they are broadcast to the files, and the files
#: that there must be for each of them.
LINES_PER_MARK, BROADCAST_RANGES, FILES_PER_RANGE = 64, 200_000, 16


def folded(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def like_prefix(argument: Column) -> Column:
    """The argument as a LIKE pattern with a trailing %; ``_`` and ``%`` in it are wildcards, a backslash is itself."""
    return F.concat(F.replace(argument, F.lit("\\"), F.lit("\\\\")), F.lit("%"))


def find_symbol(nodes: DataFrame, requests: DataFrame, exact: bool = True) -> DataFrame:
    """Requests (request, name, kind or null) -> the matching nodes with their request.

    ``exact``: equal names. Else the name begins with the argument, A-Z of either case, ``_`` and ``%`` being wildcards: see ``prefix_matches``.
    """
    kind_fits = F.col("kind_").isNull() | (F.col("kind") == F.col("kind_"))
    asked = requests.select("request", F.col("name").alias("name_"), F.col("kind").alias("kind_"))
    if not exact:
        asked = asked.join(prefix_matches(nodes.select("id", "name"), asked.select(F.col("name_").alias("pattern"))), F.col("name_") == F.col("pattern"))
        return asked.join(nodes, "id").where(kind_fits).select("request", *NODE_COLUMNS)
    return nodes.join(asked, F.col("name") == F.col("name_")).where(kind_fits).select("request", *NODE_COLUMNS)


def prefix_matches(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """Names (id, name) and patterns (pattern) -> (pattern, id) of the names that begin with what a distinct pattern stands for.

    Names are sorted once, with both ends of each pattern's literal letters among them, so a pattern is an interval of places; it meets the
    blocks of names that it covers, and the whole pattern decides. Name rows grow with the number of leading ``_`` that patterns differ in, not
    with the patterns' lengths; a pattern without letters covers all names, as it has to.
    """
    spark = names.sparkSession
    asked = written(patterns.where("pattern is not null").distinct().select("pattern", F.length(F.regexp_extract("pattern", "^(_*)", 1)).alias("skip"), folded(F.regexp_extract("pattern", "^_*([^_%]*)", 1)).cast("binary").alias("literal")), "patterns")
    skips = [r["skip"] for r in asked.select("skip").distinct().orderBy("skip").collect()]  # no more than the longest pattern has characters
    order, none = ["skip", "key", "side", "id"], F.lit(None).cast("string")
    tails = names.where("name is not null").withColumn("skip", F.explode(F.array(*map(F.lit, skips)).cast("array<int>"))).where("skip <= length(name)")
    events = tails.select("skip", folded(F.expr("substring(name, skip + 1, length(name))")).cast("binary").alias("key"), F.lit(1).alias("side"), "id", "name", none.alias("pattern"))
    for side, key in ((0, F.col("literal")), (-1, F.concat("literal", F.lit(b"\xff")))):  # no text holds the byte 0xFF
        events = events.unionByName(asked.select("skip", key.alias("key"), F.lit(side).alias("side"), none.alias("id"), none.alias("name"), "pattern"))
    dealt = events.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "sorted-names")
    n, before, total = (F.col("side") == 1).cast("long"), [], 0
    for row in dealt.groupBy("part").agg(F.sum(n).alias("n")).orderBy("part").collect():  # a row per range
        before.append((row["part"], total))
        total += row["n"]
    starts = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    # the number of names before each row, over all ranges
    place = F.sum(n).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - n + F.col("before")
    placed = written(dealt.join(starts, "part").select("id", "name", "pattern", "side", place.alias("place")), "placed-names")
    ends = placed.where("side < 1").groupBy("pattern").agg(F.max(F.when(F.col("side") == 0, F.col("place"))).alias("low"), F.max(F.when(F.col("side") == -1, F.col("place"))).alias("high"))
    covered = ends.where("low < high").withColumn("block", F.explode(F.expr(f"sequence(low div {NAME_BLOCK}, (high - 1) div {NAME_BLOCK})")))
    blocks = placed.where("side = 1").select("id", "name", "place", F.expr(f"place div {NAME_BLOCK}").alias("block"))
    met = covered.join(blocks, "block").where("low <= place and place < high")
    return met.where(F.like(folded(F.col("name")), like_prefix(folded(F.col("pattern"))))).select("pattern", "id")


def node_matches(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (request, node_id, name, kind) -> the nodes that each may mean, a row each; an id wins over a name."""
    has_id = F.coalesce(F.col("node_id") != "", F.lit(False))
    has_name = F.coalesce(F.col("name") != "", F.lit(False))
    by_id = requests.where(has_id).select("request", F.col("node_id").alias("wanted")).join(nodes, F.col("wanted") == F.col("id")).select("request", *NODE_COLUMNS)
    return by_id.unionByName(find_symbol(nodes, requests.where(~has_id & has_name).select("request", "name", "kind")))


def resolve_node(nodes: DataFrame, requests: DataFrame, listed: int = LISTED) -> DataFrame:
    """Requests (request, node_id, name, kind) -> (request, status, id, n_matches, message), one row each.

    status: ok, not_found, nothing_given or ambiguous; the message of an ambiguous one lists its first ``listed`` matches by file and name and
    says how many more there are (``node_matches`` gives them all as rows).
    """
    has_id = F.coalesce(F.col("node_id") != "", F.lit(False))
    has_name = F.coalesce(F.col("name") != "", F.lit(False))
    matches = node_matches(nodes, requests)
    counted = matches.groupBy("request").agg(F.count(F.lit(1)).alias("n_matches"), F.min("id").alias("id"))
    order = Window.partitionBy("request").orderBy("file_path", "name", "kind", "id")
    shown = F.format_string("%s (%s in %s)", "name", "kind", "file_path")
    first = matches.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= listed).groupBy("request").agg(F.array_sort(F.collect_list(F.struct("rank", shown.alias("shown")))).alias("found"))
    n = F.coalesce("n_matches", F.lit(0))
    status = F.when(~has_id & ~has_name, "nothing_given").when(n == 0, "not_found").when(n > 1, "ambiguous").otherwise("ok")
    more = F.when(n > listed, F.format_string(", and %d more", n - listed)).otherwise("")
    text = F.when(status == "ambiguous", F.concat(F.array_join("found.shown", ", "), more)).when(status == "not_found", F.when(has_id, F.col("node_id")).otherwise(F.col("name"))).otherwise("")
    out = requests.join(counted, "request", "left").join(first, "request", "left")
    return out.select("request", status.alias("status"), F.when(status == "ok", F.col("id")).alias("id"), n.alias("n_matches"), text.alias("message"))


def line_index(files: DataFrame, every: int = LINES_PER_MARK) -> DataFrame:
    """Files (path, content) -> (path, n_lines, every, marks): the byte at which every ``every``-th line starts, then the length with a last newline.

    To be stored beside the files: it holds 8 bytes for ``every`` lines and serves any number of snippets. Lines are cut at newlines only; null is
    empty, one line. Contents are valid UTF-8 and stay where they are; only the bytes of each block of lines are shuffled, to be summed up by file.
    """
    lines = files.select("path", F.split(F.coalesce("content", F.lit("")), "\n").alias("lines_"))
    size = lambda at: F.aggregate(F.slice("lines_", at, F.lit(every)), F.lit(0).cast("long"), lambda sum_, line: sum_ + F.octet_length(line) + 1)
    n = F.size("lines_")
    blocks = lines.select("path", n.alias("n_"), F.posexplode(F.transform(F.sequence(F.lit(1), n, F.lit(every)), size)).alias("block_", "bytes_"))
    before = Window.partitionBy("path").orderBy("block_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = blocks.withColumn("end_", F.sum("bytes_").over(before)).groupBy("path").agg(F.first("n_").alias("n_lines"), F.array_sort(F.collect_list("end_")).alias("ends_"))
    return ends.select("path", "n_lines", F.lit(every).alias("every"), F.concat(F.array(F.lit(0).cast("long")), "ends_").alias("marks"))


def snippets(files: DataFrame, ranges: DataFrame, index: DataFrame | None = None, broadcast_ranges: int = BROADCAST_RANGES) -> DataFrame:
    """Files (path, content) and ranges (request, path, start_line, end_line, padding) -> (request, path, first, last, snippet).

    Lines are cut at newlines only; first and last are the 1-based lines after padding, clamped to the file. A start beyond the file
    gives an empty snippet and a last line below the first. Ranges that repeat a request and path are taken once; those of missing files give no row.

    ``index`` is the ``line_index`` of the files, made here for the files asked for where there is none. It turns a range into bytes, and a snippet is
    cut out of its file by these: lines are never rows. If few files are asked for (``broadcast_ranges`` different ranges at most, and
    FILES_PER_RANGE files for each), the ranges go to the files, whose contents stay where they are. Else both are joined by path, which moves the
    contents once, unless they are bucketed by it: a request for most files costs the same share of the input at every size. Equal ranges of a
    file are cut once.
    """
    few = min(broadcast_ranges, files.count() // FILES_PER_RANGE)
    if index is None:
        paths = written(ranges.select("path").distinct(), "paths")
        index = line_index(files.join(F.broadcast(paths), "path", "left_semi") if paths.count() <= few else files)
    first = F.greatest(F.lit(0), F.col("start_line") - 1 - F.col("padding")) + 1
    last = F.least(F.col("n_lines") - 1, F.col("end_line") - 1 + F.col("padding")) + 1
    every = F.col("every").cast("int")
    block = lambda line: F.floor((F.col(line) - 1) / every).cast("int")
    clamped = ranges.join(index, "path").withColumn("first", first.cast("int")).withColumn("last", last.cast("int"))
    start, stop = F.get("marks", block("first")), F.get("marks", block("last") + 1)
    found = F.col("first") <= F.col("last")
    placed = written(clamped.select("request", "path", "first", "last", F.when(found, start).alias("from_"), F.when(found, stop - start - 1).alias("size_"), ((F.col("first") - 1) % every + 1).alias("skip_")).distinct(), "ranges")
    spots = placed.where("from_ is not null").select("path", "first", "last", "from_", "size_", "skip_").distinct()
    spots = F.broadcast(spots) if placed.count() <= few else spots.hint("merge")
    part = F.substring(F.coalesce("content", F.lit("")).cast("binary"), (F.col("from_") + 1).cast("int"), F.col("size_").cast("int")).cast("string")
    text = F.array_join(F.slice(F.split(part, "\n"), F.col("skip_"), F.col("last") - F.col("first") + 1), "\n")
    cut = files.join(spots, "path").select("path", "first", "last", text.alias("text_"))
    return placed.join(cut, ["path", "first", "last"], "left").select("request", "path", "first", "last", F.coalesce("text_", F.lit("")).alias("snippet"))


def find_symbol_with_snippet(nodes: DataFrame, files: DataFrame, requests: DataFrame, exact: bool = True, padding: int = 0, index: DataFrame | None = None) -> DataFrame:
    """``find_symbol`` with each symbol's source text; null where the file is missing. ``index`` is the ``line_index`` of the files, if there is one."""
    found = find_symbol(nodes, requests, exact)
    ranges = found.select(F.col("id").alias("request"), F.col("file_path").alias("path"), "start_line", "end_line", F.lit(padding).alias("padding")).distinct()
    text = snippets(files, ranges, index).select(F.col("request").alias("id"), "snippet")
    return found.join(text, "id", "left").select("request", *NODE_COLUMNS, "snippet")


#: Columns that answers are read by, the most significant first: the request, then steps from it, then place and name.
READING_ORDER = ("request", "seed_id", "depth", "file_path", "path", "importer", "start_line", "name", "from_name", "source_id", "target_id", "from_id", "to_id", "relationship_type", "id")


def in_reading_order(answers: DataFrame, *first: str) -> DataFrame:
    """``answers`` of any lookup, neighbour, file view or traversal, sorted for reading: by ``first``, then by what it has of READING_ORDER.

    Operators give rows in no order, as a global sort costs a shuffle of every row; this is for what a person or a page of results reads.
    """
    return answers.orderBy(*first, *(c for c in READING_ORDER if c in answers.columns and c not in first))
