"""Paths and globs as column expressions, and import resolution as joins on a listing of existing paths."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Existing paths (entry, is_dir), or a function that gives those of some entries (entry).
Listing = DataFrame | Callable[[DataFrame], DataFrame]


def dirname(path: Column) -> Column:
    cut = F.left(path, F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1)
    return F.when(~F.contains(path, F.lit("/")), path).when(cut == "", "/").otherwise(cut)


def stem(path: Column) -> Column:
    """The base name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), "(?<=.)\\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(F.substring_index(path, "/", -1), "(?<=.)(\\.[^.]*)$", 1)


def normalize_path(base: Column, relative: Column) -> Column:
    """Join and fold ``.``, ``..`` and empty parts; an absolute ``relative`` stands alone. Paths are taken apart only where such a part is left once each ``/./`` is one slash."""
    joined = F.regexp_replace(F.when(relative.startswith("/"), relative).otherwise(F.concat_ws("/", base, relative)), "/(\\./)+", "/")
    step = lambda acc, part: F.when(part.isin("", "."), acc).when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(part)))
    folded = F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), step), "/"))
    return F.when(joined.startswith("/") & ~joined.rlike("/\\.{0,2}(/|$)"), joined).otherwise(folded)


def glob_regex(glob: str) -> str:
    """A glob with ``**``, ``*``, ``?`` and ``{a,b}`` as an anchored regular expression."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        elif glob[k] == "{" and "}" in glob[k:]:
            end = glob.index("}", k)
            out, k = out + "(?:" + "|".join(map(re.escape, glob[k + 1 : end].split(","))) + ")", end + 1
        else:
            out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[k], re.escape(glob[k])), k + 1
    return f"^{out}$"


def filter_paths(df: DataFrame, root: str, globs: list[str], ignore: list[str], column: str = "path") -> DataFrame:
    """Rows whose path under ``root`` fits a glob and no ignored one."""
    inner = F.substring(F.col(column), len(root.rstrip("/")) + 2, 1 << 30)
    under = F.col(column).startswith(root.rstrip("/") + "/")
    fits = lambda patterns: inner.rlike("|".join(map(glob_regex, patterns))) if patterns else F.lit(False)
    return df.where(under & fits(globs) & ~fits(ignore))


def listing_with_dirs(paths: DataFrame) -> DataFrame:
    """(path) of files -> (entry, is_dir): the files and all folders above them, once."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    folders = paths.select(F.explode(above).alias("entry")).where("entry <> ''").distinct().select("entry", F.lit(True).alias("is_dir"))
    return paths.select(F.col("path").alias("entry"), F.lit(False).alias("is_dir")).distinct().unionByName(folders)


# What an emitted extension stands for in sources, in order of preference.
REMAPPED = ((".js", (".ts", ".tsx")), (".mjs", (".mts",)), (".cjs", (".cts",)))
PROBED = (".ts", ".tsx", "/index.ts", "/index.tsx")

#: Words of 64 bits in a filter of listed paths (some 17 MB as a broadcast when all are in use), and the bits that a path sets in one of them.
FILTER_WORDS, BITS_PER_PATH = 1 << 20, 6
#: Words in a row of the broadcast, one for each bit of a long.
BLOCK_WORDS = 64


def ancestors(path: Column) -> Column:
    """The folders above and with ``path``, the root folder first."""
    parts = F.split(path, "/")
    inner = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return F.array_distinct(F.transform(inner, lambda x: F.when(x == "", "/").otherwise(x)))


def project_roots(folders: DataFrame, roots: DataFrame) -> DataFrame:
    """Folders (dir_) and roots (root) -> (dir_, root): the nearest root at or above the folder; none, no row."""
    above = folders.select("dir_", F.explode(ancestors(F.col("dir_"))).alias("root"))
    return above.join(roots.select("root").distinct(), "root").groupBy("dir_").agg(F.max_by("root", F.length("root")).alias("root"))


def import_tries(imports: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Imports (from_file, specifier) -> of relative specifiers (dir_, spec_, raw_, tries_), of aliased ones the same with root and dir_.

    tries_ are the paths that may stand for the specifier, in order; raw_ is the first of them.
    """
    asked = imports.select(dirname(F.col("from_file")).alias("dir_"), F.col("specifier").alias("spec_")).distinct()
    relative = asked.where(F.col("spec_").startswith(".")).withColumn("raw_", normalize_path(F.col("dir_"), F.col("spec_")))
    swaps = [F.when(F.col("raw_").endswith(old), F.array(*(F.concat(F.expr(f"left(raw_, length(raw_) - {len(old)})"), F.lit(new)) for new in news))) for old, news in REMAPPED]
    near = relative.withColumn("tries_", F.concat(F.array("raw_"), F.coalesce(*swaps, F.array().cast("array<string>"))))

    root = F.col("root") if "root" in aliases.columns else F.col("base_dir")
    rules = aliases.where("replacement is not null").select(normalize_path(F.lit("/"), root).alias("root"), "base_dir", "ord", "pattern", "replacement")
    named = asked.where(~F.col("spec_").startswith("."))
    projects = project_roots(named.select("dir_").distinct(), rules)
    specs = named.join(projects, "dir_").select("root", "spec_").distinct()
    # a specifier offers itself to exact rules, and each of its prefixes that end with a slash to the others
    parts = F.split("spec_", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, F.col("spec_")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/"))))
    offers = specs.select("root", "spec_", F.posexplode(prefixes).alias("place_", "key_")).withColumn("star_", F.col("place_") > 0)
    star = F.col("pattern").endswith("/*")
    keyed = rules.withColumn("star_", star).withColumn("key_", F.when(star, F.expr("left(pattern, length(pattern) - 1)")).otherwise(F.col("pattern")))
    base = F.when(F.col("replacement").endswith("/*"), F.expr("left(replacement, length(replacement) - 2)")).otherwise(F.col("replacement"))
    rest = F.expr("substring(spec_, length(pattern), length(spec_))")
    hit = offers.join(keyed, ["root", "key_", "star_"]).withColumn("to_", F.when(F.col("star_"), F.concat_ws("/", normalize_path(F.col("base_dir"), base), rest)).otherwise(normalize_path(F.col("base_dir"), F.col("replacement"))))
    first = hit.groupBy("root", "spec_").agg(F.min_by("to_", "ord").alias("to_")).select("root", "spec_", normalize_path(F.lit("/"), F.col("to_")).alias("raw_"))
    aliased = first.withColumn("tries_", F.concat(F.array("raw_"), F.array(*(F.concat("raw_", F.lit(x)) for x in PROBED))))
    return near, named.join(projects, "dir_").join(aliased, ["root", "spec_"])


def with_tries(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """Imports (from_file, specifier) -> adds tries: every path whose coming or going may change where the import leads, in order; none for a module."""
    near, aliased = import_tries(imports, aliases)
    tries = near.select("dir_", "spec_", F.col("tries_").alias("tries")).unionByName(aliased.select("dir_", "spec_", F.col("tries_").alias("tries")))
    keyed = imports.withColumn("dir_", dirname(F.col("from_file"))).withColumn("spec_", F.col("specifier"))
    return keyed.join(tries, ["dir_", "spec_"], "left").drop("dir_", "spec_").withColumn("tries", F.coalesce("tries", F.array().cast("array<string>")))


def first_existing(imports: DataFrame, listing: DataFrame) -> DataFrame:
    """Imports (from_file, specifier, tries, ...) and existing paths (entry, is_dir) -> adds target, as ``resolve_imports`` finds it."""
    each = imports.select("from_file", "specifier", F.posexplode("tries").alias("rank", "try")).join(listing, F.col("try") == F.col("entry"))
    late = F.col("rank") >= 3
    hits = each.groupBy("from_file", "specifier").agg(F.min_by("try", "rank").alias("any"), F.max(F.when(F.col("rank") == 0, F.col("is_dir"))).alias("folder"), F.min_by(F.when(late, F.col("try")), F.when(late, F.col("rank"))).alias("index"))
    raw = F.coalesce(F.get("tries", 0), F.col("specifier"))
    through_index = ~F.col("specifier").startswith(".") & F.coalesce("folder", F.lit(False))
    out = imports.join(hits, ["from_file", "specifier"], "left")
    return out.withColumn("target", F.when(through_index, F.coalesce("index", raw)).otherwise(F.coalesce("any", raw))).drop("any", "folder", "index")


def path_filter(listing: DataFrame, n_words: int = FILTER_WORDS) -> DataFrame:
    """Listing (entry) -> (word, bits): a blocked Bloom filter of at most ``n_words`` words of 64 bits, joined up by one bitwise or.

    A path sets BITS_PER_PATH bits of one word. With n paths a word holds about n / ``n_words`` of them; at 6 paths a word some 3 in 100 paths that are
    not listed pass, at 1 a word fewer than 1 in 1,000. Beyond that more pass, and results stay equal.
    """
    word, bits = _filter_bits(F.col("entry"), n_words)
    return listing.where("entry is not null").groupBy(word.alias("word")).agg(F.bit_or(bits).alias("bits"))


def _filter_bits(path: Column, n_words: int) -> tuple[Column, Column]:
    """The word of a path and its bits there, from two hashes."""
    hash_ = F.xxhash64(F.lit("bits"), path)
    bits = F.lit(0).cast("long")
    for k in range(BITS_PER_PATH):
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(hash_, 6 * k), F.lit(64)).cast("int")))
    return F.pmod(F.xxhash64(path), F.lit(n_words)), bits


def filter_blocks(words: DataFrame) -> DataFrame:
    """(word, bits) -> (block, slots, block_bits): BLOCK_WORDS words a row, so a full filter is some 9 MB as rows and 17 as a broadcast; a row for each word took 168.

    ``slots`` has a bit for each word that is in use, ``block_bits`` holds these words in order.
    """
    slot = F.col("word").bitwiseAND(F.lit(BLOCK_WORDS - 1)).cast("int")
    used = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot)).alias("slots")
    held = F.sort_array(F.collect_list(F.struct(slot.alias("slot"), "bits")))["bits"].alias("block_bits")
    return words.groupBy(_block(F.col("word")).alias("block")).agg(used, held)


def _block(word: Column) -> Column:
    return F.shiftright(word, BLOCK_WORDS.bit_length() - 1)


def maybe_listed(rows: DataFrame, column: str, words: DataFrame, n_words: int = FILTER_WORDS) -> DataFrame:
    """The rows whose path may be listed, by ``path_filter``'s words (at most ``n_words``, broadcast by blocks): rows stay where they are."""
    word, bits = _filter_bits(F.col(column), n_words)
    slot = F.col("word_").bitwiseAND(F.lit(BLOCK_WORDS - 1)).cast("int")
    shifted = lambda n: F.call_function("shiftleft", F.lit(n).cast("long"), slot)
    place = F.bit_count(F.col("slots").bitwiseAND(F.bitwise_not(shifted(-1))))  # words in use before this one
    known = F.coalesce(F.get("block_bits", place), F.lit(0).cast("long"))
    near = rows.withColumn("word_", word).join(F.broadcast(filter_blocks(words)), _block(F.col("word_")) == F.col("block"))
    return near.where((F.col("slots").bitwiseAND(shifted(1)) != 0) & (bits.bitwiseAND(known) == bits)).select(*rows.columns)


def resolve_imports(imports: DataFrame, listing: DataFrame, aliases: DataFrame, n_words: int = FILTER_WORDS) -> DataFrame:
    """Imports (from_file, specifier), listing (entry, is_dir), aliases (base_dir, ord, pattern, replacement[, root]) -> adds target.

    A relative specifier is joined to the importing folder; if that does not exist, sources of a mapped extension are tried, else it stays as
    it is and dangles. Another specifier takes the first alias in order that fits, of the project whose ``root`` (else ``base_dir``) is the
    nearest at or above the importing folder; its replacement is probed for extensions and index files. Without an alias it is an external
    module. Distinct (folder, specifier) and (project, specifier) pairs are resolved once; all joins have keys. Of the paths that are tried, those
    that a filter of the listing rules out are never shuffled.
    """
    near, aliased = import_tries(imports, aliases)
    words = path_filter(listing, n_words)
    probe = lambda rows, folders=False: _first_existing(rows, listing, words, n_words, folders)
    once = probe(aliased.drop("dir_").dropDuplicates(["root", "spec_"]), folders=True)
    by_dir = aliased.select("dir_", "root", "spec_").join(once.select("root", "spec_", "found_"), ["root", "spec_"])
    found = probe(near).select("dir_", "spec_", "found_").unionByName(by_dir.select("dir_", "spec_", "found_"))
    out = imports.withColumn("dir_", dirname(F.col("from_file"))).withColumn("spec_", F.col("specifier")).join(found, ["dir_", "spec_"], "left")
    return out.withColumn("target", F.coalesce("found_", "specifier")).drop("dir_", "spec_", "found_")


def _first_existing(rows: DataFrame, listing: DataFrame, words: DataFrame, n_words: int, folders: bool = False) -> DataFrame:
    """Adds found_: the first of tries_ that is listed, else raw_. With ``folders`` a folder counts through its index file only."""
    keys = [c for c in rows.columns if c not in ("tries_",)]
    each = maybe_listed(rows.select(*keys, F.posexplode("tries_").alias("rank_", "try_")), "try_", words, n_words)
    hits = each.join(listing, F.col("try_") == F.col("entry"))
    if folders:
        # existing folder: its index files come before the extensions, as the folder itself exists
        is_dir = F.max(F.when(F.col("rank_") == 0, F.col("is_dir"))).alias("dir0_")
        first = hits.groupBy(*keys).agg(is_dir, F.min_by("try_", "rank_").alias("any_"), F.min_by(F.when(F.col("rank_") >= 3, F.col("try_")), F.when(F.col("rank_") >= 3, F.col("rank_"))).alias("index_"))
        found = F.when(F.coalesce("dir0_", F.lit(False)), F.coalesce("index_", "raw_")).otherwise(F.coalesce("any_", "raw_"))
        first = first.select(*keys, F.col("any_").alias("any2_"), found.alias("found0_"))
        return rows.join(first, keys, "left").withColumn("found_", F.coalesce("found0_", "raw_"))
    first = hits.groupBy(*keys).agg(F.min_by("try_", "rank_").alias("found0_"))
    return rows.join(first, keys, "left").withColumn("found_", F.coalesce("found0_", "raw_"))
