"""An index of imports for change streams: what each specifier tries in order, inverted by path, and a listing of existing paths that is kept by counts.

A file that comes or goes changes where an import leads only if the import tries its path, or a folder above it. These imports are found by a join of
the paths that came or went with ``probes``; of them, those whose target differs anew are resolved. No work depends on the number of files that did
not change: each table is read and written by the buckets of the paths concerned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import first_existing, with_tries
from codeloom.schema import ImportIndex


def counted_listing(paths: DataFrame, n: int = 1) -> DataFrame:
    """(path) of files -> (entry, is_dir, n): each file, and each folder above with how many of these files it holds, times ``n``."""
    files = paths.select("path").distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    folders = files.select(F.explode(above).alias("entry")).where("entry <> ''").groupBy("entry").agg((F.count(F.lit(1)) * n).alias("n"))
    return files.select(F.col("path").alias("entry"), F.lit(False).alias("is_dir"), F.lit(n).cast("long").alias("n")).unionByName(folders.select("entry", F.lit(True).alias("is_dir"), "n"))


def listing_after(listing: DataFrame, changes: DataFrame) -> DataFrame:
    """A counted listing with counts added; entries that hold nothing any more are left out."""
    return listing.unionByName(changes).groupBy("entry", "is_dir").agg(F.sum("n").alias("n")).where("n > 0")


def came_or_went(listing: DataFrame, changes: DataFrame) -> DataFrame:
    """(entry) that is there after the changes and was not before, or the other way round."""
    moved = changes.groupBy("entry", "is_dir").agg(F.sum("n").alias("d"))
    both = moved.join(listing.select("entry", "is_dir", "n"), ["entry", "is_dir"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return both.where((F.col("n") > 0) != (F.col("n") + F.col("d") > 0)).select("entry")


def probes_of(imports: DataFrame) -> DataFrame:
    """Imports (path, specifier, tries) by what they try: (candidate, rank, importer, specifier)."""
    return imports.select(F.posexplode("tries").alias("rank", "candidate"), F.col("path").alias("importer"), "specifier").select("candidate", "rank", "importer", "specifier")


def built_index(paths: DataFrame, imports: DataFrame, aliases: DataFrame) -> ImportIndex:
    """The index of files (path) that are there and of their imports (path, specifier, target)."""
    asked = with_tries(imports.select(F.col("path").alias("from_file"), "specifier", "target").distinct(), aliases).withColumnRenamed("from_file", "path")
    known = asked.select("path", "specifier", "target", "tries")
    return ImportIndex(known, counted_listing(paths), probes_of(known))


def tried_imports(probes: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries (entry) -> (path, specifier) of the imports that try them."""
    hits = probes.join(entries, F.col("candidate") == F.col("entry"), "left_semi")
    return hits.select(F.col("importer").alias("path"), "specifier").distinct()


def retargeted(imports: DataFrame, listing: DataFrame) -> DataFrame:
    """(path) of the files with an import (path, specifier, target, tries) that leads elsewhere than to its target by the listing as it is now."""
    known = imports.select(F.col("path").alias("from_file"), "specifier", F.col("target").alias("old"), "tries")
    return first_existing(known, listing).where("target <> old").select(F.col("from_file").alias("path")).distinct()
