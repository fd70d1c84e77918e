"""Source trees and project settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.paths import filter_paths, normalize_path

# What a project scan takes and leaves out by default.
DEFAULT_GLOBS = ["**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx", "**/*.mjs", "**/*.cjs"]
DEFAULT_IGNORE = ["**/node_modules/**", "**/dist/**", "**/build/**", "**/.git/**"]


def name_filter(globs: list[str]) -> str | None:
    """One glob on file names that lets pass what any of ``globs`` does, so that other files are not read; None if their names differ in form."""
    endings = [glob.rpartition("/")[2] for glob in globs]
    plain = all(name.startswith("*.") and name[2:].isalnum() for name in endings)
    return "*.{" + ",".join(sorted({name[2:] for name in endings})) + "}" if plain and endings else None


def read_source_tree(spark: SparkSession, root: str, globs: list[str] | None = None, ignore: list[str] | None = None) -> DataFrame:
    """(path, content) of the files under ``root``; bytes that are no UTF-8 become U+FFFD. Contents are not shuffled."""
    globs = globs or DEFAULT_GLOBS
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if names := name_filter(globs):
        reader = reader.option("pathGlobFilter", names)
    path = F.regexp_replace("path", "^file:/+", "/").alias("path")
    inside = filter_paths(reader.load(root).select(path, "content"), root.removeprefix("file://"), globs, ignore if ignore is not None else DEFAULT_IGNORE)
    return inside.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def load_path_aliases(settings: DataFrame) -> DataFrame:
    """Settings (project, dir, text) -> (project, root, base_dir, ord, pattern, replacement), in the order of the file; ``root`` is the settings' folder.

    ``//`` comments go wherever they stand; text that is no JSON then gives no rule. The first replacement of a rule counts; a rule without one is
    left out.
    """
    plain = F.regexp_replace("text", "//[^\\n]*", "")
    raw = settings.select("project", "dir", plain.alias("j")).select("project", "dir", F.get_json_object("j", "$.compilerOptions.paths").alias("paths"), F.coalesce(F.get_json_object("j", "$.compilerOptions.baseUrl"), F.lit(".")).alias("base"))
    rules = F.from_json("paths", "map<string,array<string>>")
    rows = raw.where("paths is not null").select("project", normalize_path(F.lit("/"), F.col("dir")).alias("root"), normalize_path(F.col("dir"), F.col("base")).alias("base_dir"), F.posexplode(F.json_object_keys("paths")).alias("ord", "pattern"), rules.alias("rules"))
    return rows.select("project", "root", "base_dir", "ord", "pattern", F.get(F.try_element_at("rules", F.col("pattern")), 0).alias("replacement")).where("replacement is not null")
