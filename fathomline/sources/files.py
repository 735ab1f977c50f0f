"""Sources: file trees, the list of roots, ignore files."""

from __future__ import annotations

import os

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.texts import decode_lossy, glob_regex, line_feeds


#: Roots that a list may have; the driver asks for each whether it exists.
MOST_ROOTS = 100_000


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """(root, meta) of a text file of lines `path --tag --tag`; lines that begin with #, lines with another word than a tag and
    roots that don't exist are skipped, a root under two lines gets the tags of both."""
    words = F.split(F.trim(F.col("value")), r"\s+")
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')").select(words.alias("w"))
    tags = F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0)))
    lines = lines.where(F.forall(tags, lambda t: t.startswith("--"))).select(F.element_at("w", 1).alias("root"), F.transform(tags, lambda t: F.substr(t, F.lit(3))).alias("meta"))
    rows = lines.groupBy("root").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("meta")))).alias("meta")).limit(MOST_ROOTS + 1).collect()
    if len(rows) > MOST_ROOTS:
        raise ValueError(f"more than {MOST_ROOTS} roots")
    return spark.createDataFrame([r for r in rows if exists(spark, r["root"])], "root string, meta array<string>")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(filepath, content) of the regular files under a root, or of the root if it is a file."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return df.select(F.regexp_replace("path", "^file:/*", "/").alias("filepath"), "content")


def ignore_patterns(folder: str, text: str) -> list[str]:
    """Regular expressions of one ignore file; comments, blank and negated lines don't count. A pattern that begins with a
    slash belongs to the folder, others to any depth below it; a pattern also covers what lies under it. The ignore file
    itself and the version folder beside it are always covered."""
    folder = folder.rstrip("/")
    globs = [f"{folder}/.gitignore", f"{folder}/.git/**"]
    for line in text.splitlines():
        p = line.strip()
        if not p or p[0] in "#!":
            continue
        p = p.rstrip("/")
        full = f"{folder}/{p.lstrip('/')}" if p.startswith("/") or "/" in p else f"{folder}/**/{p}"
        globs += [full, f"{full}/**"]
    return [glob_regex(g) for g in globs]


def tracked(files: DataFrame, ignored: list[str], path: str = "filepath") -> DataFrame:
    """Files that match no pattern, as one predicate: no join is needed while the patterns are a list. A version folder is
    excluded in any case."""
    keep: Column = ~F.col(path).rlike(r"/\.git(/|$)")
    if ignored:
        keep = keep & ~F.col(path).rlike("|".join(f"(?:{p})" for p in ignored))
    return files.where(keep)


def without_ignored(files: DataFrame, patterns: DataFrame, path: str = "filepath") -> DataFrame:
    """The same against a table of patterns (root, pattern): anti join on the root, then on the expression, so that a file
    meets the patterns of its own root only."""
    f, p = files.alias("f"), patterns.alias("p")
    root = F.split_part(F.col(f"f.{path}"), F.lit("/"), F.lit(1))
    return f.join(p, (root == F.col("p.root")) & F.expr(f"f.{path} rlike p.pattern"), "left_anti")


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a path or URI, and the path there."""
    return pafs.FileSystem.from_uri(path if ":" in path.split("/")[0] else os.path.abspath(path))


def ignore_files(root: str) -> list[str]:
    """Patterns of all ignore files under a root, on any file system that Arrow knows (Spark's own listing skips names that
    begin with a dot). They go to the driver: a line each."""
    fs, at = file_system(root)
    out = []
    for info in fs.get_file_info(pafs.FileSelector(at, recursive=True)):
        if info.base_name == ".gitignore" and info.is_file:
            with fs.open_input_stream(info.path) as f:
                out += ignore_patterns(info.path.rpartition("/")[0], f.read().decode(errors="replace"))
    return out


def read_texts(files: DataFrame) -> DataFrame:
    """(filepath, text): content as text with line feeds."""
    return files.select("filepath", line_feeds(decode_lossy(F.col("content"))).alias("text"))


def kept_counts(files: DataFrame, roots: DataFrame, path: str = "filepath") -> DataFrame:
    """(root, kept): how many files lie under each root, or are it. Every file meets the roots with its own leading folders,
    an equal join on as many rows as a path is deep."""
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    under = files.where(F.col(path).isNotNull()).select(F.explode(folders).alias("folder")).groupBy("folder").agg(F.count("*").alias("kept"))
    names = roots.select("root").where("root is not null").distinct().withColumn("folder", F.rtrim("root", F.lit("/")))
    return names.join(under, "folder", "left").select("root", F.coalesce("kept", F.lit(0)).alias("kept"))
