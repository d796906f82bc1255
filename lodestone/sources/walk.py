"""Source files of a repository: a recursive read of known languages, without hidden and ignored paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.paths import file_hash, language_of


def ignore_regexes(lines: list[str]) -> list[tuple[str, bool]]:
    """(regex over relative paths, ignored) of an ignore file's lines; later ones win."""
    out = []
    for line in lines:
        rule = line.rstrip("\n").rstrip()
        if not rule or rule.startswith("#"):
            continue
        keep = rule.startswith("!")
        rule = rule.lstrip("!")
        folder, rule = rule.endswith("/"), rule.rstrip("/")
        anchored = "/" in rule
        rule = rule.lstrip("/")
        body = ""
        i = 0
        while i < len(rule):
            if rule.startswith("**/", i):
                body, i = body + "(?:.*/)?", i + 3
            elif rule.startswith("**", i):
                body, i = body + ".*", i + 2
            else:
                c = rule[i]
                body, i = body + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), i + 1
        out.append((("^" if anchored else "(?:^|/)") + body + ("/" if folder else "(?:/|$)"), not keep))
    return out


def is_ignored(path: Column, lines: list[str]) -> Column:
    out = F.lit(False)
    for regex, ignored in ignore_regexes(lines):
        out = F.when(path.rlike(regex), F.lit(ignored)).otherwise(out)
    return out


def _below(path: Column, folder: str) -> Column:
    """The path relative to a folder of ignore rules; null outside."""
    return path if not folder else F.when(F.startswith(path, F.lit(folder + "/")), F.substr(path, F.lit(len(folder) + 2)))


def is_ignored_by_tree(path: Column, rules: dict[str, list[str]]) -> Column:
    """By the rules of every folder above the path, the deeper ones last; ``rules``: folder ("" is the root) to lines."""
    out = F.lit(False)
    for folder in sorted(rules, key=lambda f: (f.count("/") + bool(f), f)):
        inner = _below(path, folder)
        for regex, ignored in ignore_regexes(rules[folder]):
            out = F.when(inner.rlike(regex), F.lit(ignored)).otherwise(out)
    return out


def _listed(root: str):
    """(file system, folder, ignore files, others that Spark's readers pass over: empty ones, and those below a name that begins with an underscore)."""
    from pyarrow import fs

    system, folder = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    folder = folder.rstrip("/")
    every = system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
    sizes = {x.path[len(folder) + 1 :]: x.size for x in every if x.type == fs.FileType.File}
    names = sorted(n for n in sizes if not any(p[0] == "." for p in n.split("/")[:-1]))
    passed = [n for n in names if n.rsplit("/", 1)[-1][0] != "." and (not sizes[n] or any(p[0] == "_" and "=" not in p for p in n.split("/")))]
    return system, folder, [n for n in names if n.rsplit("/", 1)[-1] == ".gitignore"], passed


def _contents(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """(file_path, content) of files named one by one, read by the tasks."""

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        for batch in batches:
            for name in batch.column("file_path").to_pylist():
                with system.open_input_stream(f"{folder.rstrip('/')}/{name}") as f:
                    yield pa.RecordBatch.from_pydict({"file_path": [name], "content": [f.read()]}, pa.schema([("file_path", pa.string()), ("content", pa.binary())]))

    listed = spark.createDataFrame([(n,) for n in names], "file_path string").repartition(max(1, len(names) // 100))
    return listed.mapInArrow(read, "file_path string, content binary")


def source_files(spark: SparkSession, root: str, ignore: list[str] | None = None, tree_rules: bool = True) -> DataFrame:
    """(file_path, language, content, content_hash) below a folder.

    Hidden files and folders are left out, and what the ``.gitignore`` files of
    the tree (unless ``tree_rules`` is off) or ``ignore`` name; the latter are
    the global excludes, which the tree's rules overrule. Spark's readers pass
    over empty files and names with an underscore in front (``__init__.py``),
    folders and files; these are listed by the driver, which holds their names and the
    ignore rules, and read by the tasks.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.escape(root.rstrip("/"))
    files = files.select(F.regexp_replace("path", rf"^.*?{base}/", "").alias("file_path"), "content")
    system, folder, ignores, passed = _listed(root)
    rules = {"": list(ignore or [])}
    if tree_rules:
        for name in ignores:
            with system.open_input_stream(f"{folder}/{name}") as f:
                rules.setdefault(name.rpartition("/")[0], []).extend(f.read().decode("utf-8", "replace").splitlines())
    if passed:
        files = files.unionByName(_contents(spark, root, passed))
    files = files.withColumn("language", language_of(F.col("file_path"))).where("language <> 'unknown'")
    files = files.where(~F.col("file_path").rlike(r"(?:^|/)\.") & ~is_ignored_by_tree(F.col("file_path"), rules))
    return files.select("file_path", F.decode("content", "UTF-8").alias("content"), "language").withColumn("content_hash", file_hash(F.col("content")))
