"""Paths: languages, tests, directories, remotes and hashes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by file extension.
EXTENSIONS = {
    "rs": "rust",
    "py": "python",
    "pyi": "python",
    "js": "javascript",
    "jsx": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
    "ts": "typescript",
    "tsx": "typescript",
    "go": "go",
    "php": "php",
    "cpp": "cpp",
    "cc": "cpp",
    "cxx": "cpp",
    "hpp": "cpp",
    "h": "cpp",
    "swift": "swift",
    "kt": "kotlin",
    "kts": "kotlin",
    "hcl": "hcl",
    "tf": "hcl",
}


def language_of(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    out = F.lit("unknown")
    for language in sorted(set(EXTENSIONS.values())):
        out = F.when(extension.isin([e for e, x in EXTENSIONS.items() if x == language]), language).otherwise(out)
    return out


def is_test_file(path: Column) -> Column:
    """The search penalty's predicate; case does not matter."""
    return path.rlike(r"(?i)(?:^|/)(?:tests?|__tests?__)/|(?:^|/)[^/]+\.(?:test|spec)\.[^/]*$|(?:^|/)test_[^/]*$|(?:^|/)[^/]*_test(?:\.[^/.]*)?$")


def is_test_path(path: Column) -> Column:
    """The channel report's predicate: also spec folders and dashed stems; case matters."""
    return path.rlike(
        r"(?:^|/)(?:tests?|__tests__|specs?)(?:/|$)|(?:^|/)[^/.]*[-_](?:test|spec)(?:\.[^/]*)?$|(?:^|/)(?:[^/]*\.)?(?:test|spec)(?:\.[^/]*)?$"
    )


def tests_symbol(caller: Column, path: Column) -> Column:
    """Whether a caller looks like a test, by its name or by its file."""
    by_name = F.coalesce(F.lower(caller).rlike(r"^test_|_test$|_spec$"), F.lit(False))
    return by_name | F.lower(path).rlike(r"(?:^|/)(?:tests?|specs?)(?:/|$)|(?:^|/)(?:test|test_[^/]*|[^/]*_test|[^/]*_spec)(?:\.[^/.]*)?$")


def ancestors(path: Column) -> Column:
    """The directories above a file, outermost first."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    return F.when(depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>"))


def normalize_remote(raw: Column) -> Column:
    """``host/path`` of a git remote: no scheme, user, port or .git; the host in lower case; null for none."""
    plain = F.trim(raw)
    scheme = F.contains(plain, F.lit("://"))
    rest = F.regexp_replace(F.regexp_replace(plain, r"^.*?://", ""), r"^[^@]*@", "")
    by = F.when(~scheme & F.contains(rest, F.lit(":")), ":").otherwise("/")
    at = F.locate("/", rest)
    at = F.when(by == ":", F.locate(":", rest)).otherwise(at)
    host = F.when(at > 0, F.substring(rest, F.lit(1), at - 1)).otherwise(rest)
    path = F.when(at > 0, F.substring(rest, at + 1, F.length(rest))).otherwise("")
    host = F.lower(F.trim(F.substring_index(host, ":", 1)))
    path = F.regexp_replace(F.regexp_replace(F.trim(path), "^/+|/+$", ""), r"\.git$", "")
    return F.nullif(F.concat_ws("/", F.nullif(host, F.lit("")), F.nullif(path, F.lit(""))), F.lit(""))


def file_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)
