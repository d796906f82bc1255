"""Names of symbols: splitting, shortening and matching, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = r"[:/#.\\]"


def bare(symbol: Column) -> Column:
    """The symbol without a trailing call mark: ``().`` or ``()``."""
    return F.regexp_replace(symbol, r"\(\)\.?$", "")


def _last_part(scope: Column) -> Column:
    """What follows the last of the first of \\ :: . / that occurs."""
    out = scope
    for sep in ("/", ".", "::", "\\"):
        out = F.when(F.contains(scope, F.lit(sep)), F.substring_index(scope, sep, -1)).otherwise(out)
    return F.nullif(out, F.lit(""))


def split_qualified(symbol: Column) -> Column:
    """struct(name, hint): split at the last of the first separator that occurs, asked in the order # \\ :: . /.

    The hint is the last part of what stands before the name; after \\, which
    only separates namespaces, there is none.
    """
    plain = bare(symbol)
    name, hint = plain, F.lit(None).cast("string")
    for sep in ("/", ".", "::", "\\", "#"):
        there = F.contains(plain, F.lit(sep))
        before = F.regexp_extract(plain, rf"(?s)^(.*){re.escape(sep)}", 1)
        name = F.when(there, F.substring_index(plain, sep, -1)).otherwise(name)
        hint = F.when(there, F.lit(None).cast("string") if sep == "\\" else _last_part(before)).otherwise(hint)
    return F.struct(name.alias("name"), hint.alias("hint"))


def short_symbol(symbol: Column) -> Column:
    """The last part that isn't empty, without call marks; the symbol itself if there is none."""
    trimmed = F.regexp_replace(symbol, r"[.()]+$", "")
    return F.coalesce(F.nullif(F.regexp_extract(trimmed, r"([^:/#.\\]+)[:/#.\\]*$", 1), F.lit("")), symbol)


def _member(descriptor: Column) -> Column:
    """An accessor's target, without call marks and type parameters; null for constructors and nothing."""
    plain = F.regexp_replace(F.trim(descriptor), "^<(?:get|set)>", "")
    plain = F.trim(F.regexp_extract(plain, "^([^(<]*)", 1))
    return F.when(F.trim(descriptor) != "<constructor>", F.nullif(plain, F.lit("")))


def _leaf(name: Column) -> Column:
    return F.substring_index(F.substring_index(F.substring_index(name, "/", -1), "::", -1), ".", -1)


def feature_name(symbol: Column) -> Column:
    """``Class.member``; a constructor is its class, an accessor its target."""
    plain = F.trim(F.substring_index(symbol, " ", -1))
    owner, member = _leaf(F.regexp_extract(plain, "(?s)^(.*)#", 1)), _member(F.substring_index(plain, "#", -1))
    leaf = _leaf(plain)
    return F.when(F.contains(plain, F.lit("#")), F.coalesce(F.concat(owner, F.lit("."), member), owner)).otherwise(F.coalesce(_member(leaf), leaf))


def class_path(symbol: Column) -> Column:
    """struct(segments, base) of ``A\\B\\C#m``: the parts of the class, and the last of them; null without #."""
    parts = F.filter(F.split(F.substring_index(symbol, "#", 1), r"[\\/:]"), lambda p: p != "")
    whole = F.struct(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))).alias("segments"), F.try_element_at(parts, F.lit(-1)).alias("base"))
    return F.when(F.contains(symbol, F.lit("#")) & (F.size(parts) > 0), whole)


def qualified(parent: Column, name: Column, sep: str = "::") -> Column:
    return F.when(parent.isNull(), name).otherwise(F.concat(parent, F.lit(sep), name))


def graph_name(parent: Column, name: Column, language: Column) -> Column:
    """The name as call graphs write it: # for TypeScript, JavaScript and PHP, . for Python, Go and Kotlin, else ::."""
    sep = F.when(language.isin("typescript", "javascript", "php"), "#").when(language.isin("python", "go", "kotlin"), ".").otherwise("::")
    return F.when(parent.isNull(), name).otherwise(F.concat(parent, sep, name))


def boundary_match(symbol: Column, name: str) -> Column:
    """Whether the symbol is ``name`` or ends with it after a separator, with or without call marks."""
    return symbol.rlike(rf"(?:^|#|/|\\|::|\.){re.escape(name)}(?:\(\)\.?)?$")


def fuzzy_pattern(text: str) -> str:
    """A regex in which every separator, and every step from lower to upper case, may be any separators."""
    out, before = [], ""
    for c in text:
        if c in "/\\#.:":
            if out[-1:] != [r"[/\\#.:]*"]:
                out.append(r"[/\\#.:]*")
        else:
            if before.islower() and c.isupper():
                out.append(r"[/\\#.:]*")
            out.append("\\" + c if c in "^$()[]{}|?*+" else c)
        before = c
    return "".join(out)


def escape_like(text: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", text)


def stable_community_id(prefix: str, members: Column) -> Column:
    """``prefix-`` and the first 12 hex digits of the SHA-256 of the sorted members, each followed by NUL."""
    joined = F.array_join(F.transform(F.sort_array(members), lambda m: F.concat(m, F.lit("\0"))), "")
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(joined.cast("binary"), 256), 1, 12))
