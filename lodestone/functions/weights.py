"""Vectors and weights, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How strongly a kind of reference ties two files.
KIND_WEIGHTS = {"call": 1.0, "method_call": 1.0, "inheritance": 0.8, "implementation": 0.7, "type_reference": 0.6, "import": 0.5}
OTHER_KIND = 0.3
EXECUTION_KINDS = ("call", "method_call", "instantiation", "macro_invocation")
IMPACT_KINDS = (*EXECUTION_KINDS, "implementation", "inheritance")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of unlike length, empty ones and zeros."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def kind_weight(kind: Column) -> Column:
    out = F.lit(OTHER_KIND)
    for name, weight in KIND_WEIGHTS.items():
        out = F.when(kind == name, weight).otherwise(out)
    return out


def edge_weight(count: Column, kinds: Column) -> Column:
    """References times the mean weight of their distinct kinds; without kinds, of an unknown one."""
    mean = F.aggregate(F.transform(kinds, kind_weight), F.lit(0.0), lambda s, x: s + x) / F.size(kinds)
    return count * F.when(F.size(kinds) > 0, mean).otherwise(OTHER_KIND)
