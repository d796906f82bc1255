"""The embedding port, and a stand-in that needs no model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.retrieval import words


def hashed_embedding(text: Column, dims: int) -> Column:
    """Unit vector of signed counts of hashed words; zeros for no words. Not a model: near texts only share words."""
    signed = lambda h: F.concat(F.lit(";"), F.pmod(h, F.lit(dims)), F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, "+").otherwise("-"))
    marks = F.array_join(F.transform(words(text), lambda w: signed(F.xxhash64(w))), "")
    # counts of marks in a string cost a scan of it, not a call for each word and dimension
    count = lambda s, mark: (F.length(s) - F.length(F.replace(s, F.lit(mark), F.lit("")))) / F.lit(float(len(mark)))
    each = lambda s: F.array(*(count(s, f";{d}+") - count(s, f";{d}-") for d in range(dims)))
    sized = F.transform(F.transform(F.array(marks), each), lambda v: F.struct(v.alias("v"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)).alias("norm")))
    unit = lambda s: F.transform(s["v"], lambda x: F.when(s["norm"] > 0, x / s["norm"]).otherwise(0.0).cast("float"))
    return F.get(F.transform(sized, unit), F.lit(0))  # through lambdas, so the marks, counts and norm are made once


def embed(chunks: DataFrame, model: Callable[[Column], Column], name: str) -> DataFrame:
    """Vectors of chunks by a port: any function from a text column to an array column, a pandas UDF for real models."""
    return chunks.select(F.col("id").alias("chunk_id"), model(F.col("content")).alias("vector"), F.lit(name).alias("model"))
