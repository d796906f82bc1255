"""The views' rows on odd tables."""

import itertools

from lodestone.plans.views import view


def _save(spark, tmp_path, rows):
    shape = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string"
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")


def test_references_with_missing_keys_are_distinct_as_rows(spark, tmp_path):
    keys = itertools.product((None, 5, -5), (None, 5), (None, 5, 6), (None, 1, 3), (None, 5.0), (None, "R", "N"))
    _save(spark, tmp_path, list(keys) * 2)
    text = lambda df: sorted(map(str, map(tuple, df.collect())))
    whole = view(spark, str(tmp_path), "refs", distinct=False)
    mine = text(view(spark, str(tmp_path), "refs").select(whole.columns))
    assert mine == text(whole.distinct()) and len(mine) < whole.count() // 2


def test_references_are_made_distinct_as_numbers(spark, tmp_path):
    """The names of a reference are many times as long as the numbers they are made of: only numbers are shuffled."""
    _save(spark, tmp_path, [(1, 2, 3, 4, 5.0, "R")] * 2)
    plan = view(spark, str(tmp_path), "refs")._jdf.queryExecution().optimizedPlan().toString()
    grouped = plan[plan.index("Aggregate [") :].split("]")[0]
    assert "caller_symbol" not in grouped and "l_partkey" in grouped
