from lodestone.streaming.incremental import change_sink, watch

SCHEMA = "repository_id string, file_path string, content_hash string"


def test_changes_of_a_stream(spark, tmp_path):
    source = f"{tmp_path}/in"
    state = {"df": spark.createDataFrame([("r", "a", "1"), ("r", "b", "1")], SCHEMA)}
    seen = []

    def save(df):
        state["df"] = spark.createDataFrame(df.collect(), SCHEMA)

    spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "c", "1"), ("r", "d", None)], SCHEMA).write.parquet(source)
    body = change_sink(lambda: state["df"], save, lambda df, _: seen.extend((r.file_path, r.change) for r in df.collect()))
    watch(spark.readStream.schema(SCHEMA).parquet(source), f"{tmp_path}/cp", body).trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen) == [("a", "unchanged"), ("b", "modified"), ("c", "added"), ("d", "unreadable")]
    assert sorted((r.file_path, r.content_hash) for r in state["df"].collect()) == [("a", "1"), ("b", "2"), ("c", "1")]
