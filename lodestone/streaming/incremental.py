"""Incremental indexing as a stream: snapshots of file hashes arrive, changes leave.

An addition: the reference has no streams. It shows how the batch operators
snapshot_diff and upsert serve as the body of a Structured Streaming sink.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lodestone.operators.maintenance import upsert
from lodestone.operators.stats import snapshot_diff


def change_sink(load: Callable[[], DataFrame], save: Callable[[DataFrame], None], emit: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch body over (repository_id, file_path, content_hash) batches.

    ``load`` and ``save`` hold the last snapshot, ``emit`` takes each batch's
    changes. A batch only speaks of the files it names, so nothing is deleted
    by it; a row with a null hash is a file that couldn't be read.
    """

    def body(batch: DataFrame, epoch: int) -> None:
        key = ["repository_id", "file_path"]
        before = load()
        named = before.join(batch.select(*key), key, "left_semi")
        emit(snapshot_diff(named, batch).where(F.col("change") != "deleted"), epoch)
        save(upsert(before, batch.where("content_hash is not null").select(before.columns), key))

    return body


def watch(stream: DataFrame, checkpoint: str, body: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    return stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
