"""Writing tables: upserts by key, deletions, namespaces and stored analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key; of equal keys in ``new`` one stays."""
    order = W.partitionBy(*key).orderBy(*(F.col(c) for c in new.columns))
    one = new.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return old.join(one.select(*key), key, "left_anti").unionByName(one, allowMissingColumns=True)


def upsert_vectors(chunks: DataFrame, vectors: DataFrame, new_chunks: DataFrame, new_vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after an upsert; as many new vectors as chunks are asked for."""
    if new_vectors.count() not in (0, new_chunks.count()):
        raise ValueError("chunks and vectors differ in number")
    return upsert(chunks, new_chunks, ["id"]), upsert(vectors, new_vectors, ["chunk_id"])


def delete_files(chunks: DataFrame, vectors: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of (repository_id, file_path) and their vectors go; a null path is the whole repository."""
    whole = files.where("file_path is null").select("repository_id").distinct()
    own = files.where("file_path is not null").select("repository_id", "file_path").distinct()
    stay = chunks.join(whole, "repository_id", "left_anti").join(own, ["repository_id", "file_path"], "left_anti")
    gone = chunks.join(stay.select("id"), "id", "left_anti").select(F.col("id").alias("chunk_id"))
    return stay.select(chunks.columns), vectors.join(gone, "chunk_id", "left_anti").select(vectors.columns)


def delete_repository(tables: dict[str, DataFrame], repository: str, namespace: str | None = None) -> dict[str, DataFrame]:
    """All tables without a repository, and without the analyses of its namespace as a whole."""
    gone = [repository, *([f"__namespace__:{namespace}"] if namespace else [])]
    return {name: df.where(~F.coalesce(F.col("id" if name == "repositories" else "repository_id").isin(gone), F.lit(False))) for name, df in tables.items()}


def delete_synthesized(endpoints: DataFrame, source: str = "package") -> DataFrame:
    return endpoints.where(~F.col("source").eqNullSafe(F.lit(source)))


NO_EMBEDDINGS = "none"


class Namespaces:
    """Namespaces as folders below a root, each with its embedding space."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _config(self, name: str) -> str:
        return f"{self.root}/{name}/config"

    def create(self, name: str, model: str, dimensions: int) -> None:
        """A namespace's embedding space is fixed: another model or size is an error, unless either side has none."""
        if self._fs.exists(self._path(self._config(name))):
            own = self.spark.read.json(self._config(name)).first()
            if NO_EMBEDDINGS not in (own["model"], model) and (own["model"], own["dimensions"]) != (model, dimensions):
                raise ValueError(f"namespace {name} holds vectors of {own['model']} ({own['dimensions']})")
            return
        self.spark.createDataFrame([(name, model, dimensions)], "name string, model string, dimensions int").coalesce(1).write.json(self._config(name))

    def names(self) -> list[str]:
        if not self._fs.exists(self._path(self.root)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)))

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)


class AnalysisStore:
    """Analyses by repository and kind, replaced as a whole; computed and empty differs from never computed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, repository: str, kind: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{kind}/repository={repository}")

    def load(self, repository: str, kind: str) -> DataFrame | None:
        path = f"{self.root}/{kind}/repository={repository}"
        jvm = self.spark.sparkContext._jvm
        own = jvm.org.apache.hadoop.fs.Path(path)
        if not own.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(own):
            return None
        return self.spark.read.parquet(path)


def vimgrep(results: DataFrame) -> DataFrame:
    """``path:line:column:text`` rows."""
    return results.select(F.concat_ws(":", "file_path", "start_line", F.lit(1), F.substring_index("content", "\n", 1)).alias("line"))


def as_json(results: DataFrame) -> DataFrame:
    return results.select(F.to_json(F.struct(*results.columns)).alias("line"))
