"""Reading point tables and writing results: Spark's own sources and sinks."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_points(spark: SparkSession, path: str, id_column: str, vector: str | None = None, features: list[str] | None = None) -> DataFrame:
    """(id, vec) from Parquet: a vector column, or feature expressions. Only these columns are read."""
    vec = F.col(vector).cast("array<double>") if vector else F.array(*[F.expr(f).cast("double") for f in features])
    return spark.read.parquet(path).select(F.col(id_column).cast("long").alias("id"), vec.alias("vec"))


def split(points: DataFrame, n_train: int, n_test: int) -> tuple[DataFrame, DataFrame]:
    """Points with id below n_train, and the n_test ids that follow as queries."""
    return points.where(F.col("id") < n_train), points.where((F.col("id") >= n_train) & (F.col("id") < n_train + n_test)).withColumnRenamed("id", "qid")


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def pivot(df: DataFrame, row: str, column: str, value: str, columns: list | None = None) -> DataFrame:
    """One row for each `row` and one column for each value of `column`, of mean values."""
    return df.groupBy(row).pivot(column, columns).agg(F.avg(value))


def append_csv(df: DataFrame, path: str) -> None:
    """Further rows for a folder of CSV files, which is made where there is none."""
    df.write.mode("append").option("header", True).csv(path)


def completed_keys(spark: SparkSession, path: str, keys: list[str], schema: str) -> DataFrame:
    """The keys of the rows that a folder of CSV files holds already; none where there is no folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema).select(*keys)
    return spark.read.option("header", True).schema(schema).csv(path).select(*keys).distinct()


def pending(jobs: DataFrame, completed: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs whose keys are not yet completed."""
    return jobs.join(completed.select(*keys), keys, "left_anti")


def merge_shards(shards: list[DataFrame]) -> DataFrame:
    """All rows of all shards; columns that a shard lacks are null."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
