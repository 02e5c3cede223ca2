"""Keyed stores as Parquet tables: vectors, scores and responses, written once and joined by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedStore:
    """An append-only table (key, value columns), partitioned by `by`; lookups are left joins, puts are anti-joins."""

    def __init__(self, spark: SparkSession, path: str, schema: str, by: str | None = None):
        self.spark, self.path, self.schema, self.by = spark, path, schema, by

    def table(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as e:  # the store is made by its first put
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)

    def get_many(self, wanted: DataFrame, key: str = "key") -> DataFrame:
        """wanted with the stored columns, null where missing."""
        return wanted.join(self.table().dropDuplicates([key]), key, "left")

    def missing(self, wanted: DataFrame, key: str = "key") -> DataFrame:
        return wanted.select(key).distinct().join(self.table(), key, "left_anti")

    def put(self, rows: DataFrame, key: str = "key") -> None:
        """Adds the rows whose key is new; equal keys within rows are written once."""
        new = rows.dropDuplicates([key]).join(self.table().select(key), key, "left_anti")
        writer = new.write.mode("append")
        (writer.partitionBy(self.by) if self.by else writer).parquet(self.path)


def text_key(model, text):
    """The key of a text's vector under a model."""
    return F.sha2(F.concat(model, F.lit("\n"), text), 256)


def score_key(model, revision, question, text):
    """The key of a cross encoder's score: what it is and what it read."""
    return F.sha2(F.concat_ws("\x1f", model, revision, question, text), 256)
