"""The call log as a stream: new lines of a folder, each record kept once, merged into the latest answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RECORD = "call_id string, request_hash string, line_no long, ok boolean, recorded timestamp, text string"


def records(spark: SparkSession, folder: str, late: str = "1 hour") -> DataFrame:
    """Records appended to a folder of JSONL files; one of equal call, request and line within the watermark passes."""
    raw = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 64).json(folder)
    return raw.withWatermark("recorded", late).dropDuplicatesWithinWatermark(["call_id", "request_hash", "line_no"])


def answers_per_window(stream: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Attempts and successes by event-time window; windows close as the watermark passes them."""
    return stream.groupBy(F.window("recorded", width)).agg(F.count("*").alias("attempts"), F.count_if("ok").alias("ok"))


def follow(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch to a Parquet table under its batch number: a batch that runs again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class LatestAnswers:
    """Each call's last success whose request is the one last tried, kept up to date as batches of records come.

    The state is a row for each call and request: its last line, and its last line that was a success. Both are
    maxima, so records may come late, twice, or in a batch that runs again. It is kept in buckets of calls; a batch
    writes new versions of the buckets that it touches and reads no others. Readers take each bucket's last version.
    """

    STATE = "call_id string, request_hash string, last long, good long, bucket int, batch long"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _versions(self, before: int | None = None) -> DataFrame:
        try:
            state = self.spark.read.schema(self.STATE).parquet(self.path)
        except Exception as e:  # the table is made by its first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            state = self.spark.createDataFrame([], self.STATE)
        state = state if before is None else state.where(F.col("batch") < before)
        newest = state.groupBy("bucket").agg(F.max("batch").alias("batch"))
        return state.join(newest, ["bucket", "batch"]).select("call_id", "request_hash", "last", "good", "bucket")

    def merge(self, records: DataFrame, number: int) -> None:
        """Takes a batch of records in. The same number again replaces what it wrote."""
        bucket = F.pmod(F.xxhash64("call_id"), F.lit(self.buckets)).cast("int")
        new = records.select("call_id", "request_hash", F.col("line_no").alias("last"), F.when(F.col("ok"), F.col("line_no")).alias("good"), bucket.alias("bucket"))
        old = self._versions(number).join(new.select("bucket").distinct(), "bucket", "left_semi").select(*new.columns)
        merged = old.unionByName(new).groupBy("bucket", "call_id", "request_hash").agg(F.max("last").alias("last"), F.max("good").alias("good"))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={number}")

    def latest(self) -> DataFrame:
        """call_id, request_hash, line_no, as runlog.latest_successful of all records so far."""
        last = self._versions().groupBy("call_id").agg(F.max(F.struct("last", "request_hash", "good")).alias("x"))
        return last.where("x.good is not null").select("call_id", F.col("x.request_hash").alias("request_hash"), F.col("x.good").alias("line_no"))

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        take: Callable[[DataFrame, int], None] = self.merge
        return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
