"""Exact line deduplication by levelled sorted runs of line hashes.

Documents are taken in ascending doc_id order, a batch at a time. The store
keeps the hashes of all lines seen so far in sorted runs, each with the doc_id
that owns the line. A batch merge-joins its hashes with the runs (a hash that no run
holds becomes the batch's own) and the result is a run of level 0;
FAN_IN runs of one level are merged into one run of the next, so that a hash
is rewritten a logarithmic number of times and a batch probes few runs. Runs are tables
bucketed and sorted by hash, in as many buckets as a shuffle has partitions: a batch's hashes are dealt
and sorted once, runs are read and merged as they lie.

A line's key is the line without spaces and control white space at its ends,
A-Z lower-cased. Keys of at least `min_chars` code points that occur in two
documents or more lose all their lines except in the smallest doc_id that holds
the key; there every repetition stays.

Defined results: a null or empty text is one empty line. Rows that share a
doc_id count as one document for ownership, and each row keeps its own lines. A
null doc_id comes after every other and counts as one with the largest long. An empty table gives an empty result.
Extra columns, whatever their names, are ignored by `line_dedup` and kept by `dedup_documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm.shared import WHILE_WRITING, WORK, ascii_lower, blocks_of, set_for, stored, stored_alone, work_path

FAN_IN = 2
#: Lines of a batch, and the least number of batches.
BATCH_LINES, LEAST_BATCHES = 200_000_000, 4
#: The largest long stands for a null doc_id.
NO_ID = (1 << 63) - 1
#: A run has one file for each bucket, sorted: its scan is sorted too.
SORTED_SCANS = {**WHILE_WRITING, "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}


class LineRuns:
    """Levelled sorted runs of (line hash, owner) in the shared folder. Every hash is in one run."""

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN):
        self.spark, self.fan_in, self.buckets = spark, fan_in, blocks_of(spark)
        self.levels: list[list[DataFrame]] = []
        self.tables: list[str] = []

    def write(self, df: DataFrame, level: int) -> DataFrame:
        """df, dealt by h, as a table bucketed and sorted by h."""
        name = f"tarnfield_{uuid.uuid4().hex}"
        path = work_path(self.spark, f"run-{level}")
        with set_for(self.spark, SORTED_SCANS):
            df.write.bucketBy(self.buckets, "h").sortBy("h").option("path", path).saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def held(self, hashes: DataFrame) -> DataFrame:
        """hashes (h, ..) with the owner that a run holds for each, or null."""
        owners = []
        for i, run in enumerate(r for level in self.levels for r in level):
            hashes = hashes.join(run.withColumnRenamed("owner", f"owner_{i}"), "h", "left")
            owners.append(f"owner_{i}")
        owner = F.coalesce(*owners) if owners else F.lit(None)
        return hashes.withColumn("owner", owner.cast("long")).drop(*owners)

    def add(self, run: DataFrame) -> None:
        """Takes a run (h, owner) of new hashes, read from a table that `write` wrote; merges full levels."""
        level = 0
        while True:
            if len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fan_in:
                return
            merged = self.levels[level][0]
            for other in self.levels[level][1:]:
                merged = merged.join(other.withColumnRenamed("owner", "other"), "h", "full_outer").select("h", F.coalesce("owner", "other").alias("owner"))
            self.levels[level] = []
            run, level = self.write(merged, level + 1), level + 1

    def close(self) -> None:
        """Takes the tables out of the catalog; their files are working tables like others."""
        for name in self.tables:
            self.spark.sql(f"drop table if exists {name}")


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row for each long enough line: row key, owner order, hash of its key and position."""
    text = F.coalesce(F.col("text"), F.lit(""))
    flat = docs.select("row", "id", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    flat = flat.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    return flat.select("row", "id", "pos", F.unhex(F.md5(F.col("key"))).alias("h"))


def _hot(counts: DataFrame, lines: float, most: int = 1000) -> DataFrame:
    """The hashes on more than one line of `most`: at most that many rows, whatever the input."""
    return counts.where(F.col("n") * most > F.lit(lines)).select("h", "owner")


def dropped_positions(docs: DataFrame, min_chars: int = 10, batches: int | None = None) -> DataFrame:
    """(row, drop: sorted positions) for the rows of docs (row, id, text) that lose lines."""
    spark, since = docs.sparkSession, len(WORK)
    lines = stored(_lines(docs, min_chars), "lines")
    total = lines.count()
    batches = batches or max(LEAST_BATCHES, -(-total // BATCH_LINES))
    bounds = docs.where(F.col("id") < NO_ID).approxQuantile("id", [i / batches for i in range(1, batches)], 0.1 / batches)
    bounds = sorted({int(x) for x in bounds})
    runs, out = LineRuns(spark), []
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        batch = lines
        if low is not None:
            batch = batch.where(F.col("id") > low)
        if high is not None:
            batch = batch.where(F.col("id") <= high)
        mine = batch.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
        seen = runs.write(runs.held(mine), 0)
        runs.add(seen.where("owner is null").select("h", F.col("first").alias("owner")))
        # only hashes with a line outside their owner can lose one
        owners = seen.select("h", F.coalesce("owner", "first").alias("owner"), "last", "n").where("last > owner")
        hot = _hot(owners, total)
        cold = owners.join(F.broadcast(hot.select("h")), "h", "left_anti").select("h", "owner")
        by_hot = batch.join(F.broadcast(hot), "h")
        by_cold = batch.join(F.broadcast(hot.select("h")), "h", "left_anti").join(cold, "h")
        for part in (by_hot, by_cold):
            out.append(part.where("id > owner").select("row", "pos"))
    drops = out[0]
    for part in out[1:]:
        drops = drops.unionByName(part)
    drops = stored_alone(drops.groupBy("row").agg(F.array_sort(F.collect_set("pos")).alias("drop")), "drops", since)
    runs.close()
    return drops


def _numbered(documents: DataFrame) -> DataFrame:
    """doc: all columns of a row, row: its name, id, text. Rows with the same id and text fare alike, so the two name a row."""
    docs = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")
    return docs.withColumn("row", F.struct("id", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))))


def _kept_lines() -> tuple[Column, Column, Column]:
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    n = F.size(lines)
    keep = F.array_except(F.sequence(F.lit(0), n - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n"))
    return n, F.coalesce(F.size("drop"), F.lit(0)), kept


def line_dedup(documents: DataFrame, min_chars: int = 10, batches: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that stays, of every row."""
    docs = _numbered(documents.select("doc_id", "text"))
    drops = dropped_positions(docs.select("row", "id", "text"), min_chars, batches)
    n, dropped, kept = _kept_lines()
    return docs.join(drops, "row", "left").select("doc.doc_id", n.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), kept.alias("kept_text"))


def dedup_documents(documents: DataFrame, min_chars: int = 10, batches: int | None = None) -> DataFrame:
    """documents with the columns they had: repeated lines gone, n_chars counted anew, rows left without text gone if they had any."""
    docs = _numbered(documents)
    drops = dropped_positions(docs.select("row", "id", "text"), min_chars, batches)
    _, dropped, kept = _kept_lines()
    out = docs.join(drops, "row", "left").withColumn("kept", kept).where((dropped == 0) | (F.length(F.btrim(F.col("kept"), F.lit(" \t\n\x0b\x0c\r"))) > 0))
    cols = [F.col("kept").alias("text") if c == "text" else F.length("kept").cast(documents.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(f"doc.`{c}`") for c in documents.columns]
    return out.select(*cols)
