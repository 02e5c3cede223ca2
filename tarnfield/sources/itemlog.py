"""Item logs: one JSON line for an item under a condition, their summaries, and selections of rows."""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.sources.library import LibraryError

CALL = "struct<text:string,model_returned:string,input_tokens:long,output_tokens:long,reasoning_tokens:long,finish_reason:string>"
_RANKED = "array<struct<chunk_id:string,score:double>>"
#: What is recorded of an item: the stages' results, where each labelled span went, the model calls and the verdict.
ITEM_LOG = (
    "item_id string, type string, asker string, answerable boolean, condition string, config_id string, queries array<string>, "
    f"searched {_RANKED}, removed array<struct<chunk_id:string,reason:string>>, ranked {_RANKED}, prompt_chunks array<string>, "
    "spans array<struct<kind:string,span:struct<doc_id:string,version:int,start:int,end:int>,cut:boolean,searched:int,filtered:int,reranked:int,in_prompt:boolean>>, "
    f"evidence_rank int, distractor_above boolean, leaks array<string>, answer {CALL}, judge {CALL}, "
    "verdict struct<declined:boolean,correct:boolean,faithful:boolean,reason:string>, judge_error string, code_check boolean, lost_at string"
)
COLUMNS = [c.split(" ")[0] for c in ITEM_LOG.replace("struct<", "").split(", ")]


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an item log; a line that is no such row fails the read, blank lines are skipped."""
    return spark.read.schema(ITEM_LOG).option("mode", "FAILFAST").json(path)


def write_log(log: DataFrame, path: str) -> None:
    """An item log with all its columns; nulls are written out."""
    if missing := [c for c in COLUMNS if c not in log.columns]:
        raise LibraryError(f"the log lacks {missing}")
    log.select(F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_condition(spark: SparkSession, results: str, condition: str) -> tuple[DataFrame, dict[str, Any]]:
    """The log and the summary of results/<condition>."""
    summary = spark.read.text(f"{results}/{condition}/summary.json", wholetext=True).first()  # a run's one summary
    return read_log(spark, f"{results}/{condition}/log.jsonl"), json.loads(summary.value)


def read_all(spark: SparkSession, results: str) -> DataFrame:
    """The logs of all conditions of a run, each row with its folder's name as `condition`."""
    log = read_log(spark, f"{results}/*/log.jsonl")
    return log.withColumn("condition", F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/log\\.jsonl(?:/[^/]+)?$", 1))


def item_scores(log: DataFrame) -> DataFrame:
    """What scoring reads of a log."""
    return log.select("item_id", "type", "asker", "answerable", "evidence_rank", "leaks", "verdict")


def of_type(rows: DataFrame, *types: str) -> DataFrame:
    return rows.where(F.col("type").isin(*types))


def select(rows: DataFrame, **equal: Any) -> DataFrame:
    """Rows whose columns equal the given values; a value of None asks nothing."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    return rows


#: Keys of one range of a digest's tree.
DIGEST_KEYS = 1024


def checksum(rows: DataFrame, key: str) -> DataFrame:
    """checksum, items: a digest of the rows in the order of their key, for comparing with a committed one.

    A tree of digests: rows are digested where they are, the digests of DIGEST_KEYS neighbouring keys make one of
    the range, in order, those of so many ranges the next, until one range is left. Ranges are of numbers; other keys go by
    their crc32. So no task holds more than a range, and the digest doesn't depend on how rows are partitioned.
    """
    whole = dict(rows.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    number = F.col(key).cast("long") if whole else F.crc32(F.col(key).cast("string").cast("binary"))
    line = F.md5(F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns]).cast("binary"))
    # a row's place is its number, then its key and digest; a null key comes first
    level = rows.select(F.coalesce(number, F.lit(-1)).alias("at"), F.struct(F.col(key).alias("k"), line.alias("d")).alias("place"), line.alias("digest"), F.lit(1).cast("long").alias("items"))
    low, high = level.agg(F.min("at"), F.max("at")).first()
    while True:
        parts = F.array_sort(F.collect_list(F.struct("at", "place", "digest")))
        cell = F.floor(F.col("at") / DIGEST_KEYS).cast("long")
        level = level.groupBy(cell.alias("cell")).agg(F.md5(F.array_join(F.transform(parts, lambda x: x["digest"]), "").cast("binary")).alias("digest"), F.sum("items").alias("items"))
        level = level.select(F.col("cell").alias("at"), F.struct("cell").alias("place"), "digest", "items")
        low, high = (None if x is None else x // DIGEST_KEYS for x in (low, high))
        if low == high:
            return level.select(F.col("digest").alias("checksum"), "items")


def committed(rows: DataFrame, key: str, config: dict, known: dict | None) -> bool:
    """Whether committed items were made with this config and are unchanged; otherwise they are built anew."""
    return known is not None and known.get("config") == config and known.get("checksum") == checksum(rows, key).first().checksum


def append_line(path: str, record: dict) -> None:
    """One JSON line put at the end of a driver's own file and flushed to disk, under a lock; a torn last line is closed first."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "ab+") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        with contextlib.suppress(OSError):  # an empty file has no last byte
            f.seek(-1, os.SEEK_END)
            if f.read(1) != b"\n":
                f.write(b"\n")
        f.write(json.dumps(record, ensure_ascii=False).encode() + b"\n")
        f.flush()
        os.fsync(f.fileno())


def write_summary_json(rows: DataFrame | dict, path: str) -> None:
    """A summary of one row, or a mapping, as indented JSON; replaced in one step."""
    data = rows if isinstance(rows, dict) else json.loads(rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first().j)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        f.write(json.dumps(data, indent=1, default=str) + "\n")
    os.replace(part, path)
