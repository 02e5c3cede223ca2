"""Texts that a model writes until they pass a check, and a count of how that went."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.operators.responders import Responder, answered

OUTCOME = "task_id string, text string, attempts int, problems array<string>"


def generate(tasks: DataFrame, make: Callable[[], Responder], check: Callable[[Column, Column], Column], retry: str, most_attempts: int = 3, keep: Callable[[DataFrame], DataFrame] | None = None, **how: Any) -> DataFrame:
    """task_id, text, attempts, problems: each task's text once it passes, or null after the last attempt.

    tasks: task_id, provider, prompt. check(task_id, text) is a column that says what is wrong, null if nothing is. A task that
    fails is asked again with its draft and the retry text, in which {problem} stands for what is wrong. Each attempt is one run
    over the tasks still open; keep, if given, stores an attempt's answers, so that a call is not made again when its rows are read twice.
    """
    spark = tasks.sparkSession
    open_ = tasks.select("task_id", "provider", "prompt", F.col("prompt").alias("asked"), F.array().cast("array<string>").alias("problems"))
    out = spark.createDataFrame([], OUTCOME)
    for attempt in range(1, most_attempts + 1):
        calls = open_.select(F.col("task_id").alias("call_id"), F.sha2("asked", 256).alias("request_hash"), "provider", F.col("asked").alias("prompt"))
        got = answered(calls, make, **how).select(F.col("call_id").alias("task_id"), "ok", F.trim("text").alias("text"))
        got = keep(got) if keep is not None else got.persist()
        problem = F.when(F.coalesce("ok", F.lit(False)), check(F.col("task_id"), F.col("text"))).otherwise(F.lit("The call failed."))
        told = open_.join(got, "task_id", "left").withColumn("problem", problem)
        out = out.unionByName(told.where("problem is null").select("task_id", "text", F.lit(attempt).alias("attempts"), "problems"))
        again = F.concat(F.col("prompt"), F.lit("\n\nYour draft:\n"), F.coalesce("text", F.lit("")), F.lit("\n\n"), F.replace(F.lit(retry), F.lit("{problem}"), F.col("problem")))
        open_ = told.where("problem is not null").select("task_id", "provider", "prompt", again.alias("asked"), F.concat("problems", F.array("problem")).alias("problems"))
        if open_.isEmpty():
            return out
    return out.unionByName(open_.select("task_id", F.lit(None).cast("string").alias("text"), F.lit(most_attempts).alias("attempts"), "problems"))


def build_summary(outcomes: DataFrame) -> DataFrame:
    """tasks, passed, failed and how many attempts passed tasks took (a map), in one row."""
    passed = F.col("text").isNotNull()
    per = outcomes.where(passed).groupBy("attempts").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attempts", "n")))).alias("attempts"))
    return outcomes.agg(F.count("*").alias("tasks"), F.count_if(passed).alias("passed"), F.count_if(~passed).alias("failed")).join(per)


def survivors(checked: DataFrame, targets: DataFrame) -> DataFrame:
    """type, split, found, target and whether too few items of a type passed the checks (checked: type, split, ok)."""
    found = checked.groupBy("type", "split").agg(F.count_if("ok").alias("found"))
    return targets.join(found, ["type", "split"], "left").select("type", "split", F.coalesce("found", F.lit(0)).alias("found"), "target", (F.coalesce("found", F.lit(0)) < F.col("target")).alias("short"))
