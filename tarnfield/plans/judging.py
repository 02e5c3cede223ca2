"""Judges set against each other: a second judge reads what the first one read, and may take its place if both agree and the hand marks bear it out."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.functions.stats import proportion
from tarnfield.operators import responders
from tarnfield.operators.corpus_build import chance
from tarnfield.plans import condition, pipeline
from tarnfield.session import written
from tarnfield.sources.responses import ResponseFolder

FIELDS = ("declined", "correct", "faithful")


def drawn(log: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """item_id of `size` items that have a verdict, by digest; all of them where there are fewer."""
    return log.where("verdict is not null").select("item_id").distinct().orderBy(chance("item_id", seed=seed), "item_id").limit(size)


def prompts_again(log: DataFrame, sample: DataFrame, chunks: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, prompt: what the judge was given for each sampled item, rebuilt from the log's passages and answer.

    log: ITEM_LOG. chunks: as pipeline.chunks_of, by the spec of the run. A logged passage that the library no longer has is an error. An
    item without an answer is judged on an empty one; one that `items` lacks has no row.
    """
    mine = log.join(sample.select(F.col("item_id").cast("string").alias("item_id")).distinct(), "item_id", "left_semi")
    places = mine.select(F.col("item_id").alias("query_id"), F.posexplode("prompt_chunks").alias("n", "chunk_id")).join(chunks.select("chunk_id", "pos"), "chunk_id", "left")
    lacking = F.raise_error(F.concat(F.lit("the library has no passage "), F.col("chunk_id"))).cast("long")
    prompt = places.select("query_id", (F.col("n") + 1).alias("place"), F.coalesce("pos", lacking).alias("pos"))
    asked = items.withColumn("item_id", F.col("item_id").cast("string")).join(mine.select("item_id"), "item_id", "left_semi")
    asked = asked if "answer" in items.columns else asked.withColumn("answer", F.lit(None).cast("string"))
    said = mine.select("item_id", F.struct(F.coalesce("answer.text", F.lit("")).alias("text")).alias("call"))
    return condition.judge_prompts(asked, {"texts": pipeline.prompt_texts(prompt, chunks, asked)}, said)


def second_judge(prompts: DataFrame, model: condition.Model, make: Callable[[], responders.Responder], folder: ResponseFolder | None = None, **how: Any) -> DataFrame:
    """item_id, verdict, error of a second judge for every prompt, under the first one's rule of asking once more. A written table."""
    judged = condition.judge(prompts, "second-judge", model, make, folder, **how)
    error = F.when(F.col("verdict").isNull(), F.coalesce("error", F.lit("no reply")))
    return written(prompts.select("item_id").join(judged, "item_id", "left").select("item_id", "verdict", error.alias("error")))


def _pairs(first: DataFrame, second: DataFrame, *by: str) -> DataFrame:
    return first.select("item_id", *by, F.col("verdict").alias("a")).join(second.select("item_id", F.col("verdict").alias("b")), "item_id").where("a is not null and b is not null")


def agreement(first: DataFrame, second: DataFrame, fields: tuple[str, ...] = FIELDS, by: tuple[str, ...] = ()) -> DataFrame:
    """by, field, agree (as proportion) over items (item_id, verdict) that both have judged; a field that either left open doesn't count.

    The columns of `by` are the first's. A field that nobody gave is a row of 0 of 0, as long as both judged some item.
    """
    both = _pairs(first, second, *by)
    counts = [F.struct(F.lit(f).alias("field"), F.count_if(F.col(f"a.{f}") == F.col(f"b.{f}")).alias("same"), F.count_if((F.col(f"a.{f}") == F.col(f"b.{f}")).isNotNull()).alias("of")) for f in fields]
    rows = both.groupBy(*by).agg(F.array(*counts).alias("x")).select(*by, F.explode("x").alias("x"))
    return rows.select(*by, "x.field", proportion(F.col("x.same"), F.col("x.of")).alias("agree"))


def handled(answerable: Column, verdict: Column) -> Column:
    """Whether an item was handled right: answered rightly from the passages, or declined where there is no answer."""
    return F.when(answerable, verdict["correct"] & verdict["faithful"]).otherwise(verdict["declined"])


def two_judges(log: DataFrame, second: DataFrame) -> DataFrame:
    """One row: both (items with two verdicts), agree (a map of proportions by field), first_right and second_right (items handled right by either's verdict)."""
    both = _pairs(log, second, "answerable").agg(F.count("*").alias("both"), F.count_if(handled(F.col("answerable"), F.col("a"))).alias("first_right"), F.count_if(handled(F.col("answerable"), F.col("b"))).alias("second_right"))
    agree = agreement(log, second).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "agree")))).alias("agree"))  # a row for each field
    return both.join(agree).select("both", "agree", "first_right", "second_right")


def switch_report(sample: DataFrame, old: DataFrame, new: DataFrame, hand: DataFrame, least_old: float = 0.9, least_hand: float = 0.8, by: tuple[str, ...] = ()) -> DataFrame:
    """Whether a new judge may take the old one's place on a sample (item_id and the columns of `by`): a row in all or for each group.

    items, no_verdict (items that the new judge gave none for), old_declined, old_correct, old_faithful, hand_declined and
    hand_correct (proportions of the items that both judged), passed: a verdict for every item, the old judge agreed with on
    `least_old` of all items as to declined and correct, and the hand marks on `least_hand` of those it judged as to correct.
    old, new, hand: item_id, verdict. Without hand marks it does not pass.
    """
    rows = sample.select("item_id", *by).dropDuplicates(["item_id"])
    for name, marks in (("n", new), ("o", old), ("h", hand)):
        rows = rows.join(marks.select("item_id", F.col("verdict").alias(name)), "item_id", "left")
    same = lambda who, f: F.col(f"n.{f}") == F.col(f"{who}.{f}")
    asked = [("old", "o", f) for f in FIELDS] + [("hand", "h", f) for f in ("declined", "correct")]
    counts = [c for who, a, f in asked for c in (F.count_if(same(a, f)).alias(f"{who}_{f}_c"), F.count(same(a, f)).alias(f"{who}_{f}_n"))]
    told = rows.groupBy(*by).agg(F.count("item_id").alias("items"), (F.count("item_id") - F.count("n")).alias("no_verdict"), *counts)
    enough = [F.col(f"old_{f}_c") >= F.ceil(F.col("items") * least_old) for f in ("declined", "correct")]
    passed = (F.col("items") > 0) & (F.col("no_verdict") == 0) & enough[0] & enough[1] & (F.col("hand_correct_n") > 0) & (F.col("hand_correct_c") >= F.ceil(F.col("hand_correct_n") * least_hand))
    return told.select(*by, "items", "no_verdict", *[proportion(F.col(f"{who}_{f}_c"), F.col(f"{who}_{f}_n")).alias(f"{who}_{f}") for who, _, f in asked], passed.alias("passed"))
