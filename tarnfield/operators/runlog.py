"""The append-only call log: latest answers, resume, pacing, budgets and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_successful(log: DataFrame) -> DataFrame:
    """Each call's last success whose request is the one last tried: a later failure of a new request voids older answers.

    Two aggregates with map-side combining; no call's records meet in a window.
    """
    last = log.groupBy("call_id").agg(F.max(F.struct("line_no", "request_hash")).alias("l")).select("call_id", F.col("l.request_hash").alias("request_hash"))
    good = log.where("ok").groupBy("call_id", "request_hash").agg(F.max("line_no").alias("line_no"))
    return good.join(last, ["call_id", "request_hash"])


def pending(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Planned calls without an answer to the request now planned."""
    return planned.join(done, ["call_id", "request_hash"], "left_anti")


def slots(arrivals: DataFrame, by: str, at: str, order: str, interval: float) -> DataFrame:
    """When a limiter lets each call of a provider go: max over earlier arrivals of (arrival - i * interval) + n * interval."""
    w = Window.partitionBy(by).orderBy(at, order)
    n = F.row_number().over(w)
    run = F.max(F.col(at) - F.col("__n") * interval).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return arrivals.withColumn("__n", n).withColumn("slot", run + F.col("__n") * interval).drop("__n")


def trimmed(turns: DataFrame, budget: int, pinned: Column) -> DataFrame:
    """Turns that stay when the oldest droppable ones go until the tokens fit; pinned rows and the last turn are kept."""
    by = Window.partitionBy("conv_id")
    last = F.max("turn").over(by)
    t = turns.withColumn("keep", pinned | (F.col("turn") == last)).withColumn("total", F.sum("tokens").over(by))
    before = by.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.sum(F.when(F.col("keep"), 0).otherwise(F.col("tokens"))).over(before), F.lit(0))
    t = t.withColumn("gone", gone)
    return t.where(F.col("keep") | (F.col("total") - F.col("gone") <= budget)).drop("keep", "total", "gone")


def hash_order(seed: int, key: Column) -> Column:
    """A fixed random order of keys."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def stratified_pilot(items: DataFrame, key: str, stratum: str, fraction: float, seed: int = 7) -> DataFrame:
    """One item of each stratum, then others at random up to the fraction of all. Only hashes and keys are ordered."""
    h = items.select(key, stratum, hash_order(seed, F.col(key)).alias("h"))
    firsts = h.groupBy(stratum).agg(F.min(F.struct("h", key)).alias("f")).select(F.col(f"f.{key}").alias(key))
    size = h.agg(F.greatest(F.lit(1), F.round(F.count("*") * fraction)).alias("n")).first().n
    rest = max(int(size) - firsts.count(), 0)
    more = h.join(firsts, key, "left_anti").orderBy("h", key).limit(rest).select(key)
    return firsts.unionByName(more)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those of equal key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
