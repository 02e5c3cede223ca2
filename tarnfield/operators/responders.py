"""The boundary to models: planned calls in, run records out, with validation, pacing and retries.

A responder is any object with `validate(call)`, which raises ValueError, and `respond(call)`, which returns the
answer's fields. Send times are planned before anything is sent: a column that every lane of a provider obeys.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.operators.runlog import pending, slots
from tarnfield.sources.responses import ResponseFolder

ATTEMPTS, FIRST_WAIT = 5, 1.0
RECORD = "call_id string, request_hash string, provider string, ok boolean, attempts int, text string, input_tokens long, output_tokens long, error string"


class Retryable(Exception):
    """A failure that may pass; `after` seconds are waited if the provider says so."""

    def __init__(self, message: str, after: float | None = None):
        super().__init__(message)
        self.after = after


class Responder(Protocol):
    def validate(self, call: dict[str, Any]) -> None: ...

    def respond(self, call: dict[str, Any]) -> dict[str, Any]: ...


class MockResponder:
    """Answers that are a function of the prompt: for tests and dry runs."""

    def validate(self, call: dict[str, Any]) -> None:
        if not call["prompt"]:
            raise ValueError("the prompt is empty")

    def respond(self, call: dict[str, Any]) -> dict[str, Any]:
        digest = hashlib.sha256(call["prompt"].encode()).hexdigest()
        return {"text": f"echo {digest[:8]}", "input_tokens": len(call["prompt"].split()), "output_tokens": 2}


def attempt(responder: Responder, call: dict[str, Any], sleep: Callable[[float], None] = time.sleep) -> dict[str, Any]:
    """One call with at most ATTEMPTS tries; waits double from FIRST_WAIT unless the provider names its own."""
    wait, tried, error = FIRST_WAIT, 0, ""
    while tried < ATTEMPTS:
        tried += 1
        try:
            return {"ok": True, "attempts": tried, "error": None} | responder.respond(call)
        except Retryable as e:
            error = str(e)
            if tried < ATTEMPTS:
                sleep(e.after if e.after is not None else wait)
                wait *= 2
        except Exception as e:  # any other failure is final and recorded
            error = str(e)
            break
    return {"ok": False, "attempts": tried, "error": error, "text": None, "input_tokens": None, "output_tokens": None}


def answered(calls: DataFrame, make: Callable[[], Responder], lanes: int = 1, interval: float = 0.0, folder: ResponseFolder | None = None) -> DataFrame:
    """Run records of calls (call_id, request_hash, provider, prompt). All calls are validated before one is sent.

    Each call has a slot of its provider's limiter, `interval` seconds apart; its lanes, a task or part of one each, send
    in the order of slots and keep to them. A folder keeps each record as it comes, and a request it has is not sent.
    """

    def bad(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        responder = make()
        for chunk in chunks:
            said = []
            for call in chunk.to_dict("records"):
                try:
                    responder.validate(call)
                except ValueError as e:
                    said.append((call["call_id"], str(e)))
            yield pd.DataFrame(said, columns=["call_id", "problem"])

    problem = calls.mapInPandas(bad, "call_id string, problem string").first()
    if problem is not None:
        raise ValueError(f"call {problem.call_id}: {problem.problem}")

    def send(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        responder, free = make(), 0.0
        for chunk in chunks:
            rows = []
            for call in chunk.to_dict("records"):
                record = folder.get(call["request_hash"]) if folder else None
                if record is None:
                    # not before its slot, nor sooner after the lane's last call than all lanes together allow
                    now = time.time()
                    due = max(began + call["slot"], free)
                    if due > now:
                        time.sleep(due - now)
                    free = max(due, now) + lanes * interval
                    record = {k: call[k] for k in ("call_id", "request_hash", "provider")} | attempt(responder, call)
                    if folder:
                        folder.put(record)
                rows.append(record | {"call_id": call["call_id"]})
            if rows:
                yield pd.DataFrame(rows)[[x.split(" ")[0] for x in RECORD.split(", ")]]

    began = time.time()
    first = slots(calls.withColumn("at", F.lit(0.0)), "provider", "at", "call_id", interval)
    lane = F.pmod(F.row_number().over(Window.partitionBy("provider").orderBy("slot", "call_id")), F.lit(lanes))
    timed = first.withColumn("lane", lane).repartition("provider", "lane").sortWithinPartitions("provider", "slot")
    return timed.mapInPandas(send, RECORD)


def run(planned: DataFrame, done: DataFrame, make: Callable[[], Responder], folder: ResponseFolder | None = None, **how: Any) -> DataFrame:
    """Records for what `done` lacks: equal requests are sent once and their answer goes to every call that planned it.

    With a folder, requests that it has an answer to are not sent, and each answer is put there before the next call
    goes: a task that runs again, or the whole run, sends only what it had no record of.
    """
    todo = pending(planned, done)
    leaders = todo.groupBy("request_hash", "provider").agg(F.min(F.struct("call_id", "prompt")).alias("x")).select("request_hash", "provider", "x.call_id", "x.prompt")
    known = folder.answers(planned.sparkSession, RECORD).dropDuplicates(["request_hash"]) if folder else None
    got = answered(folder.lacking(leaders, RECORD) if folder else leaders, make, folder=folder, **how)
    got = got if known is None else got.unionByName(known.join(todo.select("request_hash").distinct(), "request_hash", "left_semi").select(*got.columns))
    # one answer for each request: what was sent since the folder was listed is among both
    got = got.drop("call_id", "provider").dropDuplicates(["request_hash"])
    return todo.select("call_id", "request_hash", "provider").join(got, "request_hash")


def check_budget(estimate: DataFrame, limit: float) -> float:
    """The estimate's highest cost; refuses above the limit and where a price is missing. estimate: cost_high of each group."""
    r = estimate.agg(F.sum("cost_high").alias("total"), F.count_if(F.col("cost_high").isNull()).alias("missing")).first()
    if r.missing:
        raise ValueError(f"{r.missing} groups have no price")
    if (r.total or 0.0) > limit:
        raise ValueError(f"the run may cost {r.total:.2f}, the budget is {limit:.2f}")
    return r.total or 0.0
