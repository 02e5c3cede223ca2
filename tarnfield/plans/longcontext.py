"""The long-context arm: the whole library in one prompt, the question after it, and how it fares against retrieval.

The library is one text within a model's context, whose size is checked before anything is gathered. It is sent to each task
once; planned calls carry a mark in its place, which names its digest, so that they stay small and a changed library is a new request.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.functions import bpe
from tarnfield.functions.stats import mcnemar, proportion
from tarnfield.operators import responders
from tarnfield.plans import condition
from tarnfield.session import written
from tarnfield.sources.responses import ResponseFolder

#: No token of a byte-pair vocabulary is longer, so that a count of tokens bounds bytes.
TOKEN_BYTES = 256


@dataclass(frozen=True)
class Packed:
    text: str
    tokens: int
    documents: int

    @property
    def mark(self) -> str:
        return "{library " + hashlib.sha256(self.text.encode()).hexdigest() + "}"


def blocks(docs: DataFrame, first: Column | None = None) -> DataFrame:
    """doc_key, late, block: each current public document under its title and key; late is 0 where `first` holds, else 1.

    docs: doc_key, title, text, access, status; null titles and texts are empty.
    """
    shown = docs.where((F.col("access") == "public") & (F.col("status") == "current"))
    body = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\r"))
    late = F.lit(1) if first is None else F.when(first, 0).otherwise(1)
    return shown.select("doc_key", late.alias("late"), F.concat(F.lit("[Document: "), F.coalesce("title", F.lit("")), F.lit(" ("), F.col("doc_key"), F.lit(")]\n"), body).alias("block"))


def packed(docs: DataFrame, most_tokens: int, first: Column | None = None, **how: Any) -> Packed:
    """The library's documents in the order of their keys, those that `first` holds for before the others.

    A library of more than most_tokens is an error: nothing of it is left out. how: vocabulary and pattern of the tokens.
    """
    rows = written(blocks(docs, first))
    sizes = bpe.token_counts(rows, "doc_key", "block", **how).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()
    bytes_ = rows.agg(F.coalesce(F.sum(F.octet_length("block")), F.lit(0)).alias("n")).first()
    if sizes.n > most_tokens or bytes_.n > most_tokens * TOKEN_BYTES:
        raise ValueError(f"the library has {sizes.n} tokens, a prompt may have {most_tokens}")
    parts = [r.block for r in rows.orderBy("late", "doc_key", "block").select("block").collect()]  # within the bound just checked
    text = "\n\n".join(parts)
    count = bpe.token_counts(docs.sparkSession.createDataFrame([(0, text)], "k long, text string"), "k", **how).first().tokens
    return Packed(text, count, len(parts))


class WithLibrary:
    """A responder that puts the library where a prompt has its mark, in the task that sends it."""

    def __init__(self, inner: responders.Responder, mark: str, text: str):
        self.inner, self.mark, self.text = inner, mark, text

    def _whole(self, call: dict[str, Any]) -> dict[str, Any]:
        return call | {"prompt": (call["prompt"] or "").replace(self.mark, self.text, 1)}

    def validate(self, call: dict[str, Any]) -> None:
        self.inner.validate(self._whole(call))

    def respond(self, call: dict[str, Any]) -> dict[str, Any]:
        return self.inner.respond(self._whole(call))


def of_each_type(items: DataFrame, n: int) -> DataFrame:
    """The first n items of each type, by id: a pilot."""
    ranked = items.withColumn("place_", F.row_number().over(Window.partitionBy("type").orderBy("item_id")))
    return ranked.where(F.col("place_") <= n).drop("place_")


def prompts(items: DataFrame, head: str) -> DataFrame:
    """item_id, prompt: the head that all items share, earlier turns if there are some, the question last."""
    history = F.nullif("history", F.lit("")) if "history" in items.columns else F.lit(None).cast("string")
    return items.select("item_id", F.concat_ws("\n\n", F.lit(head), history, F.concat(F.lit("Question: "), F.coalesce("question", F.lit("")))).alias("prompt"))


def run(docs: DataFrame, items: DataFrame, name: str, results: str, model: condition.Model, make: Callable[[], responders.Responder], most_tokens: int, judge_model: condition.Model | None = None, first: Column | None = None, folder: ResponseFolder | None = None, sending: dict[str, Any] | None = None, **how: Any) -> DataFrame:
    """Asks every item with the whole library before it, judges and logs it under results/name; returns its one summary row.

    items: item_id, type, answerable, question, and answer, history and key_values if there are some. The log has item_id, type, answerable, answer,
    verdict, judge_error and code_check. The judge is told how long the library was instead of reading it, so its `faithful` says nothing here.
    """
    send = sending or {}
    library = packed(docs, most_tokens, first, **how)
    shared, mark = docs.sparkSession.sparkContext.broadcast(library.text), library.mark  # at most most_tokens
    answers = condition.wave(condition.calls_of(prompts(items, f"Documents:\n\n{mark}"), "answer", name, model, condition.ANSWER), lambda: WithLibrary(make(), mark, shared.value), model, folder, **send)
    note = f"Passages:\n\n(the whole library, {library.tokens} tokens, was given; it is not repeated here)"
    known = items if "answer" in items.columns else items.withColumn("answer", F.lit(None).cast("string"))
    told = {"texts": prompts(items, note).withColumnRenamed("item_id", "query_id")}
    judged = written(condition.judge(condition.judge_prompts(known, told, answers), name, judge_model or model, make, folder, **send))
    keyed = items.select("item_id", "type", "answerable", F.col("key_values") if "key_values" in items.columns else F.lit(None).cast("array<string>").alias("key_values"))
    log = keyed.join(answers.withColumnRenamed("call", "answer"), "item_id", "left").join(judged.select("item_id", "verdict", F.col("error").alias("judge_error")), "item_id", "left")
    log = written(log.select(F.col("item_id").cast("string").alias("item_id"), "type", "answerable", "answer", "verdict", "judge_error", condition.code_check(F.col("key_values"), F.col("answer")).alias("code_check")))
    log.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(f"{results}/{name}/log.jsonl")
    about = {"condition": name, "library_tokens": library.tokens, "documents": library.documents, "answer_model": model.name, "judge_model": (judge_model or model).name}
    counts = log.agg(F.count("*").alias("items"), F.count("answer").alias("answered"), F.count("verdict").alias("judged"), F.coalesce(F.sum("answer.input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("answer.output_tokens"), F.lit(0)).alias("output_tokens"))
    summary = counts.select(*[F.lit(v).alias(k) for k, v in about.items()], *counts.columns)
    summary.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(f"{results}/{name}/summary.json")
    return summary


def against(long: DataFrame, retrieval: DataFrame, by: tuple[str, ...] = ("type",)) -> DataFrame:
    """The long-context arm and a retrieval arm on what both measure: the judge's `correct` and the code check.

    by (of the long arm's log), items in both logs, then for judge and code: <m>_long and <m>_retrieval (proportions of the items that both arms have it
    for), <m>_gained, <m>_lost (items that only the long, or only the retrieval arm has right) and <m>_p, the exact two-sided p.
    Logs: item_id, verdict, code_check; an item id must stand once in a log.
    """
    pick = lambda log, x, *more: log.select("item_id", *more, F.col("verdict.correct").alias(f"judge_{x}"), F.col("code_check").alias(f"code_{x}"))
    both = pick(long, "l", *by).join(pick(retrieval, "r"), "item_id")
    counts = []
    for m in ("judge", "code"):
        a, b = F.col(f"{m}_l"), F.col(f"{m}_r")
        told = a.isNotNull() & b.isNotNull()
        counts += [F.count_if(told).alias(f"{m}_n"), F.count_if(told & a).alias(f"{m}_a"), F.count_if(told & b).alias(f"{m}_b"), F.count_if(a & ~b).alias(f"{m}_gained"), F.count_if(b & ~a).alias(f"{m}_lost")]
    rows = both.groupBy(*by).agg(F.count("*").alias("items"), *counts)
    out = []
    for m in ("judge", "code"):
        out += [proportion(F.col(f"{m}_a"), F.col(f"{m}_n")).alias(f"{m}_long"), proportion(F.col(f"{m}_b"), F.col(f"{m}_n")).alias(f"{m}_retrieval"), F.col(f"{m}_gained"), F.col(f"{m}_lost"), mcnemar(F.col(f"{m}_gained"), F.col(f"{m}_lost")).alias(f"{m}_p")]
    return rows.select(*by, "items", *out)
