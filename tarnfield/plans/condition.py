"""A condition from its spec to its item log: retrieval, the waves of model calls, span traces, the verdict and where an item was lost.

Every step is a plan over all items. Stage rows (items times the search's depth) and model answers are written tables, as
several steps read them and an answer must not be asked for twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.functions.stats import mcnemar, proportion
from tarnfield.functions.text import contains_whole, parse_verdict
from tarnfield.operators import responders
from tarnfield.operators.spans import held
from tarnfield.plans import pipeline
from tarnfield.session import written
from tarnfield.sources.itemlog import CALL, COLUMNS, ITEM_LOG, write_log
from tarnfield.sources.responses import ResponseFolder

#: Ranked chunks that a log keeps of each stage, and the kinds of labelled spans in the order they are logged.
LOG_DEPTH = 20
KINDS = ("evidence", "distractor", "stale", "restricted")
STAGES = ("searched", "filtered", "ranked", "prompt")
SPAN_KEY = ["item_id", "kind", "no", "doc_id", "start", "stop"]

JUDGE = "Decide whether the answer declines to answer, whether it agrees with the reference answer and whether the passages bear it out. Reply with one JSON object with the fields declined, correct, faithful (each true or false) and reason (a sentence)."
ANSWER = "Answer the question from the passages alone, naming those that you use, and say so if they don't hold the answer."
RETRY = "Your reply above was not a verdict. Reply with the JSON object alone."


@dataclass(frozen=True)
class Model:
    provider: str
    name: str


def stage_rows(stages: dict[str, DataFrame]) -> DataFrame:
    """query_id, stage, pos, rank, score, reason, chunk_id, access of all stages of pipeline.run, as a written table."""
    none = lambda kind: F.lit(None).cast(kind)
    parts = []
    for stage in (*STAGES, "removed"):
        rank = F.col("place" if stage == "prompt" else "rank").cast("int").alias("rank")
        score = none("double") if stage == "removed" else F.col("score").cast("double")
        reason = F.col("reason") if stage == "removed" else none("string")
        parts.append(stages[stage].select("query_id", F.lit(stage).alias("stage"), "pos", rank, score.alias("score"), reason.alias("reason")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return written(rows.join(stages["chunks"].select("pos", "chunk_id", "access"), "pos"))


def span_traces(spans: DataFrame, chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """spans with cut (no chunk holds it whole), its first rank when searched, filtered and ranked, and in_prompt.

    spans: item_id, kind, no, doc_id, start, stop. rows: as stage_rows.
    """
    here = chunks.join(spans.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "start", "stop", "pos")
    holders = held(spans.select(*SPAN_KEY), here).select(*SPAN_KEY, F.col("c_pos").alias("pos"))
    placed = holders.join(rows.select(F.col("query_id").alias("item_id"), "pos", "stage", "rank"), ["item_id", "pos"], "left")
    first = [F.min(F.when(F.col("stage") == s, F.col("rank"))).alias(s) for s in STAGES]
    traced = placed.groupBy(*SPAN_KEY).agg(*first).withColumn("whole", F.lit(True))
    out = spans.join(traced, SPAN_KEY, "left")
    return out.select(*spans.columns, F.col("whole").isNull().alias("cut"), "searched", "filtered", F.col("ranked").alias("reranked"), F.col("prompt").isNotNull().alias("in_prompt"))


def lost_at(cut: Column, searched: Column, filtered: Column, ranked: Column, k: int, verdict: Column) -> Column:
    """The first stage that lost the evidence or the answer; null if the answer is right."""
    return (
        F.when(cut, "chunk").when(searched.isNull(), "search").when(filtered.isNull(), "filter").when(ranked.isNull() | (ranked > k), "rerank")
        .when(verdict.isNull(), "unjudged").when(verdict["correct"], F.lit(None)).when(verdict["declined"], "prompt").otherwise("answer")
    )


def code_check(key_values: Column, call: Column) -> Column:
    """Whether an answer holds every key value whole; null without key values or an answer."""
    return F.when((F.size(key_values) > 0) & call.isNotNull(), F.forall(key_values, lambda v: F.coalesce(contains_whole(call["text"], v), F.lit(False))))


def _with_defaults(spans: DataFrame) -> DataFrame:
    if unknown := [c for c in ("item_id", "kind", "doc_id", "start", "stop") if c not in spans.columns]:
        raise ValueError(f"spans lack {unknown}")
    no = F.col("no").cast("int") if "no" in spans.columns else F.lit(0)
    version = F.col("version").cast("int") if "version" in spans.columns else F.lit(None).cast("int")
    name = F.col("doc_name") if "doc_name" in spans.columns else F.col("doc_id").cast("string")
    return spans.select("item_id", "kind", no.alias("no"), "doc_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), version.alias("version"), name.alias("doc_name")).dropDuplicates(SPAN_KEY)


def item_logs(stages: dict[str, DataFrame], items: DataFrame, spans: DataFrame, name: str, spec: pipeline.Spec, answers: DataFrame | None = None, judged: DataFrame | None = None) -> DataFrame:
    """The item log of a condition: a row for each item with the columns of ITEM_LOG.

    stages: of pipeline.run. items: item_id, type, asker, answerable, and key_values (array) if there are some. spans: item_id, kind
    (of KINDS), doc_id, start, stop, and no (the order within a kind), version and doc_name (the logged doc_id) if known; equal spans count once.
    Other columns of items are left out. answers: item_id, call (as ITEM_LOG's answer). judged: item_id, call, verdict, error. An item without spans has an empty list
    and, if it is answerable, is lost at search; one without rows of a stage has an empty list there.
    """
    rows = stage_rows(stages)
    logged = lambda stage, *what: F.transform(F.array_sort(F.collect_list(F.when(F.col("stage") == stage, F.struct("rank", F.struct(*what).alias("x"))))), lambda r: r["x"])
    ranked = ("chunk_id", F.round("score", 6).alias("score"))
    leaking = (F.col("stage") == "prompt") & (F.col("access") == "staff")
    lists = rows.groupBy("query_id").agg(
        F.slice(logged("searched", *ranked), 1, LOG_DEPTH).alias("searched"), logged("removed", "chunk_id", "reason").alias("removed"),
        F.slice(logged("ranked", *ranked), 1, LOG_DEPTH).alias("ranked"), F.transform(logged("prompt", "chunk_id"), lambda c: c["chunk_id"]).alias("prompt_chunks"),
        F.transform(F.array_sort(F.collect_list(F.when(leaking, F.struct("rank", "chunk_id")))), lambda c: c["chunk_id"]).alias("staff"),
    )
    traces = span_traces(_with_defaults(spans), stages["chunks"], rows)
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct(F.col("doc_name").alias("doc_id"), "version", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("end"))
    entry = F.struct("kind", span.alias("span"), "cut", "searched", "filtered", "reranked", "in_prompt")
    good = F.col("kind") == "evidence"
    by = lambda c: F.when(F.count_if(good) == F.count(F.when(good, F.col(c))), F.max(F.when(good, F.col(c))))
    spanned = traces.groupBy("item_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(kind.alias("k"), "no", "doc_id", "start", "stop", entry.alias("x")))), lambda s: s["x"]).alias("spans"),
        F.coalesce(F.bool_or(good & F.col("cut")), F.lit(False)).alias("any_cut"), by("searched").alias("at_search"), by("filtered").alias("at_filter"), by("reranked").alias("evidence_rank"),
        F.min(F.when(F.col("kind") == "distractor", F.col("reranked"))).alias("lookalike"),
    )
    asked = stages["queries"].groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("query_no", "text"))), lambda q: q["text"]).alias("queries"))
    types = {f.name: f.dataType for f in items.sparkSession.createDataFrame([], ITEM_LOG).schema.fields}
    null = lambda c: F.lit(None).cast(types[c])
    about = items.select("item_id", "type", "asker", "answerable", *[c for c in ("key_values",) if c in items.columns])
    log = about.join(asked, "item_id", "left").join(lists.withColumnRenamed("query_id", "item_id"), "item_id", "left").join(spanned, "item_id", "left")
    if answers is not None:
        log = log.join(answers.select("item_id", F.col("call").alias("answer")), "item_id", "left")
    if judged is not None:
        log = log.join(judged.select("item_id", F.col("call").alias("judge"), "verdict", F.col("error").alias("judge_error")), "item_id", "left")
    for c in ("answer", "judge", "verdict", "judge_error"):
        log = log if c in log.columns else log.withColumn(c, null(c))
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(types[c])).alias(c)
    above = F.col("lookalike").isNotNull() & (F.col("evidence_rank").isNull() | (F.col("lookalike") < F.col("evidence_rank")))
    checked = F.lit(None).cast("boolean")
    if "key_values" in items.columns:
        checked = code_check(F.col("key_values"), F.col("answer"))
    out = {
        "item_id": F.col("item_id").cast("string"), "condition": F.lit(name), "config_id": F.lit(spec.config_id), "distractor_above": F.coalesce(above, F.lit(False)),
        "leaks": F.when(F.col("asker") == "staff", F.array().cast("array<string>")).otherwise(F.coalesce("staff", F.array().cast("array<string>"))), "code_check": checked,
        "lost_at": F.when(F.col("answerable"), lost_at(F.coalesce("any_cut", F.lit(False)), F.col("at_search"), F.col("at_filter"), F.col("evidence_rank"), spec.prompt.k, F.col("verdict"))),
    } | {c: empty(c) for c in ("queries", "searched", "removed", "ranked", "prompt_chunks", "spans")}
    return log.select(*[out.get(c, F.col(c)).cast(types[c]).alias(c) for c in COLUMNS])


def calls_of(prompts: DataFrame, stage: str, condition: str, model: Model, system: str) -> DataFrame:
    """The planned calls of a stage (call_id, request_hash, provider, prompt, item_id) for prompts (item_id, prompt).

    A call is named by what it is for; a request by what is sent, so that equal prompts are one request.
    """
    text = F.concat(F.lit(system + "\n\n"), F.col("prompt"))
    request = F.sha2(F.concat_ws("\x1f", F.lit(model.provider), F.lit(model.name), text), 256)
    call = F.concat_ws("|", F.lit(model.name), F.lit(stage), F.lit(condition), F.col("item_id").cast("string"))
    return prompts.select("item_id", call.alias("call_id"), request.alias("request_hash"), F.lit(model.provider).alias("provider"), text.alias("prompt"))


def wave(calls: DataFrame, make: Callable[[], responders.Responder], model: Model, folder: ResponseFolder | None = None, **how: Any) -> DataFrame:
    """item_id, call of the calls that were answered; call is as ITEM_LOG's answer. A written table."""
    none = calls.sparkSession.createDataFrame([], responders.RECORD)
    records = responders.run(calls.drop("item_id"), none, make, folder, **how).where("ok")
    empty = lambda kind, name: F.lit(None).cast(kind).alias(name)
    call = F.struct("text", F.lit(model.name).alias("model_returned"), "input_tokens", "output_tokens", empty("long", "reasoning_tokens"), empty("string", "finish_reason"))
    return written(records.join(calls.select("call_id", "item_id"), "call_id").select("item_id", call.alias("call")))


def judge_prompts(items: DataFrame, stages: dict[str, DataFrame], answers: DataFrame) -> DataFrame:
    """item_id, prompt for every answered item: the question, the reference answer, what was given and what was said."""
    told = stages["texts"].withColumnRenamed("query_id", "item_id").join(items.select("item_id", "answerable", F.col("answer").alias("reference")), "item_id")
    parts = [F.col("prompt"), F.concat(F.lit("The library holds the answer: "), F.when(F.col("answerable"), "yes").otherwise("no")), F.concat(F.lit("Reference answer: "), F.coalesce("reference", F.lit(""))), F.concat(F.lit("Answer to judge:\n"), F.trim("call.text"))]
    return told.join(answers, "item_id").select("item_id", F.concat_ws("\n\n", *parts).alias("prompt"))


def judge(prompts: DataFrame, condition: str, model: Model, make: Callable[[], responders.Responder], folder: ResponseFolder | None = None, **how: Any) -> DataFrame:
    """item_id, call, verdict, error. A reply without a verdict is asked for again once; then its error is kept."""
    first = wave(calls_of(prompts, "judge", condition, model, JUDGE), make, model, folder, **how)
    read = first.withColumn("verdict", parse_verdict(F.col("call.text")))
    clear = read.where("verdict is not null").select("item_id", "call", "verdict", F.lit(None).cast("string").alias("error"))
    unclear = read.where("verdict is null").select("item_id", F.col("call.text").alias("reply")).join(prompts, "item_id")
    again = unclear.select("item_id", F.concat_ws("\n\n", "prompt", F.concat(F.lit("Your reply:\n"), F.col("reply")), F.lit(RETRY)).alias("prompt"))
    if again.isEmpty():
        return clear
    second = wave(calls_of(again, "judge-retry", condition, model, JUDGE), make, model, folder, **how)
    reread = again.select("item_id").join(second, "item_id", "left").withColumn("verdict", parse_verdict(F.col("call.text")))
    error = F.when(F.col("call").isNull(), "the judge's call failed").when(F.col("verdict").isNull(), "the reply holds no verdict")
    return clear.unionByName(reread.select("item_id", "call", "verdict", error.alias("error")))


def numbers(log: DataFrame, k: int, *by: str) -> DataFrame:
    """search, answer, not_found and leaks as struct(count, total, rate, low, high), of the whole log or by columns."""
    said = lambda c: F.coalesce(c, F.lit(False))
    public = F.col("asker") == "public"
    four = {
        "search": (F.col("answerable"), said(F.col("evidence_rank") <= k)), "answer": (F.col("answerable"), said(F.col("verdict.correct") & F.col("verdict.faithful"))),
        "not_found": (~F.col("answerable"), said(F.col("verdict.declined"))), "leaks": (public, F.size("leaks") > 0),
    }
    counts = [a for n, (of, hit) in four.items() for a in (F.count_if(of & hit).alias(f"{n}_c"), F.count_if(of).alias(f"{n}_n"))]
    return log.groupBy(*by).agg(*counts).select(*by, *[proportion(F.col(f"{n}_c"), F.col(f"{n}_n")).alias(n) for n in four])


def summary(log: DataFrame, name: str, spec: pipeline.Spec, full: bool) -> DataFrame:
    """One row: condition, config_id, measure, items, numbers, by_type, judge_errors and code_check_disagrees (counts; the items are in the log)."""
    names = ("search", "answer", "not_found", "leaks") if full else ("search", "leaks")
    whole = numbers(log, spec.prompt.k).select(F.struct(*names).alias("numbers"))
    differs = F.coalesce(F.col("code_check") != F.col("verdict.correct"), F.lit(False))
    counts = log.agg(F.count("*").alias("items"), F.count("judge_error").alias("judge_errors"), F.count_if(differs).alias("code_check_disagrees"))
    types = numbers(log, spec.prompt.k, "type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", F.struct(*names).alias("numbers"))))).alias("by_type"))  # a row for each type
    return counts.join(whole).join(types).select(F.lit(name).alias("condition"), F.lit(spec.config_id).alias("config_id"), F.lit("full" if full else "search").alias("measure"), "items", "numbers", "by_type", "judge_errors", "code_check_disagrees")


def episode_report(log: DataFrame, reference: str, k: int | dict[str, int] = 5) -> DataFrame:
    """A row for each condition of a log (ITEM_LOG), against one of them.

    condition, items, full (every item has a verdict or the judge's error, and some a verdict), search, answer, not_found, leaks (as
    numbers), wrong (judged answerable items that aren't right), lost_at (a map of how many of these each stage lost; an item that no
    stage lost counts as the answer's), paired_search and paired_answer (items that only the condition, or only the reference, has right, and
    the exact two-sided p; null for the reference, and for answers where either isn't judged), joins (whether it takes the reference's place: the
    one with the most found, then right, then the first name, of those judged whose search lies above the reference's interval
    and whose answers are no fewer). k: passages in the prompt, of all or of each condition.
    """
    depth = F.lit(k) if isinstance(k, int) else F.create_map(*[F.lit(x) for kv in k.items() for x in kv])[F.col("condition")]
    said = lambda c: F.coalesce(c, F.lit(False))
    rows = log.select(
        "condition", "item_id", "answerable", "asker", "leaks", "lost_at", "verdict", "judge_error", F.when(F.col("evidence_rank") <= depth, F.lit(1)).alias("evidence_rank"),
        said(F.col("evidence_rank") <= depth).alias("found"), said(F.col("verdict.correct") & F.col("verdict.faithful")).alias("right"),
    )
    wrong = F.col("answerable") & F.col("verdict").isNotNull() & ~F.col("right")
    sums = rows.groupBy("condition").agg(F.count("*").alias("items"), ((F.count("verdict") > 0) & F.bool_and(F.col("verdict").isNotNull() | F.col("judge_error").isNotNull())).alias("full"), F.count_if(wrong).alias("wrong"))
    lost = rows.where(wrong).groupBy("condition", F.coalesce("lost_at", F.lit("answer")).alias("lost_at")).agg(F.count("*").alias("n"))
    lost = lost.groupBy("condition").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lost_at", "n")))).alias("lost_at"))  # a row for each stage
    ref = rows.where(F.col("condition") == reference).select("item_id", F.col("found").alias("r_found"), F.col("right").alias("r_right"))
    only = lambda a, b: F.count_if(F.col(a) & ~F.col(b))
    both = rows.where(F.col("condition") != reference).join(ref, "item_id").groupBy("condition")
    pairs = both.agg(only("found", "r_found").alias("sb"), only("r_found", "found").alias("sc"), only("right", "r_right").alias("ab"), only("r_right", "right").alias("ac"))
    paired = lambda b, c: F.struct(F.col(b).alias("only_other"), F.col(c).alias("only_reference"), mcnemar(F.col(b), F.col(c)).alias("p_value"))
    pairs = pairs.select("condition", paired("sb", "sc").alias("paired_search"), paired("ab", "ac").alias("paired_answer"))
    told = numbers(rows, 1, "condition").join(sums, "condition").join(lost, "condition", "left").join(pairs, "condition", "left")
    base = told.where(F.col("condition") == reference).select(F.col("full").alias("r_full"), F.col("search").alias("r_search"), F.col("answer").alias("r_answer"))
    told = told.join(F.broadcast(base), how="left")  # one row
    passes = F.col("full") & said(F.col("r_full")) & (F.col("condition") != reference) & (F.col("r_search.high") < F.col("search.low")) & (F.col("answer.count") >= F.col("r_answer.count"))
    best = told.where(passes).orderBy(F.desc("search.count"), F.desc("answer.count"), "condition").limit(1).select("condition", F.lit(True).alias("joins"))
    judged = F.col("full") & said(F.col("r_full"))
    return told.join(best, "condition", "left").select(
        "condition", "items", "full", "search", "answer", "not_found", "leaks", F.coalesce("lost_at", F.create_map().cast("map<string,bigint>")).alias("lost_at"), "wrong", "paired_search",
        F.when(judged, F.col("paired_answer")).alias("paired_answer"), said(F.col("joins")).alias("joins"),
    )


def run_condition(docs: DataFrame, items: DataFrame, spans: DataFrame, spec: pipeline.Spec, name: str, results: str, model: Model | None = None, judge_model: Model | None = None, make: Callable[[], responders.Responder] | None = None, folder: ResponseFolder | None = None, sending: dict[str, Any] | None = None, **inputs: Any) -> DataFrame:
    """Runs, scores and logs one condition under results/name; returns its one summary row.

    items: item_id, type, asker, answerable, question, and answer (the reference's), history and key_values if there are some. Without a model
    only the search is measured; with one, make() gives what answers its calls, and folder keeps the answers for a run that starts
    again. inputs go to pipeline.run.
    """
    stages = pipeline.run(docs, items, spec, **inputs)
    answers = judged = None
    if model is not None:
        if make is None:
            raise ValueError("a model needs a responder")
        how = sending or {}
        prompts = stages["texts"].select(F.col("query_id").alias("item_id"), "prompt")
        answers = wave(calls_of(prompts, "answer", name, model, ANSWER), make, model, folder, **how)
        known = items if "answer" in items.columns else items.withColumn("answer", F.lit(None).cast("string"))
        judged = written(judge(judge_prompts(known, stages, answers), name, judge_model or model, make, folder, **how))
    log = written(item_logs(stages, items, spans, name, spec, answers, judged))
    write_log(log, f"{results}/{name}/log.jsonl")
    told = summary(log, name, spec, model is not None)
    told.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(f"{results}/{name}/summary.json")
    return told


def from_library(documents: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs, items and spans as run_condition takes them, of a library's documents and items as sources.library reads them.

    Documents are numbered in the order of their keys, so that ties rank as the library lies. A span of a document that the
    library lacks is an error. Earlier turns become lines of role and content.
    """
    keys = documents.select("doc_key").distinct().orderBy("doc_key").rdd.zipWithIndex().map(lambda x: (x[0].doc_key, x[1]))
    numbered = written(documents.sparkSession.createDataFrame(keys, "doc_key string, place long"))
    docs = documents.join(numbered, "doc_key").select(F.col("place").alias("doc_id"), "doc_key", "title", F.col("body").alias("text"), "access", "status")
    turns = F.array_join(F.transform("history", lambda h: F.concat(h["role"], F.lit(": "), h["content"])), "\n")
    asked = items.select(F.col("id").alias("item_id"), "type", "asker", "answerable", "question", "answer", "key_values", turns.alias("history"))
    labelled = None
    for kind, column in zip(KINDS, ("evidence", "distractor_spans", "stale_spans", "restricted_spans"), strict=True):
        part = items.select(F.col("id").alias("item_id"), F.lit(kind).alias("kind"), F.posexplode(column).alias("no", "s"))
        labelled = part if labelled is None else labelled.unionByName(part)
    labelled = labelled.select("item_id", "kind", "no", F.concat_ws("@", "s.doc_id", "s.version").alias("doc_key"), F.col("s.doc_id").alias("doc_name"), "s.version", "s.start", F.col("s.end").alias("stop"))
    spans = labelled.join(numbered, "doc_key", "left")
    lacking = F.raise_error(F.concat(F.lit("a span of an unknown document: "), F.col("doc_key"))).cast("long")
    return docs, asked, spans.select("item_id", "kind", "no", F.coalesce("place", lacking).alias("doc_id"), "start", "stop", "version", "doc_name")
