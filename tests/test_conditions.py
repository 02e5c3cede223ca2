import json

import pytest
from pyspark.sql import functions as F

from tarnfield.functions.text import parse_verdict
from tarnfield.plans import condition as R
from tarnfield.plans import pipeline as P
from tarnfield.sources.itemlog import COLUMNS, read_condition
from tarnfield.sources.responses import ResponseFolder

GOOD = '{"declined": false, "correct": true, "faithful": true, "reason": "so {it} is"}'


@pytest.mark.parametrize(
    ("reply", "reason"),
    [
        (GOOD, "so {it} is"), (f"```json\n{GOOD}\n```", "so {it} is"), (f"I think {{so}}. {GOOD} That is all.", "so {it} is"),
        (GOOD + " or rather " + GOOD.replace("so {it} is", "no"), "no"), ("", None), ("no object", None), (GOOD[:-1], None),
        (GOOD.replace("true", '"true"'), None), (GOOD.replace('"faithful": true, ', ""), None), (GOOD.replace("}", "", 0)[:-1] + ', "more": 1}', None), (None, None),
    ],
)
def test_verdicts_are_the_last_whole_object(spark, reply, reason):
    got = spark.createDataFrame([(reply,)], "t string").select(parse_verdict(F.col("t")).alias("v")).first().v
    assert (got.reason if got else None) == reason


DOCS = [
    (1, "the lamp on the pier is red and shines at night over the boats", "public", "current"),
    (2, "the lamp on the pier was green and shone at night", "public", "superseded"),
    (3, "staff keep the lamp on the pier and its key at the office", "staff", "current"),
    (4, "boats leave the pier at nine", "public", "current"),
    *[(i, f"nothing of note in row {i}", "public", "current") for i in range(5, 10)],
]
ITEMS = [
    (1, "fact", "public", True, "lamp on the pier is red", "red", ["red"]),
    (2, "fact", "public", True, "boats leave at nine", "nine", []),
    (3, "none", "public", False, "who built the lamp on the pier", None, None),
    (4, "fact", "staff", True, "key of the lamp on the pier", "at the office", ["office"]),
    (5, "fact", "public", True, "nothing at all asked zzz", "x", None),
]
SPANS = [(1, "evidence", 1, 0, 26), (1, "distractor", 2, 0, 28), (2, "evidence", 4, 0, 28), (3, "restricted", 3, 0, 10), (4, "evidence", 3, 0, 40), (4, "stale", 2, 3, 9), (1, "evidence", 1, 0, 26)]


def tables(spark):
    return (
        spark.createDataFrame(DOCS, "doc_id long, text string, access string, status string"),
        spark.createDataFrame(ITEMS, "item_id long, type string, asker string, answerable boolean, question string, answer string, key_values array<string>"),
        spark.createDataFrame(SPANS, "item_id long, kind string, doc_id long, start long, stop long"),
    )


def plainly(stages, spans, chunks, item, k, verdict):
    """What a log says of an item, from lists of chunks."""
    holds = lambda c, s: c.doc_id == s[2] and c.start <= s[3] and s[4] <= c.stop
    mine = sorted({s for s in spans if s[0] == item[0]})
    rank = lambda s, stage: next((i for i, p in enumerate(stages[stage], 1) if holds(chunks[p], s)), None)
    good = [s for s in mine if s[1] == "evidence"]
    at = {}
    for stage in ("searched", "filtered", "ranked"):
        ranks = [rank(s, stage) for s in good]
        at[stage] = None if not ranks or None in ranks else max(ranks)
    cut = any(not any(holds(c, s) for c in chunks.values()) for s in good)
    if cut:
        lost = "chunk"
    elif at["searched"] is None:
        lost = "search"
    elif at["filtered"] is None:
        lost = "filter"
    elif at["ranked"] is None or at["ranked"] > k:
        lost = "rerank"
    else:
        lost = "unjudged" if verdict is None else None if verdict["correct"] else "prompt" if verdict["declined"] else "answer"
    others = [r for s in mine if s[1] == "distractor" and (r := rank(s, "ranked")) is not None]
    traces = [(s[1], s[2], not any(holds(c, s) for c in chunks.values()), rank(s, "searched"), rank(s, "filtered"), rank(s, "ranked"), any(holds(chunks[p], s) for p in stages["prompt"])) for s in sorted(mine, key=lambda s: (R.KINDS.index(s[1]), s[2:]))]
    leaks = [] if item[2] == "staff" else [chunks[p].chunk_id for p in stages["prompt"] if chunks[p].access == "staff"]
    return {"evidence_rank": at["ranked"], "distractor_above": any(at["ranked"] is None or r < at["ranked"] for r in others), "lost_at": lost if item[3] else None, "spans": traces, "leaks": leaks}


@pytest.mark.parametrize("spec", [
    P.Spec(P.Chunker("whole"), P.Search(depth=3), prompt=P.Prompt(2)), P.Spec(P.Chunker("words", 7), P.Search(depth=6), P.Filter("after"), prompt=P.Prompt(2, "reverse")),
    P.Spec(P.Chunker("whole"), P.Search(depth=2), P.Filter("before"), prompt=P.Prompt(1)),
])
def test_logs_equal_those_made_item_by_item(spark, spec):
    docs, items, spans = tables(spark)
    stages = P.run(docs, items, spec)
    verdicts = {1: {"declined": False, "correct": True}, 2: {"declined": True, "correct": False}, 4: {"declined": False, "correct": False}}
    judged = spark.createDataFrame([(i, v["declined"], v["correct"]) for i, v in verdicts.items()], "item_id long, d boolean, c boolean")
    judged = judged.select("item_id", F.lit(None).cast("struct<text:string,model_returned:string,input_tokens:long,output_tokens:long,reasoning_tokens:long,finish_reason:string>").alias("call"), F.struct(F.col("d").alias("declined"), F.col("c").alias("correct"), F.lit(True).alias("faithful"), F.lit("r").alias("reason")).alias("verdict"), F.lit(None).cast("string").alias("error"))
    got = {int(r.item_id): r for r in R.item_logs(stages, items, spans, "one", spec, judged=judged).collect()}
    assert sorted(got) == [i[0] for i in ITEMS]
    chunks = {c.pos: c for c in stages["chunks"].collect()}
    order = {"searched": "rank", "filtered": "rank", "ranked": "rank", "prompt": "place"}
    rows = {s: stages[s].collect() for s in order}
    for item in ITEMS:
        mine = {s: [r.pos for r in sorted((r for r in rows[s] if r.query_id == item[0]), key=lambda r: r[order[s]])] for s in order}
        r, want = got[item[0]], plainly(mine, SPANS, chunks, item, spec.prompt.k, verdicts.get(item[0]))
        assert {c: r[c] for c in ("evidence_rank", "distractor_above", "lost_at", "leaks")} == {c: want[c] for c in ("evidence_rank", "distractor_above", "lost_at", "leaks")}, item
        assert [(s.kind, int(s.span.doc_id), s.cut, s.searched, s.filtered, s.reranked, s.in_prompt) for s in r.spans] == want["spans"]
        assert [c.chunk_id for c in r.searched] == [chunks[p].chunk_id for p in mine["searched"]] and r.prompt_chunks == [chunks[p].chunk_id for p in mine["prompt"]]
        assert list(r.queries) == [item[4]] and r.config_id == spec.config_id


def judging():
    """Makes a judge; within a function, as tasks can't import this module."""

    class Judge:
        """Answers with the question's last words; judges right what is not about boats, in two tries for the key."""

        def validate(self, call):
            pass

        def respond(self, call):
            prompt = call["prompt"]
            if not prompt.startswith("Decide"):
                text = "It is red." if "is red" in prompt.split("Question: ")[-1] else "At the office."
            elif "Question: key" in prompt and "Your reply:" not in prompt:
                text = "Well, I am not sure {"
            elif "who built" in prompt:
                text = "never an object"
            else:
                text = json.dumps({"declined": "Question: boats" in prompt, "correct": "Question: boats" not in prompt, "faithful": True, "reason": "r"})
            return {"text": text, "input_tokens": len(prompt.split()), "output_tokens": 3}

    return Judge


def test_a_condition_is_run_judged_and_logged(spark, tmp_path):
    docs, items, spans = tables(spark)
    spec = P.Spec(P.Chunker("whole"), P.Search(depth=4), P.Filter("after"), prompt=P.Prompt(2))
    folder = ResponseFolder((tmp_path / "answers").as_uri(), "run")
    told = R.run_condition(docs, items, spans, spec, "after", str(tmp_path), R.Model("p", "m"), make=judging(), folder=folder).first()
    log, kept = read_condition(spark, str(tmp_path), "after")
    rows = {r.item_id: r for r in log.collect()}
    assert log.columns == COLUMNS and len(rows) == len(ITEMS) and kept["items"] == told["items"] == len(ITEMS)
    assert rows["1"].verdict.correct and rows["1"].code_check is True and rows["1"].lost_at is None and rows["1"].answer.text == "It is red."
    assert rows["2"].code_check is None and rows["2"].lost_at == "prompt"
    assert rows["3"].verdict is None and rows["3"].judge_error and rows["3"].lost_at is None
    assert rows["4"].verdict.correct and rows["4"].judge_error is None and rows["4"].code_check is True
    assert rows["5"].lost_at == "search" and rows["5"].spans == []
    assert kept["numbers"]["search"]["total"] == 4 and kept["numbers"]["not_found"]["count"] == 0 and set(kept["by_type"]) == {"fact", "none"} and kept["judge_errors"] == 1


def test_a_condition_without_models_measures_the_search(spark, tmp_path):
    docs, items, spans = tables(spark)
    told = R.run_condition(docs, items, spans, P.Spec(P.Chunker("whole"), P.Search(depth=4)), "plain", str(tmp_path)).first()
    assert told.measure == "search" and set(told.numbers.asDict()) == {"search", "leaks"}
    rows = {r.item_id: r for r in read_condition(spark, str(tmp_path), "plain")[0].collect()}
    assert rows["1"].lost_at == "unjudged" and rows["3"].lost_at is None and rows["1"].answer is None
    empty = R.item_logs(P.run(docs, items.limit(0), P.Spec(P.Chunker("whole"))), items.limit(0), spans.limit(0), "none", P.Spec(P.Chunker("whole")))
    assert empty.columns == COLUMNS and empty.count() == 0


def test_an_episode_runs_from_files(spark, tmp_path, monkeypatch, capsys):
    from tarnfield import __main__ as command

    (tmp_path / "docs").mkdir()
    head = "---\ndoc_id: {}\nversion: 1\ntitle: {}\nfamily: article\naccess: {}\nstatus: current\n---\n{}"
    for i, (name, access, body) in enumerate([("lamps", "public", "The lamp is red."), ("boats", "staff", "Boats leave at nine."), *[(f"x{n}", "public", f"Nothing in {n}.") for n in range(4)]]):
        (tmp_path / "docs" / f"{name}@1.md").write_text(head.format(name, f"T{i}", access, body))
    span = lambda doc, stop: {"doc_id": doc, "version": 1, "start": 0, "end": stop}
    items = [
        {"id": "q-1", "type": "fact", "asker": "public", "question": "is the lamp red", "answerable": True, "evidence": [span("lamps", 16)], "key_values": ["red"], "history": [{"role": "user", "content": "hello"}]},
        {"id": "q-2", "type": "fact", "asker": "public", "question": "when do boats leave", "answerable": False, "restricted_spans": [span("boats", 5)]},
    ]
    (tmp_path / "items.jsonl").write_text("\n".join(map(json.dumps, items)))
    (tmp_path / "base.yaml").write_text("chunker: {kind: whole}\nsearch: {depth: 3}\n")
    (tmp_path / "episode.yaml").write_text("base: base.yaml\nconditions:\n- {name: open, measure: full}\n- {name: closed, measure: search, changes: {filter: {placement: before}}}\n")
    monkeypatch.setattr("sys.argv", ["tarnfield", "episode", *(str(tmp_path / f) for f in ("episode.yaml", "docs", "items.jsonl", "results")), "--mock"])
    monkeypatch.setattr(command, "local_session", lambda: spark)
    command.main()
    said = [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]
    assert [(x["condition"], x["measure"], x["items"]) for x in said] == [("open", "full", 2), ("closed", "search", 2)]
    assert said[0]["numbers"]["leaks"]["count"] >= said[1]["numbers"]["leaks"]["count"] == 0 and said[0]["judge_errors"] == 2
    first, second = sorted(read_condition(spark, str(tmp_path / "results"), "open")[0].collect(), key=lambda r: r.item_id)
    assert first.evidence_rank == 1 and first.lost_at == "unjudged" and first.code_check is False and first.spans[0].span.doc_id == "lamps"
    assert second.spans[0].kind == "restricted" and second.leaks == ["boats@1#0"]


def test_a_report_says_which_condition_joins(spark):
    rows = []
    for name, found, right in (("base", 5, 5), ("far", 60, 50), ("low", 60, 3), ("same", 6, 40), ("search", 60, 0)):
        for i in range(100):
            verdict = None if name == "search" or i == 99 else (False, i < right, True, "r")
            rows.append((name, str(i), True, "public", [], None if i < right else "answer" if i < found else "search", verdict, "no verdict" if i == 99 and name != "search" else None, 1 if i < found else None))
    log = spark.createDataFrame(rows, "condition string, item_id string, answerable boolean, asker string, leaks array<string>, lost_at string, verdict struct<declined:boolean,correct:boolean,faithful:boolean,reason:string>, judge_error string, evidence_rank int")
    got = {r.condition: r for r in R.episode_report(log, "base").collect()}
    assert {n for n, r in got.items() if r.joins} == {"far"} and {n for n, r in got.items() if r.full} == {"base", "far", "low", "same"}
    assert got["base"].paired_search is None and got["search"].paired_answer is None
    assert (got["far"].paired_search.only_other, got["far"].paired_search.only_reference) == (55, 0) and got["far"].paired_search.p_value < 1e-9
    assert (got["low"].paired_answer.only_other, got["low"].paired_answer.only_reference) == (0, 2) and abs(got["low"].paired_answer.p_value - 0.5) < 1e-9
    assert got["far"].lost_at == {"answer": 10, "search": 39} and got["far"].wrong == 49 and got["search"].lost_at == {}
    deep = {r.condition: r for r in R.episode_report(log, "base", {"base": 5, "far": 0, "low": 5, "same": 5, "search": 5}).collect()}
    assert deep["far"].search["count"] == 0 and not any(r.joins for n, r in deep.items() if n == "far")
