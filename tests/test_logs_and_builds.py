"""Item logs, configurations, the building of a library, and texts that are written until they pass."""

import json
import subprocess
import sys

import pytest
import yaml
from pyspark.sql import functions as F

from tarnfield.operators import corpus_build as B
from tarnfield.operators import generation as G
from tarnfield.sources import configs, itemlog
from tarnfield.sources.library import LibraryError

ROW = {
    "item_id": "q1", "type": "t0", "asker": "public", "answerable": True, "condition": "base", "config_id": "abc", "queries": ["how", "why"],
    "searched": [{"chunk_id": "d@1#0", "score": 1.5}], "removed": [{"chunk_id": "e@1#0", "reason": "access"}], "ranked": [], "prompt_chunks": ["d@1#0"],
    "spans": [{"kind": "evidence", "span": {"doc_id": "d", "version": 1, "start": 0, "end": 4}, "cut": False, "searched": 1, "filtered": 1, "reranked": None, "in_prompt": True}],
    "evidence_rank": 1, "distractor_above": False, "leaks": [], "answer": {"text": "yes", "model_returned": "m", "input_tokens": 9, "output_tokens": 1, "reasoning_tokens": None, "finish_reason": "stop"},
    "judge": None, "verdict": {"declined": False, "correct": True, "faithful": True, "reason": "r"}, "judge_error": None, "code_check": None, "lost_at": None,
}


def test_item_log_round_trip(spark, tmp_path):
    assert list(ROW) == itemlog.COLUMNS and len(ROW) == 21
    folder = tmp_path / "results" / "base"
    folder.mkdir(parents=True)
    (folder / "log.jsonl").write_text(json.dumps(ROW) + "\n\n" + json.dumps(ROW | {"item_id": "q2", "answer": None}) + "\n")
    (folder / "summary.json").write_text(json.dumps({"pipeline": {"k": 5}}))
    log, summary = itemlog.read_condition(spark, str(tmp_path / "results"), "base")
    assert summary == {"pipeline": {"k": 5}}
    itemlog.write_log(log, str(tmp_path / "again"))
    got = sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "again")).collect()), key=lambda r: r["item_id"])
    assert got == [ROW, ROW | {"item_id": "q2", "answer": None}]
    assert [r.condition for r in itemlog.read_all(spark, str(tmp_path / "results")).collect()] == ["base", "base"]
    assert itemlog.item_scores(log).columns == ["item_id", "type", "asker", "answerable", "evidence_rank", "leaks", "verdict"]
    assert itemlog.select(itemlog.of_type(log, "t0"), item_id="q2", asker=None).count() == 1
    with pytest.raises(LibraryError):
        itemlog.write_log(log.drop("spans"), str(tmp_path / "bad"))
    (folder / "log.jsonl").write_text("{torn\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        itemlog.read_log(spark, str(folder / "log.jsonl")).collect()


def test_lines_and_summaries(spark, tmp_path):
    path = str(tmp_path / "x" / "log.jsonl")
    itemlog.append_line(path, {"a": 1})
    with open(path, "a") as f:
        f.write('{"torn')
    itemlog.append_line(path, {"a": "ü"})
    assert open(path, encoding="utf-8").read().split("\n") == ['{"a": 1}', '{"torn', '{"a": "ü"}', ""]
    itemlog.write_summary_json(spark.range(1).selectExpr("id", "array(1, 2) as xs"), str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text()) == {"id": 0, "xs": [1, 2]}
    items = spark.createDataFrame([(2, "b"), (1, "a")], "item_id long, text string")
    known = {"config": {"seed": 1}, "checksum": itemlog.checksum(items, "item_id").first().checksum}
    assert itemlog.committed(items.orderBy("item_id"), "item_id", {"seed": 1}, known)
    assert not itemlog.committed(items, "item_id", {"seed": 2}, known) and not itemlog.committed(items.limit(1), "item_id", {"seed": 1}, known)


def _yaml(path, data):
    path.write_text(yaml.safe_dump(data))
    return str(path)


def test_rules_and_cases(spark, tmp_path):
    rule = {"name": "r", "version": 1, "gates": [{"id": "legal"}], "criteria": [{"id": "c1"}, {"id": "c2"}], "weights": {"c1": 0.6, "c2": 0.4}, "sensitivity": {"equal": {"c1": 1, "c2": 1}}}
    got = configs.load_rule(_yaml(tmp_path / "rule.yaml", rule))
    assert got.gates == ("legal",) and got.criteria == ("c1", "c2")
    with pytest.raises(LibraryError, match="add up to 1"):
        configs.load_rule(_yaml(tmp_path / "bad.yaml", rule | {"weights": {"c1": 0.6, "c2": 0.6}}))
    _yaml(tmp_path / "candidates.yaml", {"candidates": [{"id": "x", "name": "X"}, {"id": "y"}]})
    scores = {"x": {"gates": {"legal": "pass"}, "scores": {"c1": 3, "c2": 4}}, "y": {"gates": {"legal": "fail"}, "redirect": "no"}}
    _yaml(tmp_path / "scores.yaml", {"candidates": scores})
    rows = {r.id: r for r in configs.load_case(spark, str(tmp_path), got).collect()}
    assert rows["x"].gates_passed and rows["x"].c2 == 4.0 and not rows["y"].gates_passed and rows["y"].c1 is None
    _yaml(tmp_path / "scores.yaml", {"candidates": {"x": {"gates": {}, "scores": {"c9": 1}}, "y": {"gates": {"legal": "fail"}}}})
    with pytest.raises(LibraryError, match="every gate.*unknown criteria.*redirect"):
        configs.load_case(spark, str(tmp_path), got)


def test_prices_capabilities_and_episodes(spark, tmp_path):
    assert configs.load_prices(spark, str(tmp_path / "none.yaml")) is None
    prices, budgets = configs.load_prices(spark, _yaml(tmp_path / "p.yaml", {"prices": {"a": {"m": {"input": 1, "output": None}}}, "budgets": {"e": 2.5}}))
    assert prices.first().asDict() == {"provider": "a", "model": "m", "price_in": 1.0, "price_out": None} and budgets == {"e": 2.5}
    (tmp_path / "c.yaml").write_text("a:\n  m: {reasoning: [off, high], temperature: true}\n")
    assert configs.load_capabilities(spark, str(tmp_path / "c.yaml")).first().reasoning == ["off", "high"]
    _yaml(tmp_path / "base.yaml", {"search": {"depth": 7}, "chunker": {"kind": "fixed", "size": 100, "overlap": 10}})
    episode = {"base": "base.yaml", "conditions": [{"name": "deeper", "changes": {"search": {"depth": 9}}, "measure": "search"}, {"name": "same"}]}
    base, conditions = configs.load_episode(_yaml(tmp_path / "e.yaml", episode))
    assert base.chunker.overlap == 10 and conditions[0].spec.search.depth == 9 and conditions[0].measure == "search" and conditions[1].spec == base
    episode["conditions"] = [{"name": "two", "changes": {"search": {"depth": 9}, "prompt": {"k": 1}}}, {"name": "two"}]
    with pytest.raises(LibraryError, match="unique.*one stage"):
        configs.load_episode(_yaml(tmp_path / "e.yaml", episode))


def test_facts_get_free_values_and_go_to_items(spark):
    kinds = spark.createDataFrame([("days", "{n} days", 1, 12), ("fee", "£{n}.00", 1, 5)], "kind string, template string, low int, high int")
    taken = spark.createDataFrame([("It takes 3 days, or 11 days.",), ("A fee of £12.00",)], "text string")
    free = B.values(kinds, taken)
    assert {r.value for r in free.where("kind = 'days'").collect()} == {"1 day", *(f"{n} days" for n in range(2, 13))} - {"3 days", "11 days"}
    assert free.where("kind = 'fee'").count() == 5  # £2.00 within £12.00 is no whole token
    slots = spark.createDataFrame([("wide1", "days", 1, 12), ("wide2", "days", 1, 12), ("narrow1", "days", 1, 4), ("narrow2", "days", 1, 4), ("narrow3", "days", 1, 4)], "fact_id string, kind string, low int, high int")
    got = {r.fact_id: r for r in B.plan_facts(slots, free).collect()}
    assert len({r.value for r in got.values()}) == 5 and all(r.low <= r.n <= r.high for r in got.values())
    assert {r.fact_id: r.value for r in B.plan_facts(slots.repartition(3), free).collect()} == {k: r.value for k, r in got.items()}
    with pytest.raises(ValueError, match="no value left"):
        B.plan_facts(slots.unionByName(slots.where("kind = 'days' and high = 4").withColumn("fact_id", F.concat("fact_id", F.lit("b")))), free)
    facts = spark.createDataFrame([(f"f{i}", i % 2 == 0, True) for i in range(12)], "fact_id string, fits_rare boolean, fits_any boolean")
    targets = B.wanted(spark.createDataFrame([("rare", "test", 3, True), ("any", "test", 3, False), ("any", "dev", 2, False)], "type string, split string, target int, checked boolean"))
    items = B.allocate(facts, targets, ["rare", "any"]).collect()
    assert len({r.fact_id for r in items}) == len(items) == 9 and sum(r.spare for r in items) == 1
    assert {r.item_id for r in items if r.split == "dev"} == {"DEV-any-000", "DEV-any-001"}
    assert all(int(r.fact_id[1:]) % 2 == 0 for r in items if r.type == "rare")
    with pytest.raises(ValueError, match="needs 4 facts, 2 are free"):
        B.allocate(facts.limit(2).withColumn("fits_rare", F.lit(True)), targets, ["rare"])


def test_documents_and_earlier_versions(spark):
    facts = spark.createDataFrame([("d", "Lamps", 1, "Fees", 2, "Two."), ("d", "Lamps", 1, "Fees", 1, "A lamp costs £9.00."), ("d", "Lamps", 0, "Use", 1, "Turn it on.")], "doc_id string, title string, section int, heading string, place int, sentence string")
    docs = B.render(facts).withColumn("version", F.lit(2))
    body = docs.first().body
    assert body == "# Lamps\n\n## Use\n\nTurn it on.\n\n## Fees\n\nA lamp costs £9.00. Two."
    changes = spark.createDataFrame([("d", "£9.00", "£8.00")], "doc_id string, value string, old_value string")
    old = B.superseded(docs, changes).first()
    assert old.version == 1 and old.body == body.replace("£9.00", "£8.00") and old.status == "superseded"
    with pytest.raises(ValueError, match="once"):
        B.superseded(docs, changes.withColumn("value", F.lit("£1.00")))


def test_texts_are_written_until_they_pass(spark):
    class Improving:
        """Writes a bad text at first, and a good one when it is shown its draft; a hopeless task stays bad."""

        def validate(self, call):
            pass

        def respond(self, call):
            good = "Your draft:" in call["prompt"] and "hopeless" not in call["prompt"] or "easy" in call["prompt"]
            return {"text": " fine " if good else "bad", "input_tokens": 1, "output_tokens": 1}

    tasks = spark.createDataFrame([("a", "p", "easy"), ("b", "p", "normal"), ("c", "p", "hopeless")], "task_id string, provider string, prompt string")
    check = lambda task, text: F.when(text != "fine", "Not fine.")
    out = G.generate(tasks, Improving, check, "Mend it: {problem}", 3)
    got = {r.task_id: (r.text, r.attempts, len(r.problems)) for r in out.collect()}
    assert got == {"a": ("fine", 1, 0), "b": ("fine", 2, 1), "c": (None, 3, 3)}
    s = G.build_summary(out).first()
    assert (s.tasks, s.passed, s.failed, s.attempts) == (3, 2, 1, {1: 1, 2: 1})
    checked = spark.createDataFrame([("t", "test", True), ("t", "test", False)], "type string, split string, ok boolean")
    targets = spark.createDataFrame([("t", "test", 2), ("u", "dev", 0)], "type string, split string, target int")
    assert {(r.type, r.found, r.short) for r in G.survivors(checked, targets).collect()} == {("t", 1, True), ("u", 0, False)}


def test_command_line_lists_queries():
    out = subprocess.run([sys.executable, "-m", "tarnfield", "list"], capture_output=True, text=True, check=True).stdout.split()
    assert "bm25_topk" in out and "episode_report" in out


def test_items_reviews_and_the_first_edition(spark, tmp_path):
    from tarnfield.sources import library, writer

    span = "array<struct<doc_id:string,version:int,start:int,end:int>>"
    items = spark.createDataFrame([("q1", "t", "how?", "public", [("d", 1, 2, 5), ("d", 1, 6, 8)]), ("q2", "t", "why?", "staff", [])], f"item_id string, type string, question string, asker string, evidence {span}")
    writer.write_items(items, str(tmp_path / "items"), {"asker": "public"})
    got = {json.loads(r.value)["item_id"]: json.loads(r.value) for r in spark.read.text(str(tmp_path / "items")).collect()}
    assert "asker" not in got["q1"] and got["q2"] == {"item_id": "q2", "type": "t", "question": "why?", "asker": "staff"}
    docs = spark.createDataFrame([("d", 1, "abcdefgh")], "doc_id string, version int, body string")
    assert {r.item_id: r.evidence for r in writer.review_sheet(items, docs).collect()} == {"q1": "cde\ngh", "q2": ""}
    (tmp_path / "corpus.json").write_text(json.dumps({"articles": [{"article_id": "a1", "product": "p", "group": 3, "text": " Lamp \nIt shines."}]}, indent=1))
    (tmp_path / "questions.json").write_text(json.dumps({"questions": [{"type": t, "article_id": "a1", "question": f"q{i}"} for i, t in enumerate("xyx")]}))
    articles, questions = library.read_first_edition(spark, str(tmp_path), {"x": "X", "y": "Y"})
    assert articles.first().title == "Lamp" and articles.first().identifier is None
    assert sorted((r.item_id, r.question) for r in questions.collect()) == [("X-000", "q0"), ("X-001", "q2"), ("Y-000", "q1")]


def test_runs_accumulate_in_their_metadata(spark, tmp_path):
    from tarnfield.sources import metadata

    path = str(tmp_path / "results" / "metadata.json")
    schema = "run_id string, started string, finished string, calls long, failures long"
    assert metadata.read_metadata(path) is None
    metadata.record_run(path, spark.createDataFrame([("b", "2024-01-02", "2024-01-03", 5, 1)], schema), str(tmp_path))
    out = metadata.record_run(path, spark.createDataFrame([("a", "2024-01-01", "2024-01-01", 2, 0), ("b", "2024-01-02", "2024-01-04", 6, 0)], schema), str(tmp_path), prices="x")
    assert metadata.read_metadata(path) == out and [(p["run_id"], p["calls"]) for p in out["passes"]] == [("a", 2), ("b", 6)]
    assert (out["started"], out["finished"], out["prices"], out["git"]["commit"]) == ("2024-01-01", "2024-01-04", "x", None)
    assert out["versions"]["pyspark"]


def test_siblings_are_the_first_of_all_pairs(spark, monkeypatch):
    """However few digests are low enough to be put in order at first, the siblings are those of all pairs; only those few are ordered."""
    import hashlib

    from pyspark.sql import functions as F

    from tarnfield.operators import corpus_build as B

    facts = [(i, i % 3 if i % 50 else None, f"e{i % 7}" if i % 11 else None) for i in range(400)]
    md5 = lambda i, j: hashlib.md5(f"{i}:{j}".encode()).hexdigest()
    want = {(i, j) for i, a, e in facts if i % 4 == 0 and a is not None for _, j in sorted((md5(i, j), j) for j, b, f in facts if b == a and f != e)[:3]}
    df = spark.createDataFrame(facts, "fact_id long, attribute int, entity string")
    assert hasattr(B, "EXPECTED")
    for expected in (1, 16):
        monkeypatch.setattr(B, "EXPECTED", expected)
        got = [tuple(r) for r in B.siblings(df.where(F.col("fact_id") % 4 == 0), df, 3).collect()]
        assert len(got) == len(want) and set(got) == want
