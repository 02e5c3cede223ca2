"""Library files, sheets, stores, the stream, and whole pipelines."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tarnfield.operators import experiments as E
from tarnfield.plans import pipeline as P
from tarnfield.sources import library as L
from tarnfield.sources.stores import KeyedStore
from tarnfield.streaming import runlog

TEXT = "---\ndoc_id: d1\nversion: 2\ntitle: Lamps\nfamily: policy\nproducts: [lamp]\naccess: public\nstatus: current\neffective_from: 2024-01-02\n---\nBody line\n# H\n"


def test_front_matter():
    got = L.parse_document(TEXT)
    assert got["version"] == 2 and got["body"] == "Body line\n# H\n"
    for bad in ("no front matter", TEXT.replace("policy", "poem"), TEXT.replace("title", "headline")):
        with pytest.raises(L.LibraryError):
            L.parse_document(bad)


def test_library_and_manifest(spark, tmp_path):
    (tmp_path / "d1@2.md").write_text(TEXT)
    (tmp_path / "wrong.md").write_text(TEXT.replace("d1", "d2"))
    docs = L.read_documents(spark, str(tmp_path))
    assert docs.where("doc_key = 'd1@2'").first().products == ["lamp"]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    manifest = spark.createDataFrame([("d1@2.md", sha(TEXT)), ("gone.md", "x"), ("wrong.md", sha(TEXT.replace("d1", "d2")))], "file string, sha256 string")
    item = {"id": "q1", "answerable": True, "evidence": [{"doc_id": "d1", "version": 2, "start": 0, "end": 999}]}
    (tmp_path / "items.jsonl").write_text(json.dumps(item) + "\n\n")
    items = L.read_items(spark, str(tmp_path / "items.jsonl"))
    found = {(r.what, r.problem) for r in L.library_problems(docs, manifest, items).collect()}
    assert found == {("gone.md", "missing"), ("wrong.md", "misnamed"), ("q1", "span out of bounds")}


def test_torn_log_lines_are_left_out(spark, tmp_path):
    (tmp_path / "raw.jsonl").write_text('{"call_id": "a", "request_hash": "h", "attempts": 1}\n{"call_id": "b", "req')
    rows = L.read_records(spark, str(tmp_path / "raw.jsonl")).collect()
    assert [r.call_id for r in rows] == ["a"]


def test_sheet_header_is_exact(spark, tmp_path):
    (tmp_path / "s.csv").write_text("﻿id,name\n1, x \n,\n2,\n")
    assert [(r.id, r.name) for r in L.read_sheet(spark, str(tmp_path / "s.csv"), ["id", "name"]).collect()] == [("1", "x"), ("2", None)]
    with pytest.raises(L.LibraryError):
        L.read_sheet(spark, str(tmp_path / "s.csv"), ["id", "title"])


def test_yaml_off_stays_text(tmp_path):
    (tmp_path / "c.yaml").write_text("mode: off\nflag: true\n")
    assert L.read_yaml(str(tmp_path / "c.yaml")) == {"mode": "off", "flag": True}


def test_store_puts_once(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "kv"), "key string, v int")
    store.put(spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "key string, v int"))
    store.put(spark.createDataFrame([("b", 9), ("c", 3)], "key string, v int"))
    wanted = spark.createDataFrame([("a",), ("b",), ("z",)], "key string")
    assert {(r.key, r.v) for r in store.get_many(wanted).collect()} == {("a", 1), ("b", 2), ("z", None)}
    assert [r.key for r in store.missing(wanted).collect()] == ["z"]


def test_stream_keeps_each_record_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = {"call_id": "a", "request_hash": "h", "line_no": 1, "ok": True, "recorded": "2024-01-01T00:00:00", "text": "x"}
    (src / "1.json").write_text(json.dumps(row) + "\n" + json.dumps(row) + "\n")
    for _ in range(2):
        runlog.follow(runlog.records(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
        (src / "2.json").write_text(json.dumps(row | {"line_no": 2}) + "\n")
    assert sorted(r.line_no for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


DOCS = [
    (1, "lamps on the pier shine red", "public", "current"),
    (2, "lamps on the pier shine red and blue at night", "staff", "current"),
    (3, "boats leave at seven", "public", "superseded"),
    (4, "boats leave at nine from the pier", "public", "current"),
    *[(i, f"nothing of note in row {i}", "public", "current") for i in range(5, 9)],
]


def run(spark, spec, question="red lamps"):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, access string, status string")
    items = spark.createDataFrame([(7, question, "public")], "item_id long, question string, asker string")
    return {k: v for k, v in P.run(docs, items, spec).items()}


def order(df):
    return [r.pos for r in df.orderBy("rank").collect()]


def test_filter_before_refills_and_after_does_not(spark):
    base = P.Spec(chunker=P.Chunker("whole"), search=P.Search(depth=2))
    assert order(run(spark, base)["ranked"]) == [1, 2]
    assert order(run(spark, base.changed(filter={"placement": "before"}))["ranked"]) == [1, 4]
    assert order(run(spark, base.changed(filter={"placement": "after"}))["ranked"]) == [1]


def test_chunk_positions_follow_documents(spark):
    texts = {d[0]: d[1] for d in DOCS}
    for chunker in (P.Chunker("words", 3), P.Chunker("fixed", 4, 2), P.Chunker("structure", 5), P.Chunker("whole")):
        chunks = run(spark, P.Spec(chunker=chunker))["chunks"].orderBy("pos").collect()
        assert all(texts[c.doc_id][c.start : c.stop] == c.text for c in chunks) and len({c.pos for c in chunks}) == len(chunks)
        assert [c.doc_id for c in chunks] == sorted(c.doc_id for c in chunks)
        assert all(c.chunk_id.startswith(f"{c.doc_id}#") for c in chunks)


def test_removed_chunks_have_reasons(spark):
    base = P.Spec(chunker=P.Chunker("whole"), search=P.Search(depth=4))
    for placement in ("before", "after"):
        removed = run(spark, base.changed(filter={"placement": placement}), "red lamps, boats leave")["removed"].collect()
        assert {(r.pos, r.reason) for r in removed} == {(2, "access"), (3, "status")}
    assert run(spark, base)["removed"].collect() == []


def test_rerank_by_scores_and_replies(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, access string, status string")
    items = spark.createDataFrame([(7, "red lamps", "public")], "item_id long, question string, asker string")
    base = P.Spec(chunker=P.Chunker("whole"), search=P.Search(depth=4))
    was = order(P.run(docs, items, base)["ranked"])
    scores = spark.createDataFrame([(7, was[0], 0.1), (7, was[1], 0.9), (7, was[2], 0.5)], "item_id long, pos long, score double")
    assert order(P.run(docs, items, base.changed(rerank={"mode": "scores", "shortlist": 3}), scores=scores)["ranked"]) == [was[1], was[2], was[0], was[3]]
    replies = spark.createDataFrame([(7, "3, then 1")], "item_id long, text string")
    out = P.run(docs, items, base.changed(rerank={"mode": "order", "shortlist": 3}), orders=replies)
    assert order(out["ranked"]) == [was[2], was[0], was[1], was[3]]
    text = out["texts"].first().prompt
    assert text.startswith("Passages:\n\n[P1] \n") and text.endswith("\n\nQuestion: red lamps")


def test_followups_are_resolved_by_replies(spark):
    items = spark.createDataFrame([(1, "and boats?", "public", "User: lamps?"), (2, "lamps", "public", None)], "item_id long, question string, asker string, history string")
    replies = spark.createDataFrame([(1, "1. when do boats leave"), (2, "ignored")], "item_id long, text string")
    text = lambda spec, r=None: {x.item_id: x.text for x in P.queries_of(items, spec, r).collect()}
    assert text(P.Spec(rewrite="resolve_followup"), replies) == {1: "when do boats leave", 2: "lamps"}
    assert text(P.Spec(rewrite="rewrite"), replies) == {1: "when do boats leave", 2: "ignored"}
    assert text(P.Spec(rewrite="rewrite")) == {1: "and boats?", 2: "lamps"}


def test_spec_changes_one_stage():
    base = P.Spec()
    assert base.config_id == P.Spec().config_id != base.changed(search={"depth": 9}).config_id
    with pytest.raises(ValueError):
        base.changed(search={"depth": 9}, prompt={"k": 1})
    with pytest.raises(ValueError):
        base.changed(nothing={})


def test_split_queries_are_fused(spark):
    spec = P.Spec(chunker=P.Chunker("whole"), rewrite="split", search=P.Search(depth=3))
    # documents 2 and 3 are in both lists, which outweighs a first place in one
    assert order(run(spark, spec, "blue lamps. boats at nine")["searched"]) == [2, 3, 4]


def test_packing_closes_before_it_overflows():
    assert E.pack([5, 5, 5, 20, 1, 1], 2, 10) == [0, 0, 1, 2, 3, 3]


def test_tiers_and_tau(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    for n in (1, 4, 9):
        scores = {f"m{i}": int(x) for i, x in enumerate(rng.integers(0, 5, n))}
        apart = {frozenset((a, b)) for a in scores for b in scores if a < b and rng.random() < 0.5}
        left, want = sorted(scores, key=lambda m: (-scores[m], m)), {}
        while left:
            mine = {m for m in left if m == left[0] or frozenset((left[0], m)) not in apart}
            want |= dict.fromkeys(mine, max(want.values(), default=0) + 1)
            left = [m for m in left if m not in mine]
        pairs = [(b, a, 0.01 if frozenset((a, b)) in apart else 0.5) for a in scores for b in scores if a < b]
        got = E.tiers(spark.createDataFrame(list(scores.items()), "model string, score long"), spark.createDataFrame(pairs, "model1 string, model2 string, p double"))
        assert {r.model: r.tier for r in got.collect()} == want
    assert E.tau_b(np.array([1, 2, 3]), np.array([1, 2, 3])) == 1.0 and E.tau_b(np.array([1, 1]), np.array([1, 2])) == 0.0


def test_bootstrap_surrounds_tau(spark):
    import numpy as np

    hit = {(i, a): (i * 7 + a * 3 + i * i % 5) % 10 < a + 2 for i in range(60) for a in range(1, 6)}
    hits = spark.createDataFrame([(*k, v) for k, v in hit.items()], "item_id long, arm int, hit boolean")
    board = {a: float(a * 3 % 5) for a in range(1, 6)}
    r = E.bootstrap_tau(hits, board)
    matrix, x = np.array([[hit[i, a] for a in range(1, 6)] for i in range(60)], int), np.array([board[a] for a in range(1, 6)])
    rng = np.random.default_rng(1)
    draws = [E.tau_b(x, matrix[rng.integers(0, 60, 60)].sum(0)) for _ in range(2000)]
    assert r["tau_b"] == round(E.tau_b(x, matrix.sum(0)), 4)
    assert abs(r["low"] - np.percentile(draws, 2.5)) < 0.12 and abs(r["high"] - np.percentile(draws, 97.5)) < 0.12


def test_sentences_and_changed_values():
    text = "Dr. Vale met J. Orr at 3.5 km. It rained! Why?"
    assert [text[:e][-6:] for e in E.sentence_ends(text)] == [".5 km. "[-6:], "ained! "[-6:]]
    assert E.changed_value("pay 30 days after", "pay 45 days after") == ("30", "45")
    assert E.changed_value("It is 24 months.", "It is 12 months.") == ("24", "12")
    assert E.insert_at("One two. Three four.", "New.", 50) == "One two. New. Three four."
    from tarnfield.functions import bpe

    b = bpe.Bpe(bpe.read(), bpe.PATTERN)
    assert E.trimmed("One two. Three four. Five six seven eight.", 8, b) == "One two. Three four."
    assert E.insert_at("One two. Three four five six seven eight nine ten.", "New.", 20, b).startswith("One two. New. Three")


def test_an_index_is_built_once_and_read_again(spark, tmp_path):
    from tarnfield.operators import retrieval as R
    from tarnfield.plans import index as I
    from tarnfield.sources.stores import KeyedStore

    def embed(texts):
        return [[float(len(t)), float(t.count("a")), 1.0] for t in texts]

    chunks = spark.createDataFrame([(1, "a lamp"), (2, "boats at sea"), (3, "a lamp")], "pos long, embed_text string")
    store = KeyedStore(spark, str(tmp_path / "vectors"), I.VECTORS)
    built = I.build_index(chunks, "m", embed, store)
    assert store.table().count() == 2 and {r.pos: r.v[0] for r in built.vectors.collect()} == {1: 6.0, 2: 12.0, 3: 6.0}

    def none(texts):
        raise AssertionError("embedded again")

    assert I.build_index(chunks, "m", none, store).vectors.count() == 3
    asks = spark.createDataFrame([(9, "lamp")], "query_id long, text string")
    built.keywords.save(str(tmp_path / "index"))
    again = R.KeywordIndex.load(spark, str(tmp_path / "index"))
    rows = lambda i: [(r.pos, r.score) for r in i.top_k(asks, 3).orderBy("rank").collect()]
    assert rows(again) == rows(built.keywords) and [p for p, _ in rows(again)] == [1, 3, 2]


def test_latest_answers_of_a_stream_equal_those_of_the_whole_log(spark, tmp_path):
    import random

    from tarnfield.operators.runlog import latest_successful
    from tarnfield.streaming.runlog import RECORD, LatestAnswers

    rng, rows = random.Random(2), []
    state = LatestAnswers(spark, str(tmp_path / "state"), buckets=4)
    for batch in range(6):
        new = [(f"c{rng.randrange(9)}", f"h{rng.randrange(3)}", len(rows) + i, rng.random() < 0.5, None, "") for i in range(12)]
        rows += new
        rng.shuffle(new)
        table = spark.createDataFrame(new + new[:3], RECORD)
        state.merge(table, batch)
        if batch % 2:
            state.merge(table, batch)  # a batch runs again
        want = sorted(tuple(r) for r in latest_successful(spark.createDataFrame(rows, RECORD)).select("call_id", "request_hash", "line_no").collect())
        assert sorted(tuple(r) for r in state.latest().collect()) == want


def test_latest_answers_follow_a_folder(spark, tmp_path):
    from tarnfield.streaming.runlog import LatestAnswers

    src = tmp_path / "in"
    src.mkdir()
    row = {"call_id": "a", "request_hash": "h", "line_no": 1, "ok": True, "recorded": "2024-01-01T00:00:00", "text": "x"}
    state = LatestAnswers(spark, str(tmp_path / "state"))
    for n, (line, ok, want) in enumerate([({}, True, [("a", "h", 1)]), ({"line_no": 2, "request_hash": "g"}, False, []), ({"line_no": 3, "request_hash": "g"}, True, [("a", "g", 3)])]):
        (src / f"{n}.json").write_text(json.dumps(row | line | {"ok": ok}) + "\n")
        state.follow(runlog.records(spark, str(src)), str(tmp_path / "ck")).awaitTermination(60)
        assert [tuple(r) for r in state.latest().collect()] == want


def test_batches_of_one_large_group(spark):
    import random

    rng = random.Random(3)
    rows = [(g, i, rng.choice([0, 1, 5, 30, 120, None])) for g, n in (("a", 3000), (None, 7), ("b", 1)) for i in range(n)]
    table = spark.createDataFrame(rows, "g string, i long, tokens long").repartition(5)
    for inputs, tokens in ((7, 100), (1, 50), (5000, 40)):
        got = {(r.g, r.i): r.batch for r in E.batches(table, "g", "i", "tokens", inputs, tokens).collect()}
        for g in ("a", None, "b"):
            mine = [r for r in rows if r[0] == g]
            want = E.pack([r[2] or 0 for r in mine], inputs, tokens)
            assert [got[(g, r[1])] for r in mine] == want


def test_a_digest_is_a_tree_of_ranges(spark):
    import hashlib

    from tarnfield.sources import itemlog

    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    rows = [(i * 37, f"t{i}") for i in range(4000)] + [(5, None), (5, "b")]
    want = {}
    for i, t in sorted(rows, key=lambda r: (r[0], md5("\t".join([str(r[0])] + ([r[1]] if r[1] is not None else []))))):
        want.setdefault(i, []).append(md5("\t".join([str(i)] + ([t] if t is not None else []))))
    level = {i: "".join(d) for i, d in want.items()}
    while True:
        cells = {}
        for i in sorted(level):
            cells.setdefault(i // 1024, []).append(level[i])
        level = {c: md5("".join(d)) for c, d in cells.items()}
        if len(level) == 1:
            break
    for parts in (1, 7):
        r = itemlog.checksum(spark.createDataFrame(rows, "id long, text string").repartition(parts), "id").first()
        assert (r.checksum, r["items"]) == (next(iter(level.values())), len(rows))
    assert itemlog.checksum(spark.createDataFrame([("x", "y"), ("z", None)], "id string, text string"), "id").count() == 1
