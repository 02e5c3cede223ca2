"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from tarnfield.llm import byte_bpe, fingerprints, line_dedup, mixing, ngram_join, piece_encoding, pitman_yor, quality_rules, shared, suffix_dedup, tandem_runs, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, size long, rank double, block string, token string"
LONG = "the cat sat on the mat again and again " * 3000


def table(spark, rows):
    full = [(i, t, "en", s, len(t or ""), "h", 7, 0.5, "b", "t") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


ROWS = [(1, None, "a"), (2, "", None), (3, "one", "a"), (4, LONG, "a"), (4, LONG, "a"), (5, "one", "b"), (None, "a null id, twice over", "b"), (None, None, None), (9, " \n\t\n", "ü"), (10, "x y z w v " * 40, "a")]


def labels(spark):
    return spark.createDataFrame([(1, 1), (2, None), (3, 0), (None, 1), (4, 0), (4, 1)], "doc_id long, toxic int")


RUNS = {
    "line_dedup": lambda s, d: line_dedup.line_dedup(d),
    "line_documents": lambda s, d: line_dedup.dedup_documents(d),
    "mixing": lambda s, d: mixing.mix(d),
    "mixed": lambda s, d: mixing.mixed_documents(d),
    "quality": lambda s, d: quality_rules.verdicts(d),
    "pieces": lambda s, d: piece_encoding.decode(piece_encoding.encode(d)),
    "toxicity": lambda s, d: toxicity.reject_toxic(d, labels(s)),
    "fingerprints": lambda s, d: fingerprints.with_edits(d),
    "join": lambda s, d: ngram_join.components(d),
    "one_of_each": lambda s, d: ngram_join.one_of_each(d),
    "suffixes": lambda s, d: suffix_dedup.deduplicate(d),
    "runs": lambda s, d: tandem_runs.periodic_runs(d),
    "tokens": lambda s, d: byte_bpe.decode(byte_bpe.encode(d)),
    "language_model": lambda s, d: pitman_yor.score(d),
}
EACH_ROW = set(RUNS) - {"mixed", "one_of_each", "line_documents", "toxicity"}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows(spark, name):
    got = RUNS[name](spark, table(spark, ROWS)).collect()
    if name in EACH_ROW:
        assert len(got) == len(ROWS)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, name):
    assert RUNS[name](spark, table(spark, [])).collect() == []


@pytest.mark.parametrize("name", ["line_documents", "mixed", "toxicity", "one_of_each"])
def test_stages_keep_columns(spark, name):
    d = table(spark, ROWS)
    assert RUNS[name](spark, d).columns == d.columns


CLASHING = ["drop", "id", "row", "doc", "kept", "copy", "copies", "got_doc_id", "rel", "kept_id", "component_id", "score", "owner", "t", "g", "w", "n", "exact_", "a.b", "__kept", "__copies", "__size", "__doc_id", "__copy", "__id", "__row"]


@pytest.mark.parametrize("name", ["line_documents", "mixed", "toxicity", "one_of_each"])
def test_names_that_operators_use_within(spark, name):
    d = table(spark, ROWS).where("doc_id is not null")
    plain = sorted(map(str, RUNS[name](spark, d).collect()))
    clash = d
    for c in CLASHING:
        clash = clash.withColumn(c, F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")))
    got = RUNS[name](spark, clash)
    assert got.columns == clash.columns
    rows = got.collect()
    assert all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in CLASHING)
    assert sorted(map(str, got.select(*d.columns).collect())) == plain


def test_rows_of_one_id_in_two_sources(spark):
    d = table(spark, [(0, "a b c d e", "s0"), (0, "a b c d e f g h", "s1"), *((i, "w " * 20, f"s{i % 2}") for i in range(1, 41))])
    taken = {(r.doc_id, r.size): r.copies for r in mixing.mix(d).collect()}
    written = [(r.doc_id, len(r.text.split())) for r in mixing.mixed_documents(d).collect()]
    assert all(written.count(k) == n for k, n in taken.items() if k[0] == 0)
    assert len(written) == sum(n * (1 if k[0] == 0 else 1) for k, n in taken.items())


def test_columns_of_the_results_names(spark):
    d = table(spark, ROWS).withColumn("exact", F.lit("x")).withColumn("n_pieces", F.lit("y")).withColumn("decoded", F.lit("z"))
    got = piece_encoding.decode(piece_encoding.encode(d))
    assert got.columns == [*table(spark, []).columns, "piece_ids", "n_pieces", "piece_score", "exact", "decoded"]
    assert all(r.decoded == (r.text or "") for r in got.collect())


def test_dotted_names_are_kept_by_encoders(spark):
    d = table(spark, ROWS).withColumn("a.b", F.lit("x"))
    for encoder in (piece_encoding, byte_bpe):
        got = encoder.decode(encoder.encode(d))
        assert "a.b" in got.columns and {r["a.b"] for r in got.collect()} == {"x"}


def test_one_row(spark):
    d = table(spark, [(7, "a b c d e f", "s")])
    r = fingerprints.with_edits(d).first()
    assert r.near_next == 1.0  # its own next
    assert mixing.mix(d).first().taken in (6, 12)


def test_results_of_odd_rows(spark):
    d = table(spark, ROWS)
    lines = {(r.doc_id, r.kept_text): r for r in line_dedup.line_dedup(d).collect()}
    assert lines[(1, "")].n_lines == 1 and lines[(9, " \n\t\n")].n_lines == 3
    groups = {r.doc_id: r.component_id for r in ngram_join.components(d).collect()}
    assert groups[1] == 1 and groups[2] == 2 and groups[5] == 3 and groups[None] is None
    kept = {r.doc_id: r for r in quality_rules.verdicts(d).collect()}
    assert kept[1].base_failed and not kept[1].kept
    scores = {r.doc_id: r for r in pitman_yor.score(d).collect()}
    assert scores[1].n_tokens == 1 and scores[3].n_tokens == 2
    empty = {r.doc_id: r.fingerprint for r in fingerprints.with_edits(d).collect()}
    assert empty[1] == "" == empty[9] and len(empty[3]) == 256
    pieces = {r.doc_id: r for r in piece_encoding.encode(d).collect()}
    assert pieces[1].n_pieces == 0 and all(r.exact for r in pieces.values())


def test_archives_of_odd_rows(spark):
    page = "<p>" + "x" * 200
    rows = [(3, "u\r\nv", page), (1, None, page), (2, "u", None), (None, "u", page), (5, "u", "short"), (6, "u", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    index = warc.write_archives(pages)
    got = sorted((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(spark, index).collect())
    assert got == [(-1, "response", None, 203), (1, "response", None, 203), (2, "response", None, 0), (3, "revisit", 1, 203), (5, "response", None, 5), (6, "response", None, 5)]
    [(page_id, fields, payload)] = warc.lookup(index, [1])
    assert page_id == 1 and payload.decode() == page and fields["WARC-Type"] == "response"
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0))).collect() == []


def test_ranges_of_frames_are_read_by_several_tasks(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"page {i % 40} " * 40) for i in range(200)], "page_id long, url string, html string")
    index = warc.write_archives(pages, frame_bytes=1 << 11)
    assert index.select("bundle", "frame").distinct().count() > 16
    read = warc.read_archives(spark, index, frames=2).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in read}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in read) == [(i, "response" if i < 40 else "revisit", i % 40 if i >= 40 else None) for i in range(200)]


def test_near_copies_deal_prefixes_and_rare_tokens_once(spark, monkeypatch):
    plans = {}

    def planned(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return shared.stored(df, name)

    monkeypatch.setattr(ngram_join, "stored", planned)
    a = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, a), (2, a + " x"), (3, "other words of a text"), (2, "short")], "doc_id long, text string")
    with shared.set_for(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        got = {tuple(r) for r in ngram_join.components(docs, 4, 85).collect()}
    assert {(r[0], r[2]) for r in got} == {(1, 1), (2, 1), (3, 3)}
    # documents and representatives, each by doc_id
    assert plans["prefixes"].count("Exchange hashpartitioning(") == 2
    # rare tokens come dealt and are counted where they lie
    assert plans["meets"].count("REPARTITION_BY_COL") == 2
    assert plans["meets"].count("partial_bit_xor") == 2


def test_the_driver_collects_garbage_between_steps(spark, monkeypatch):
    monkeypatch.setattr(shared, "_COLLECTED", [0.0])
    count = lambda: sum(x.getCollectionCount() for x in spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in x.getName() or "MarkSweep" in x.getName())
    before = count()
    for _ in range(2):
        shared.stored(spark.range(3), "rows")
    assert count() == before + 1


def test_training_tokens_are_told_with_the_last_sample_alone(spark, monkeypatch):
    told = {}

    def kept(df, name):
        out = shared.stored(df, name)
        if name.startswith("told"):
            told[name] = {r.c is not None for r in out.select("c").collect()}
        return out

    monkeypatch.setattr(pitman_yor, "stored", kept)
    docs = spark.createDataFrame([(i, f"a b c{i % 3} a b") for i in range(1, 13)], "doc_id long, text string")
    assert pitman_yor.score(docs).count() == 12
    last = f"told{pitman_yor.BURN_IN + pitman_yor.SAMPLES - 1}"
    assert told.pop(last) == {True} and all(x == {False} for x in told.values())
