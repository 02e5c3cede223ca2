"""Hand-computed values and order of ties."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnfield.functions import stats as S
from tarnfield.functions import text as X
from tarnfield.operators import chunking as C
from tarnfield.operators import retrieval as R
from tarnfield.operators import runlog as L


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_wilson_edges(spark):
    assert tuple(one(spark, S.safe_wilson(F.lit(0), F.lit(0)))) == (0.0, 1.0)
    assert tuple(one(spark, S.proportion(F.lit(0), F.lit(0)))) == (0, 0, 0.0, 0.0, 0.0)
    low, high = one(spark, S.safe_wilson(F.lit(239), F.lit(400)))
    assert round(low, 2) == 0.55 and round(high, 2) == 0.64


@pytest.mark.parametrize(("b", "c"), [(0, 0), (0, 5), (1, 9), (7, 7), (30, 12), (400, 350)])
def test_mcnemar_is_exact(spark, b, c):
    n = b + c
    want = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n)
    assert one(spark, S.mcnemar(F.lit(b), F.lit(c))) == pytest.approx(want, rel=1e-6)


def test_newcombe_without_pairs(spark):
    assert tuple(one(spark, S.newcombe(F.lit(0), F.lit(0), F.lit(0), F.lit(0)))) == (0.0, -1.0, 1.0)


def test_ties_keep_corpus_order(spark):
    s = spark.createDataFrame([(0, p, v) for p, v in enumerate([1.0, 2.0, 2.0, 0.5])], "query_id int, pos int, score double")
    assert [r.pos for r in R.top_k(s, 4).orderBy("rank").collect()] == [1, 2, 0, 3]


def test_fusion_prefers_what_both_lists_hold_high(spark):
    lists = [("a", 1, 1), ("b", 1, 2), ("c", 1, 3), ("b", 2, 1), ("c", 2, 2), ("a", 2, 3)]
    df = spark.createDataFrame([(0, n, r, p) for p, n, r in lists], "query_id int, list_no int, rank int, pos string")
    assert [r.pos for r in R.fuse(df).orderBy("rank").collect()][0] == "b"


def test_a_new_request_that_fails_voids_older_answers(spark):
    rows = [("a", 1, "x", True), ("a", 2, "y", False), ("b", 1, "x", True), ("b", 2, "x", False), ("c", 1, "x", False)]
    log = spark.createDataFrame(rows, "call_id string, line_no int, request_hash string, ok boolean")
    assert [(r.call_id, r.line_no) for r in L.latest_successful(log).collect()] == [("b", 1)]


def test_citation_ranges(spark):
    got = one(spark, X.cited(F.lit("see [P2], [P4-P3], [P1,P2] and [P5–P9]"), F.lit(6)))
    assert got == [1, 2, 5, 6]


def test_order_reply(spark):
    # passages are numbered from 1 in the prompt, positions from 0
    assert one(spark, X.parse_order(F.lit("3 then 1, 3, 0, 9"), F.lit(4))) == [2, 0, 1, 3]
    assert one(spark, X.parse_order(F.lit("none"), F.lit(0))) == []


def test_checks_and_quotes(spark):
    fence = "`" * 3
    assert one(spark, X.parse_check(F.lit(f'{fence}json\n{{"answers": true}}\n{fence}'))) is True
    assert one(spark, X.parse_check(F.lit('{"answers": 1}'))) is None and one(spark, X.parse_check(F.lit("true"))) is None
    article = F.lit("It floats. The lamp has two bulbs. It floats.\nThe end of it")
    assert one(spark, X.broken_quote(article, F.lit(' "The lamp has two bulbs." '))) is None
    assert one(spark, X.broken_quote(article, F.lit("The lamp has nine bulbs."))) == "not in the article"
    text = "One here. Two is there! Three\nFour"
    for at, want in ((2, "One here."), (12, "Two is there!"), (26, "Three"), (31, "Four")):
        s = one(spark, X.sentence_around(F.lit(text), F.lit(at)))
        assert text[s.start : s.stop] == want


@pytest.mark.parametrize(("n", "want"), [(0, [(0, 0)]), (5, [(0, 5)]), (10, [(0, 8), (6, 10)]), (16, [(0, 8), (6, 14), (12, 16)])])
def test_windows(spark, n, want):
    d = spark.createDataFrame([(1, " ".join(["w"] * n))], "doc_id long, text string")
    assert [(r.first, r.stop) for r in C.fixed_windows(d, 8, 2).orderBy("first").collect()] == want


def test_sections_cover_the_text_and_merge_empty_headings(spark):
    from tarnfield.functions import bpe

    texts = {1: "before\n# A\n## B\nbody of b\n\nmore\n# C\n" + "word " * 30, 2: "", 3: "plain", 4: "# T\n### deep\nx\n## up \ny\n# last", 5: "\n\n## first\nz"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = sorted(((r.doc_id, r.start, r.stop, r.headings) for r in C.sections(docs).collect()), key=lambda r: r[:3])
    by = {d: [(texts[d][a:b], h) for i, a, b, h in rows if i == d] for d in texts}
    assert by[1] == [("before\n", []), ("# A\n## B\nbody of b\n\nmore\n", ["A", "B"]), ("# C\n" + "word " * 30, ["C"])]
    assert by[2] == [] and by[3] == [("plain", [])] and by[5] == [("\n\n## first\nz", ["first"])]
    assert by[4] == [("# T\n### deep\nx\n", ["T", "deep"]), ("## up \ny\n", ["T", "up"]), ("# last", ["last"])]
    b = bpe.Bpe(bpe.read(), bpe.PATTERN)
    got = sorted((r.doc_id, r.chunk_no, r.start, r.stop) for r in C.structure_chunks(docs, 12).collect())
    for d, text in texts.items():
        mine = [(a, z) for i, _, a, z in got if i == d]
        assert "".join(text[a:z] for a, z in mine) == text and all(b.count(text[a:z]) <= 12 for a, z in mine)
        assert [n for i, n, _, _ in got if i == d] == list(range(len(mine)))


def _fitted_plainly(b, text, limit):
    """As fitted, with every growing run of paragraphs encoded anew."""
    import regex

    if b.count(text) <= limit:
        return [(0, len(text))]
    edges = sorted({0, len(text), *(m.end() for m in regex.finditer(C.PARAGRAPH_BREAK, text))})
    out, now = [], None
    for x, y in zip(edges, edges[1:], strict=False):
        if now and b.count(text[now[0] : y]) <= limit:
            now = (now[0], y)
            continue
        out += [now] if now else []
        now = (x, y) if b.count(text[x:y]) <= limit else None
        if now is None:
            out += [(x + p, x + q) for p, q in b.windows(text[x:y], limit)]
    return out + ([now] if now else [])


def test_paragraph_runs_are_counted_from_one_encoding():
    import random

    from tarnfield.functions import bpe

    b = bpe.Bpe(bpe.read(), bpe.PATTERN)
    rng = random.Random(5)
    parts = ["\n\n", "\n \t\n", "\n", " ", "  ", "\t", "\u00a0", "\u2003", "\x1c", "word", "it's", "'ll", "12", "!?", "日本", "🙂", "e\u0301", "---", "Ab"]
    for n in range(600):
        text = "".join(rng.choices(parts, k=rng.randrange(60)))
        total, count = b.run_counts(text)
        assert total == b.count(text)
        import regex

        edges = sorted({0, len(text), *(m.end() for m in regex.finditer(C.PARAGRAPH_BREAK, text))})
        for x in edges:
            for y in edges:
                if x < y:
                    assert count(x, y) == b.count(text[x:y]), (text, x, y)
        for limit in (3, 9, 25):
            assert C.fitted(b, text, limit) == _fitted_plainly(b, text, limit)


def test_a_long_section_is_encoded_a_bounded_number_of_times(monkeypatch):
    from tarnfield.functions import bpe

    b = bpe.Bpe(bpe.read(), bpe.PATTERN)
    seen = []
    ids = bpe.Bpe.ids
    monkeypatch.setattr(bpe.Bpe, "ids", lambda self, text: seen.append(len(text)) or ids(self, text))
    text = "a few words\n\n" * 5000
    got = C.fitted(b, text, 2000)
    assert got[0][0] == 0 and got[-1][1] == len(text) and len(got) > 1
    assert sum(seen) < 2 * len(text)


def test_byte_pair_windows_hold_whole_characters(spark):
    from tarnfield.functions import bpe

    b = bpe.Bpe(bpe.read(), bpe.PATTERN)
    for text in ("", "one two three four five six seven", "日本語のテキスト 🙂🙃 ende", "a" * 50):
        low, high = b.bounds(text)
        assert len(low) == b.count(text) + 1 and high[-1] == len(text)
        for size, overlap in ((3, 0), (4, 2), (100, 7)):
            got = b.windows(text, size, overlap)
            want = []
            for first in range(0, max(len(low) - 1, 1), size - overlap):
                last = min(first + size, len(low) - 1)
                want.append((low[first], high[last]))
                if last == len(low) - 1:
                    break
            assert got == want


def test_word_chunks_are_slices(spark):
    text = "a bb  ccc dddd e"
    docs = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    got = C.word_chunks(docs, 2).orderBy("doc_id", "chunk_no").collect()
    assert all(r.text == {1: text, 2: ""}[r.doc_id][r.start : r.stop] for r in got)
    assert [(r.start, r.stop) for r in got if r.doc_id == 1] == [(0, 4), (5, 9), (10, 16)]


def test_spans_stand_beside_anything(spark):
    docs = {1: "a\nred lamps shine at night, they say", 2: '"red lamps shine at night"', 3: "red lamps shine", 4: "no lamps", 5: "at nightfall red  lamps"}
    items = {10: "red lamps shine at night", 11: "lamps", 12: "red lamps", 13: "at night", 14: "lamps shine at nigh"}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    i = spark.createDataFrame(list(items.items()), "item_id long, evidence string")
    got = {(r.item_id, r.doc_id, r.start, r.stop) for r in R.spans(i, d).collect()}
    assert got == {(k, n, t.index(e), t.index(e) + len(e)) for k, e in items.items() for n, t in docs.items() if e in t}


def test_budgets_cut_where_they_end(spark):
    rows = spark.createDataFrame([(g, i, (i * 7 + g) % 5 + 1) for g in range(3) for i in range(400)], "g int, i long, n long")
    got = R.within_budget(rows, ["g"], "i", "n", 200, cells=16).collect()
    for g in range(3):
        so_far, want = 0, []
        for i in range(400):
            so_far += (i * 7 + g) % 5 + 1
            want += [(i, so_far)] if so_far <= 200 else []
        assert sorted((r.i, r.so_far) for r in got if r.g == g) == want


def test_best_chunks_with_ties_and_filters(spark):
    texts = {i: "lamp " * (i % 3) + f"word{i % 7}" for i in range(700)}
    chunks = spark.createDataFrame(list(texts.items()), "pos long, text string").repartition(5)
    facts = spark.createDataFrame([(i, "staff" if i % 2 else "public") for i in texts], "pos long, access string")
    asks = spark.createDataFrame([(1, "lamp word3", "public"), (2, "nothing here", "staff"), (3, "", "public")], "query_id long, text string, asker string")
    index = R.KeywordIndex(chunks)
    allowed = (F.col("access") == "public") | (F.col("asker") == "staff")
    for may, filtered in ((allowed, True), (None, False)):
        got = index.top_k(asks, 6, may, facts if filtered else None).collect()
        scores = {(r.query_id, r.pos): r.score for r in index.scores(asks).collect()}
        for q, who in ((1, "public"), (2, "staff"), (3, "public")):
            open_ = [i for i in texts if not filtered or who == "staff" or i % 2 == 0]
            want = sorted(open_, key=lambda i: (-scores.get((q, i), 0.0), i))[:6]
            assert [r.pos for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


# ------------------------------------------------------------------ indexes, tiles, whole fusion and intervals


def _plain_ranking(scores, allowed):
    return sorted((p for p in scores if p in allowed), key=lambda p: (-scores[p], p))


@pytest.mark.parametrize("few", [True, False])
def test_blocks_that_cannot_matter_stay_shut(spark, monkeypatch, few):
    from tarnfield.operators import keyword_index as K

    monkeypatch.setattr(K, "BLOCK_ROWS", 8)
    monkeypatch.setattr(K, "FEW_BLOCKS", 1000 if few else 0)
    rng = random.Random(4)
    texts = {i * 3: " ".join(rng.choice("a b c d e f g h".split() + [f"w{i % 40}"]) for _ in range(rng.randrange(0, 12))) for i in range(300)}
    texts[9] = None
    chunks = spark.createDataFrame(list(texts.items()), "pos long, text string").repartition(3)
    facts = spark.createDataFrame([(i, "staff" if i % 2 else "public", None) for i in texts if i != 6], "pos long, access string, status string")
    asks = spark.createDataFrame([(1, "a w3 w7 w3", "public"), (2, "nothing here", "staff"), (3, "", "public"), (4, "w11", "public"), (5, None, "staff"), (6, "w1 w2 w5", "staff")], "query_id long, text string, asker string")
    index = K.KeywordIndex(chunks)
    reached: dict = {}
    for r in index.scores(asks).collect():
        reached.setdefault(r.query_id, {})[r.pos] = r.score
    opened = []
    scored = K._Search.scored
    monkeypatch.setattr(K._Search, "scored", lambda self, o, *a: (opened.append(o.count()), scored(self, o, *a))[1])
    may = (F.col("access") == "public") | (F.col("asker") == "staff")
    wanted = spark.createDataFrame([(1, 0), (1, 9), (1, 30), (4, 33), (6, 3), (2, 60)], "query_id long, pos long")
    for allowed in (None, may):
        got = index.top_k(asks, 5, allowed, facts if allowed is not None else None).collect()
        places = {(r.query_id, r.pos): r.rank for r in index.places(asks, wanted, allowed, facts if allowed is not None else None).collect()}
        for q, who in ((1, "public"), (2, "staff"), (3, "public"), (4, "public"), (5, "staff"), (6, "staff")):
            seen = [i for i in texts if allowed is None or (i != 6 and (who == "staff" or i % 2 == 0))]
            want = _plain_ranking({i: reached.get(q, {}).get(i, 0.0) for i in texts}, set(seen))
            assert [r.pos for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want[:5]
            assert all(places[q, p] == want.index(p) + 1 for k, p in places if k == q and p in want)
    if not few:
        only = asks.where("query_id = 6")
        opened.clear()
        assert index.top_k(only, 2).count() == 2 and sum(opened) < index.blocks  # rare words open some blocks


def test_vectors_without_a_direction_are_left_out(spark, monkeypatch):
    from tarnfield.operators import ranking, vectors as V

    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)]
    for i in (5, 6, 7, 8, 9):
        rows[i] = (i, [0.0] * 4)
    rows[20], rows[21] = (20, None), (21, [1.0, None, 2.0, 3.0])
    chunks = spark.createDataFrame(rows, "pos long, v array<double>").repartition(3)
    asks = spark.createDataFrame([(q, None if q == 3 else [0.0] * 4 if q == 4 else rows[30 + q][1]) for q in range(7)], "query_id long, v array<double>")
    good = {i: np.array(v) for i, v in rows if v and None not in v and any(v)}
    for size in (4096, 3):  # one block of queries, then tiles
        monkeypatch.setattr(ranking, "QUERY_ROWS", size)
        monkeypatch.setattr(V, "TILE_ROWS", 64 if size == 3 else 16384)
        got = V.vector_top_k(asks, chunks, 5).collect()
        wanted = spark.createDataFrame([(q, p) for q in range(7) for p in (0, 7, 50, 299)], "query_id long, pos long")
        places = {(r.query_id, r.pos): r.rank for r in V.vector_places(asks, chunks, wanted).collect()}
        assert {r.query_id for r in got} == {0, 1, 2, 5, 6}
        for q in (0, 1, 2, 5, 6):
            a = np.array(rows[30 + q][1])
            scores = {i: round(float(a @ v / np.linalg.norm(a) / np.linalg.norm(v)), 6) for i, v in good.items()}
            want = _plain_ranking(scores, set(good))
            assert [r.pos for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want[:5]
            assert all(places[q, p] == want.index(p) + 1 for p in (0, 50, 299)) and (q, 7) not in places


@pytest.mark.parametrize("depth, k", [(1, 60), (5, 60), (10, 3), (400, 60)])
def test_fusion_of_whole_rankings_from_prefixes(spark, depth, k):
    rng = random.Random(depth)
    orders = {q: [rng.sample(range(300), 300), rng.sample(range(300), 280)] for q in range(4)}
    read = []

    def side(i):
        rows = [(q, p, r + 1) for q, o in orders.items() for r, p in enumerate(o[i])]
        table = spark.createDataFrame(rows, "query_id long, pos long, rank int")

        def places(wanted):
            read.append(wanted.count())
            return table.join(wanted, ["query_id", "pos"])

        return table.where(F.col("rank") <= R.prefix(depth, k)), places

    got = R.fuse_whole([side(0), side(1)], depth, k).collect()
    for q, o in orders.items():
        at = [{p: r + 1 for r, p in enumerate(x)} for x in o]
        score = {p: round(sum(1.0 / (k + a[p]) for a in at if p in a), 9) for p in range(300)}
        first = {p: min((i, a[p]) for i, a in enumerate(at) if p in a) for p in range(300)}
        want = sorted(range(300), key=lambda p: (-score[p], first[p]))[:depth]
        rows = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.pos for r in rows] == want and all(abs(r.score - score[r.pos]) < 1e-9 for r in rows)
    if depth <= 5:
        assert sum(read) < 4 * 2 * 100  # few places are counted, and none for most chunks


def test_spans_and_the_chunks_that_hold_them(spark):
    rng = random.Random(6)
    text = "".join(rng.choice("ab c\n") for _ in range(400))
    found = [(1, a, a + rng.randrange(0, 60)) for a in range(0, 400, 3)] + [(2, 0, 3)]
    cuts = [(1, n, a, a + 90) for n, a in enumerate(range(0, 400, 45))] + [(3, 0, 0, 50), (1, 99, 0, 400)]
    f = spark.createDataFrame(found, "doc_id long, start long, stop long")
    c = spark.createDataFrame(cuts, "doc_id long, chunk_no int, start long, stop long")
    want = sorted((a, b, n) for d, a, b in found for e, n, x, y in cuts if d == e and x <= a and b <= y)
    for size in (7, 8192):
        assert sorted((r.start, r.stop, r.c_chunk_no) for r in R.held(f, c, size=size).collect()) == want
        assert R.held(f, c, "left_anti", size).count() == sum(not any(d == e and x <= a and b <= y for e, _, x, y in cuts) for d, a, b in found)
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    items = {i: text[i * 9 : i * 9 + i % 7] for i in range(30)} | {30: "", 31: None, 32: text[5:9]}
    i = spark.createDataFrame(list(items.items()), "item_id long, evidence string")
    got = {(r.item_id, r.doc_id, r.start, r.stop) for r in R.spans(i, docs).collect()}
    assert got == {(k, n, t.index(e), t.index(e) + len(e)) for k, e in items.items() if e is not None for n, t in ((1, text), (3, "")) if e in t}


def test_scores_are_added_up_in_blocks(spark):
    """Hits of a frequent term are not joined by term: every block of chunks is scored in a task of its own, by terms that are sent to it."""
    from tarnfield.operators.keyword_index import KeywordIndex, _Search

    chunks = spark.createDataFrame([(i, "common " + ("rare" if i % 7 == 0 else "plain")) for i in range(1200)], "pos long, text string")
    queries = spark.createDataFrame([(1, "common rare"), (2, "rare"), (3, "absent")], "query_id long, text string")
    index = KeywordIndex(chunks)
    out = index.scores(queries)
    assert "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()
    assert _Search(index, queries, None, None).sent.value.num_rows == 3
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, set()).add(r.pos)
    assert got == {1: set(range(1200)), 2: set(range(0, 1200, 7))}


@pytest.mark.parametrize("small", [True, False])
def test_few_queries_scan_texts_and_write_no_index(spark, monkeypatch, tmp_path, small):
    """Searches by an index that is not written read the texts once, keep a query's best in every task, and rank as a written index does."""
    from tarnfield.operators import keyword_index as K

    if small:
        monkeypatch.setattr(K, "CELLS", 12)
        monkeypatch.setattr(K, "HITS", 5)
        monkeypatch.setattr(K, "SEEN_ROWS", 1)
    rng = random.Random(8)
    texts = {i * 2: " ".join(rng.choice("a b c d e".split() + [f"w{i % 30}"]) for _ in range(rng.randrange(0, 9))) for i in range(200)} | {7: None}
    chunks = spark.createDataFrame(list(texts.items()), "pos long, text string").repartition(3)
    facts = spark.createDataFrame([(i, "staff" if i % 4 else "public") for i in texts if i != 6], "pos long, access string")
    asks = spark.createDataFrame([(1, "a w3 w7 w3", "public"), (2, "nothing", "staff"), (3, None, "public"), (4, "w11 a", "staff")], "query_id long, text string, asker string")
    may = (F.col("access") == "public") | (F.col("asker") == "staff")
    index, written = K.KeywordIndex(chunks), K.KeywordIndex(chunks)
    written.save(str(tmp_path / "index"))
    written = K.KeywordIndex.load(spark, str(tmp_path / "index"))
    wanted = spark.createDataFrame([(1, 0), (1, 7), (4, 22), (2, 8), (9, 8), (1, 1001)], "query_id long, pos long")
    for allowed, about in ((None, None), (may, facts)):
        out = index.top_k(asks, 9, allowed, about)
        rows = lambda df: sorted((r.query_id, r.rank, r.pos, r.score) for r in df.collect())
        assert rows(out) == rows(written.top_k(asks, 9, allowed, about)) and "Arrow" not in out._jdf.queryExecution().executedPlan().toString()
        order = {}
        for q, _, p, _ in rows(written.top_k(asks, 500, allowed, about)):
            order.setdefault(q, []).append(p)
        want = {(q, p): order[q].index(p) + 1 for q, p in ((1, 0), (1, 7), (4, 22), (2, 8)) if p in order[q]}
        assert {(r.query_id, r.pos): r.rank for r in index.places(asks, wanted, allowed, about).collect()} == want
    assert "path" not in index.__dict__ and len(index.tallies) == 1
