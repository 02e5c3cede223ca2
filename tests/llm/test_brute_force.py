"""Operators against plain Python on small corpora with planted copies, passages and labels."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tarnfield.llm import fingerprints, line_dedup, mixing, ngram_join, piece_encoding, pitman_yor, quality_rules, suffix_dedup, toxicity
from tarnfield.llm import shared as sh

WORDS = [a + b for a in "ba ke lo mi nu pra sto tul vex zen".split() for b in "r st nd ma lo ti x é".split()]


def corpus(seed, n=120):
    rng = random.Random(seed)
    passage = " ".join(rng.choices(WORDS, k=60))
    out = []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.15:
            out.append(rng.choice(out))
        elif out and kind < 0.4:
            ws = rng.choice(out).split(" ")
            for _ in range(rng.randint(0, max(1, len(ws) // 25))):
                ws[rng.randrange(len(ws))] = rng.choice(WORDS)
            out.append(" ".join(ws))
        else:
            ws = rng.choices(WORDS, k=rng.randint(1, 150))
            for p in range(0, len(ws), 17):
                ws[p] += rng.choice([".\n", ",", ""])
            out.append(" ".join(ws) + (" " + passage if rng.random() < 0.2 else ""))
    return {3 * i: t for i, t in enumerate(out)}


def frame(spark, docs):
    rows = [(i, t, f"s{i % 4}") for i, t in docs.items()]
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


def tokens(text):
    return (text or "").encode().lower().split()


def test_words_are_found_and_hashed_alike():
    import pyarrow as pa

    texts = ["Ab cd", None, "", " x\ty\x0bz\r\n", "Äb äb", "ab cd"]
    [w] = list(sh.words(pa.array(texts)))
    assert w.counts.tolist() == [len(tokens(t)) for t in texts]
    h = w.hash.tolist()
    assert h[0:2] == h[-2:] and len(set(h)) == 7


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed):
    docs = corpus(seed)
    sets = {}
    for i, t in docs.items():
        w = tokens(t)
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    group = {i: i for i in docs}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in docs:
        for b in docs:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                group[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(frame(spark, docs)).collect()}
    assert got == {i: (len(sets[i]), top(i)) for i in docs}


def test_rows_of_one_id_count_once(spark):
    rng = random.Random(21)
    short, long = (rng.choices(WORDS, k=k) for k in (90, 120))
    near = lambda ws: " ".join([*ws[:-1], "edited"])
    rows = [(1, " ".join(short)), (1, " ".join(long)), (10, " ".join(short)), (11, near(short)), (12, near(long))]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.components(docs).collect())
    assert got == [(1, 87, 1), (1, 117, 1), (10, 87, 10), (11, 87, 10), (12, 117, 1)]


@pytest.mark.parametrize("seed", [3, 4])
def test_repeated_strings_go(spark, seed):
    docs = corpus(seed, 60)
    docs[999] = "ab" * 200
    seen, want = set(), {}
    for i in sorted(docs):
        b = docs[i].encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        want[i] = bytes(np.frombuffer(b, np.uint8)[~gone])
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.deduplicate(frame(spark, docs)).collect()}
    assert got == want


def test_lines(spark):
    docs = corpus(6)
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    owner, holders = {}, Counter()
    for i in sorted(docs):
        for k in {x.strip(strip).translate(lower) for x in docs[i].split("\n")}:
            owner.setdefault(k, i)
            holders[k] += 1
    want = {}
    for i, t in docs.items():
        keys = [(x, x.strip(strip).translate(lower)) for x in t.split("\n")]
        want[i] = "\n".join(x for x, k in keys if len(k) < 10 or holders[k] < 2 or owner[k] == i)
    got = {r.doc_id: r.kept_text for r in line_dedup.line_dedup(frame(spark, docs), batches=5).collect()}
    assert got == want


def test_runs_are_levelled(spark):
    runs = line_dedup.LineRuns(spark, fan_in=2)
    for i in range(5):
        runs.add(runs.write(spark.createDataFrame([(bytes([i]), i)], "h binary, owner long"), 0))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    asked = spark.createDataFrame([(bytes([i]),) for i in range(7)], "h binary")
    assert {r.h[0]: r.owner for r in runs.held(asked).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: None, 6: None}
    runs.close()


def test_runs_are_read_as_they_lie(spark):
    """Neither a run that a batch meets nor runs that are merged are dealt or sorted again."""
    runs = line_dedup.LineRuns(spark, fan_in=8)
    with sh.set_for(spark, {**line_dedup.SORTED_SCANS, "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        for i in range(2):
            runs.add(runs.write(spark.range(100 * i, 100 * i + 100).selectExpr("unhex(md5(string(id))) as h", "id as owner").groupBy("h").agg({"owner": "min"}).toDF("h", "owner"), 0))
        batch = spark.range(300).selectExpr("unhex(md5(string(id))) as h").groupBy("h").count()
        plan = runs.held(batch)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange") == 1 and plan.count("Sort [") == 1
        a, b = runs.levels[0]
        plan = a.join(b.withColumnRenamed("owner", "other"), "h", "full_outer")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and "Exchange" not in plan and "Sort [" not in plan
    runs.close()


def test_mix_meets_targets(spark):
    docs = {i: " ".join(["w"] * (1 + i * 37 % 50)) for i in range(2000)}
    d = frame(spark, docs)
    got = mixing.mix(d).collect()
    by = {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        s = by.setdefault(r.doc_id % 4, [r.target, r.source_size, 0])
        s[2] += r.taken
    total = sum(s[1] for s in by.values())
    assert sum(s[0] for s in by.values()) == pytest.approx(1.5 * total)
    for target, size, taken in by.values():
        assert abs(taken - target) <= 0.01 * size and target <= 2 * size
    assert {(r.doc_id, r.taken) for r in mixing.mix(d.repartition(2)).collect()} == {(r.doc_id, r.taken) for r in got}


def test_fingerprints_estimate_jaccard(spark):
    docs = corpus(8)
    fives = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} for i, w in ((i, tokens(t)) for i, t in docs.items())}
    ids = sorted(docs)
    got = {r.doc_id: r for r in fingerprints.with_edits(frame(spark, docs)).collect()}
    errors = []
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        q = len(docs[i]) // 4
        edited = docs[i][: len(docs[i]) - q] + docs[j][:q]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors.append(got[i].near_next - len(fives[i] & fives[j]) / len(fives[i] | fives[j]))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    same = {}
    for i in ids:
        assert same.setdefault(docs[i], got[i].fingerprint) == got[i].fingerprint


def test_quality_counts(spark):
    docs = corpus(9, 60)
    docs[1000] = "a b c d e f g h " * 5 + "### $$"
    got = {r.doc_id: r for r in quality_rules.verdicts(frame(spark, docs)).collect()}
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        covered = {k for j in range(len(w) - 7) if windows[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
        lines = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_expectation_maximisation_finds_the_defect():
    rng = np.random.default_rng(0)
    votes = np.zeros((2000, 4), int)
    votes[:, 3] = 1
    votes[:150, 0] = -1
    votes[150:165, 1] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, share, _ = quality_rules.expectation_maximisation(patterns, counts)
    assert share > 0.8 and all((post < 0.5) == (patterns == -1).any(1))
    del rng


def test_defects_are_voted_against(spark):
    rng = random.Random(3)
    prose = {i: " ".join(rng.choices(WORDS, k=60)) + "." for i in range(400)}
    few = {1000 + i: prose[i].replace(" ", " | ", 20) for i in range(20)}  # 0.25 symbols a word
    bare = {2000 + i: " ".join("--" if j % 5 > 2 and j < 59 else w for j, w in enumerate(prose[20 + i].split(" "))) for i in range(20)}  # a letter in 0.62 of the words
    got = {r.doc_id: r for r in quality_rules.verdicts(frame(spark, prose | few | bare)).collect()}
    assert not any(r.base_failed for r in got.values())
    assert all(got[i].kept for i in prose) and not any(got[i].kept for i in few | bare)


def best_score(word, pieces, unknown):
    best = [0.0] + [-1e30] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(e):
            if word[s:e] in pieces:
                best[e] = max(best[e], best[s] + pieces[word[s:e]])
        if word[e - 1] not in pieces:
            best[e] = max(best[e], best[e - 1] + unknown)
    return best[-1]


def test_segmentation_is_best_and_decodes():
    rng = random.Random(1)
    vocab = [("<unk>", 0.0, 2)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    seen = set()
    while len(seen) < 40:
        seen.add("▁" * (rng.random() < 0.3) + "".join(rng.choices("abc", k=rng.randint(1, 3))))
    seen |= {"▁", "a"}
    scores = {p: -rng.randint(1, 60) / 2 for p in sorted(seen)}
    vocab += [(p, s, 1) for p, s in scores.items()]
    m = piece_encoding.Pieces.of(vocab)
    for _ in range(300):
        text = "".join(rng.choices("abc zé ", k=rng.randint(1, 12)))
        ids = np.frombuffer(m.encode(text), np.int32)
        score = m.scores[ids].sum()
        word_scores = sum(best_score(w, scores, m.unknown_score) for w in re.findall("▁+[^▁]*", "▁" + text.replace(" ", "▁")))
        assert score == pytest.approx(word_scores)
        assert m.decode(ids.tolist()).decode() == text


def test_language_model(spark):
    docs = corpus(11, 100)
    train = {i: zlib.crc32(str(i).encode()) % 10 != 0 for i in docs}
    c = Counter()
    for i, t in docs.items():
        if train[i]:
            c.update([*tokens(t), "end"])
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in pitman_yor.score(frame(spark, docs)).collect()}
    for i, t in docs.items():
        ws = [*tokens(t), "end"]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not train[i], len(ws), sum(w in c for w in ws), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > 1.02 * sum(r.base_score for r in held)


def test_predictive_probabilities_add_up(spark):
    docs = frame(spark, corpus(12, 60))
    from pyspark.sql import functions as F

    vocab = sh.stored(pitman_yor.vocabulary(pitman_yor.blocks(docs, F.col("doc_id") % 2 == 0), 3), "v")
    rows = pitman_yor.word_samples(vocab, pitman_yor.fitted(vocab)).collect()
    for i in range(pitman_yor.SAMPLES):
        unseen = {round(r.p[i], 12) for r in rows if r.c == 0} or {0.0}
        assert sum(r.p[i] for r in rows if r.c > 0) + max(unseen) == pytest.approx(1.0, abs=1e-6)


def test_seating_follows_the_exact_conditional():
    # p(t) is proportional to S(c, t) * prod(base * (theta + d * (others + i))), S(c + 1, t) = S(c, t - 1) + (c - t * d) * S(c, t)
    d, theta, n = 0.6, pitman_yor.CONCENTRATION, 40_000
    for c, base, others in ((2, 0.05, 30), (5, 0.1, 20), (9, 0.02, 100), (12, 0.3, 2)):
        row = np.zeros(c + 2)
        row[0] = 1.0
        for k in range(c):
            row = np.concatenate([[0], row[:-1]]) + np.maximum(k - np.arange(c + 2) * d, 0 if k else 0) * row
        want = np.array([row[t] * np.prod([base * (theta + d * (others + i)) for i in range(t)]) for t in range(1, c + 1)])
        want /= want.sum()
        f = lambda x: np.full(n, float(x))
        t = pitman_yor.gibbs(f(c), f(base), f(others), d, theta, np.arange(n).astype(np.uint64), 3).astype(int)
        got = np.bincount(t, minlength=c + 1)[1:] / n
        assert np.abs(got - want).sum() < 0.02, (c, got, want)


def test_seating_of_many_customers_follows_the_exact_conditional():
    n = 4_000
    for exact, (c, base, others, d) in [(e, x) for e in (20, pitman_yor.EXACT) for x in ((65, 0.05, 30, 0.6), (200, 0.02, 100, 0.6), (1000, 0.01, 1000, 0.5), (600, 0.5, 9000, 0.5), (1000, 0.3, 3, 0.05), (700, 0.2, 400, 0.95))]:
        t = np.arange(1, c + 1)
        want = pitman_yor.log_stirling(c, d)[c, 1 : c + 1] + t * np.log(base) + np.cumsum(np.log(pitman_yor.CONCENTRATION + d * (others + t - 1)))
        want = np.exp(want - want.max())
        want /= want.sum()
        f = lambda x: np.full(n, float(x))
        with pytest.MonkeyPatch.context() as m:
            m.setattr(pitman_yor, "EXACT", exact)
            got = pitman_yor.gibbs(f(c), f(base), f(others), d, pitman_yor.CONCENTRATION, pitman_yor.mix(np.arange(n).astype(np.uint64)), 3).astype(int)
        assert abs(got.mean() - (want * t).sum()) < 0.06 * np.sqrt((want * t * t).sum() - (want * t).sum() ** 2) + 1e-9, (c, d, exact)
        assert np.abs(np.bincount(got, minlength=c + 1)[1:] / n - want).sum() / 2 < 0.06, (c, d, exact)


def test_stirling_numbers_at_any_size():
    for d in (0.05, 0.5, 0.8, 0.95):
        table = pitman_yor.log_stirling(1200, d)
        for c in (70, 600, 1200):
            t = np.arange(1, c)
            assert np.abs(pitman_yor.log_stirling_at(np.full(len(t), c), t, d) - table[c, t]).max() < 5e-3, (c, d)
    # one table has the product of 1 - d, 2 - d, ... however many sit there
    many = np.array([10**5, 10**7])
    want = [np.log(np.arange(1, c) - 0.6).sum() for c in many]
    assert pitman_yor.log_stirling_at(many, np.ones(2), 0.6) == pytest.approx(want, abs=1e-2)


def test_contexts_over_all_blocks_equal_one_restaurant(spark, monkeypatch):
    """A dozen tokens: counts, tables of the first state and scores against plain Python, however the texts lie in blocks."""
    from pyspark.sql import functions as F

    texts = {1: "a b a b", 2: "a b c", 3: "b a", 4: "a c", 5: "", 6: "a b d"}
    rows = [(i, t, "s") for i, t in texts.items()]
    training = F.col("doc_id") < 5
    out = []
    for parts, size in ((1, 10**6), (4, 3)):
        monkeypatch.setattr(pitman_yor, "BLOCK_TOKENS", size)
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        out.append({r.doc_id: (r.n_tokens, r.n_known, r.score) for r in pitman_yor.score(docs, training).collect()})
        of_blocks = pitman_yor.blocks(docs, training)
        vocab = sh.stored(pitman_yor.vocabulary(of_blocks, 3), "v")
        assert {r.word: r.c for r in vocab.collect()} == {"a": 5, "b": 4, "c": 2, "": 4, "d": 0}
        answers = sh.stored(pitman_yor.pair_counts(of_blocks, 3), "p")
        first = sh.stored(pitman_yor.first_tables(of_blocks, answers, vocab, 3), "f")
        seated = {r.word: r for r in pitman_yor.seated_contexts(of_blocks, answers.unionByName(first), vocab, 3, 15, 0.5).collect()}
        pairs = Counter(p for i, t in texts.items() if i < 5 for p in zip(["", *t.split()], [*t.split(), ""], strict=True))
        for w, r in seated.items():
            kinds, heads = ([p for p in pairs if p[k] == w] for k in (0, 1))
            assert len(kinds) <= r.t <= sum(pairs[p] for p in kinds) and len(heads) <= r.k <= sum(pairs[p] for p in heads)
        assert sum(r.t for r in seated.values()) == sum(r.k for r in seated.values())
    assert set(out[0]) == set(out[1]) == set(texts)
    for i in texts:
        assert out[0][i][:2] == out[1][i][:2] and out[0][i][2] == pytest.approx(out[1][i][2])


def test_word_order_counts(spark):
    rng = random.Random(13)
    follows = {w: rng.sample(WORDS, 2) for w in WORDS}
    docs = {}
    for i in range(300):
        ws = [rng.choice(WORDS)]
        while len(ws) < 40:
            ws.append(rng.choice(follows[ws[-1]]))
        docs[i] = " ".join(ws)
    held = [i for i in docs if zlib.crc32(str(i).encode()) % 10 == 0]
    mixed = {}
    for i in held:
        for j in range(1000, 10**6):
            if j not in mixed and j % 300 == i and zlib.crc32(str(j).encode()) % 10 == 0:
                mixed[j] = " ".join(rng.sample(docs[i].split(" "), 40))
                break
    got = {r.doc_id: r.score for r in pitman_yor.score(frame(spark, docs | mixed)).collect()}
    assert all(got[i] > got[j] + 10 for j in mixed for i in [j % 300])


def toxic_corpus(seed):
    rng = random.Random(seed)
    docs, toxic = {}, {}
    for i in range(600):
        ws = rng.choices(WORDS, k=rng.randint(20, 120))
        toxic[i] = int(rng.random() < 0.2)
        if toxic[i]:
            for _ in range(rng.randint(3, 8)):
                ws.insert(rng.randrange(len(ws)), rng.choice(["grumk", "vlaster"]) + rng.choice(["", "in", "ed", "!"]))
        docs[i] = " ".join(ws)
    return docs, toxic


def test_toxic_documents_and_spans(spark):
    docs, toxic = toxic_corpus(1)
    d = frame(spark, docs)
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    model = toxicity.trained(d, labels.where("doc_id % 2 = 0"))
    got = toxicity.score(d, model, spans=True).collect()
    wrong = [r.doc_id for r in got if r.doc_id % 2 and (r.score >= 0.7) != bool(toxic[r.doc_id])]
    assert len(wrong) <= 6
    hits = [docs[r.doc_id].encode()[s.start : s.end] for r in got for s in r.spans]
    assert sum(x.startswith((b"grumk", b"vlast")) for x in hits) > 0.95 * len(hits) > 100


def test_marginals_are_exact():
    rng = np.random.default_rng(2)
    e, trans = rng.normal(size=7) * 2, np.array([[0.0, -0.7], [0.0, 0.9]])
    p, both, _ = toxicity.Chains(np.array([0, 4]), 7).marginals(e, trans)
    for a, z in ((0, 4), (4, 7)):
        total, one, two = 0.0, np.zeros(z - a), np.zeros(z - a)
        for bits in range(1 << (z - a)):
            y = [(bits >> k) & 1 for k in range(z - a)]
            w = np.exp(sum(e[a + k] * y[k] for k in range(z - a)) + sum(trans[y[k - 1], y[k]] for k in range(1, z - a)))
            total += w
            one += w * np.array(y)
            two[1:] += w * np.array([y[k - 1] * y[k] for k in range(1, z - a)])
        assert np.allclose(p[a:z], one / total) and np.allclose(both[a + 1 : z], two[1:] / total)


def test_texts_longer_than_a_pass(spark):
    """One text of 1.4 MiB, over a pass, with passages that repeat across the cut and in another document."""
    rng = random.Random(31)
    passage = " ".join(rng.choices(WORDS, k=60))
    parts = [" ".join(str(rng.getrandbits(40)) for _ in range(40_000)) for _ in range(3)]
    long = f"{parts[0]} {passage}\n{parts[1]}\n{passage} {parts[2]}"
    docs = {1: long, 2: f"other words first {passage} and last", 3: long[: 1 << 20] + " tail"}
    assert len(long) > 1.3 * (1 << 20)
    seen, want = set(), {}
    for i, t in docs.items():
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            w = hash(b[p : p + 100])
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        want[i] = int(gone.sum())
    d = frame(spark, docs)
    got = {r.doc_id: len(docs[r.doc_id].encode()) - len(r.kept) for r in suffix_dedup.deduplicate(d).collect()}
    assert got == want and want[1] >= len(passage) and want[2] >= len(passage) and want[3] > 1_000_000
    scores = {r.doc_id: r for r in pitman_yor.score(d).collect()}
    assert {i: r.n_tokens for i, r in scores.items()} == {i: len(tokens(t)) + 1 for i, t in docs.items()}
    sets = {r.doc_id: r.n_shingles for r in ngram_join.components(d).collect()}
    assert sets == {i: len({tuple(w[j : j + 4]) for j in range(len(w) - 3)}) for i, w in ((i, tokens(t)) for i, t in docs.items())}
    lines = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(d).collect()}
    assert lines[1] == (3, 0) and lines[3][0] == docs[3].count("\n") + 1


def test_contexts_are_seated_in_every_sweep(spark, monkeypatch):
    """Context restaurants move with the word restaurant: how a pair sits, and the words' probabilities, change from sample to sample, and these add up to 1."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(pitman_yor, "BLOCK_TOKENS", 400)
    of_blocks = pitman_yor.blocks(frame(spark, corpus(14, 60)).repartition(3), sh.crc_mod(F.col("doc_id"), 10) != 0)
    assert of_blocks.count() >= 3
    vocab = sh.stored(pitman_yor.vocabulary(of_blocks, 3), "v")
    of_pairs = sh.stored(pitman_yor.pair_counts(of_blocks, 3), "p")
    of_seats = sh.stored(pitman_yor.seats(of_blocks, of_pairs, 3), "s")
    samples, state = pitman_yor.sampled(of_seats, vocab, 3, 0.5, len(sh.WORK))
    known = {r.h: r.c for r in vocab.collect()}
    assert any(known.values())
    seen = []
    for sample in samples:
        p, tables, rows = {}, {}, sample.collect()
        keys = {r.block: pitman_yor.unpacked(r.vocab, np.uint64, True) for r in of_blocks.collect()}
        for r in rows:
            cuts = pitman_yor._cuts(keys[r.block], 3)
            part = keys[r.block][cuts[r.bucket] : cuts[r.bucket + 1]].view(np.int64).tolist()
            p.update(zip(part, pitman_yor.unpacked(r.b, np.float32).tolist(), strict=True))
            tables.update(zip(part, pitman_yor.unpacked(r.a, np.int64).tolist(), strict=True))
        unseen = {p[h] for h in p if not known[h]} or {0.0}
        assert len(p) == len(known) and sum(p[h] for h in p if known[h]) + max(unseen) == pytest.approx(1.0, abs=1e-4)
        seen.append((p, tables))
    assert seen[0][1] != seen[1][1] != seen[2][1] and seen[0][0] != seen[1][0] != seen[2][0]
    # every block is told its owner's tables of pairs that it shares, and these are as many in all blocks
    told = of_pairs.unionByName(state)
    got = told.unionByName(pitman_yor.shared_tables(of_blocks, told, 3)).collect()
    sums: dict[int, set[int]] = {}
    for r in of_blocks.collect():
        row = of_blocks.where(F.col("block") == r.block).toArrow()
        answers = pitman_yor._rows([tuple(x) for x in got if x.block == r.block], pitman_yor.ANSWER, pitman_yor._ANSWER_TYPES)
        pairs = pitman_yor.Pairs.found(pitman_yor.Block.read(row))
        c, shared, total = pitman_yor._told_pairs(pairs, answers, 3)
        had = total[shared]
        [total[shared]] = pitman_yor._answers(answers, pitman_yor.OF_SHARED, pairs.keys[shared], 3, np.int64)
        assert (total[shared] >= pitman_yor.SAMPLES).all() and (total[shared] <= pitman_yor.SAMPLES * c[shared]).all()
        assert (total[shared][had > 0] == had[had > 0]).all()
        for k, t in zip(pairs.keys[shared].tolist(), total[shared].tolist(), strict=True):
            sums.setdefault(k, set()).add(t)
    assert sums and all(len(x) == 1 for x in sums.values())
