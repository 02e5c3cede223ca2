"""Whitening, periodic runs and byte-level tokens against plain versions."""

import base64
import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from tarnfield.llm import byte_bpe, entries, tandem_runs, whitening

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ whitening


def vectors(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").withColumn("n", F.lit("mine")).withColumn("a.b", F.col("vec_id"))


def plain(rows):
    x = [[int(np.floor(64 * c)) + 1000000 for c in r] for r in rows]
    n, dim = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(dim)]
    v = [[Fraction(sum(n * r[i] * r[j] for r in x) - s[i] * s[j], n * n) for j in range(dim)] for i in range(dim)]
    return [sum((n * r[i] - s[i]) ** 2 for i in range(dim)) for r in x], np.array([[float(c) for c in r] for r in v])


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e9])
def test_scatter_is_exact(spark, scale):
    rng = np.random.default_rng(4)
    rows = (rng.normal(0, scale, (300, 5)) + scale * 1000).tolist()
    deviation, v = plain(rows)
    out = whitening.whiten(vectors(spark, rows).repartition(3), count=5)
    assert out.columns == ["vec_id", "embedding", "a.b", "n", "deviation", "whitened", "explained", "identity_error"]
    got = sorted(out.collect(), key=lambda r: r.vec_id)
    assert [r.deviation for r in got] == [d if d < 1 << 63 else None for d in deviation]
    e = np.linalg.eigvalsh(v)[::-1]
    assert np.allclose(got[0].explained, e / np.trace(v), rtol=1e-9)
    w = np.array([r.whitened for r in got])
    assert abs(np.cov(w.T, bias=True) - np.eye(5)).max() < 1e-6 and got[0].identity_error < 1e-6


def test_cells_of_any_size():
    s = whitening.Scatter(2)
    big = np.array([[2**62, -(2**62)], [5, -7], [2**61 + 3, 2**40]], np.int64)
    s.add(big)
    b = big.astype(object)
    assert s.sums.tolist() == b.sum(0).tolist() and s.products.tolist() == (b.T @ b).tolist()
    for _, value in s.cells():
        assert sum(limb << whitening.CELL * place for place, limb in whitening._cut(value)) == value
    y = np.array([[3, 4], [2**40, 1]], np.int64)
    assert whitening.deviations(y, 10**12, [5, 6]).to_pylist() == [None, None]
    assert whitening.deviations(y[:1], 10**6, [5, 6]).to_pylist() == [(3 * 10**6 - 5) ** 2 + (4 * 10**6 - 6) ** 2]


def test_vectors_that_are_left_out(spark):
    good = [[0.5, 1.0], [0.25, -1.0], [2.0, 0.0], [2.0, 0.0]]
    bad = [None, [None, 1.0], [float("nan"), 1.0], [float("inf"), 0.0], [], [1.0, 2.0, 3.0]]
    got = whitening.whiten(vectors(spark, good + bad)).collect()
    assert sorted(r.vec_id for r in got) == [0, 1, 2, 3] and {r.n for r in got} == {4}
    assert whitening.whiten(vectors(spark, bad[:5])).collect() == []
    same = whitening.whiten(vectors(spark, [[1.0, 2.0]] * 3)).collect()
    assert all(r.deviation == 0 and r.whitened == [None, None] and r.identity_error == 0.0 for r in same)
    huge = whitening.whiten(vectors(spark, [[1e300, 0.0], [-1e300, 1.0], [0.0, 5.0]])).collect()
    assert {r.vec_id: r.deviation for r in huge} == {0: None, 1: None, 2: (3 * 320 - 384) ** 2}


def test_whitening_query(spark):
    got = entries.QUERIES["op12_whitening"](spark, SF)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    deviation, v = plain([list(map(float, r.embedding)) for r in rows])
    first = {r.vec_id: r for r in got.where("component = 1").collect()}
    assert [first[r.vec_id].deviation for r in rows] == deviation
    assert got.count() == len(rows) * 32 and abs(first[rows[0].vec_id].explained - np.linalg.eigvalsh(v)[-1] / np.trace(v)) < 1e-9


# ------------------------------------------------------------------ periodic runs


def plain_runs(s, least, times):
    out = []
    for q in range(1, len(s) // times + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            size, w = j - i + q, s[i : j + q]
            if j > i and size >= max(least, times * q) and not any(w[p:] == w[:-p] for p in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_a_plain_search():
    rng = np.random.default_rng(5)
    seen = 0
    for t in range(1500):
        n = int(rng.integers(2, 70))
        s = rng.integers(0, int(rng.integers(1, 4)), n)
        if t % 3 == 0:
            k, p = int(rng.integers(0, n)), int(rng.integers(1, 8))
            s[k:] = s[k + (np.arange(n - k) % p) % (n - k)]
        least, times = int(rng.integers(2, 9)), int(rng.integers(2, 4))
        want = plain_runs(s.tolist(), least, times)
        assert [tuple(r) for r in tandem_runs.runs(s, least, times).tolist()] == want
        seen += len(want)
    assert seen > 1000


def test_runs_in_texts(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(120):
        ws = [rng.choice("aé bc d".split() + [" x"]) for _ in range(rng.randrange(0, 200))]
        p = rng.randrange(1, 12)
        k = rng.randrange(0, len(ws) + 1)
        ws[k:] = (ws[k : k + p] * 300)[: len(ws) - k]
        texts.append(rng.choice([" ", "\n", " \t "]).join(ws))
    docs = spark.createDataFrame(list(enumerate(texts)), "`a.b` long, text string").repartition(3)
    for r in tandem_runs.periodic_runs(docs).collect():
        ws = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in texts[r["a.b"]]).split(" ") if w]
        want = plain_runs(ws, 24, 3)
        assert [tuple(x) for x in r.runs] == want and r.n_words == len(ws)
        gone = {i for start, size, q in want for i in range(start + q, start + size)}
        assert r.collapsed == " ".join(w for i, w in enumerate(ws) if i not in gone)


def test_long_run(spark):
    text = " ".join(f"w{i % 5000}" for i in range(60000))
    r = tandem_runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in r.runs] == [(0, 60000, 5000)] and len(r.collapsed.split()) == 5000


def test_runs_query(spark):
    got = {r.doc_id: r for r in entries.QUERIES["op11_tandem_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ws = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in d.text or "").split(" ") if w]
        n, h = len(ws), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            ws = [ws[a + (i - a) % p] if i >= a else ws[i] for i in range(n)]
        want, r = plain_runs(ws, 24, 3), got[d.doc_id]
        gone = {i for start, size, q in want for i in range(start + q, start + size)}
        assert r.n_runs == len(want)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(ws) if i not in gone).encode()).hexdigest()
        best = min(want, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if want else None)


# ------------------------------------------------------------------ byte-level tokens


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in byte_bpe.read(byte_bpe.VOCABULARY).splitlines())}
    return tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk, overlap", [(8, 5), (16, 8), (40, 20)])
def test_chunks_stitch_to_the_library_s_ids(spark, library, chunk, overlap):
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "'", "'s", "'re", "1", "٣", "é", "漢", "!", "\t", "\U000323b0", "՘", "xyz " * 3, "ab" * 20, "🙂", "\r\n", "\x1c", "　"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 120))) for _ in range(300)]
    texts += [None, "", "x" * 3000, "ab cd " * 500, "'" * 500, " " * 700, " " * 100 + "a", "a" * 11, "a" * 13]
    docs = spark.createDataFrame(list(enumerate(texts)), "`a.b` long, text string").withColumn("decoded", F.lit("mine")).repartition(4)
    out = byte_bpe.decode(byte_bpe.encode(docs, chunk=chunk, overlap=overlap)).collect()
    assert len(out) == len(texts)
    for r in out:
        text = texts[r["a.b"]] or ""
        assert list(r.token_ids) == library.encode_ordinary(text) and r.n_tokens == len(r.token_ids)
        assert bytes(r.decoded) == text.encode()


def test_long_pre_tokens(library):
    r = byte_bpe.Ranks(byte_bpe.read(byte_bpe.VOCABULARY), byte_bpe.PATTERN, byte_bpe.newer())
    rng = random.Random(2)
    for size in (65, 300, 5000):
        for letters in ("ab", "abcdefghij", "e"):
            piece = "".join(rng.choice(letters) for _ in range(size))
            for size in (64, len(piece)):
                assert np.frombuffer(r.merged([piece[:size].encode()])[0], np.int32).tolist() == library.encode_ordinary(piece[:size])


def test_token_query(spark, library):
    got = {r.doc_id: r for r in entries.QUERIES["op13_byte_bpe"](spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids, r = library.encode_ordinary(d.text or ""), got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
