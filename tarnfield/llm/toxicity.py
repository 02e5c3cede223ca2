"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Training. The labels are of documents, so tokens are labelled first: a token of a
toxic document is toxic if one of its features (the word, or its first four to eight
bytes) is all but confined to toxic documents of the training rows. On
these labelled tokens a chain with tags clean and toxic is trained by Adagrad on
the exact log-likelihood, gradients from forward-backward marginals; a line is a
chain. Emission weights live in a hashed table of FEATURES cells, so the model
has a fixed size. Document scores come from the sum, the largest and the density of
the tags' marginals by a logistic regression on the same rows, shifted from the
sample's to the labels' share of toxic documents.

The model is fitted on a bounded sample: at most SAMPLE_DOCS rows of either label,
those with the smallest md5 of the id. Scoring covers every word of every text.
Inputs are the text alone.

Defined results: a null or empty text has no tokens and gets the score of no
evidence; labels that are null are left out, and a document labelled twice is
toxic if any label says so. Without a toxic or a clean training row every score
is the known share. Rows are scored one by one, so repeated rows agree. Extra
columns are ignored by `score` and kept by `reject_toxic`.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfield.llm.shared import BASE_INV, Words, crc_mod, mix, powers, prefix_hash, tidy, words

FEATURES = 1 << 20
SAMPLE_DOCS = 2500
PREFIXES = (4, 5, 6, 7, 8)
#: A feature is toxic from so many toxic texts, so many times the clean texts' share, and so many standard errors.
SUPPORT, RATIO, SIGMAS = 4, 5.0, 4.0
#: Gradient steps at least, one for each pass over a stretch of the sample.
STEPS, RATE, DECAY = 64, 0.3, 1e-5
SPAN_THRESHOLD = 0.5
#: Features of a document that its tags give.
EVIDENCE = 7


def features(w: Words) -> np.ndarray:
    """Cells of each token's features: the word and its first bytes; a shorter word has itself again."""
    sums, inv = prefix_hash(w.data), powers(BASE_INV, len(w.data) + 1)
    start, end = w.start, w.end
    # punctuation at the ends is not part of the word
    letter = np.ones(256, bool)
    letter[:128] = False
    letter[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
    at = np.flatnonzero(letter[w.data])
    if len(at):
        first = at[np.minimum(np.searchsorted(at, start), len(at) - 1)]
        last = at[np.maximum(np.searchsorted(at, end) - 1, 0)] + 1
        has = (first >= start) & (first < end)
        start, end = np.where(has, first, start), np.where(has, last, end)
    out = np.empty((len(start), 1 + len(PREFIXES)), np.int32)
    for j, k in enumerate((None, *PREFIXES)):
        stop = end if k is None else np.minimum(start + k, end)
        h = mix((sums[stop] - sums[start]) * inv[start] + np.uint64(j + 1))
        out[:, j] = (h % np.uint64(FEATURES)).astype(np.int32)
    return out


def lines(w: Words) -> np.ndarray:
    """Where each line's tokens begin: a line is a chain."""
    if not len(w.start):
        return np.zeros(0, np.int64)
    key = np.cumsum(w.data == 10)[w.start] + w.doc
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


class Chains:
    """Chains laid side by side, longest first, so that a step is one vector operation."""

    def __init__(self, begin: np.ndarray, n: int):
        size = np.diff(np.append(begin, n))
        order = np.argsort(-size, kind="stable")
        self.begin, self.size = begin[order], size[order]
        longest = int(self.size[0]) if len(size) else 0
        # chains that reach step t are the first active[t]
        self.active = np.searchsorted(-self.size, -np.arange(1, longest + 1), "right")

    def marginals(self, e: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(tag is toxic) of each token, and P(toxic, toxic) and P(clean, toxic) of each token and the one before."""
        a = np.exp(trans)
        odds = np.exp(np.clip(e, -30, 30))
        f, b = np.empty(len(e)), np.ones(len(e))
        for t, k in enumerate(self.active):
            at = self.begin[:k] + t
            if t:
                r = f[at - 1]
                f[at] = odds[at] * (a[0, 1] + r * a[1, 1]) / (a[0, 0] + r * a[1, 0])
            else:
                f[at] = odds[at]
        for t in range(len(self.active) - 2, -1, -1):
            at = self.begin[: self.active[t + 1]] + t
            x = odds[at + 1] * b[at + 1]
            b[at] = (a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x)
        p = f * b / (1 + f * b)
        has = np.ones(len(e), bool)
        has[self.begin] = False
        at = np.flatnonzero(has)
        r, x = f[at - 1], odds[at] * b[at]
        z = a[0, 0] + a[0, 1] * x + r * (a[1, 0] + a[1, 1] * x)
        both, rise = np.zeros(len(e)), np.zeros(len(e))
        both[at], rise[at] = r * a[1, 1] * x / z, a[0, 1] * x / z
        return p, both, rise


@dataclass
class Model:
    weights: np.ndarray  # of FEATURES cells, then the bias; single precision
    trans: np.ndarray
    evidence: np.ndarray  # logistic weights of what evidence() gives
    share: float

    def tags(self, w: Words) -> np.ndarray:
        if not len(w.start):
            return np.zeros(0)
        e = self.weights[features(w)].sum(1) + self.weights[-1]
        return Chains(lines(w), len(e)).marginals(e, self.trans)[0]

    def documents(self, w: Words, tags: np.ndarray) -> np.ndarray:
        x = evidence(tags, w)
        return 1 / (1 + np.exp(-np.clip(x @ self.evidence, -50, 50)))


def evidence(p: np.ndarray, w: Words) -> np.ndarray:
    top, total = np.zeros(w.n_docs), np.bincount(w.doc, p, w.n_docs)
    np.maximum.at(top, w.doc, p)
    n = np.maximum(w.counts, 1)
    return np.stack([np.ones(w.n_docs), top, np.log1p(total), np.minimum(total, 30), total / np.sqrt(n), 100 * total / (n + 100), np.log1p(n)], 1)


def token_labels(passes: list[tuple[Words, np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Labels of tokens from (words, features, toxic by text): pure features mark the tokens of toxic texts."""
    seen = np.zeros((2, FEATURES), np.float32)
    for w, f, toxic in passes:
        for j in range(f.shape[1]):
            pair = np.unique(w.doc.astype(np.int64) * FEATURES + f[:, j])
            doc, cell = pair // FEATURES, pair % FEATURES
            for y in (0, 1):
                seen[y] += np.bincount(cell[toxic[doc] == y], minlength=FEATURES)
    n = [max(sum(int((t == y).sum()) for _, _, t in passes), 1) for y in (0, 1)]
    expected = (seen[0] + 0.5) / n[0] * n[1]  # toxic texts that would hold it at the clean texts' share
    pure = (seen[1] >= SUPPORT) & (seen[1] >= RATIO * expected) & (seen[1] >= expected + SIGMAS * np.sqrt(expected))
    return [pure[f].any(1) & (toxic[w.doc] == 1) for w, f, toxic in passes], pure


def fit(texts: pa.Array, toxic: np.ndarray, share: float) -> Model:
    """Fits the chain and the document scores on texts labelled 0 or 1; share: of toxic documents among all labels."""
    weights = np.zeros(FEATURES + 1)
    weights[-1] = -4.0
    trans, grads, tgrads = np.zeros((2, 2)), np.full(FEATURES + 1, 1e-3), np.full((2, 2), 1e-3)
    logit = float(np.log(max(share, 1e-4) / max(1 - share, 1e-4)))
    if len(set(toxic.tolist())) < 2:
        return Model(weights, trans, np.array([logit, *[0.0] * (EVIDENCE - 1)]), share)
    passes = [(w, features(w), toxic[w.first : w.first + w.n_docs]) for w in words(texts)]
    labels, _ = token_labels(passes)
    laid = [Chains(lines(w), len(w.start)) for w, _, _ in passes]
    for _ in range(-(-STEPS // max(len(passes), 1))):
        for (_w, f, _), y, chains in zip(passes, labels, laid, strict=True):
            if not len(f):
                continue
            p, both, rise = chains.marginals(weights[f].sum(1) + weights[-1], trans)
            g = y - p
            grad = np.bincount(f.ravel(), np.repeat(g, f.shape[1]), FEATURES + 1) / len(chains.size)
            grad[-1] = g.sum() / len(chains.size)
            grad -= DECAY * weights
            grads += grad**2
            weights += RATE * grad / np.sqrt(grads)
            prev = np.append(False, y[:-1])
            first = np.zeros(len(y), bool)
            first[chains.begin] = True
            tg = np.array([[0.0, ((~prev & y & ~first) - rise).sum()], [0.0, ((prev & y & ~first) - both).sum()]]) / len(chains.size)
            tgrads += tg**2
            trans += RATE * tg / np.sqrt(tgrads)
    model = Model(weights, trans, np.zeros(EVIDENCE), share)
    x = np.concatenate([evidence(model.tags(w), w) for w, _, _ in passes])
    beta = np.zeros(EVIDENCE)
    ridge = np.diag([1e-3, *[0.05] * (EVIDENCE - 1)])
    for _ in range(30):  # Newton's method
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta += np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + ridge, x.T @ (toxic - q) - ridge @ beta)
    inside = toxic.mean()
    beta[0] += logit - np.log(inside / (1 - inside))
    model.evidence = beta
    model.weights = weights.astype(np.float32)
    return model


def trained(documents: DataFrame, labels: DataFrame) -> Model:
    """A model from the documents that labels (doc_id, toxic) name."""
    told = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    counts = {r.y: r["count"] for r in told.groupBy("y").count().collect()}
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    sample = None
    for y in (0, 1):
        part = told.where(F.col("y") == y).orderBy(order, "doc_id").limit(SAMPLE_DOCS)
        sample = part if sample is None else sample.unionByName(part)
    # at most 2 * SAMPLE_DOCS rows, fitted in one task; the driver gets the model alone
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.lit(0).alias("all"), "doc_id", "text", F.col("y").cast("long").alias("y"))

    @tidy
    def run(told: pa.Table) -> pa.Table:
        told = told.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        model = fit(told.column("text").cast(pa.large_string()), told.column("y").to_numpy(), share)
        return pa.table([pa.array([pickle.dumps(model)])], names=["model"])

    got = rows.groupBy("all").applyInArrow(run, "model binary").first()
    return pickle.loads(bytes(got.model)) if got else fit(pa.array([], pa.large_string()), np.zeros(0, np.int64), share)


def _runs(w: Words, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(runs in each text, first byte and end of each run) of adjacent tokens that are on, as offsets within the text."""
    at = np.flatnonzero(on)
    doc = w.doc[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
    last = np.append(new[1:], True)[: len(at)]
    base = w.bounds[doc[new]]
    return np.bincount(doc[new], minlength=w.n_docs), w.start[at[new]] - base, w.end[at[last]] - base


def score(documents: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), spans: bool = False) -> DataFrame:
    """The columns `keep` with score and, if asked for, spans: byte offsets of the runs of toxic tokens in the UTF-8 text."""
    docs = documents.select(*keep, "text")
    schema = docs.drop("text").schema.add("score", "double")
    if spans:
        schema = schema.add("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long")))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES cells, whatever the input

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            out, runs = [], []
            for w in words(batch.column(len(keep))):
                tags = m.tags(w)
                out.append(m.documents(w, tags))
                if spans:
                    runs.append(_runs(w, tags >= SPAN_THRESHOLD))
            cols = [*batch.columns[: len(keep)], pa.array(np.concatenate(out) if out else np.zeros(0))]
            if spans:
                n, start, end = (np.concatenate(x) for x in zip(*runs, strict=True)) if runs else (np.zeros(0, np.int64),) * 3
                both = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], names=["start", "end"])
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), both))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.mapInArrow(run, schema)


def reject_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """documents, with the columns they had, whose score is below the threshold."""
    known = labels.where(crc_mod(F.col("doc_id"), 3) != 1)
    model = trained(documents, known)
    extra = [c for c in documents.columns if c != "text"]
    renamed = documents.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(extra)], F.col("text").alias("c_text"), "text")
    keep = tuple(f"c{i}" for i in range(len(extra))) + ("c_text",)
    names = dict(zip(extra, keep, strict=False)) | {"text": "c_text"}
    return score(renamed, model, keep).where(F.col("score") < threshold).select(*[F.col(names[c]).alias(c) for c in documents.columns])
