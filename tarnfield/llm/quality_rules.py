"""Quality by weak supervision: rules vote good, bad or abstain, and expectation-maximisation weighs them.

Every rule casts +1, -1 or 0 on a document from counts of its whole text. The
votes of all documents are counted by pattern (at most 3**rules patterns, so the
table that the driver fits on has a bound that does not depend on the input).
Expectation-maximisation of a model with independent rules gives each rule's
accuracy on good and on bad documents, without labels; a document's quality is
the posterior probability of good given its votes.

The counts: words are `[^\\x20\\x09-\\x0D]+`, lines are split at \\n.

Defined results: a null or empty text has zero of everything and fails the base
rules. Every row is judged on its own, so repeated rows get equal verdicts. An
empty table gives an empty result. Extra columns are ignored. A rule that no document
moves keeps its prior accuracy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.shared import BASE_INV, mix, powers, prefix_hash, rolled, stored, tidy, words

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MARKS = b".!?:;\"'"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ends", "n_alpha", "n_digits", "n_long")


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


IS_SYMBOL, IS_MARK = _flags(SYMBOLS), _flags(MARKS)
IS_DIGIT = _flags(b"0123456789")
IS_LETTER = np.zeros(256, bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[0x80:] = True
IS_LEAD = np.ones(256, bool)
IS_LEAD[0x80:0xC0] = False


def _measure(texts: pa.Array) -> dict[str, np.ndarray]:
    out: dict[str, list] = {c: [] for c in COUNTS}
    for w in words(texts, lower=False):
        n, b = w.n_docs, w.bounds
        first = np.concatenate([[0], np.cumsum(w.counts)])

        def per_doc(mask: np.ndarray, b=b) -> np.ndarray:
            s = np.zeros(len(mask) + 1, np.int64)
            np.cumsum(mask, out=s[1:])
            return s[b[1:]] - s[b[:-1]]

        lead = np.zeros(len(w.data) + 1, np.int64)
        np.cumsum(IS_LEAD[w.data], out=lead[1:])
        chars = lead[w.end] - lead[w.start]
        letters = np.zeros(len(w.data) + 1, np.int64)
        np.cumsum(IS_LETTER[w.data], out=letters[1:])
        of = w.doc
        out["n_words"].append(w.counts)
        out["word_chars"].append(np.bincount(of, chars, n).astype(np.int64))
        out["n_symbols"].append(per_doc(IS_SYMBOL[w.data]))
        out["n_alpha"].append(np.bincount(of, letters[w.end] > letters[w.start], n).astype(np.int64))
        out["n_digits"].append(per_doc(IS_DIGIT[w.data]))
        out["n_long"].append(np.bincount(of, chars > 30, n).astype(np.int64))
        # lines with a word: the words between two line ends, compared by all their bytes
        line = np.cumsum(w.data == 10)
        key = line[w.start] + of  # both only rise, so the sum changes with either
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        ends = np.concatenate([begin[1:], [len(key)]]).astype(np.int64) if len(begin) else begin
        line_doc = of[begin]
        out["n_lines"].append(np.bincount(line_doc, minlength=n))
        out["n_ends"].append(np.bincount(line_doc, IS_MARK[w.data[w.end[ends - 1] - 1]], n).astype(np.int64) if len(begin) else np.zeros(n, np.int64))
        out["n_dup_lines"].append(_dup_lines(w, begin, line_doc))
        h, at = rolled(w.hash, of, WINDOW)
        rep = np.zeros(len(w.hash) + 1, np.int64)
        if len(h):
            order = np.lexsort((h, of[at]))
            same = (h[order][1:] == h[order][:-1]) & (of[at][order][1:] == of[at][order][:-1])
            twice = np.zeros(len(h), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            np.add.at(rep, at[twice], 1)
            np.add.at(rep, at[twice] + WINDOW, -1)
        covered = np.cumsum(rep[:-1]) > 0 if len(w.hash) else np.zeros(0, bool)
        out["n_repeat_words"].append(np.bincount(of, covered, n).astype(np.int64))
    return {c: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for c, v in out.items()}


def _dup_lines(w, begin: np.ndarray, line_doc: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text, all bytes between the line ends compared."""
    if not len(begin):
        return np.zeros(w.n_docs, np.int64)
    breaks = np.flatnonzero(w.data == 10)
    a, z = w.bounds[line_doc], w.bounds[line_doc + 1] - 1
    at = np.searchsorted(breaks, w.start[begin])
    low = np.maximum(np.where(at > 0, breaks[at - 1] + 1 if len(breaks) else 0, 0), a)
    high = np.minimum(np.where(at < len(breaks), breaks[np.minimum(at, max(len(breaks) - 1, 0))] if len(breaks) else z, z), z)
    sums = prefix_hash(w.data)
    h = mix((sums[high] - sums[low]) * powers(BASE_INV, len(w.data) + 1)[low]) ^ mix((high - low).astype(np.uint64))
    order = np.lexsort((h, line_doc))
    same = (h[order][1:] == h[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    return np.bincount(line_doc[order[1:]][same], minlength=w.n_docs)


def measured(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and the counts of every row's whole text."""
    docs = documents.select(*keep, "text")
    schema = docs.drop("text").schema
    for c in COUNTS:
        schema = schema.add(c, "long")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = _measure(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(got[c]) for c in COUNTS]], names=[*keep, *COUNTS])

    return docs.mapInArrow(run, schema)


def votes() -> dict[str, Column]:
    """The rules. Ratios are over words or lines. Two rules can speak for a text; the others speak
    against one with a defect and abstain elsewhere. A text without words is bad by every rule."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    against = {
        "word_length": ~(F.col("word_chars") / n).between(2.0, 12.0),
        "symbols": F.col("n_symbols") > 0.1 * n,
        "repeated_lines": F.col("n_dup_lines") > 0.3 * lines,
        "repeated_words": F.col("n_repeat_words") > 0.25 * n,
        "letters": F.col("n_alpha") < 0.7 * n,
        "digits": F.col("n_digits") > 0.2 * F.col("word_chars"),
        "long_words": F.col("n_long") > 0.02 * n,
    }
    rules = {k: F.when(v, -1).otherwise(0) for k, v in against.items()}
    rules["length"] = F.when(F.col("n_words") >= 50, 1).when(F.col("n_words") >= 20, 0).otherwise(-1)
    rules["endings"] = F.when(F.col("n_ends") >= 0.5 * lines, 1).when(F.col("n_ends") >= 0.1 * lines, 0).otherwise(-1)
    return {k: F.when(F.col("n_words") == 0, -1).otherwise(v).cast("int") for k, v in rules.items()}


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, prior: float = 0.9, strength: tuple[float, float] = (0.01, 1.0)) -> tuple[np.ndarray, float, np.ndarray]:
    """(posterior of good by pattern, share of good, table[class, rule, vote+1]) of the independent-rules model.

    Starts from rules whose bad votes are rare on good documents and whose good votes say little, as
    one defect leaves the other rules content; pseudo-documents (`strength` times the
    documents, for the bad and the good class) hold each rule to that start, so a rule's direction can't be swapped and rules without votes stay put.
    """
    m = patterns.shape[1]
    start = np.zeros((2, m, 3))
    speaks_for = (patterns == 1).any(0)
    start[1] = np.where(speaks_for[:, None], [0.001, 0.199, 0.8], [0.001, 0.994, 0.005])
    start[0] = np.where(speaks_for[:, None], [0.3, 0.2, 0.5], [0.3, 0.695, 0.005])
    table, share = start.copy(), prior
    weight = counts.astype(float)
    held = [x * max(weight.sum(), 1.0) for x in strength]
    post = np.full(len(patterns), prior)
    for _ in range(rounds):
        logs = [np.log(s) + sum(np.log(table[c, j, patterns[:, j] + 1]) for j in range(m)) for c, s in ((0, 1 - share), (1, share))]
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
        for c, r in ((0, 1 - new), (1, new)):
            for v in range(3):
                table[c, :, v] = ((patterns == v - 1) * (weight * r)[:, None]).sum(0) + held[c] * start[c, :, v]
            table[c] /= table[c].sum(1, keepdims=True)
        share = float(np.clip(((weight * new).sum() + held[1] * prior) / (weight.sum() + held[1]), 0.01, 0.99))
        done = np.abs(new - post).max(initial=0.0) < 1e-9
        post = new
        if done:
            break
    return post, share, table


def verdicts(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, quality (posterior of good) and kept."""
    names = list(votes())
    voted = stored(measured(documents).select("*", *[v.alias(f"vote_{k}") for k, v in votes().items()]), "votes")
    vote_cols = [f"vote_{k}" for k in names]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    # documents that the base rules decide say nothing about the rest
    table = voted.where(~failed).groupBy(*vote_cols).count().toPandas()  # at most 3**9 rows
    post, _, _ = expectation_maximisation(table[vote_cols].to_numpy(int).reshape(-1, len(names)), table["count"].to_numpy())
    spark = documents.sparkSession
    code = lambda f: sum((f(c) + 1) * 3**i for i, c in enumerate(vote_cols))
    rows = [(int(c), float(p)) for c, p in zip(code(lambda c: table[c]), post, strict=True)] if len(table) else []
    posterior = spark.createDataFrame(rows, "pattern long, quality double")
    out = voted.withColumn("pattern", code(F.col).cast("long")).join(F.broadcast(posterior), "pattern", "left")
    kept = ~failed & F.coalesce(F.col("quality") >= threshold, F.lit(False))
    return out.select("doc_id", *COUNTS, failed.alias("base_failed"), "quality", kept.alias("kept"))
