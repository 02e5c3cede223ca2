"""What keyword and vector search share: keys of queries, who may see what, the best of a block, and places in a whole ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that one task scores at a time, and that one message to all tasks may hold.
QUERY_ROWS = 4096
#: Decimal places that scores are compared at: sums in any order compare alike.
PLACES, VECTOR_PLACES = 9, 6


def query_key(query_id: Column) -> Column:
    """An id of any type as text."""
    return F.to_json(F.struct(query_id.alias("query_id")))


def query_of(key: Column, queries: DataFrame) -> Column:
    """The id that a key was made of."""
    kind = queries.schema["query_id"].dataType.simpleString()
    return F.from_json(key, f"query_id {kind}")["query_id"]


def query_block(key: Column, queries: int) -> Column:
    """Which of the blocks of about QUERY_ROWS a query is in."""
    return F.pmod(F.xxhash64(key), F.lit(max(1, -(-queries // QUERY_ROWS)))).cast("int")


def kinds_of(facts: DataFrame) -> DataFrame:
    """pos, kind: a chunk's facts as one text."""
    about = [c for c in facts.columns if c != "pos"]
    return facts.select("pos", F.to_json(F.struct(*about)).alias("kind"))


def permitted(queries: DataFrame, facts: DataFrame, allowed: Column) -> DataFrame:
    """q, kinds: the kinds of chunks (distinct facts) that a query ranks."""
    about = [c for c in facts.columns if c != "pos"]
    kinds = facts.select(*about).distinct().withColumn("kind", F.to_json(F.struct(*about)))
    seen = queries.withColumn("q", query_key(F.col("query_id"))).join(kinds).where(allowed)
    return seen.groupBy("q").agg(F.collect_set("kind").alias("kinds"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The first k of each query by score, then position, with rank. Spark cuts each task's rows to k before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def visible(kinds: pa.Array | None, may: list[list[str] | None] | None, rows: int) -> np.ndarray | None:
    """Queries x chunks: whether a query ranks a chunk of that kind. A chunk without a kind is ranked by nobody."""
    if may is None or kinds is None:
        return None
    coded = kinds.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    number = {k: i for i, k in enumerate(coded.dictionary.to_pylist())}
    table = np.zeros((len(may), len(number) + 1), bool)
    for i, seen in enumerate(may):
        table[i, [number[k] for k in seen or [] if k in number]] = True
    return table[:, coded.indices.fill_null(len(number)).to_numpy(zero_copy_only=False).astype(int)] if rows else np.zeros((len(may), 0), bool)


def best(scores: np.ndarray, pos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, pos, score) of each query's best k in a block (queries x chunks, -inf where not ranked); ties by position."""
    order = np.argsort(pos, kind="stable")
    scores, pos = scores[:, order], pos[order]
    if scores.shape[1] > k:
        # ties with the k-th stay until the position decides among them
        edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        q, at = np.nonzero((scores >= edge[:, None]) & (scores > -np.inf))
    else:
        q, at = np.nonzero(scores > -np.inf)
    s = scores[q, at]
    order = np.lexsort((at, -s, q))
    q, at, s = q[order], at[order], s[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return q[place < k], pos[at[place < k]], s[place < k]


def before(scores: np.ndarray, pos: np.ndarray, q: np.ndarray, want_pos: np.ndarray, want_score: np.ndarray) -> np.ndarray:
    """How many chunks of a block come before each wanted (query, position, score)."""
    out = np.zeros(len(q), np.int64)
    for a in range(0, len(q), 1024):
        s, p = scores[q[a : a + 1024]], want_pos[a : a + 1024, None]
        w = want_score[a : a + 1024, None]
        out[a : a + 1024] = ((s > w) | ((s == w) & (pos[None, :] < p))).sum(1)
    return out


class Best:
    """The best k of each query so far."""

    def __init__(self, k: int):
        self.k, self.kept = k, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def add(self, pos: np.ndarray, scores: np.ndarray) -> None:
        q, p, s = (np.concatenate([x, y]) for x, y in zip(self.kept, best(scores, pos, self.k), strict=True))
        order = np.lexsort((p, -s, q))
        q, p, s = q[order], p[order], s[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, int)
        stay = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < self.k
        self.kept = q[stay], p[stay], s[stay]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.kept


class Before:
    """How many chunks come before each wanted one so far."""

    def __init__(self, q: np.ndarray, pos: np.ndarray, score: np.ndarray):
        self.q, self.pos, self.score, self.n = q, pos, score, np.zeros(len(q), np.int64)

    def add(self, pos: np.ndarray, scores: np.ndarray) -> None:
        self.n += before(scores, pos, self.q, self.pos, self.score)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.q, self.pos, self.n.astype(float)
