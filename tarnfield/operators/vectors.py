"""Exact vector search: blocks of queries against blocks of chunks.

A query set that fits one block is sent to the tasks, which score the chunks where they lie. A larger one is dealt into
blocks of QUERY_ROWS, the chunks into blocks of TILE_ROWS, and each pair of blocks is one product in one task, so neither
side is ever whole in one place. Every product keeps each query's best k, which are merged by query.

A vector that is null, has a null entry, or has no direction (all zeros) is left out, as a chunk and as a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.operators import ranking
from tarnfield.operators.ranking import VECTOR_PLACES, Before, Best, kinds_of, permitted, query_block, query_key, query_of, top_k, visible

#: Chunks of one block of a tiled product, and of one matrix product.
TILE_ROWS, PRODUCT_ROWS = 16384, 256
FOUND = "q string, pos long, score double"


def unit(v: Column) -> Column:
    """v over its Euclidean length, in double."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / length)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def directed(v: Column) -> Column:
    """Whether a vector has a direction: no nulls, and an entry that is not zero."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull()) & F.exists(v, lambda x: x != 0)


def units(v: pa.Array) -> np.ndarray:
    """Rows over their lengths; all of them are directed."""
    x = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1) if len(v) else np.zeros((0, 1))
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _product(chunks: pa.RecordBatch, names: list[str], asked: np.ndarray, may: list | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, queries x chunks) of PRODUCT_ROWS chunks at a time."""
    for a in range(0, len(chunks) if len(asked) else 0, PRODUCT_ROWS):
        part = chunks.slice(a, PRODUCT_ROWS)
        s = np.round(asked @ units(part.column(names.index("v"))).T, VECTOR_PLACES)
        seen = visible(part.column(names.index("kind")), may, len(part)) if may is not None else None
        yield part.column(names.index("pos")).to_numpy(), s if seen is None else np.where(seen, s, -np.inf)


def _over(asks: DataFrame, chunks: DataFrame, n: int, filtered: bool, make: Callable[[pa.Table], object]) -> DataFrame:
    """q, pos, score that make(asks).rows() gives after it was shown the scores of all chunks (pos, v, kind) for its queries (q, v, kinds, ..)."""
    names = chunks.columns

    def of(told: pa.Table) -> tuple:
        told = told.combine_chunks()
        one = lambda c: pa.concat_arrays(told.column(c).chunks or [pa.array([], told.schema.field(c).type)])
        return one("q"), units(one("v")), one("kinds").to_pylist() if filtered else None, make(told)

    def batch_of(q: pa.Array, rows: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([q.take(pa.array(rows[0])).cast(pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.float64())], names=["q", "pos", "score"])

    if n <= ranking.QUERY_ROWS:
        told = asks.toArrow()  # QUERY_ROWS at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, asked, may, keep = of(told)
            for batch in batches:
                for pos, s in _product(batch, names, asked, may):
                    keep.add(pos, s)
            yield batch_of(q, keep.rows())

        return chunks.mapInArrow(run, FOUND)

    tiles = max(1, -(-chunks.count() // TILE_ROWS))
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    left = chunks.withColumn("tile", F.pmod(F.xxhash64("pos"), F.lit(tiles)).cast("int")).withColumn("qb", every(-(-n // ranking.QUERY_ROWS)))
    right = asks.withColumn("qb", query_block(F.col("q"), n)).withColumn("tile", every(tiles))

    def tile(mine: pa.Table, told: pa.Table) -> pa.Table:
        q, asked, may, keep = of(told)
        for batch in mine.select(names).to_batches():
            for pos, s in _product(batch, names, asked, may):
                keep.add(pos, s)
        return pa.Table.from_batches([batch_of(q, keep.rows())])

    return left.groupBy("tile", "qb").cogroup(right.groupBy("tile", "qb")).applyInArrow(tile, FOUND)


def _sides(queries: DataFrame, chunks: DataFrame, allowed: Column | None, facts: DataFrame | None) -> tuple[DataFrame, DataFrame, bool]:
    """Queries (q, v, kinds) and chunks (pos, v, kind) that have a direction, and whether kinds decide what is ranked."""
    asks = queries.where(directed(F.col("v"))).select(query_key(F.col("query_id")).alias("q"), F.col("v").cast("array<double>").alias("v"))
    rows = chunks.where(directed(F.col("v"))).select("pos", "v")
    if allowed is None or facts is None:
        return asks.withColumn("kinds", F.lit(None).cast("array<string>")), rows, False
    return asks.join(permitted(queries, facts, allowed), "q", "left").select("q", "v", "kinds"), rows.join(kinds_of(facts), "pos"), True


def vector_top_k(queries: DataFrame, chunks: DataFrame, k: int, allowed: Column | None = None, facts: DataFrame | None = None) -> DataFrame:
    """query_id, pos, score (cosine), rank of each query's (query_id, v) best k chunks (pos, v); allowed and facts as in KeywordIndex.top_k."""
    asks, rows, filtered = _sides(queries, chunks, allowed, facts)
    found = _over(asks, rows, asks.count(), filtered, lambda told: Best(k))
    return top_k(found.select(query_of(F.col("q"), queries).alias("query_id"), "pos", "score"), k)


def vector_places(queries: DataFrame, chunks: DataFrame, wanted: DataFrame, allowed: Column | None = None, facts: DataFrame | None = None) -> DataFrame:
    """query_id, pos, rank of wanted pairs (query_id, pos) in the query's ranking of all chunks, which is nowhere put in order."""
    asks, rows, filtered = _sides(queries, chunks, allowed, facts)
    pairs = wanted.select(query_key(F.col("query_id")).alias("q"), "pos").join(rows.select("pos", F.col("v").alias("w")), "pos").join(asks, "q")
    # the same sums as those of the products, to VECTOR_PLACES
    score = F.round(dot(unit(F.col("v")), unit(F.col("w"))), VECTOR_PLACES)
    want = pairs.groupBy("q").agg(F.collect_list(F.struct("pos", score.alias("score"))).alias("want"))

    def make(told: pa.Table) -> Before:
        lists = pa.concat_arrays(told.column("want").chunks)
        flat = lists.flatten()
        return Before(np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), *(flat.field(i).to_numpy(zero_copy_only=False) for i in range(2)))

    asks = asks.join(want, "q")
    n = asks.count()
    if not n:
        return queries.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, pos long, rank int")
    counted = _over(asks, rows, n, filtered, make).groupBy("q", "pos").agg(F.sum("score").alias("n"))
    return counted.select(query_of(F.col("q"), queries).alias("query_id"), "pos", (F.col("n") + 1).cast("int").alias("rank"))


def vector_pairs(queries: DataFrame, chunks: DataFrame, least: float) -> DataFrame:
    """query_id, pos, score of the pairs of a stated query set (query_id, v) and all chunks (pos, v) with a cosine of `least` or more."""
    asks, rows, _ = _sides(queries, chunks, None, None)

    class Reached:
        def __init__(self) -> None:
            self.parts: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

        def add(self, pos: np.ndarray, scores: np.ndarray) -> None:
            q, at = np.nonzero(scores >= least)
            self.parts.append((q, pos[at], scores[q, at]))

        def rows(self) -> tuple:
            return tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))

    found = _over(asks, rows, asks.count(), False, lambda told: Reached())
    return found.select(query_of(F.col("q"), queries).alias("query_id"), "pos", "score")
