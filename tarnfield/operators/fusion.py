"""Reciprocal rank fusion, of given lists and of two whole rankings of which only prefixes are read.

Of two rankings of all chunks, the best `depth` by 1 / (c + rank) in either, summed, are found exactly from the first
c + 2 * depth of each: the first `depth` of one ranking alone score 1 / (c + depth) at least, and a chunk
in neither prefix less than that. Chunks of one prefix whose bound (their place there, and the first place after the
other prefix) can reach the best `depth` have their place in the other ranking counted, without putting that ranking in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
#: Decimal places that fused scores are compared at.
FUSED_PLACES = 9


def fuse(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, list_no, rank, pos): score, and rank; ties keep the order of first mention."""
    first = F.min(F.struct("list_no", "rank"))
    s = rankings.groupBy("query_id", "pos").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), FUSED_PLACES).alias("score"), first.alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first.list_no", "first.rank")
    return s.withColumn("rank", F.row_number().over(w)).select("query_id", "pos", "score", "rank")


def prefix(depth: int, k: int = RRF_K) -> int:
    """How much of each ranking decides the best `depth` of their fusion."""
    return k + 2 * depth + 1


def fuse_whole(lists: list[tuple[DataFrame, Callable[[DataFrame], DataFrame]]], depth: int, k: int = RRF_K) -> DataFrame:
    """The best `depth` of the fusion of two whole rankings: query_id, pos, score, rank.

    Each list is its first prefix(depth, k) rows (query_id, pos, rank), which must hold still when read twice, and a function
    from pairs (query_id, pos) to their places (query_id, pos, rank) in the whole ranking; a pair that it leaves out is not ranked there.
    """
    # a fused score is rounded, so what is a rounding below may tie
    slack = 2 * 10.0**-FUSED_PLACES
    keyed = [rows.select(F.struct("query_id").alias("key"), "pos", F.col("rank").alias(f"r{i}")) for i, (rows, _) in enumerate(lists)]
    both = keyed[0].join(keyed[1], ["key", "pos"], "full")
    part = lambda r, other: 1.0 / (k + F.coalesce(r, other))
    worst = F.coalesce(1.0 / (k + F.col("r0")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("r1")), F.lit(0.0))
    most = part(F.col("r0"), F.lit(prefix(depth, k) + 1)) + part(F.col("r1"), F.lit(prefix(depth, k) + 1))
    told = both.withColumn("worst", worst).withColumn("most", most)
    nth = Window.partitionBy("key").orderBy(F.desc("worst"), "pos")
    least = told.withColumn("n", F.row_number().over(nth)).where(F.col("n") == depth).select("key", F.col("worst").alias("least"))
    open_ = told.join(least, "key", "left").where(F.col("least").isNull() | (F.col("most") + slack >= F.col("least"))).select("key", "pos", "r0", "r1")
    rows = open_.select("key.query_id", "pos", "r0", "r1")
    found = []
    for i, (_, places) in enumerate(lists):
        lacking = rows.where(F.col(f"r{i}").isNull()).select("query_id", "pos")
        known = rows.where(F.col(f"r{i}").isNotNull()).select("query_id", "pos", F.col(f"r{i}").alias("rank"))
        found.append(known.unionByName(places(lacking).select("query_id", "pos", "rank")).withColumn("list_no", F.lit(i + 1)))
    return fuse(found[0].unionByName(found[1]), k).where(F.col("rank") <= depth)
