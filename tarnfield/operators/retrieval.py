"""Who may read a chunk, and what a prompt takes. Search itself is in keyword_index, vectors and fusion, evidence in spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.operators.fusion import RRF_K, fuse, fuse_whole, prefix
from tarnfield.operators.keyword_index import KeywordIndex
from tarnfield.operators.ranking import top_k
from tarnfield.operators.spans import held, spans
from tarnfield.operators.vectors import dot, unit, vector_pairs, vector_places, vector_top_k

__all__ = ["RRF_K", "KeywordIndex", "dot", "fuse", "fuse_whole", "held", "prefix", "spans", "top_k", "unit", "vector_pairs", "vector_places", "vector_top_k"]

def refusal(access: Column, status: Column, asker: Column) -> Column:
    """Why a chunk is withheld: access comes before status; null if it isn't."""
    return F.when((access == "staff") & (asker != "staff"), "access").when(status != "current", "status")


def span_ranks(found: DataFrame, ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """item_id, doc_id, start, stop, rank of the first ranked chunk (query_id, pos, rank) that holds the span whole; null if none."""
    placed = ranked.join(chunks.select("pos", F.col("doc_id").alias("c_doc"), F.col("start").alias("c_start"), F.col("stop").alias("c_stop")), "pos")
    holds = (F.col("doc_id") == F.col("c_doc")) & (F.col("c_start") <= F.col("start")) & (F.col("stop") <= F.col("c_stop")) & (F.col("item_id") == F.col("query_id"))
    return found.join(placed, holds, "left").groupBy("item_id", "doc_id", "start", "stop").agg(F.min("rank").alias("rank"))


def ends_order(rank: Column, n: Column) -> Column:
    """What to sort n ranked passages by, so that the best stands first, the second best last, and so on inwards."""
    return F.when(rank % 2 == 1, rank).otherwise(2 * n + 1 - rank)


def within_budget(rows: DataFrame, group: list[str], order: str, size: str, budget: int, cells: int = 256) -> DataFrame:
    """rows whose running sum of `size` within the group, in the order of a numeric column, is at most a budget; with it as `so_far`.

    Sums of cells of the order tell where the budget ends, and only rows of cells up to there are put in order, so that no task
    holds a whole group.
    """
    low, high = rows.agg(F.min(order), F.max(order)).first()
    step = max((float(high) - float(low)) / cells, 1e-9) if low is not None else 1.0
    cell = F.floor((F.col(order) - F.lit(float(low or 0))) / step).cast("long")
    sums = rows.groupBy(*group, cell.alias("cell")).agg(F.sum(size).alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy(*group).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = sums.withColumn("before", before).where(F.col("before") <= budget).select(*group, "cell", "before")
    inside = rows.withColumn("cell", cell).join(open_, [*group, "cell"])
    w = Window.partitionBy(*group, "cell").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return inside.withColumn("so_far", F.col("before") + F.sum(size).over(w)).where(F.col("so_far") <= budget).drop("cell", "before")


def ordered_union(parts: list[DataFrame], value: str, place: str) -> DataFrame:
    """Distinct values of all parts with the place of their first mention."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy(value).agg(F.min(place).alias(place))
