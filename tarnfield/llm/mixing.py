"""Mixing sources to target weights by Pareto order sampling.

Targets: the budget (a share of all words) is split over sources by weight;
a source stops at `cap` times its words and the excess goes to the others by
weight until none is above (water filling, one sorted pass over sources).

A document's expected copies are its source's target over its source's words,
times its relative weight if a weight column is named. Whole copies are certain.
For the rest, documents are ranked by their random odds u/(1-u) over their
inclusion odds p/(1-p) (Pareto order sampling); the sample is the head of that
order that fits the source's remaining target, so its size is fixed in words,
and one document more, the one that comes nearest to the words still missing.
u comes from a digest of doc_id and seed: reruns agree.

The cut in each source's order is found without sorting the source in one task:
words are summed over cells of the rank, the cell that holds the cut is split
again, and only the last cell's documents are put in order.

Defined results: a null text has size 0 and takes nothing. A null source is a
source of its own, the last in order. Rows that repeat a doc_id are sampled
together: they share u, within a source they are taken alike. An empty table gives an empty result. Extra columns,
whatever their names, are ignored by `mix` and kept by `mixed_documents`. Targets are computed in one task over a row for
each source, as the order of sources and the filling of targets run over all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.llm.shared import NOT_WS, stored

#: Cells that a source's rank is cut into at each level, and levels.
CELLS, LEVELS = 1024, 2
#: A table of sources is broadcast up to this many rows.
BROADCAST_ROWS = 50_000


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of md5(doc_id:seed)."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target. Sources by code point, null last, take the weights in turn."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("limit", F.col("source_size") * float(cap))
    everything = Window.partitionBy()
    filled = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("budget", F.sum("source_size").over(everything) * float(share))
        .withColumn("w_all", F.sum("w").over(everything))
        .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("limit_before", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    )
    # the level that the sources from this one on get if all before it are full; past the first open source it only falls
    level = (F.col("budget") - F.col("limit_before")) / (F.col("w_all") - F.col("w_before"))
    per = per.withColumn("level", level).withColumn("full", F.col("limit") <= F.col("level") * F.col("w"))
    per = per.withColumn("first_open", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    return per.select("source", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(F.col("first_open") * F.col("w")).alias("target"))


def _with_source(docs: DataFrame, per_source: DataFrame, key: str, how: str = "left") -> DataFrame:
    """docs joined with a table of one row for each source: broadcast if its rows are counted to be few, else dealt by source."""
    few = per_source.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(per_source) if few else per_source.hint("shuffle_merge"), F.col("source").eqNullSafe(F.col(key)), how)


def copies(sized: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """sized (doc_id, source, size, rel) with the copies that each document gets."""
    per = targets.withColumnRenamed("source", "t_source")
    expected = F.least(F.lit(2.0), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)) * F.col("rel"))
    docs = _with_source(sized, per, "t_source", "inner").drop("t_source").withColumn("e", expected).withColumn("sure", F.floor("e").cast("long"))
    u, p = uniform(F.col("doc_id"), seed), F.col("e") - F.col("sure")
    odds = (u / (1 - u)) * (1 - p) / F.when(p > 0, p)
    # a monotone image of the Pareto rank in [0, 1); inclusion odds of 0 come last
    docs = docs.withColumn("rank", F.when(F.col("sure") >= 2, F.lit(None)).otherwise(F.coalesce(odds / (1 + odds), F.lit(1.0 - 2.0**-53))))
    docs = stored(docs.select("doc_id", "source", "size", "rel", "source_size", "target", "sure", "rank"), "ranked")
    left = docs.groupBy("source").agg((F.first("target") - F.sum(F.col("sure") * F.col("size"))).alias("left"))
    low, width = F.lit(0.0), 1.0
    state = left.withColumn("low", low)
    for _ in range(LEVELS):
        width = width / CELLS
        s = state.withColumnRenamed("source", "s_source")
        inside = _with_source(docs.where("rank is not null and size > 0"), s, "s_source", "inner").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + width * CELLS))
        cell = F.floor((F.col("rank") - F.col("low")) / width)
        sums = inside.groupBy("source", "low", "left", cell.alias("cell")).agg(F.sum("size").alias("words"))
        so_far = F.sum("words").over(Window.partitionBy("source").orderBy("cell"))
        cut = sums.withColumn("so_far", so_far).withColumn("over", F.col("so_far") > F.col("left"))
        state = stored(
            cut.groupBy("source").agg(
                F.coalesce(F.min(F.when(F.col("over"), F.col("low") + F.col("cell") * width)), F.lit(1.0)).alias("low"),
                (F.first("left") - F.coalesce(F.max(F.when(~F.col("over"), F.col("so_far"))), F.lit(0))).alias("left"),
            ),
            "cells",
        )
    s = state.withColumnRenamed("source", "s_source")
    at = _with_source(docs, s, "s_source")
    in_cell = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + width) & (F.col("size") > 0)
    last = at.where(in_cell).select("doc_id", "source", "size", "rank", "left")
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = last.withColumn("fits", before + F.col("size") <= F.col("left"))
    edge = stored(last.where("fits").select(F.col("doc_id").alias("e_id"), F.col("source").alias("e_source"), F.col("rank").alias("e_rank"), F.col("size").alias("e_size")), "edge")
    filled = stored(edge.groupBy("e_source").agg(F.sum("e_size").alias("e_words")), "filled")
    once = edge.select("e_id", "e_source", "e_rank").distinct()
    chosen = at.join(once, F.col("doc_id").eqNullSafe(F.col("e_id")) & F.col("source").eqNullSafe(F.col("e_source")) & (F.col("rank") == F.col("e_rank")), "left")
    extra = F.when((F.col("size") > 0) & ((F.col("rank") < F.col("low")) | F.col("e_rank").isNotNull()), 1).otherwise(0)
    chosen = chosen.withColumn("extra", F.coalesce(extra, F.lit(0))).select("doc_id", "source", "size", "rel", "source_size", "target", "sure", "rank", "left", "extra")
    # the words still missing in each source, and the one document more that comes nearest to them
    gap = F.col("left") - F.coalesce(F.col("e_words"), F.lit(0))
    open_ = _with_source(chosen.where("extra = 0 and rank is not null and size > 0"), filled, "e_source")
    near = F.struct(F.abs(F.col("size") - gap).alias("off"), F.col("rank").alias("r"), F.col("doc_id").alias("c_id"))
    closing = open_.where(F.abs(F.col("size") - gap) < gap).groupBy("source").agg(F.min(near).alias("c")).select(F.col("source").alias("c_source"), F.col("c.c_id"), F.col("c.r").alias("c_rank"))
    closing = stored(closing, "closing")
    out = _with_source(chosen, closing, "c_source")
    closes = F.coalesce(F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("rank") == F.col("c_rank")) & (F.col("extra") == 0), F.lit(False))
    return out.select("doc_id", "source", "size", "rel", "source_size", "target", (F.col("sure") + F.col("extra") + closes.cast("int")).alias("copies"))


def _size_and_rel(weight: str | None) -> list[Column]:
    size = F.coalesce(F.regexp_count("text", F.lit(NOT_WS)), F.lit(0)).cast("long")
    rel = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    return [size.alias("size"), rel.alias("rel")]


def sized(documents: DataFrame, weight: str | None = None) -> DataFrame:
    return stored(documents.select("doc_id", "source", *_size_and_rel(weight)), "sized")


def _mixed(documents: DataFrame, weights: tuple[float, ...], share: float, cap: float, seed: int, weight: str | None) -> DataFrame:
    docs = sized(documents, weight)
    return copies(docs, stored(source_targets(docs, weights, share, cap), "targets"), seed)


def mix(documents: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 0, weight: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of every document."""
    out = _mixed(documents, weights, share, cap, seed, weight)
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(documents: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 0, weight: str | None = None) -> DataFrame:
    """The mix itself: every document as many times as it is taken; a document without words stays once."""
    # rows that are alike in what the mix looks at are taken alike
    key = ["doc_id", "source", "size", "rel"]
    got = _mixed(documents, weights, share, cap, seed, weight).groupBy(*key).agg(F.max("copies").alias("copies"))
    got = got.select(*(F.col(c).alias(f"got_{c}") for c in key), "copies")
    docs = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("doc"), "doc_id", "source", *_size_and_rel(weight))
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"got_{c}"))
    n = F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).cast("int")
    out = docs.join(got, same).where(n > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), n)))
    return out.select(*(F.col(f"doc.`{c}`") for c in documents.columns))
