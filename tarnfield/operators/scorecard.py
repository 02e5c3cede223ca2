"""The scorecard: weighted totals, ranks and how they hold under other weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CRITERIA = ["c1", "c2", "c3", "c4", "c5", "c6"]
WEIGHTS = {"c1": 0.25, "c2": 0.2, "c3": 0.2, "c4": 0.15, "c5": 0.1, "c6": 0.1}


def weighted_total(weights: dict[str, float]) -> Column:
    """Sum of weight times score to 6 places; null if a score is missing."""
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.lit(w) * F.col(c)
    return F.round(total, 6)


def weightings() -> dict[str, dict[str, float]]:
    """Equal weights, each criterion halved and doubled, and two stated preferences; all sum to 1."""
    out = {"equal": dict.fromkeys(CRITERIA, 1.0)}
    for c in CRITERIA:
        out[f"half_{c}"] = WEIGHTS | {c: WEIGHTS[c] / 2}
        out[f"double_{c}"] = WEIGHTS | {c: WEIGHTS[c] * 2}
    out["value_first"] = {"c1": 4.0, "c2": 2.0, "c3": 1.0, "c4": 1.0, "c5": 1.0, "c6": 1.0}
    out["safety_first"] = {"c1": 1.0, "c2": 1.0, "c3": 1.0, "c4": 2.0, "c5": 3.0, "c6": 2.0}
    return {k: {c: w / sum(v.values()) for c, w in v.items()} for k, v in out.items()}


def first_picks(cards: DataFrame) -> DataFrame:
    """name, pick, total of each weighting: one pass over the cards, a running best for each weighting."""
    eligible = cards.where(F.col("gates_passed") & F.col("c1").isNotNull())
    best = [F.max(F.struct(weighted_total(w).alias("t"), F.col("c4"), F.col("c5"), (-F.col("id")).alias("i"))).alias(k) for k, w in weightings().items()]
    wide = eligible.agg(*best)
    rows = F.array(*[F.struct(F.lit(k).alias("name"), (-F.col(f"{k}.i")).alias("pick"), F.col(f"{k}.t").alias("total")) for k in weightings()])
    return wide.select(F.inline(rows))


def ranked(cards: DataFrame) -> DataFrame:
    """cards with total and rank; the rank of one that fails a gate or misses a score is null."""
    scored = cards.withColumn("total", weighted_total(WEIGHTS))
    ok = F.col("gates_passed") & F.col("total").isNotNull()
    w = Window.partitionBy(ok).orderBy(F.desc("total"), F.desc("c4"), F.desc("c5"), "id")
    return scored.withColumn("rank", F.when(ok, F.row_number().over(w)))
