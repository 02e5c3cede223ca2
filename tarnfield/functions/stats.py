"""Intervals, paired tests and rank statistics as column expressions; none leaves whole-stage codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.959963984540054


def wilson(count: Column, total: Column, z: float = Z) -> Column:
    """struct(low, high) of the Wilson score interval; (0, 1) when total is 0."""
    n, p = total.cast("double"), F.try_divide(count, total)
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    none = total == 0
    return F.struct(
        F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)).alias("low"),
        F.when(none, 1.0).otherwise(F.least(F.lit(1.0), centre + half)).alias("high"),
    )


def safe_wilson(count: Column, total: Column) -> Column:
    """wilson with the total kept away from 0, so that no division by 0 is planned."""
    some = F.greatest(total, F.lit(1))
    w = wilson(count, some)
    none = total == 0
    return F.struct(F.when(none, 0.0).otherwise(w["low"]).alias("low"), F.when(none, 1.0).otherwise(w["high"]).alias("high"))


def proportion(count: Column, total: Column) -> Column:
    """struct(count, total, rate, low, high); all 0 when total is 0."""
    some = F.greatest(total, F.lit(1))
    w, none = wilson(count, some), total == 0
    return F.struct(
        count.alias("count"),
        total.alias("total"),
        F.when(none, 0.0).otherwise(count / some).alias("rate"),
        F.when(none, 0.0).otherwise(w["low"]).alias("low"),
        F.when(none, 0.0).otherwise(w["high"]).alias("high"),
    )


def newcombe(both: Column, first: Column, second: Column, neither: Column) -> Column:
    """struct(difference, low, high) of two paired proportions (method 10); (0, -1, 1) without pairs."""
    total = both + first + second + neither
    n = F.greatest(total, F.lit(1)).cast("double")
    p1, p2 = (both + first) / n, (both + second) / n
    w1, w2 = wilson(both + first, F.greatest(total, F.lit(1))), wilson(both + second, F.greatest(total, F.lit(1)))
    margins = (both + first).cast("double") * (second + neither) * (both + second) * (first + neither)
    phi = F.when(margins == 0, 0.0).otherwise((both.cast("double") * neither - first.cast("double") * second) / F.sqrt(F.greatest(margins, F.lit(1.0))))

    def distance(x: Column, y: Column) -> Column:
        return F.sqrt(F.greatest(F.lit(0.0), x * x - 2 * phi * x * y + y * y))

    d = p1 - p2
    low = F.greatest(F.lit(-1.0), d - distance(p1 - w1["low"], w2["high"] - p2))
    high = F.least(F.lit(1.0), d + distance(w1["high"] - p1, p2 - w2["low"]))
    none = total == 0
    return F.struct(F.when(none, 0.0).otherwise(d).alias("difference"), F.when(none, -1.0).otherwise(low).alias("low"), F.when(none, 1.0).otherwise(high).alias("high"))


def log_factorial(n: Column) -> Column:
    """ln n!: summed up to 20, Stirling's series beyond."""
    x = n.cast("double") + 1.0
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(20)), F.lit(1)).cast("int")), F.lit(0.0), lambda acc, i: acc + F.ln(i.cast("double")))
    return F.when(n <= 20, small).otherwise(series)


def mcnemar(b: Column, c: Column) -> Column:
    """Two-sided exact McNemar p of b against c discordant pairs, summed in logarithms outward from the largest term.

    With m = min(b, c) the terms C(n, i), i = m, m-1, ..., shrink by i / (n - i + 1) each; all are summed relative to the first, so nothing overflows.
    """
    n, m = b + c, F.least(b, c)
    top = log_factorial(n) - log_factorial(m) - log_factorial(n - m) - n * math.log(2.0)
    # ten standard deviations on, a term is less than 1e-40 of the first: the list has the length of a square root
    steps = F.sequence(F.lit(0), F.greatest(F.least(m - 1, F.ceil(10 * F.sqrt(n.cast("double"))) + 20), F.lit(0)).cast("int"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * (m - i) / (n - m + i + 1)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    ratio = F.aggregate(steps, start, add)["sum"]
    return F.when(n == 0, 1.0).when(m == 0, F.least(F.lit(1.0), 2 * F.exp(-n * math.log(2.0)))).otherwise(F.least(F.lit(1.0), 2 * F.exp(top) * ratio))


def holm(df: DataFrame, p: str, out: str, *ties: str) -> DataFrame:
    """df with Holm's step-down adjustment of p. For tables of comparisons: one ordered window over all rows."""
    order = Window.orderBy(p, *ties)
    total = F.count("*").over(Window.partitionBy())
    step = F.least(F.lit(1.0), (total - F.row_number().over(order) + 1) * F.col(p))
    ranked = df.withColumn("__step", step)
    return ranked.withColumn(out, F.max("__step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__step")


def kendall_tau_b(concordant: Column, discordant: Column, ties_x: Column, ties_y: Column) -> Column:
    root = F.sqrt((concordant + discordant + ties_x).cast("double") * (concordant + discordant + ties_y))
    return F.when(root == 0, 0.0).otherwise((concordant - discordant) / F.when(root > 0, root))
