"""Evaluation statistics over paired arms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.functions import stats as S
from tarnfield.queries.registry import Tables, query

WILSON = "(({c} / {n} + {zz} / (2 * {n})) / (1 + {zz} / {n}) {s} 1.959963984540054 * sqrt({c} / {n} * (1 - {c} / {n}) / {n} + {zz} / (4 * {n} * {n})) / (1 + {zz} / {n}))"


def _w(c: str, n: str, side: str) -> str:
    """Wilson bound in DuckDB SQL."""
    body = WILSON.format(c=f"({c})::double", n=f"greatest(({n})::double, 1)", zz="3.841458820694124", s="-" if side == "low" else "+")
    return f"case when ({n}) = 0 then {0.0 if side == 'low' else 1.0} else {'greatest(0.0, ' if side == 'low' else 'least(1.0, '}{body}) end"


def _rates(df: DataFrame, *keep: str) -> DataFrame:
    w = S.safe_wilson(F.col("count"), F.col("total"))
    return df.select(*keep, "count", "total", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"))


@query(f"""with a as (select arm, type, count(*) filter (where correct) as count, count(*) as total from arms group by arm, type)
select arm, type, count, total, round({_w('count', 'total', 'low')}, 6) as low, round({_w('count', 'total', 'high')}, 6) as high from a""")
def wilson_interval(t: Tables) -> DataFrame:
    return _rates(t.arms.groupBy("arm", "type").agg(F.count_if("correct").alias("count"), F.count("*").alias("total")), "arm", "type")


@query(f"""with a as (select type, count(*) filter (where leaked and asker = 'public') as count, count(*) filter (where asker = 'public') as total from arms group by type)
select type, count, total, case when total = 0 then 0.0 else round(count / total, 6) end as rate, round({_w('count', 'total', 'low')}, 6) as low, round({_w('count', 'total', 'high')}, 6) as high from a""")
def proportion_wilson(t: Tables) -> DataFrame:
    a = t.arms.groupBy("type").agg(F.count_if(F.col("leaked") & (F.col("asker") == "public")).alias("c"), F.count_if(F.col("asker") == "public").alias("n"))
    p = S.proportion(F.col("c"), F.col("n"))
    return a.select("type", p["count"].alias("count"), p["total"].alias("total"), *[F.round(p[x], 6).alias(x) for x in ("rate", "low", "high")])


SEASON = {
    "search": ("answerable", "evidence_rank <= 5"),
    "answer": ("answerable", "correct and faithful"),
    "not_found": ("not answerable", "declined"),
    "leaks": ("asker = 'public'", "leaked"),
}


def _season(df: DataFrame, *by: str) -> DataFrame:
    aggs = [a for k, (of, hit) in SEASON.items() for a in (F.count_if(F.expr(f"{of} and {hit}")).alias(f"{k}_count"), F.count_if(F.expr(of)).alias(f"{k}_total"))]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


_SEASON_SQL = ", ".join(f"count(*) filter (where {of} and {hit}) as {k}_count, count(*) filter (where {of}) as {k}_total" for k, (of, hit) in SEASON.items())


@query(f"select {_SEASON_SQL} from arms")
def season_numbers(t: Tables) -> DataFrame:
    return _season(t.arms)


@query(f"select type, {_SEASON_SQL} from arms group by rollup(type)")
def season_numbers_rollup(t: Tables) -> DataFrame:
    aggs = [a for k, (of, hit) in SEASON.items() for a in (F.count_if(F.expr(f"{of} and {hit}")).alias(f"{k}_count"), F.count_if(F.expr(of)).alias(f"{k}_total"))]
    return t.arms.rollup("type").agg(*aggs)


@query("select type, arm, count(*) filter (where evidence_rank <= 5) as hits, count(*) as total from arms where answerable group by type, arm")
def recall_at_k(t: Tables) -> DataFrame:
    return t.arms.where("answerable").groupBy("type", "arm").agg(F.count_if(F.col("evidence_rank") <= 5).alias("hits"), F.count("*").alias("total"))


LOST = """case when evidence_rank is null then 'search' when evidence_rank > 20 then 'filter' when evidence_rank > 5 then 'rerank'
 when correct is null then 'unjudged' when correct then null when declined then 'prompt' else 'answer' end"""


def lost_stage_column():
    r = F.col("evidence_rank")
    return F.when(r.isNull(), "search").when(r > 20, "filter").when(r > 5, "rerank").when(F.col("correct").isNull(), "unjudged").when(F.col("correct"), None).when(F.col("declined"), "prompt").otherwise("answer")


@query(f"select item_id, arm, {LOST} as lost_at from arms where answerable")
def lost_stage(t: Tables) -> DataFrame:
    return t.arms.where("answerable").select("item_id", "arm", lost_stage_column().alias("lost_at"))


@query(f"select arm, coalesce({LOST}, 'answer') as stage, count(*) as n from arms where answerable and not correct group by 1, 2")
def lost_stage_histogram(t: Tables) -> DataFrame:
    return t.arms.where("answerable and not correct").groupBy("arm", F.coalesce(lost_stage_column(), F.lit("answer")).alias("stage")).agg(F.count("*").alias("n"))


@query("""select arm, count(*) filter (where answerable and evidence_rank is null) as lost_search,
 count(*) filter (where answerable and evidence_rank > 20) as below_shortlist, count(*) filter (where answerable and evidence_rank between 6 and 20) as in_shortlist,
 count(*) filter (where leaked and asker = 'public') as leaks, count(*) filter (where not answerable and not coalesce(declined, false)) as undeclined from arms group by arm""")
def trace_report(t: Tables) -> DataFrame:
    r = F.col("evidence_rank")
    return t.arms.groupBy("arm").agg(
        F.count_if(F.col("answerable") & r.isNull()).alias("lost_search"),
        F.count_if(F.col("answerable") & (r > 20)).alias("below_shortlist"),
        F.count_if(F.col("answerable") & r.between(6, 20)).alias("in_shortlist"),
        F.count_if(F.col("leaked") & (F.col("asker") == "public")).alias("leaks"),
        F.count_if(~F.col("answerable") & ~F.coalesce("declined", F.lit(False))).alias("undeclined"),
    )


@query("""select item_id, arm, coalesce(correct and faithful, false) as is_right, coalesce(not (correct and faithful), false) as is_wrong,
 case when answerable then coalesce(correct and faithful, false) else coalesce(declined, false) end as handled from arms""")
def handled_flags(t: Tables) -> DataFrame:
    ok = F.col("correct") & F.col("faithful")
    return t.arms.select("item_id", "arm", F.coalesce(ok, F.lit(False)).alias("is_right"), F.coalesce(~ok, F.lit(False)).alias("is_wrong"), F.when(F.col("answerable"), F.coalesce(ok, F.lit(False))).otherwise(F.coalesce("declined", F.lit(False))).alias("handled"))


def _pairs(t: Tables, hit: str = "coalesce(correct, false)") -> DataFrame:
    """Items that arms 1 and 2 share, with a hit flag of each: one pass and one shuffle on the item."""
    a = t.arms.where("arm in (1, 2)").groupBy("item_id", "type").agg(F.max(F.when(F.col("arm") == 1, F.expr(hit))).alias("h1"), F.max(F.when(F.col("arm") == 2, F.expr(hit))).alias("h2"))
    return a.where("h1 is not null and h2 is not null")


_PAIRS = """p as (select a.item_id, a.type, coalesce(a.correct, false) as h1, coalesce(b.correct, false) as h2 from arms a join arms b on a.item_id = b.item_id where a.arm = 1 and b.arm = 2)"""


@query(f"with {_PAIRS} select item_id, type, h1, h2 from p")
def paired_arms(t: Tables) -> DataFrame:
    return _pairs(t).select("item_id", "type", "h1", "h2")


@query(f"with {_PAIRS} select type, count(*) filter (where h1 and not h2) as lost, count(*) filter (where h2 and not h1) as gained, count(*) filter (where h1 <> h2) as flipped, count(*) filter (where h2) - count(*) filter (where h1) as net from p group by type")
def flips(t: Tables) -> DataFrame:
    return _pairs(t).groupBy("type").agg(F.count_if(F.expr("h1 and not h2")).alias("lost"), F.count_if(F.expr("h2 and not h1")).alias("gained"), F.count_if(F.expr("h1 <> h2")).alias("flipped"), (F.count_if("h2") - F.count_if("h1")).alias("net"))


_N = "greatest((a+b+c+d)::double, 1)"
_NEWCOMBE = f"""g as (select *, (a+b)/{_N} as p1, (a+c)/{_N} as p2, {_w('a+b', 'a+b+c+d', 'low')} as l1, {_w('a+b', 'a+b+c+d', 'high')} as u1, {_w('a+c', 'a+b+c+d', 'low')} as l2, {_w('a+c', 'a+b+c+d', 'high')} as u2,
 case when (a+b)*(c+d)*(a+c)*(b+d) = 0 then 0.0 else (a*d - b*c) / sqrt((a+b)::double*(c+d)*(a+c)*(b+d)) end as phi from s)"""
_FOUR = "count(*) filter (where h1 and h2) as a, count(*) filter (where h1 and not h2) as b, count(*) filter (where h2 and not h1) as c, count(*) filter (where not h1 and not h2) as d"


@query(f"""with {_PAIRS}, s as (select type, {_FOUR} from p group by type), {_NEWCOMBE}
select type, round(p1 - p2, 6) as difference,
 round(greatest(-1.0, p1 - p2 - sqrt(greatest(0.0, (p1-l1)*(p1-l1) - 2*phi*(p1-l1)*(u2-p2) + (u2-p2)*(u2-p2)))), 6) as low,
 round(least(1.0, p1 - p2 + sqrt(greatest(0.0, (u1-p1)*(u1-p1) - 2*phi*(u1-p1)*(p2-l2) + (p2-l2)*(p2-l2)))), 6) as high from g""")
def newcombe_interval(t: Tables) -> DataFrame:
    s = _four(_pairs(t), "type")
    x = S.newcombe(*[F.col(c) for c in "abcd"])
    return s.select("type", *[F.round(x[k], 6).alias(k) for k in ("difference", "low", "high")])


def _four(pairs: DataFrame, *by: str) -> DataFrame:
    return pairs.groupBy(*by).agg(F.count_if(F.expr("h1 and h2")).alias("a"), F.count_if(F.expr("h1 and not h2")).alias("b"), F.count_if(F.expr("h2 and not h1")).alias("c"), F.count_if(F.expr("not h1 and not h2")).alias("d"))


@query(f"""with {_PAIRS}, s as (select type, {_FOUR} from p group by type), {_NEWCOMBE}
select type, a + b + c + d as items, a + b as first_right, a + c as second_right,
 (p1 - p2 - sqrt(greatest(0.0, (p1-l1)*(p1-l1) - 2*phi*(p1-l1)*(u2-p2) + (u2-p2)*(u2-p2)))) > 0 or (p1 - p2 + sqrt(greatest(0.0, (u1-p1)*(u1-p1) - 2*phi*(u1-p1)*(p2-l2) + (p2-l2)*(p2-l2)))) < 0 as significant from g""")
def paired_gain(t: Tables) -> DataFrame:
    s = _four(_pairs(t), "type")
    x = S.newcombe(*[F.col(c) for c in "abcd"])
    return s.select("type", F.expr("a + b + c + d").alias("items"), F.expr("a + b").alias("first_right"), F.expr("a + c").alias("second_right"), ((x["low"] > 0) | (x["high"] < 0)).alias("significant"))


_MCNEMAR_SQL = """case when b + c = 0 then 1.0 else least(1.0, 2 * list_sum([exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0)) for i in range(0, least(b, c) + 1)])) end"""


@query(f"with {_PAIRS}, s as (select type, {_FOUR} from p group by type) select type, b, c, round({_MCNEMAR_SQL}, 6) as p from s")
def mcnemar_exact(t: Tables) -> DataFrame:
    return _four(_pairs(t), "type").select("type", "b", "c", F.round(S.mcnemar(F.col("b"), F.col("c")), 6).alias("p"))


_ALL = f"""p as (select a.arm as arm1, b.arm as arm2, coalesce(a.correct, false) as h1, coalesce(b.correct, false) as h2 from arms a join arms b on a.item_id = b.item_id and a.arm < b.arm),
 s as (select arm1, arm2, {_FOUR} from p group by arm1, arm2)"""


def _every_pair(t: Tables) -> DataFrame:
    """Counts of all pairs of arms. The self-join is on the item, of which each arm has one row."""
    a = t.arms.select("item_id", F.col("arm").alias("arm1"), F.expr("coalesce(correct, false)").alias("h1"))
    b = a.select("item_id", F.col("arm1").alias("arm2"), F.col("h1").alias("h2"))
    return _four(a.join(b, "item_id").where("arm1 < arm2"), "arm1", "arm2")


@query(f"with {_ALL} select arm1, arm2, b, c, round({_MCNEMAR_SQL}, 6) as p from s")
def all_pairs_mcnemar(t: Tables) -> DataFrame:
    return _every_pair(t).select("arm1", "arm2", "b", "c", F.round(S.mcnemar(F.col("b"), F.col("c")), 6).alias("p"))


#: Common table expressions that end in h: arm1, arm2, p and adjusted.
HOLM_SQL = f"""{_ALL}, m as (select arm1, arm2, round({_MCNEMAR_SQL}, 6) as p from s),
 r as (select *, least(1.0, (count(*) over () - row_number() over (order by p, arm1, arm2) + 1) * p) as step from m),
 h as (select arm1, arm2, p, round(max(step) over (order by p, arm1, arm2 rows between unbounded preceding and current row), 6) as adjusted from r)"""


@query(f"with {HOLM_SQL} select arm1, arm2, p, adjusted from h")
def holm(t: Tables) -> DataFrame:
    p = _every_pair(t).select("arm1", "arm2", F.round(S.mcnemar(F.col("b"), F.col("c")), 6).alias("p"))
    return S.holm(p, "p", "adjusted", "arm1", "arm2").withColumn("adjusted", F.round("adjusted", 6))


@query("select flag, arm, type, count(*) filter (where correct) as correct, count(*) as trials from arms group by flag, arm, type")
def accuracy_by_cell(t: Tables) -> DataFrame:
    return t.arms.groupBy("flag", "arm", "type").agg(F.count_if("correct").alias("correct"), F.count("*").alias("trials"))


@query("select flag, arm, type, count(*) filter (where correct) as correct, count(*) as trials from arms group by cube(flag, arm, type)")
def accuracy_cube(t: Tables) -> DataFrame:
    return t.arms.cube("flag", "arm", "type").agg(F.count_if("correct").alias("correct"), F.count("*").alias("trials"))


@query("""with p as (select a.type, a.latency as l1, b.latency as l2, a.out_tokens as o1, b.out_tokens as o2 from arms a join arms b on a.item_id = b.item_id where a.arm = 1 and b.arm = 2)
select type, count(*) as pairs, round(avg(l2) / nullif(avg(l1), 0), 6) as mean_latency_ratio, round(median(l2) / nullif(median(l1), 0), 6) as median_latency_ratio,
 round(sum(o2) / nullif(sum(o1), 0), 6) as token_multiple from p group by type""")
def mode_comparison(t: Tables) -> DataFrame:
    a = t.arms.where("arm in (1, 2)").groupBy("item_id", "type").pivot("arm", [1, 2]).agg(F.max("latency").alias("l"), F.max("out_tokens").alias("o"))
    a = a.where("1_l is not null and 2_l is not null")
    return a.groupBy("type").agg(
        F.count("*").alias("pairs"),
        F.round(F.try_divide(F.avg("2_l"), F.avg("1_l")), 6).alias("mean_latency_ratio"),
        F.round(F.try_divide(F.median("2_l"), F.median("1_l")), 6).alias("median_latency_ratio"),
        F.round(F.try_divide(F.sum("2_o"), F.sum("1_o")), 6).alias("token_multiple"),
    )


@query("select arm, round(median(latency), 6) as median, quantile_disc(out_tokens, 0.9) as p90, round(avg(evidence_rank), 6) as mean from arms group by arm")
def median_p90_mean(t: Tables) -> DataFrame:
    return t.arms.groupBy("arm").agg(F.round(F.median("latency"), 6).alias("median"), F.expr("percentile_disc(0.9) within group (order by out_tokens)").cast("long").alias("p90"), F.round(F.avg("evidence_rank"), 6).alias("mean"))


@query("""with c as (select arm, sum(in_tokens * 0.5 + out_tokens * 2.0) / 1000000 as cost, count(*) filter (where correct and faithful) as handled from arms group by arm), d as (select arm, cost / handled as each from c where handled > 0)
select arm, round(each, 10) as cost_each, round(each / min(each) over (), 2) as ratio from d""")
def cost_ratios(t: Tables) -> DataFrame:
    c = t.arms.groupBy("arm").agg((F.sum(F.col("in_tokens") * 0.5 + F.col("out_tokens") * 2.0) / 1000000).alias("cost"), F.count_if(F.expr("correct and faithful")).alias("handled"))
    d = c.where("handled > 0").select("arm", (F.col("cost") / F.col("handled")).alias("each"))
    return d.select("arm", F.round("each", 10).alias("cost_each"), F.round(F.col("each") / F.min("each").over(Window.partitionBy()), 2).alias("ratio"))


@query("""select arm, count(*) filter (where evidence_rank <= 5) as found, count(*) filter (where evidence_rank <= 5 and correct) as right_found,
 count(*) filter (where not coalesce(evidence_rank <= 5, false)) as missed, count(*) filter (where not coalesce(evidence_rank <= 5, false) and correct) as right_missed from arms where answerable group by arm""")
def right_given_found(t: Tables) -> DataFrame:
    found = F.coalesce(F.col("evidence_rank") <= 5, F.lit(False))
    return t.arms.where("answerable").groupBy("arm").agg(F.count_if(found).alias("found"), F.count_if(found & F.col("correct")).alias("right_found"), F.count_if(~found).alias("missed"), F.count_if(~found & F.col("correct")).alias("right_missed"))


@query("""select type, asker, flag, count(*) filter (where correct is not null) as answered, count(*) filter (where correct is null) as unanswered, count(*) filter (where correct) as n,
 case when count(*) filter (where correct is not null) > 0 then round(count(*) filter (where correct) / count(*) filter (where correct is not null), 6) end as rate
 from arms group by grouping sets ((type, flag), (type, asker, flag))""")
def tally_grouping_sets(t: Tables) -> DataFrame:
    answered = F.count_if(F.col("correct").isNotNull())
    return t.arms.groupingSets([["type", "flag"], ["type", "asker", "flag"]], "type", "asker", "flag").agg(answered.alias("answered"), F.count_if(F.col("correct").isNull()).alias("unanswered"), F.count_if("correct").alias("n"), F.round(F.try_divide(F.count_if("correct"), answered), 6).alias("rate"))


_BOARD = """b as (select arm, count(*) filter (where correct) as x, count(*) filter (where faithful and answerable) as y from arms group by arm)"""


@query(f"""with {_BOARD}, p as (select sign(a.x - c.x) as sx, sign(a.y - c.y) as sy from b a join b c on a.arm < c.arm),
 s as (select count(*) filter (where sx * sy > 0) as c, count(*) filter (where sx * sy < 0) as d, count(*) filter (where sx = 0 and sy <> 0) as tx, count(*) filter (where sy = 0 and sx <> 0) as ty from p)
select c, d, tx, ty, case when (c+d+tx)*(c+d+ty) = 0 then 0.0 else round((c - d) / sqrt((c+d+tx)::double*(c+d+ty)), 6) end as tau from s""")
def kendall_tau_b(t: Tables) -> DataFrame:
    b = t.arms.groupBy("arm").agg(F.count_if("correct").alias("x"), F.count_if(F.expr("faithful and answerable")).alias("y"))
    o = b.select(F.col("arm").alias("arm2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    # a handful of arms: one row each after the aggregate
    p = b.join(o, F.col("arm") < F.col("arm2")).select(F.signum(F.col("x") - F.col("x2")).alias("sx"), F.signum(F.col("y") - F.col("y2")).alias("sy"))
    s = p.agg(F.count_if(F.expr("sx * sy > 0")).alias("c"), F.count_if(F.expr("sx * sy < 0")).alias("d"), F.count_if(F.expr("sx = 0 and sy <> 0")).alias("tx"), F.count_if(F.expr("sy = 0 and sx <> 0")).alias("ty"))
    return s.withColumn("tau", F.round(S.kendall_tau_b(*[F.col(c) for c in ("c", "d", "tx", "ty")]), 6))


@query(f"with {_BOARD} select arm, dense_rank() over (order by x desc) as rank_x, dense_rank() over (order by y desc) as rank_y from b")
def dense_rank_two_orders(t: Tables) -> DataFrame:
    b = t.arms.groupBy("arm").agg(F.count_if("correct").alias("x"), F.count_if(F.expr("faithful and answerable")).alias("y"))
    return b.select("arm", F.dense_rank().over(Window.orderBy(F.desc("x"))).cast("long").alias("rank_x"), F.dense_rank().over(Window.orderBy(F.desc("y"))).cast("long").alias("rank_y"))


@query(f"""with {_BOARD} select arm as chosen, x from b order by x desc, y desc, arm limit 1""")
def choose_on_dev(t: Tables) -> DataFrame:
    b = t.arms.groupBy("arm").agg(F.count_if("correct").alias("x"), F.count_if(F.expr("faithful and answerable")).alias("y"))
    return b.orderBy(F.desc("x"), F.desc("y"), "arm").limit(1).select(F.col("arm").alias("chosen"), "x")


@query(f"""with a as (select arm, count(*) filter (where evidence_rank <= 5) as count, count(*) as total from arms where answerable group by arm),
 w as (select arm, {_w('count', 'total', 'low')} as low, {_w('count', 'total', 'high')} as high from a)
select w.arm, coalesce(r.high < w.low, false) as above_reference from w, w r where r.arm = 1""")
def interval_below_join_rule(t: Tables) -> DataFrame:
    a = t.arms.where("answerable").groupBy("arm").agg(F.count_if(F.col("evidence_rank") <= 5).alias("c"), F.count("*").alias("n"))
    w = S.safe_wilson(F.col("c"), F.col("n"))
    b = a.select("arm", w["low"].alias("low"), w["high"].alias("high"))
    ref = b.where("arm = 1").select(F.col("high").alias("ref_high"))
    return b.join(F.broadcast(ref)).select("arm", (F.col("ref_high") < F.col("low")).alias("above_reference"))


@query("""with a as (select arm, type, count(*) filter (where correct) as n from arms group by arm, type), m as (select type, max(n) as best from a group by type)
select a.type, case when count(*) = 1 then min(arm) end as best_arm from a join m on a.type = m.type and a.n = m.best group by a.type""")
def best_above_reference(t: Tables) -> DataFrame:
    a = t.arms.groupBy("arm", "type").agg(F.count_if("correct").alias("n"))
    a = a.withColumn("best", F.max("n").over(Window.partitionBy("type"))).where("n = best")
    return a.groupBy("type").agg(F.when(F.count("*") == 1, F.min("arm")).alias("best_arm"))


@query("""with c as (select arm, type, flag, count(*) filter (where correct)::double / count(*) as rate from arms group by arm, type, flag),
 d as (select c.arm, c.type, c.flag, round(b.rate - c.rate, 6) as fall from c join c b on c.arm = b.arm and c.type = b.type where b.flag = 'A' and c.flag <> 'A')
select arm, type, flag, fall from (select *, row_number() over (order by fall desc, arm, type, flag) as rn from d) where rn = 1""")
def largest_drop(t: Tables) -> DataFrame:
    c = t.arms.groupBy("arm", "type", "flag").agg((F.count_if("correct") / F.count("*")).alias("rate"))
    b = c.where("flag = 'A'").select("arm", "type", F.col("rate").alias("base"))
    d = c.where("flag <> 'A'").join(b, ["arm", "type"]).select("arm", "type", "flag", F.round(F.col("base") - F.col("rate"), 6).alias("fall"))
    return d.orderBy(F.desc("fall"), "arm", "type", "flag").limit(1)


@query("""with c as (select arm, type, count(*) filter (where correct)::double / count(*) as rate from arms group by arm, type)
select arm, round(max(rate) filter (where type in ('t0', 't3')) - min(rate) filter (where type in ('t1', 't2')), 6) as dip from c group by arm""")
def deepest_dip(t: Tables) -> DataFrame:
    c = t.arms.groupBy("arm", "type").agg((F.count_if("correct") / F.count("*")).alias("rate"))
    return c.groupBy("arm").agg(F.round(F.max(F.when(F.col("type").isin("t0", "t3"), F.col("rate"))) - F.min(F.when(F.col("type").isin("t1", "t2"), F.col("rate"))), 6).alias("dip"))


@query("""with e as (select a.arm, i.type from (select distinct arm from arms) a, (select distinct type from arms) i)
select e.arm, e.type from e anti join (select distinct arm, type from arms where correct and leaked and evidence_rank = 1) x on e.arm = x.arm and e.type = x.type""")
def grid_gaps(t: Tables) -> DataFrame:
    # arms times types: a few dozen cells
    grid = t.arms.select("arm").distinct().crossJoin(t.arms.select("type").distinct())
    return grid.join(t.arms.where("correct and leaked and evidence_rank = 1").select("arm", "type").distinct(), ["arm", "type"], "left_anti")


@query("select arm, round(regr_slope(latency, out_tokens), 6) as slope from arms group by arm")
def ls_slope(t: Tables) -> DataFrame:
    return t.arms.groupBy("arm").agg(F.round(F.regr_slope("latency", "out_tokens"), 6).alias("slope"))


@query("""with u as (select type, 'correct' as field, judge_correct as j, hand_correct as h from marks union all select type, 'faithful', judge_faithful, hand_faithful from marks union all select type, 'declined', judge_declined, hand_declined from marks)
select field, count(*) as total, count(*) filter (where j = h) as agree, count(*) filter (where j and not h) as judge_yes_hand_no from u group by field""")
def judge_agreement(t: Tables) -> DataFrame:
    long = t.marks.select(F.expr("stack(3, 'correct', judge_correct, hand_correct, 'faithful', judge_faithful, hand_faithful, 'declined', judge_declined, hand_declined) as (field, j, h)"))
    return long.groupBy("field").agg(F.count("*").alias("total"), F.count_if(F.expr("j = h")).alias("agree"), F.count_if(F.expr("j and not h")).alias("judge_yes_hand_no"))




@query("""select item_id, (10 * ((judge_correct and judge_faithful) <> (hand_correct and hand_faithful))::int + (judge_correct <> hand_correct)::int + (judge_faithful <> hand_faithful)::int + (judge_declined <> hand_declined)::int)::int as disagreement
 from marks order by disagreement desc, item_id limit 25""")
def pick_for_hand(t: Tables) -> DataFrame:
    score = F.expr("10 * cast((judge_correct and judge_faithful) <> (hand_correct and hand_faithful) as int) + cast(judge_correct <> hand_correct as int) + cast(judge_faithful <> hand_faithful as int) + cast(judge_declined <> hand_declined as int)")
    return t.marks.select("item_id", score.alias("disagreement")).orderBy(F.desc("disagreement"), "item_id").limit(25)


@query("""with o as (select item_id, type, concat(judge_correct::int, judge_faithful::int, judge_declined::int) as outcome from marks), c as (select type, outcome, count(*) as n from o group by 1, 2),
 r as (select o.*, c.n, row_number() over (partition by o.type, o.outcome order by md5(o.item_id::varchar), o.item_id) as round from o join c on o.type = c.type and o.outcome = c.outcome)
select type, item_id, outcome, place from (select type, item_id, outcome, row_number() over (partition by type order by round, n, outcome) as place from r) where place <= 12""")
def judge_sample_roundrobin(t: Tables) -> DataFrame:
    o = t.marks.select("item_id", "type", F.concat(*[F.col(c).cast("int").cast("string") for c in ("judge_correct", "judge_faithful", "judge_declined")]).alias("outcome"))
    c = o.groupBy("type", "outcome").agg(F.count("*").alias("n"))
    w = Window.partitionBy("type", "outcome").orderBy(F.md5(F.col("item_id").cast("string").cast("binary")), "item_id")
    # only 12 of a type are drawn, so no outcome gives more than 12
    r = o.withColumn("round", F.row_number().over(w)).where("round <= 12").join(c, ["type", "outcome"])
    return r.withColumn("place", F.row_number().over(Window.partitionBy("type").orderBy("round", "n", "outcome")).cast("long")).where("place <= 12").select("type", "item_id", "outcome", "place")


@query("""select arm, count(*) filter (where finish_length) as truncated, round(avg(parsed::int), 6) as parse_rate from (select arm, out_tokens >= 300 as finish_length, correct is not null as parsed from arms) group by arm""")
def parse_rate(t: Tables) -> DataFrame:
    return t.arms.groupBy("arm").agg(F.count_if(F.col("out_tokens") >= 300).alias("truncated"), F.round(F.avg(F.col("correct").isNotNull().cast("int")), 6).alias("parse_rate"))


@query("""select arm, median(in_tokens) as median_in, quantile_disc(in_tokens, 0.9) as p90_in, median(out_tokens) as median_out, quantile_disc(out_tokens, 0.9) as p90_out from arms group by arm""")
def usage_table(t: Tables) -> DataFrame:
    p90 = lambda c: F.expr(f"percentile_disc(0.9) within group (order by {c})").cast("long")
    return t.arms.groupBy("arm").agg(F.median("in_tokens").alias("median_in"), p90("in_tokens").alias("p90_in"), F.median("out_tokens").alias("median_out"), p90("out_tokens").alias("p90_out"))


@query("select item_id from arms where arm in (1, 2, 3) group by item_id having count(distinct arm) = 3")
def tasks_in_all_modes(t: Tables) -> DataFrame:
    return t.arms.where("arm in (1, 2, 3)").groupBy("item_id").agg(F.countDistinct("arm").alias("n")).where("n = 3").select("item_id")


@query("""select type, case when bool_and(hand_correct is not null) then count(*) filter (where hand_correct) end as by_hand, count(*) filter (where judge_correct) as by_rule, count(*) filter (where judge_correct <> hand_correct) as disagreements from marks group by type""")
def rule_vs_reading(t: Tables) -> DataFrame:
    return t.marks.groupBy("type").agg(F.when(F.bool_and(F.col("hand_correct").isNotNull()), F.count_if("hand_correct")).alias("by_hand"), F.count_if("judge_correct").alias("by_rule"), F.count_if(F.expr("judge_correct <> hand_correct")).alias("disagreements"))


@query("""select arm, round(avg((answerable and correct and faithful)::int) filter (where type in ('t0', 't1')), 6) as rate_single, median(in_tokens) as median_input, round(median(latency), 6) as median_seconds,
 round(sum(in_tokens * 0.1 + out_tokens * 2.0) / count(*) / 1000000, 10) as mean_cost from arms group by arm""")
def arm_cost_latency(t: Tables) -> DataFrame:
    return t.arms.groupBy("arm").agg(F.round(F.avg(F.when(F.col("type").isin("t0", "t1"), F.expr("answerable and correct and faithful").cast("int"))), 6).alias("rate_single"), F.median("in_tokens").alias("median_input"), F.round(F.median("latency"), 6).alias("median_seconds"), F.round(F.sum(F.col("in_tokens") * 0.1 + F.col("out_tokens") * 2.0) / F.count("*") / 1000000, 10).alias("mean_cost"))


@query("select type, min(item_id) as item_id from arms where answerable and not correct and evidence_rank <= 5 group by type")
def first_matching(t: Tables) -> DataFrame:
    return t.arms.where("answerable and not correct and evidence_rank <= 5").groupBy("type").agg(F.min("item_id").alias("item_id"))


@query("select a.item_id from (select item_id from arms where arm = 1) a semi join (select item_id from arms where arm = 2) b on a.item_id = b.item_id")
def intersect_pairs(t: Tables) -> DataFrame:
    return t.arms.where("arm = 1").select("item_id").intersect(t.arms.where("arm = 2").select("item_id"))


@query("""select arm, case when count(first_thinking) = 0 then round(median(latency), 6) else round(median(latency) filter (where first_thinking is not null), 6) end as median_first
 from (select arm, latency, case when arm % 2 = 0 then evidence_rank end as first_thinking from arms) group by arm""")
def first_token_rows(t: Tables) -> DataFrame:
    a = t.arms.withColumn("first_thinking", F.when(F.col("arm") % 2 == 0, F.col("evidence_rank")))
    return a.groupBy("arm").agg(F.round(F.when(F.count("first_thinking") == 0, F.median("latency")).otherwise(F.median(F.when(F.col("first_thinking").isNotNull(), F.col("latency")))), 6).alias("median_first"))
