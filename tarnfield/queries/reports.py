"""Reports over conditions: pre-stated claims as rows, and the tables that charts are drawn from.

Each arm stands for a condition of an experiment. A report is one aggregate over the item log, whose
few rows are compared afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.functions import stats as S
from tarnfield.queries.evaluation import _w
from tarnfield.queries.registry import Tables, query

RIGHT = "coalesce(correct and faithful, false)"
HANDLED = f"case when answerable then {RIGHT} else coalesce(declined, false) end"


def _claims(df: DataFrame, claims: dict[str, str]) -> DataFrame:
    """claim, holds: one row for each expression over the single row of df."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("claim"), F.expr(v).alias("holds")) for k, v in claims.items()])))


def _claims_sql(facts: str, claims: dict[str, str]) -> str:
    return f"with f as ({facts}) " + " union all ".join(f"select '{k}' as claim, {v} as holds from f" for k, v in claims.items())


def _facts(df: DataFrame, facts: dict[str, str]) -> DataFrame:
    return df.agg(*[F.count_if(F.expr(v)).alias(k) for k, v in facts.items()])


def _facts_sql(facts: dict[str, str], view: str = "arms") -> str:
    return f"select {', '.join(f'count(*) filter (where {v}) as {k}' for k, v in facts.items())} from {view}"


FIRST_SYSTEM = {
    "wrong": f"arm = 1 and answerable and not {RIGHT}",
    "wrong_rank": f"arm = 1 and answerable and not {RIGHT} and evidence_rank between 6 and 20",
    "wrong_search": f"arm = 1 and answerable and not {RIGHT} and evidence_rank is null",
    "found_t0": "arm = 1 and answerable and type = 't0' and evidence_rank <= 5",
    "found_t1": "arm = 1 and answerable and type = 't1' and evidence_rank <= 5",
    "leaked": "arm = 1 and asker = 'public' and leaked",
    "declined": "arm = 1 and not answerable and coalesce(declined, false)",
    "undeclined": "arm = 1 and not answerable and not coalesce(declined, false)",
}
FIRST_CLAIMS = {"ranking_loses_most": "wrong_rank > wrong_search", "half_lost_before_answer": "2 * (wrong_rank + wrong_search) >= wrong", "t0_found_more": "found_t0 > found_t1", "leaks_happen": "leaked > 0", "declines_under_half": "declined < undeclined"}


@query(_claims_sql(_facts_sql(FIRST_SYSTEM), FIRST_CLAIMS))
def claims_first_system(t: Tables) -> DataFrame:
    return _claims(_facts(t.arms, FIRST_SYSTEM), FIRST_CLAIMS)


JUDGE = {"n": "true", "same_correct": "judge_correct = hand_correct", "same_faithful": "judge_faithful = hand_faithful", "too_kind": "judge_correct and not hand_correct", "too_hard": "not judge_correct and hand_correct"}
JUDGE_CLAIMS = {"correct_90": "same_correct >= 0.9 * n", "faithful_90": "same_faithful >= 0.9 * n", "errs_on_the_kind_side": "too_kind > too_hard"}


@query(_claims_sql(_facts_sql(JUDGE, "marks"), JUDGE_CLAIMS))
def claims_judge(t: Tables) -> DataFrame:
    return _claims(_facts(t.marks, JUDGE), JUDGE_CLAIMS)


COMPARE = {f"{k}_{a}": f"arm = {a} and {v}" for a in (1, 2, 3) for k, v in {"found": "answerable and evidence_rank <= 5", "right": f"answerable and {RIGHT}", "leaks": "asker = 'public' and leaked", "short": "in_tokens < 50", "cut": "answerable and evidence_rank is null", "above": "answerable and evidence_rank > 1"}.items()}
CHUNKING_CLAIMS = {"middle_size_is_best": "found_2 >= found_1 and found_2 >= found_3", "fewer_cuts": "cut_2 <= cut_1", "search_gain_reaches_answers": "(found_2 - found_1) * (right_2 - right_1) >= 0"}
SEARCH_CLAIMS = {"fusion_beats_both": "found_3 > found_1 and found_3 > found_2", "lookalikes_fall": "above_3 < above_1"}
FILTER_CLAIMS = {"before_not_below_after": "found_1 >= found_2", "no_leaks": "leaks_1 = 0", "after_leaves_short_prompts": "short_2 > short_1"}


@query(_claims_sql(_facts_sql(COMPARE), CHUNKING_CLAIMS))
def claims_chunking(t: Tables) -> DataFrame:
    return _claims(_facts(t.arms, COMPARE), CHUNKING_CLAIMS)


@query(_claims_sql(_facts_sql(COMPARE), SEARCH_CLAIMS))
def claims_search(t: Tables) -> DataFrame:
    return _claims(_facts(t.arms, COMPARE), SEARCH_CLAIMS)


@query(_claims_sql(_facts_sql(COMPARE), FILTER_CLAIMS))
def claims_filters(t: Tables) -> DataFrame:
    return _claims(_facts(t.arms, COMPARE), FILTER_CLAIMS)


@query(f"""with h as (select arm, count(*) filter (where {HANDLED}) as handled, count(*) as items from arms group by arm)
select arm, handled, items, round({_w('handled', 'items', 'low')}, 6) as low, round({_w('handled', 'items', 'high')}, 6) as high, rank() over (order by handled desc) as place from h""")
def report_prompts(t: Tables) -> DataFrame:
    h = t.arms.groupBy("arm").agg(F.count_if(F.expr(HANDLED)).alias("handled"), F.count("*").alias("items"))
    w = S.safe_wilson(F.col("handled"), F.col("items"))
    return h.select("arm", "handled", "items", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"), F.rank().over(Window.orderBy(F.desc("handled"))).cast("long").alias("place"))


@query(f"""with p as (select a.item_id, a.arm, {HANDLED} as h from arms a), b as (select item_id, h as base from p where arm = 1)
select p.arm, count(*) filter (where base and not h) as lost, count(*) filter (where h and not base) as gained, count(*) filter (where h <> base) as changed_hands, count(*) filter (where h) - count(*) filter (where base) as net from p join b on p.item_id = b.item_id where p.arm <> 1 group by p.arm""")
def report_model_change(t: Tables) -> DataFrame:
    p = t.arms.select("item_id", "arm", F.expr(HANDLED).alias("h"))
    base = p.where("arm = 1").select("item_id", F.col("h").alias("base"))
    x = p.where("arm <> 1").join(base, "item_id")
    return x.groupBy("arm").agg(F.count_if(F.expr("base and not h")).alias("lost"), F.count_if(F.expr("h and not base")).alias("gained"), F.count_if(F.expr("h <> base")).alias("changed_hands"), (F.count_if("h") - F.count_if("base")).alias("net"))


@query(f"select flag, arm, count(*) filter (where {HANDLED}) as handled, count(*) as items from arms group by flag, arm")
def report_pipeline_by_model(t: Tables) -> DataFrame:
    return t.arms.groupBy("flag", "arm").agg(F.count_if(F.expr(HANDLED)).alias("handled"), F.count("*").alias("items"))


@query(f"""with b as (select arm, count(*) filter (where {HANDLED}) as own, count(*) filter (where faithful) as board, sum(in_tokens * 0.5 + out_tokens * 2.0) / 1000000 as cost from arms group by arm)
select arm, own, board, dense_rank() over (order by own desc) as own_rank, dense_rank() over (order by board desc) as board_rank, round(cost / min(cost) over (), 2) as cost_ratio from b""")
def report_leaderboard(t: Tables) -> DataFrame:
    b = t.arms.groupBy("arm").agg(F.count_if(F.expr(HANDLED)).alias("own"), F.count_if("faithful").alias("board"), (F.sum(F.col("in_tokens") * 0.5 + F.col("out_tokens") * 2.0) / 1000000).alias("cost"))
    place = lambda c: F.dense_rank().over(Window.orderBy(F.desc(c))).cast("long")
    return b.select("arm", "own", "board", place("own").alias("own_rank"), place("board").alias("board_rank"), F.round(F.col("cost") / F.min("cost").over(Window.partitionBy()), 2).alias("cost_ratio"))


@query("""with b as (select arm, count(*) filter (where correct) as own, count(*) filter (where faithful) as board from arms group by arm)
select a.arm as arm1, c.arm as arm2 from b a join b c on a.arm < c.arm where (a.own - c.own) * (a.board - c.board) < 0""")
def report_reversed_pairs(t: Tables) -> DataFrame:
    b = t.arms.groupBy("arm").agg(F.count_if("correct").alias("own"), F.count_if("faithful").alias("board"))
    o = b.select(F.col("arm").alias("arm2"), F.col("own").alias("own2"), F.col("board").alias("board2"))
    return b.join(o, F.col("arm") < F.col("arm2")).where("(own - own2) * (board - board2) < 0").select(F.col("arm").alias("arm1"), "arm2")


_FOUR = {"search": "answerable and evidence_rank <= 5", "answer": f"answerable and {RIGHT}", "not_found": "not answerable and coalesce(declined, false)", "leaks": "asker = 'public' and leaked"}


@query("with s as (" + " union all ".join(f"select '{k}' as number, count(*) filter (where arm = 1 and {v}) as first, count(*) filter (where arm = 7 and {v}) as final from arms" for k, v in _FOUR.items()) + ") select number, first, final from s")
def season_recap(t: Tables) -> DataFrame:
    wide = t.arms.where("arm in (1, 7)").agg(*[F.count_if(F.expr(f"arm = {a} and {v}")).alias(f"{k}_{a}") for k, v in _FOUR.items() for a in (1, 7)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(k).alias("number"), F.col(f"{k}_1").alias("first"), F.col(f"{k}_7").alias("final")) for k in _FOUR])))


@query("""with c as (select arm, type, flag, count(*) filter (where correct) as hits, count(*) as n from arms group by 1, 2, 3)
select type, flag, max(case when arm = 1 then round(hits / n, 6) end) as arm1, max(case when arm = 2 then round(hits / n, 6) end) as arm2, max(case when arm = 3 then round(hits / n, 6) end) as arm3 from c group by type, flag""")
def chart_heatmap(t: Tables) -> DataFrame:
    a = t.arms.where("arm in (1, 2, 3)").groupBy("type", "flag").pivot("arm", [1, 2, 3]).agg(F.round(F.count_if("correct") / F.count(F.lit(1)), 6))
    return a.select("type", "flag", F.col("1").alias("arm1"), F.col("2").alias("arm2"), F.col("3").alias("arm3"))


@query("""with m as (select a.type, a.in_tokens as i1, b.in_tokens as i2, a.correct as c1, b.correct as c2 from arms a join arms b on a.item_id = b.item_id where a.arm = 1 and b.arm = 2)
select type, median(i2) - median(i1) as extra_tokens, round(avg(coalesce(c2, false)::int) - avg(coalesce(c1, false)::int), 6) as gain from m group by type""")
def chart_cost_of_accuracy(t: Tables) -> DataFrame:
    a = t.arms.where("arm in (1, 2)").groupBy("item_id", "type").pivot("arm", [1, 2]).agg(F.max("in_tokens").alias("i"), F.max(F.coalesce("correct", F.lit(False)).cast("int")).alias("c"))
    a = a.where("1_i is not null and 2_i is not null")
    return a.groupBy("type").agg((F.median("2_i") - F.median("1_i")).alias("extra_tokens"), F.round(F.avg("2_c") - F.avg("1_c"), 6).alias("gain"))
