"""Reports of single experiments: their pre-stated claims, and the report that joins all measures of an arm.

The arms of the log stand for conditions: arm 1 is the reference, the types t0 to t3 for kinds of items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.functions import stats as S
from tarnfield.functions import text as X
from tarnfield.queries.evaluation import _MCNEMAR_SQL, _w
from tarnfield.queries.registry import Tables, query
from tarnfield.queries.reports import HANDLED, RIGHT, _claims, _claims_sql, _facts, _facts_sql

FOUND = "answerable and evidence_rank <= 5"


def _below(a: str, b: str) -> str:
    """The interval of count a of n_a lies below that of count b: both SQL dialects read it. a and b: (count, total) columns."""
    (c1, n1), (c2, n2) = a.split("/"), b.split("/")
    return f"({_w(c1, n1, 'high')}) < ({_w(c2, n2, 'low')})"


def _same_way(search: str, answer: str, a: int, b: int) -> str:
    """Two changes from arm a to arm b that are both up, both down or both none."""
    ds, da = f"({search}_{b} - {search}_{a})", f"({answer}_{b} - {answer}_{a})"
    return f"({ds} > 0) = ({da} > 0) and ({ds} < 0) = ({da} < 0)"


def _by_arm(arms: tuple[int, ...], facts: dict[str, str]) -> dict[str, str]:
    return {f"{k}_{a}": f"arm = {a} and {v}" for a in arms for k, v in facts.items()}


_KINDS = {"followup": "t0", "two_part": "t1", "bridge": "t2"}
REWRITING = _by_arm((1, 2, 3, 4), {
    **{k: f"type = '{v}' and {FOUND}" for k, v in _KINDS.items()}, **{f"n_{k}": f"type = '{v}'" for k, v in _KINDS.items()},
    "other": f"type = 't3' and {FOUND}", "n_other": "type = 't3' and answerable", "found": FOUND, "right": f"answerable and {RIGHT}",
})
REWRITING_CLAIMS = {
    "resolving_finds_followups": _below("followup_1/n_followup_1", "followup_4/n_followup_4"),
    "splitting_finds_two_parts": _below("two_part_1/n_two_part_1", "two_part_3/n_two_part_3"),
    "no_rewrite_solves_bridges": " and ".join(f"bridge_{a} <= 5" for a in (1, 2, 3, 4)),
    "rewriting_all_does_not_hurt": f"not ({_below('other_2/n_other_2', 'other_1/n_other_1')})",
    "search_gain_reaches_answers": _same_way("found", "right", 1, 4),
}


@query(_claims_sql(_facts_sql(REWRITING), REWRITING_CLAIMS))
def claims_rewriting(t: Tables) -> DataFrame:
    return _claims(_facts(t.arms, REWRITING), REWRITING_CLAIMS)


@query(f"""with r as (select arm, count(*) filter (where type = 't0' and {FOUND}) + count(*) filter (where type = 't1' and {FOUND}) as found from arms where arm in (1, 2, 3, 4) group by arm)
select arm as chosen, found from r order by found desc, arm limit 1""")
def choose_rewriting(t: Tables) -> DataFrame:
    """The mode that finds most passages of the types it is for; the simplest of the best."""
    r = t.arms.where("arm in (1, 2, 3, 4)").groupBy("arm").agg(F.count_if(F.expr(f"type in ('t0', 't1') and {FOUND}")).alias("found"))
    return r.orderBy(F.desc("found"), "arm").limit(1).select(F.col("arm").alias("chosen"), "found")


RERANKING = _by_arm((1, 2, 3), {"found": FOUND, "n": "answerable", "above": "type = 't1' and evidence_rank > 1", "right": f"answerable and {RIGHT}"})
RERANKING_CLAIMS = {
    "reranking_finds_more": _below("found_1/n_1", "found_2/n_2"),
    "fewer_lookalikes_above": "above_2 < above_1",
    "longer_shortlist_finds_more": "found_3 >= found_2",
    "search_gain_reaches_answers": _same_way("found", "right", 1, 2),
}


@query(_claims_sql(_facts_sql(RERANKING), RERANKING_CLAIMS))
def claims_reranking(t: Tables) -> DataFrame:
    return _claims(_facts(t.arms, RERANKING), RERANKING_CLAIMS)


@query(f"""select arm, count(*) as items, count(*) filter (where {FOUND}) as found, round({_w(f'count(*) filter (where {FOUND})', 'count(*)', 'low')}, 6) as low, count(*) filter (where evidence_rank > 1) as above from arms where type = 't1' and answerable group by arm""")
def reranker_subset(t: Tables) -> DataFrame:
    """One reranker's measures on the items with look-alikes alone."""
    a = t.arms.where("type = 't1' and answerable").groupBy("arm").agg(F.count("*").alias("items"), F.count_if(F.expr(FOUND)).alias("found"), F.count_if(F.col("evidence_rank") > 1).alias("above"))
    return a.select("arm", "items", "found", F.round(S.safe_wilson(F.col("found"), F.col("items"))["low"], 6).alias("low"), "above")


_ANSWERED = "correct is not null and not coalesce(declined, false)"
CITING = _by_arm((1, 2), {
    "answered": _ANSWERED, "citing": f"{_ANSWERED} and flag <> 'N'", "right_answered": f"answerable and {_ANSWERED} and correct", "right_citing": f"answerable and {_ANSWERED} and correct and flag = 'A'",
    "faithful": f"answerable and {_ANSWERED} and coalesce(faithful, false)", "could": f"answerable and {_ANSWERED}", "right": f"answerable and {RIGHT}", "n": "answerable", "handled": f"({HANDLED})", "items": "true",
})
CITING_CLAIMS = {
    "asked_to_cite_it_cites": "10 * citing_2 >= 9 * answered_2",
    "right_answers_cite_evidence": "10 * right_citing_2 >= 8 * right_answered_2",
    "grounding_is_more_faithful": "faithful_2 * could_1 > faithful_1 * could_2",
    "grounding_costs_no_answers": f"not ({_below('right_2/n_2', 'right_1/n_1')})",
    "joins": f"10 * citing_2 >= 9 * answered_2 and not ({_below('right_2/n_2', 'right_1/n_1')}) and not ({_below('handled_2/items_2', 'handled_1/items_1')})",
}


@query(_claims_sql(_facts_sql(CITING), CITING_CLAIMS))
def claims_citing(t: Tables) -> DataFrame:
    return _claims(_facts(t.arms, CITING), CITING_CLAIMS)


_CITED_TEXT = "concat('It is so [P', cast(coalesce(evidence_rank, 0) as string), '] and [P2-P', cast(1 + arm as string), '].')"


@query(rf"""with a as (select item_id, arm, {_CITED_TEXT} as answer, evidence_rank as good, correct from arms where {_ANSWERED} and answerable),
g as (select item_id, arm, good, correct, unnest(regexp_extract_all(answer, '\[P(\d+)(?:\s*[,–-]\s*P?(\d+))?\]', 1))::int as lo, unnest(regexp_extract_all(answer, '\[P(\d+)(?:\s*[,–-]\s*P?(\d+))?\]', 2)) as hi from a),
s as (select distinct item_id, arm, good, correct, unnest(range(greatest(lo, 1), least(case when coalesce(hi, '') = '' then lo else hi::int end, 5) + 1)) as p from g),
i as (select item_id, arm, correct, count(*) as citations, count(*) filter (where p = good) as supported from s group by 1, 2, 3)
select arm, sum(citations)::bigint as citations, sum(supported)::bigint as supported, count(*) filter (where supported = 0) as only_unsupported, count(*) filter (where correct and supported > 0) as right_citing_evidence from i group by arm""")
def citation_report(t: Tables) -> DataFrame:
    """Citations of answers, and how many name a passage with evidence."""
    a = t.arms.where(f"{_ANSWERED} and answerable").select("arm", "correct", F.col("evidence_rank").alias("good"), X.cited(F.expr(_CITED_TEXT), F.lit(5)).alias("cited"))
    a = a.where(F.size("cited") > 0).withColumn("supported", F.coalesce(F.array_contains("cited", F.col("good")), F.lit(False)).cast("long"))
    return a.groupBy("arm").agg(
        F.sum(F.size("cited")).cast("long").alias("citations"), F.sum("supported").alias("supported"),
        F.count_if(F.col("supported") == 0).alias("only_unsupported"), F.count_if(F.expr("correct and supported > 0")).alias("right_citing_evidence"),
    )


_RULE = {"declined_1": "arm = 1 and not answerable and coalesce(declined, false)", "n_1": "arm = 1 and not answerable", "declined_2": "arm = 2 and not answerable and coalesce(declined, false)", "n_2": "arm = 2 and not answerable"}
_RULE_CLAIMS = {
    "same_answers_are_right": "p >= 0.05",
    "declines_alike": f"not ({_below('declined_1/n_1', 'declined_2/n_2')}) and not ({_below('declined_2/n_2', 'declined_1/n_1')})",
    "answers_are_longer": "out_2 >= 1.2 * out_1",
}


@query(f"""with q as (select item_id, bool_or({RIGHT}) filter (where arm = 1) as h1, bool_or({RIGHT}) filter (where arm = 2) as h2 from arms where arm in (1, 2) group by item_id),
s as (select count(*) filter (where h1 and not h2) as b, count(*) filter (where h2 and not h1) as c from q), m as (select {_MCNEMAR_SQL} as p from s),
o as (select median(out_tokens) filter (where arm = 1 and correct is not null) as out_1, median(out_tokens) filter (where arm = 2 and correct is not null) as out_2 from arms),
x as ({_facts_sql(_RULE)}), f as (select * from x, m, o) """ + " union all ".join(f"select '{k}' as claim, {v} as holds from f" for k, v in _RULE_CLAIMS.items()))
def claims_citation_rule(t: Tables) -> DataFrame:
    """Two arms over the same items: which answers change, when they decline, how long they are."""
    a = t.arms.where("arm in (1, 2)")
    hit = lambda n: F.bool_or(F.when(F.col("arm") == n, F.expr(RIGHT)))
    pairs = a.groupBy("item_id").agg(hit(1).alias("h1"), hit(2).alias("h2")).agg(F.count_if(F.expr("h1 and not h2")).alias("b"), F.count_if(F.expr("h2 and not h1")).alias("c"))
    out = lambda n: F.median(F.when((F.col("arm") == n) & F.col("correct").isNotNull(), F.col("out_tokens")))
    facts = a.agg(out(1).alias("out_1"), out(2).alias("out_2"), *[F.count_if(F.expr(v)).alias(k) for k, v in _RULE.items()])
    return _claims(facts.join(pairs.select(S.mcnemar(F.col("b"), F.col("c")).alias("p"))), _RULE_CLAIMS)


_SWAP_CLAIMS = {"larger_finds_more": "net > 0", "totals_hide_changes": "changed >= 5 * abs(net)", "search_gain_reaches_answers": "(net > 0) = (right > 0) and (net < 0) = (right < 0)"}


@query(f"""with q as (select item_id, bool_or(coalesce({FOUND}, false)) filter (where arm = 1) as h1, bool_or(coalesce({FOUND}, false)) filter (where arm = 2) as h2,
 bool_or({RIGHT}) filter (where arm = 1) as r1, bool_or({RIGHT}) filter (where arm = 2) as r2 from arms where arm in (1, 2) and answerable group by item_id),
f as (select count(*) filter (where h1 <> h2) as changed, count(*) filter (where h2) - count(*) filter (where h1) as net, count(*) filter (where r2) - count(*) filter (where r1) as right from q where h1 is not null and h2 is not null) """.replace("as right from", "as gain from") + " union all ".join(f"select '{k}' as claim, {v.replace('right', 'gain')} as holds from f" for k, v in _SWAP_CLAIMS.items()))
def claims_embedding_swap(t: Tables) -> DataFrame:
    """Items that change hands between two arms, beside the change of the total."""
    of = lambda n, what: F.bool_or(F.when(F.col("arm") == n, F.coalesce(F.expr(what), F.lit(False))))
    q = t.arms.where("arm in (1, 2) and answerable").groupBy("item_id").agg(of(1, FOUND).alias("h1"), of(2, FOUND).alias("h2"), of(1, RIGHT).alias("r1"), of(2, RIGHT).alias("r2"))
    f = q.where("h1 is not null and h2 is not null").agg(F.count_if(F.expr("h1 <> h2")).alias("changed"), (F.count_if("h2") - F.count_if("h1")).alias("net"), (F.count_if("r2") - F.count_if("r1")).alias("right"))
    return _claims(f, _SWAP_CLAIMS)


@query(r"""with k as (select sum(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')))::bigint as tokens from documents), p as (select * from (values ('small', 0.02::double), ('large', 0.13::double)) v(model, price))
select model, tokens as library_tokens, round(tokens * price / 1000000, 4) as cost, round(tokens * price / 1000000 * 1000, 2) as cost_1000x from k, p""")
def embedding_cost(t: Tables) -> DataFrame:
    """What embedding the library again costs under each price per million tokens."""
    k = t.documents.agg(F.sum(X.token_count(F.col("text"))).alias("tokens"))
    price = F.explode(F.create_map(F.lit("small"), F.lit(0.02), F.lit("large"), F.lit(0.13))).alias("model", "price")
    cost = F.col("tokens") * F.col("price") / 1000000
    return k.select("tokens", price).select("model", F.col("tokens").alias("library_tokens"), F.round(cost, 4).alias("cost"), F.round(cost * 1000, 2).alias("cost_1000x"))


_LONG = _by_arm((1, 7), {"hard": f"type in ('t0', 't1') and {RIGHT}", "n_hard": "type in ('t0', 't1')", "easy": f"type in ('t2', 't3') and {RIGHT}", "n_easy": "type in ('t2', 't3')"})
_LONG_CLAIMS = {
    "everything_beats_retrieval_on_hard": _below("hard_1/n_hard_1", "hard_7/n_hard_7"),
    "retrieval_loses_nothing_on_easy": f"not ({_below('easy_1/n_easy_1', 'easy_7/n_easy_7')}) and not ({_below('easy_7/n_easy_7', 'easy_1/n_easy_1')})",
    "costs_many_times_more": "tokens_7 >= 20 * tokens_1",
    "is_slower": "seconds_7 >= 3 * seconds_1",
}


@query(f"with x as ({_facts_sql(_LONG)}), o as (select " + ", ".join(f"median({c}) filter (where arm = {a}) as {k}_{a}" for a in (1, 7) for k, c in (("tokens", "in_tokens"), ("seconds", "latency"))) + " from arms), f as (select * from x, o) " + " union all ".join(f"select '{k}' as claim, {v} as holds from f" for k, v in _LONG_CLAIMS.items()))
def claims_long_context(t: Tables) -> DataFrame:
    medians = [F.median(F.when(F.col("arm") == a, F.col(c))).alias(f"{k}_{a}") for a in (1, 7) for k, c in (("tokens", "in_tokens"), ("seconds", "latency"))]
    facts = t.arms.agg(*medians, *[F.count_if(F.expr(v)).alias(k) for k, v in _LONG.items()])
    return _claims(facts, _LONG_CLAIMS)


_WRONG = f"answerable and correct is not null and not {RIGHT}"
TRACING = {
    "wrong": f"arm = 7 and {_WRONG}", "outside": f"arm = 7 and {_WRONG} and evidence_rank > 20", "inside": f"arm = 7 and {_WRONG} and evidence_rank between 6 and 20",
    "two_types": f"arm = 7 and {_WRONG} and type in ('t0', 't1')", "undeclined": "arm = 7 and not answerable and correct is not null and not coalesce(declined, false)",
    "absent": "arm = 7 and not answerable and correct is not null and not coalesce(declined, false) and type = 't3'",
}
TRACING_CLAIMS = {"losses_before_the_reranker": "outside + inside > 0 and outside * 2 >= outside + inside", "failures_sit_in_two_types": "two_types >= 0.6 * wrong", "topic_but_not_the_detail": "absent * 2 >= undeclined and undeclined > 0"}


@query(_claims_sql(_facts_sql(TRACING), TRACING_CLAIMS))
def claims_tracing(t: Tables) -> DataFrame:
    return _claims(_facts(t.arms, TRACING), TRACING_CLAIMS)


@query(f"""with c as (select arm, count(*) as items, count(*) filter (where {FOUND}) as found, count(*) filter (where answerable) as answerable, count(*) filter (where answerable and {RIGHT}) as right_answers,
 count(*) filter (where not answerable and coalesce(declined, false)) as declined, count(*) filter (where asker = 'public' and leaked) as leaks, count(*) filter (where {_WRONG}) as wrong, bool_and(correct is not null) as complete from arms group by arm),
h as (select item_id, arm, coalesce({FOUND}, false) as s, {RIGHT} as a from arms),
p as (select o.arm, count(*) filter (where o.s and not r.s) as search_gained, count(*) filter (where r.s and not o.s) as search_lost, count(*) filter (where o.a and not r.a) as answers_gained, count(*) filter (where r.a and not o.a) as answers_lost from h o join h r on o.item_id = r.item_id and r.arm = 1 where o.arm <> 1 group by o.arm),
m as (select arm, search_gained, search_lost, answers_gained, answers_lost, (select {_MCNEMAR_SQL} from (select p.search_lost as b, p.search_gained as c)) as p_search from p)
select c.arm, items, found, round({_w('found', 'answerable', 'low')}, 6) as found_low, round({_w('found', 'answerable', 'high')}, 6) as found_high, right_answers, declined, leaks, wrong, complete, search_gained, search_lost, answers_gained, answers_lost, round(p_search, 6) as p_search from c left join m on c.arm = m.arm""")
def episode_report(t: Tables) -> DataFrame:
    """A row for each condition: its four numbers with an interval, its wrong answers, and the paired change from the reference."""
    c = t.arms.groupBy("arm").agg(
        F.count("*").alias("items"), F.count_if(F.expr(FOUND)).alias("found"), F.count_if("answerable").alias("answerable"), F.count_if(F.expr(f"answerable and {RIGHT}")).alias("right_answers"),
        F.count_if(F.expr("not answerable and coalesce(declined, false)")).alias("declined"), F.count_if(F.expr("asker = 'public' and leaked")).alias("leaks"), F.count_if(F.expr(_WRONG)).alias("wrong"),
        F.bool_and(F.col("correct").isNotNull()).alias("complete"),
    )
    h = t.arms.select("item_id", "arm", F.coalesce(F.expr(FOUND), F.lit(False)).alias("s"), F.expr(RIGHT).alias("a"))
    ref = h.where("arm = 1").select("item_id", F.col("s").alias("rs"), F.col("a").alias("ra"))
    count = lambda e, k: F.count_if(F.expr(e)).alias(k)
    p = h.where("arm <> 1").join(ref, "item_id").groupBy("arm").agg(count("s and not rs", "search_gained"), count("rs and not s", "search_lost"), count("a and not ra", "answers_gained"), count("ra and not a", "answers_lost"))
    p = p.withColumn("p_search", F.round(S.mcnemar(F.col("search_lost"), F.col("search_gained")), 6))
    w = S.safe_wilson(F.col("found"), F.col("answerable"))
    return c.join(p, "arm", "left").select("arm", "items", "found", F.round(w["low"], 6).alias("found_low"), F.round(w["high"], 6).alias("found_high"), "right_answers", "declined", "leaks", "wrong", "complete", "search_gained", "search_lost", "answers_gained", "answers_lost", "p_search")


@query("""with c as (select user_id % 50 as condition, lower(trim(event_type)) as answer, event_type = 'error' as failed, event_id from events)
select condition, case when failed then null else answer end as answer, count(*) as n, min(event_id) as first_seen from c group by 1, 2""")
def repeated_call_answers(t: Tables) -> DataFrame:
    """Answers of a call that is made again and again, counted; calls without an answer stand apart."""
    c = t.events.select((F.col("user_id") % 50).alias("condition"), F.when(F.col("event_type") != "error", F.lower(F.trim("event_type"))).alias("answer"), "event_id")
    return c.groupBy("condition", "answer").agg(F.count("*").alias("n"), F.min("event_id").alias("first_seen"))


@query("""with c as (select arm, sum(in_tokens * p.price_in + out_tokens * p.price_out) / 1000000 as cost from arms left join prices p on p.provider = concat('p', cast(arm % 3 as varchar)) group by arm),
k as (select * from (values (1, 1.0::double), (2, 2.5::double), (3, 3.5::double)) v(arm, committed))
select c.arm, round(coalesce(c.cost / (select min(cost) from c), k.committed), 4) as ratio, c.cost is null as kept from c left join k on c.arm = k.arm""")
def cost_ratios_or_kept(t: Tables) -> DataFrame:
    """Each arm's cost over the cheapest's; where a price is missing, the ratio of an earlier report stands."""
    a = t.arms.withColumn("provider", F.concat(F.lit("p"), (F.col("arm") % 3).cast("string"))).join(F.broadcast(t.prices), "provider", "left")
    c = a.groupBy("arm").agg((F.sum(F.col("in_tokens") * F.col("price_in") + F.col("out_tokens") * F.col("price_out")) / 1000000).alias("cost"))
    low = c.agg(F.min("cost").alias("low"))
    kept = F.create_map(F.lit(1), F.lit(1.0), F.lit(2), F.lit(2.5), F.lit(3), F.lit(3.5))
    return c.join(F.broadcast(low)).select("arm", F.round(F.coalesce(F.col("cost") / F.col("low"), F.get(F.array(kept), F.lit(0))[F.col("arm")]), 4).alias("ratio"), F.col("cost").isNull().alias("kept"))


@query("""with a as (select ps_partkey as p, ps_key from (select l_partkey as ps_partkey, l_suppkey as ps_key from lineitem group by 1, 2)), f as (select concat('a', cast(p % 40 as varchar), '/', cast(ps_key as varchar)) as fact_id, p % 40 as attribute, ps_key as entity from a group by 1, 2, 3)
select f.fact_id, w.fact_id as twin from f left join f w on w.entity = f.entity and w.attribute = f.attribute + 1 and f.attribute % 2 = 0""")
def twin_facts(t: Tables) -> DataFrame:
    """Each fact with its twin: the fact of the paired attribute about the same entity, null if there is none."""
    from tarnfield.operators import corpus_build as B

    f = t.lineitem.select((F.col("l_partkey") % 40).alias("attribute"), F.col("l_suppkey").alias("entity")).distinct()
    f = f.withColumn("twin_of", F.when(F.col("attribute") % 2 == 0, F.col("attribute") + 1))
    f = f.withColumn("fact_id", F.concat(F.lit("a"), F.col("attribute").cast("string"), F.lit("/"), F.col("entity").cast("string")))
    return B.with_twins(f).select("fact_id", "twin")


@query("""with f as (select p_partkey as fact_id, p_size as attribute, p_brand as entity from part),
r as (select f.fact_id, o.fact_id as sibling, row_number() over (partition by f.fact_id order by md5(concat(cast(f.fact_id as varchar), ':', cast(o.fact_id as varchar))), o.fact_id) as n from f join f o on o.attribute = f.attribute and o.entity <> f.entity where f.fact_id % 20 = 0)
select fact_id, sibling from r where n <= 3""")
def sibling_facts(t: Tables) -> DataFrame:
    """For every twentieth fact, three facts of the same attribute about other entities."""
    from tarnfield.operators import corpus_build as B

    f = t.part.select(F.col("p_partkey").alias("fact_id"), F.col("p_size").alias("attribute"), F.col("p_brand").alias("entity"))
    return B.siblings(f.where("fact_id % 20 = 0"), f, 3)


@query("""with a as (select call_id % 300 as task, count(*) as attempts, bool_or(ok) as passed from runs group by 1)
select attempts, count(*) filter (where passed) as passed, count(*) filter (where not passed) as failed from a group by attempts""")
def attempts_histogram(t: Tables) -> DataFrame:
    a = t.runs.groupBy((F.col("call_id") % 300).alias("task")).agg(F.count("*").alias("attempts"), F.bool_or("ok").alias("passed"))
    return a.groupBy("attempts").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


@query("select text, min(conv_id * 1000 + turn) as first_seen from conversations group by text")
def ordered_union_distinct(t: Tables) -> DataFrame:
    """Distinct texts of all turns in the order of their first mention."""
    from tarnfield.operators import retrieval as R

    parts = [t.conversations.where(f"turn % 2 = {k}").select("text", F.expr("conv_id * 1000 + turn").alias("first_seen")) for k in (0, 1)]
    return R.ordered_union(parts, "text", "first_seen")


@query("select item_id, arm, type from arms where type in ('t0', 't2') and flag = 'A' and asker = 'public'")
def select_rows(t: Tables) -> DataFrame:
    from tarnfield.sources import itemlog

    return itemlog.select(itemlog.of_type(t.arms, "t0", "t2"), flag="A", asker="public", arm=None).select("item_id", "arm", "type")


@query("""select md5(string_agg(md5(concat(cast(item_id as varchar), chr(9), text)), '' order by item_id)) as checksum, count(*) as items from benchmark""")
def items_checksum(t: Tables) -> DataFrame:
    from tarnfield.sources import itemlog

    return itemlog.checksum(t.benchmark.select("item_id", "text"), "item_id")
