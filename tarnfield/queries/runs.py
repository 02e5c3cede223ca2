"""The call log, sampling, scorecards, conversations and experiment plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.operators import runlog as R
from tarnfield.operators import scorecard as K
from tarnfield.queries.registry import Tables, query

_LATEST = """la as (select call_id, arg_max(request_hash, line_no) as request_hash from runs group by call_id),
ls as (select r.call_id, r.request_hash, max(line_no) as line_no from runs r join la on r.call_id = la.call_id and r.request_hash = la.request_hash where ok group by 1, 2)"""


@query(f"with {_LATEST} select call_id, request_hash, line_no from ls")
def latest_successful(t: Tables) -> DataFrame:
    return R.latest_successful(t.runs)


_PLAN = "pl as (select c_custkey as call_id, concat('h', cast(c_custkey % 2 as string)) as request_hash from customer)"


def _plan(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("call_id"), F.concat(F.lit("h"), (F.col("c_custkey") % 2).cast("string")).alias("request_hash"))


@query(f"with {_LATEST}, {_PLAN} select call_id, request_hash from pl anti join ls on pl.call_id = ls.call_id and pl.request_hash = ls.request_hash")
def resume_pending(t: Tables) -> DataFrame:
    return R.pending(_plan(t), R.latest_successful(t.runs))


@query(f"with {_LATEST}, {_PLAN} select count(*) as planned, count(ls.line_no) as complete, count(*) filter (where ls.line_no is null and f.call_id is not null) as failed, count(*) filter (where ls.line_no is null and f.call_id is null) as not_run from pl left join ls on pl.call_id = ls.call_id and pl.request_hash = ls.request_hash left join (select distinct call_id, request_hash from runs) f on f.call_id = pl.call_id and f.request_hash = pl.request_hash")
def result_counts(t: Tables) -> DataFrame:
    tried = t.runs.select("call_id", "request_hash", F.lit(True).alias("tried")).distinct()
    x = _plan(t).join(R.latest_successful(t.runs), ["call_id", "request_hash"], "left").join(tried, ["call_id", "request_hash"], "left")
    none = F.col("line_no").isNull()
    return x.agg(F.count("*").alias("planned"), F.count("line_no").alias("complete"), F.count_if(none & F.col("tried").isNotNull()).alias("failed"), F.count_if(none & F.col("tried").isNull()).alias("not_run"))


@query(f"with {_PLAN} select count(*) filter (where r.request_hash = pl.request_hash) as current, count(*) filter (where r.request_hash <> pl.request_hash) as stale, count(distinct r.call_id) filter (where r.request_hash <> pl.request_hash) as stale_calls from runs r join pl on r.call_id = pl.call_id")
def stale_records(t: Tables) -> DataFrame:
    x = t.runs.select("call_id", F.col("request_hash").alias("h")).join(_plan(t), "call_id")
    return x.agg(F.count_if(F.expr("h = request_hash")).alias("current"), F.count_if(F.expr("h <> request_hash")).alias("stale"), F.countDistinct(F.when(F.expr("h <> request_hash"), F.col("call_id"))).alias("stale_calls"))


@query("with f as (select distinct call_id from runs where not ok), s as (select distinct call_id from runs where ok and latency > 100) select count(*) as failed from f anti join s on f.call_id = s.call_id")
def failed_calls(t: Tables) -> DataFrame:
    ok = t.runs.where("ok and latency > 100").select("call_id").distinct()
    return t.runs.where("not ok").select("call_id").distinct().join(ok, "call_id", "left_anti").agg(F.count("*").alias("failed"))


@query("with d as (select event_type, request_hash, provider, min(line_no) as leader from runs group by 1, 2, 3) select r.line_no, d.leader from runs r join d on r.event_type = d.event_type and r.request_hash = d.request_hash and r.provider = d.provider")
def dedup_fanout(t: Tables) -> DataFrame:
    keys = ["event_type", "request_hash", "provider"]
    return t.runs.select(*keys, "line_no").join(t.runs.groupBy(*keys).agg(F.min("line_no").alias("leader")), keys).select("line_no", "leader")


@query("select provider, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, sum(coalesce(reasoning_tokens, 0))::bigint as reasoning_tokens from runs where source = 'api' group by provider")
def token_totals(t: Tables) -> DataFrame:
    return t.runs.where("source = 'api'").groupBy("provider").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(F.coalesce("reasoning_tokens", F.lit(0))).alias("reasoning_tokens"))


@query("""with g as (select provider, model, mode, count(*) as calls, count(*) filter (where ok) as samples, sum(input_tokens)::bigint as input_low, avg(output_tokens) filter (where ok) as mean_out, quantile_disc(output_tokens, 0.9) filter (where ok) as p90_out from runs group by 1, 2, 3)
select g.provider, model, mode, calls, input_low, ceil(input_low * 1.3)::bigint as input_high, round(case when samples >= 3 then mean_out else 256 end * calls, 4) as output_low, case when samples >= 3 then p90_out::double else 256 end * calls as output_high,
 round((input_low * price_in + case when samples >= 3 then mean_out else 256 end * calls * price_out) / 1000000, 8) as cost_low from g left join prices p on g.provider = p.provider""")
def cost_estimate(t: Tables) -> DataFrame:
    g = t.runs.groupBy("provider", "model", "mode").agg(F.count("*").alias("calls"), F.count_if("ok").alias("samples"), F.sum("input_tokens").alias("input_low"), F.avg(F.when(F.col("ok"), F.col("output_tokens"))).alias("mean_out"), F.expr("percentile_disc(0.9) within group (order by case when ok then output_tokens end)").alias("p90_out"))
    enough = F.col("samples") >= 3
    mean, p90 = F.when(enough, F.col("mean_out")).otherwise(256.0), F.when(enough, F.col("p90_out").cast("double")).otherwise(256.0)
    g = g.join(F.broadcast(t.prices), "provider", "left")
    return g.select("provider", "model", "mode", "calls", "input_low", F.ceil(F.col("input_low") * 1.3).cast("long").alias("input_high"), F.round(mean * F.col("calls"), 4).alias("output_low"), (p90 * F.col("calls")).alias("output_high"), F.round((F.col("input_low") * F.col("price_in") + mean * F.col("calls") * F.col("price_out")) / 1000000, 8).alias("cost_low"))


@query("select model, median(output_tokens) as median_out, median(input_tokens) as median_in, count(*) filter (where not ok) as errors, count(*) filter (where output_tokens = 0) as empties, round(median(latency), 6) as median_latency from runs group by model")
def behaviour(t: Tables) -> DataFrame:
    return t.runs.groupBy("model").agg(F.median("output_tokens").alias("median_out"), F.median("input_tokens").alias("median_in"), F.count_if(~F.col("ok")).alias("errors"), F.count_if(F.col("output_tokens") == 0).alias("empties"), F.round(F.median("latency"), 6).alias("median_latency"))


@query("select provider, array_to_string(list_sort(list(distinct model)), ' ') as models from runs group by provider")
def models_returned(t: Tables) -> DataFrame:
    return t.runs.groupBy("provider").agg(F.array_join(F.array_sort(F.collect_set("model")), " ").alias("models"))


@query("select model, case when count(reasoning_tokens) = 0 then 'none reported' when sum(reasoning_tokens) = 0 then 'reported 0' else 'reported' end as reasoning, sum(reasoning_tokens)::bigint as total, max(output_tokens) as max_output from runs group by model")
def reasoning_report(t: Tables) -> DataFrame:
    n, s = F.count("reasoning_tokens"), F.sum("reasoning_tokens")
    return t.runs.groupBy("model").agg(F.when(n == 0, "none reported").when(s == 0, "reported 0").otherwise("reported").alias("reasoning"), s.alias("total"), F.max("output_tokens").alias("max_output"))


@query("select model, coalesce(round(sum(input_tokens) filter (where source = 'cache') / nullif(sum(input_tokens), 0), 6), 0) as cached_share from runs group by model")
def cached_share(t: Tables) -> DataFrame:
    return t.runs.groupBy("model").agg(F.coalesce(F.round(F.try_divide(F.sum(F.when(F.col("source") == "cache", F.col("input_tokens"))), F.sum("input_tokens")), 6), F.lit(0.0)).alias("cached_share"))


@query("""with u as (select line_no, 'reasoning_tokens' as field, case when reasoning_tokens is not null then null when mode = 'high' then 'NOT REPORTED' else 'optional' end as note from runs union all select line_no, 'event_type', case when coalesce(event_type, '') <> '' then null else 'NOT REPORTED' end from runs)
select note, field, count(*) as n from u where note is not null group by 1, 2""")
def null_field_audit(t: Tables) -> DataFrame:
    absent = F.when(F.col("value").isNotNull() & (F.col("value") != ""), None).when((F.col("field") == "reasoning_tokens") & (F.col("mode") != "high"), "optional").otherwise("NOT REPORTED")
    u = t.runs.select("mode", F.expr("stack(2, 'reasoning_tokens', cast(reasoning_tokens as string), 'event_type', event_type) as (field, value)")).withColumn("note", absent)
    return u.where("note is not null").groupBy("note", "field").agg(F.count("*").alias("n"))


@query("""with k as (select user_id, min(ts) as began, min(ts) filter (where event_type = 'view') as thinking, min(ts) filter (where event_type = 'click') as answer, max(ts) as ended from events group by user_id)
select user_id, epoch_us(thinking) - epoch_us(began) as to_thinking, epoch_us(answer) - epoch_us(began) as to_answer, epoch_us(ended) - epoch_us(began) as total from k""")
def stream_clock(t: Tables) -> DataFrame:
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("ts")))
    k = t.events.groupBy("user_id").agg(F.min("ts").alias("began"), first("view").alias("thinking"), first("click").alias("answer"), F.max("ts").alias("ended"))
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return k.select("user_id", *[(us(F.col(a)) - us(F.col("began"))).alias(b) for a, b in (("thinking", "to_thinking"), ("answer", "to_answer"), ("ended", "total"))])


@query("""with a as (select provider, line_no, epoch_us(ts) / 1000000.0::double as arr from runs), n as (select *, row_number() over (partition by provider order by arr, line_no) as n from a)
select line_no, round(max(arr - n * 0.5) over (partition by provider order by arr, line_no rows unbounded preceding) + n * 0.5, 3) as slot from n""")
def rate_limiter_slots(t: Tables) -> DataFrame:
    a = t.runs.select("provider", "line_no", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("at"))
    return R.slots(a, "provider", "at", "line_no", 0.5).select("line_no", F.round("slot", 3).alias("slot"))


@query("""with c as (select call_id, count(*) as n, round(min(latency), 6) as fastest, round(max(latency), 6) as slowest, round(median(latency), 6) as median from runs group by call_id)
select call_id, n, fastest, slowest, median, slowest <= fastest * 1.1 as same from c""")
def timing_spread(t: Tables) -> DataFrame:
    c = t.runs.groupBy("call_id").agg(F.count("*").alias("n"), F.round(F.min("latency"), 6).alias("fastest"), F.round(F.max("latency"), 6).alias("slowest"), F.round(F.median("latency"), 6).alias("median"))
    return c.withColumn("same", F.col("slowest") <= F.col("fastest") * 1.1)


@query("select line_no from runs where (model = 'm1' and mode = 'high') or (provider = 'p2' and finish = 'length')")
def pilot_filter_rules(t: Tables) -> DataFrame:
    rules = [{"model": "m1", "mode": "high"}, {"provider": "p2", "finish": "length"}]
    cell = F.create_map(*[x for k in ("model", "mode", "provider", "finish") for x in (F.lit(k), F.col(k))])
    any_rule = F.lit(False)
    for rule in rules:
        every = F.lit(True)
        for k, v in rule.items():
            every = every & (F.element_at(cell, F.lit(k)) == v)
        any_rule = any_rule | every
    return t.runs.where(any_rule).select("line_no")


@query("""select line_no, case when provider = 'p2' and mode = 'high' then 'reasoning not supported' when output_tokens > 90 and provider <> 'p0' then 'output limit' when model is null then 'unknown model' end as problem from runs""")
def capability_check(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([("p0", True, 1000), ("p1", True, 90), ("p2", False, 90)], "provider string, reasons boolean, output_limit long")
    x = t.runs.join(F.broadcast(rules), "provider", "left")
    problem = F.when(~F.col("reasons") & (F.col("mode") == "high"), "reasoning not supported").when(F.col("output_tokens") > F.col("output_limit"), "output limit").when(F.col("model").isNull(), "unknown model")
    return x.select("line_no", problem.alias("problem"))


@query("select source, provider, count(*) as n from runs where ok group by source, provider")
def cache_partition(t: Tables) -> DataFrame:
    return t.runs.where("ok").groupBy("source", "provider").agg(F.count("*").alias("n"))


@query("with d as (select distinct md5(text) as k from documents), b as (select distinct md5(text) as k from benchmark) select k from b anti join d on b.k = d.k")
def embed_cache_missing(t: Tables) -> DataFrame:
    key = F.md5(F.col("text").cast("binary")).alias("k")
    return t.benchmark.select(key).distinct().join(t.documents.select(key), "k", "left_anti")


@query("select c_custkey from customer except select o_custkey from orders")
def except_missing(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").exceptAll(t.orders.select(F.col("o_custkey").alias("c_custkey")).distinct()).distinct()


@query("with r as (select event_id, event_id % 13 = 0 as cut, event_type from events) select event_type, count(*) filter (where not cut) as good, count(*) as lines from r group by event_type")
def raw_log_skip_corrupt(t: Tables) -> DataFrame:
    line = F.to_json(F.struct("event_id", "event_type"))
    torn = F.when(F.col("event_id") % 13 == 0, F.expr("substring(line, 1, length(line) - 3)")).otherwise(F.col("line"))
    read = t.events.select("event_type", line.alias("line"), "event_id").select("event_type", F.from_json(torn, "event_id long, event_type string, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return read.groupBy("event_type").agg(F.count_if(F.col("r._bad").isNull()).alias("good"), F.count("*").alias("lines"))


# ------------------------------------------------------------------ conversations

_TRIM = "select *, sum(tokens) over (partition by conv_id) as total, max(turn) over (partition by conv_id) as last from turns"


def _trim_sql(pinned: str) -> str:
    return f"""with a as ({_TRIM}), k as (select *, ({pinned}) or turn = last as keep from a), g as (select *, coalesce(sum(case when keep then 0 else tokens end) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as gone from k)
select conv_id, turn from g where keep or total - gone <= 1500"""


@query(_trim_sql("false"))
def trim_naive(t: Tables) -> DataFrame:
    return R.trimmed(t.turns, 1500, F.lit(False)).select("conv_id", "turn")


@query(_trim_sql("role = 'system'"))
def trim_pinned(t: Tables) -> DataFrame:
    return R.trimmed(t.turns, 1500, F.col("role") == "system").select("conv_id", "turn")


@query("with s as (select conv_id, sum(tokens)::bigint as tokens, count(*) as turns from turns group by conv_id), l as (select max(length(text)) as longest from documents) select conv_id, tokens + 3 * longest as bound from s, l")
def prompt_upper_bound(t: Tables) -> DataFrame:
    longest = t.documents.agg(F.max(F.length("text")).alias("longest"))
    return t.turns.groupBy("conv_id").agg(F.sum("tokens").alias("tokens")).join(F.broadcast(longest)).select("conv_id", (F.col("tokens") + 3 * F.col("longest")).alias("bound"))


# ------------------------------------------------------------------ plans and samples

@query("select r.r_name as model, m.mode, p.p_partkey as item_id from region r, (select unnest(['low', 'high']) as mode) m, part p")
def plan_grid(t: Tables) -> DataFrame:
    modes = F.explode(F.array(F.lit("low"), F.lit("high"))).alias("mode")
    return t.part.select(F.col("p_partkey").alias("item_id"), modes).join(F.broadcast(t.region.select(F.col("r_name").alias("model")))).select("model", "mode", "item_id")


@query("""with h as (select c_custkey, c_mktsegment, md5('7:' || c_custkey) as h from customer), f as (select c_custkey from (select *, row_number() over (partition by c_mktsegment order by h, c_custkey) as rn from h) where rn = 1),
r as (select c_custkey from h where c_custkey not in (select c_custkey from f) order by h, c_custkey limit (select greatest(1, round(count(*) * 0.05))::bigint - (select count(*) from f) from customer))
select c_custkey from f union all select c_custkey from r""")
def stratified_pilot(t: Tables) -> DataFrame:
    return R.stratified_pilot(t.customer, "c_custkey", "c_mktsegment", 0.05)


@query("select type, item_id, rn as place from (select type, item_id, row_number() over (partition by type order by item_id) as rn from items) where rn <= 3")
def pilot_first_n_per_type(t: Tables) -> DataFrame:
    w = Window.partitionBy("type").orderBy("item_id")
    return t.items.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").select("type", "item_id", "place")


@query("select doc_id from documents order by md5('1:' || doc_id), doc_id limit 100")
def hash_sample(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").orderBy(R.hash_order(1, F.col("doc_id")), "doc_id").limit(100)


@query("""with o as (select s_suppkey as k, s_name as name, 'old' as src from supplier), n as (select distinct l_suppkey as k, concat('new ', l_suppkey) as name, 'new' as src from lineitem where l_quantity > 49)
select k, name, src from o where k not in (select k from n) union all select k, name, src from n""")
def upsert_by_key(t: Tables) -> DataFrame:
    old = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.lit("old").alias("src"))
    new = t.lineitem.where("l_quantity > 49").select(F.col("l_suppkey").alias("k"), F.concat(F.lit("new "), F.col("l_suppkey")).alias("name"), F.lit("new").alias("src")).distinct()
    return R.upsert(old, new, "k")


@query("select a.s_suppkey as id, b.s_suppkey as lookalike from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey <> b.s_suppkey where b.s_acctbal < 0")
def lookalike_join(t: Tables) -> DataFrame:
    s = t.supplier
    b = s.where("s_acctbal < 0").select("s_nationkey", F.col("s_suppkey").alias("lookalike"))
    return s.join(b, "s_nationkey").where("s_suppkey <> lookalike").select(F.col("s_suppkey").alias("id"), "lookalike")


@query("with m as (select l_partkey, sum(case when l_returnflag = 'R' then -l_quantity else l_quantity end) as moved from lineitem group by l_partkey) select p_partkey, p_size + coalesce(moved, 0) as stock from part left join m on p_partkey = l_partkey")
def state_tracking_ledger(t: Tables) -> DataFrame:
    m = t.lineitem.groupBy("l_partkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))).alias("moved"))
    return t.part.join(m, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", (F.col("p_size") + F.coalesce("moved", F.lit(0.0))).alias("stock"))


_CLUES = "1 + s_suppkey % 2 as gap, 1 + s_nationkey % 3 as apart, 1 + s_suppkey % 5 as never"


@query(f"""with x as (select unnest(range(1, 6)) as i), p as (select s_suppkey as id, {_CLUES} from supplier), k as (select distinct gap, apart, never from p),
s as (select k.*, a.i * 10000 + b.i * 1000 + c.i * 100 + d.i * 10 + e.i as seats from k, x a, x b, x c, x d, x e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5 and b.i = a.i + gap and c.i < d.i and e.i <> never and abs(d.i - a.i) = apart)
select id, count(seats) as solutions, min(seats)::bigint as first_seats from p left join s using (gap, apart, never) group by id""")
def puzzle_solutions(t: Tables) -> DataFrame:
    """How many seatings of five meet each supplier's clues, and the smallest: seats are dealt one by one, and a seating goes with its first broken clue."""
    puzzles = t.supplier.select(F.col("s_suppkey").alias("id"), *[F.expr(c) for c in _CLUES.split(", ")])
    rules = {"b": "b = a + gap", "c": "true", "d": "c < d and abs(d - a) = apart", "e": "e <> never"}
    seated = puzzles.select("gap", "apart", "never").distinct().withColumn("left", F.sequence(F.lit(1), F.lit(5))).withColumn("a", F.explode("left"))
    for name, rule in rules.items():
        taken = F.array(*[F.col(n) for n in "abcde"[: "abcde".index(name)]])
        seated = seated.withColumn(name, F.explode(F.array_except("left", taken))).where(rule)
    seats = F.expr("a * 10000 + b * 1000 + c * 100 + d * 10 + e").cast("long")
    solved = seated.groupBy("gap", "apart", "never").agg(F.count("*").alias("solutions"), F.min(seats).alias("first_seats"))
    return puzzles.join(solved, ["gap", "apart", "never"], "left").select("id", F.coalesce("solutions", F.lit(0)).cast("long").alias("solutions"), "first_seats")


# ------------------------------------------------------------------ scorecard

_TOTAL = "round(0.25::double * c1 + 0.2::double * c2 + 0.2::double * c3 + 0.15::double * c4 + 0.1::double * c5 + 0.1::double * c6, 6)"


@query(f"select id, {_TOTAL} as total from cards")
def weighted_total(t: Tables) -> DataFrame:
    return t.cards.select("id", K.weighted_total(K.WEIGHTS).alias("total"))


@query(f"with s as (select *, {_TOTAL} as total, gates_passed and c1 is not null as ok from cards) select id, total, case when ok then row_number() over (partition by ok order by total desc, c4 desc, c5 desc, id) end as rank from s")
def scorecard_rank(t: Tables) -> DataFrame:
    return K.ranked(t.cards).select("id", "total", F.col("rank").cast("long").alias("rank"))


def _sensitivity_sql() -> str:
    parts = [f"select '{k}' as name, id as pick, total from (select id, round({' + '.join(f'{w!r}::double * {c}' for c, w in ws.items())}, 6) as total, c4, c5 from cards where gates_passed and c1 is not null) order by total desc, c4 desc, c5 desc, id limit 1" for k, ws in K.weightings().items()]
    return " union all ".join(f"(select * from ({p}))" for p in parts)


@query(_sensitivity_sql())
def sensitivity(t: Tables) -> DataFrame:
    return K.first_picks(t.cards)


@query("select id, name, case when 1 <= 2 then c1 end as c1, case when 2 <= 2 then c2 end as c2, null::bigint as c3 from cards")
def reveal_mask(t: Tables) -> DataFrame:
    through, shown_from = 2, {"c1": 1, "c2": 2, "c3": 3}
    return t.cards.select("id", "name", *[F.when(F.lit(at) <= through, F.col(c)).cast("long").alias(c) for c, at in shown_from.items()])


@query("select id, 'c1' as part, (c1 - 1) / 4.0::double as shade from cards union all select id, 'c2', (c2 - 1) / 4.0::double from cards union all select id, 'c3', (c3 - 1) / 4.0::double from cards")
def reveal_heat(t: Tables) -> DataFrame:
    long = t.cards.select("id", F.expr("stack(3, 'c1', cast(c1 as double), 'c2', cast(c2 as double), 'c3', cast(c3 as double)) as (part, score)"))
    return long.select("id", "part", ((F.col("score") - 1) / 4.0).alias("shade"))


@query("select c_custkey, case when c_custkey % 4 = 0 then null else c_custkey % 5 + 1 end as score, c_nationkey % 3 <> 0 as gate from customer")
def scorecard_parse(t: Tables) -> DataFrame:
    raw = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.concat(F.lit(" "), (F.col("c_custkey") % 5 + 1).cast("string"))).alias("s"), F.when(F.col("c_nationkey") % 3 != 0, " YES").otherwise("no ").alias("g"))
    return raw.select("c_custkey", F.nullif(F.trim("s"), F.lit("")).try_cast("long").alias("score"), F.lower(F.trim("g")).isin("y", "yes", "true", "1").alias("gate"))


@query("select item_id, case when item_id % 3 = 0 then null else hand_correct end as correct from marks")
def marks_parse(t: Tables) -> DataFrame:
    raw = t.marks.select("item_id", F.when(F.col("item_id") % 3 == 0, " ").when(F.col("hand_correct"), "Y ").otherwise("no").alias("m"))
    low = F.lower(F.trim("m"))
    return raw.select("item_id", F.when(low.isin("y", "yes", "true", "1"), True).when(low.isin("n", "no", "false", "0"), False).alias("correct"))


@query("with m as (select doc_id, case when doc_id % 50 = 0 then 'x' else sha256(text) end as expected from documents where doc_id % 70 <> 1), a as (select doc_id, sha256(text) as actual from documents) select coalesce(m.doc_id, a.doc_id) as doc_id, case when m.doc_id is null then 'not listed' else 'changed' end as problem from m full join a on m.doc_id = a.doc_id where expected is distinct from actual")
def manifest_check(t: Tables) -> DataFrame:
    actual = t.documents.select("doc_id", F.sha2("text", 256).alias("actual"))
    listed = actual.where("doc_id % 70 <> 1").select("doc_id", F.when(F.col("doc_id") % 50 == 0, "x").otherwise(F.col("actual")).alias("expected"), F.lit(True).alias("listed"))
    x = actual.join(listed, "doc_id", "full").where(~F.col("expected").eqNullSafe(F.col("actual")))
    return x.select("doc_id", F.when(F.col("listed").isNull(), "not listed").otherwise("changed").alias("problem"))


@query("""with s as (select item_id, type, row_number() over (partition by type order by item_id) as place from marks where hand_correct and judge_correct) select item_id, type, place from s where place <= 20""")
def select_survivors(t: Tables) -> DataFrame:
    w = Window.partitionBy("type").orderBy("item_id")
    return t.marks.where("hand_correct and judge_correct").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 20").select("item_id", "type", "place")


@query("""select type, count(*) as outcomes, count(*) filter (where score = 1) as ones from (select a.type, case when a.correct is null then null when a.evidence_rank = p.p_size then 1 else 0 end as score from arms a join part p on a.in_tokens = p.p_partkey) group by type""")
def score_outcomes(t: Tables) -> DataFrame:
    x = t.arms.join(t.part, F.col("in_tokens") == F.col("p_partkey"))
    score = F.when(F.col("correct").isNull(), None).when(F.col("evidence_rank") == F.col("p_size"), 1).otherwise(0)
    return x.select("type", score.alias("score")).groupBy("type").agg(F.count("*").alias("outcomes"), F.count_if(F.col("score") == 1).alias("ones"))


@query("""select arm, count(*) as items, count(*) filter (where answerable and evidence_rank <= 5) as recall, count(*) filter (where leaked and asker = 'public') as leak_items, count(*) filter (where answerable and evidence_rank is null) as cut_items, median(in_tokens) as median_prompt from arms group by arm""")
def condition_row(t: Tables) -> DataFrame:
    return t.arms.groupBy("arm").agg(F.count("*").alias("items"), F.count_if(F.expr("answerable and evidence_rank <= 5")).alias("recall"), F.count_if(F.expr("leaked and asker = 'public'")).alias("leak_items"), F.count_if(F.expr("answerable and evidence_rank is null")).alias("cut_items"), F.median("in_tokens").alias("median_prompt"))


@query("""with b as (select type, max(latency) filter (where flag = 'A') as best, max(latency) filter (where flag = 'N') as plain from arms group by type) select type, case when best > plain then round(best, 6) end as flagged from b""")
def flagged_pair(t: Tables) -> DataFrame:
    top = lambda f: F.max(F.when(F.col("flag") == f, F.col("latency")))
    b = t.arms.groupBy("type").agg(top("A").alias("best"), top("N").alias("plain"))
    return b.select("type", F.when(F.col("best") > F.col("plain"), F.round("best", 6)).alias("flagged"))


@query("""with c as (select arm, evidence_rank as n, count(*) filter (where correct) as supported, count(*) as cited from arms where evidence_rank is not null group by 1, 2) select arm, sum(cited)::bigint as citations, sum(supported)::bigint as supported, count(*) filter (where n > 5) as out_of_prompt from c group by arm""")
def citation_validity(t: Tables) -> DataFrame:
    c = t.arms.where("evidence_rank is not null").groupBy("arm", F.col("evidence_rank").alias("n")).agg(F.count_if("correct").alias("supported"), F.count("*").alias("cited"))
    return c.groupBy("arm").agg(F.sum("cited").alias("citations"), F.sum("supported").alias("supported"), F.count_if(F.col("n") > 5).alias("out_of_prompt"))


@query("""select item_id, string_agg(concat(arm, ':', coalesce(evidence_rank::varchar, '-')), ' ' order by arm) as ranks, count(*) filter (where correct) as right_arms from arms group by item_id""")
def item_log(t: Tables) -> DataFrame:
    entry = F.concat(F.col("arm").cast("string"), F.lit(":"), F.coalesce(F.col("evidence_rank").cast("string"), F.lit("-")))
    parts = F.array_sort(F.collect_list(F.struct("arm", entry.alias("e"))))
    return t.arms.groupBy("item_id").agg(F.array_join(F.transform(parts, lambda x: x["e"]), " ").alias("ranks"), F.count_if("correct").alias("right_arms"))
