"""Smaller reports over the log, the calls and the conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.functions import stats as S
from tarnfield.functions import text as X
from tarnfield.operators import chunking as C
from tarnfield.queries.evaluation import _w
from tarnfield.queries.registry import Tables, query
from tarnfield.queries.reports import HANDLED, RIGHT
from tarnfield.queries.retrieval import _CHUNKS, _LOGITS, _softmax
from tarnfield.sources.stores import score_key as stored_score_key

_SHARES = {
    "declined": ("not answerable and coalesce(declined, false)", "not answerable"),
    "faithful": ("answerable and correct is not null and not coalesce(declined, false) and coalesce(faithful, false)", "answerable and correct is not null and not coalesce(declined, false)"),
    "handled": (f"({HANDLED})", "true"),
    "right": (f"answerable and {RIGHT}", "answerable"),
}


@query("with a as (select arm, " + ", ".join(f"count(*) filter (where {c}) as c_{k}, count(*) filter (where {n}) as n_{k}" for k, (c, n) in _SHARES.items()) + " from arms group by arm) "
       + " union all ".join(f"select arm, '{k}' as measure, c_{k} as count, n_{k} as total, round({_w(f'c_{k}', f'n_{k}', 'low')}, 6) as low, round({_w(f'c_{k}', f'n_{k}', 'high')}, 6) as high from a" for k in _SHARES))
def share_measures(t: Tables) -> DataFrame:
    """Shares of each arm with their intervals: declined, faithful, handled and right."""
    a = t.arms.groupBy("arm").agg(*[F.struct(F.count_if(F.expr(c)).alias("count"), F.count_if(F.expr(n)).alias("total")).alias(k) for k, (c, n) in _SHARES.items()])
    a = a.select("arm", F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(f"{k}.count").alias("count"), F.col(f"{k}.total").alias("total")) for k in _SHARES])))
    w = S.safe_wilson(F.col("count"), F.col("total"))
    return a.select("arm", "measure", "count", "total", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"))


@query("select doc_id, sha256(concat('encoder', chr(31), 'rev1', chr(31), lang, chr(31), text)) as key from documents")
def score_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", stored_score_key(F.lit("encoder"), F.lit("rev1"), F.col("lang"), F.col("text")).alias("key"))


@query(f"with {_CHUNKS} select concat(d.doc_key, '#', cast(chunk_no as varchar)) as chunk_id, ck.doc_id, start::bigint as start, stop::bigint as stop, d.family, d.access, d.status from ck join docs d on d.doc_id = ck.doc_id")
def chunk_assembly(t: Tables) -> DataFrame:
    """Chunks with their ids and what their documents say of them."""
    about = t.docs.select("doc_id", "doc_key", "family", "access", "status")
    c = C.word_chunks(t.docs, 64).drop("text").join(about, "doc_id")
    return c.select(F.concat("doc_key", F.lit("#"), F.col("chunk_no").cast("string")).alias("chunk_id"), "doc_id", "start", "stop", "family", "access", "status")


_MARKED = "concat('# ', source, chr(10), '## ', lang, chr(10), text, chr(10), '### ', case when doc_id % 2 = 0 then 'even' else 'odd' end, chr(10), chr(10), '## ', 'last', chr(10), 'end')"


@query(rf"""with m as (select doc_id, {_MARKED} as text from documents), l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as no from m),
p as (select doc_id, no, line, regexp_matches(line, '^(#{{1,6}})[ \t]+(.+?)[ \t]*$') as head, sum(length(line) + 1) over (partition by doc_id order by no rows between unbounded preceding and 1 preceding) as s, lead(no) over (partition by doc_id order by no) is null as last from l),
q as (select *, coalesce(s, 0) as start, coalesce(s, 0) + length(line) + case when last then 0 else 1 end as stop, sum(head::int) over (partition by doc_id order by no) as part, case when head then length(regexp_extract(line, '^(#+)', 1)) end as level from p),
g as (select doc_id, part, min(start) as start, max(stop) as stop, max(level) as level, max(case when head then regexp_extract(line, '^(#{{1,6}})[ \t]+(.+?)[ \t]*$', 2) end) as title, bool_or(not head and regexp_matches(line, '\S')) as body from q group by 1, 2),
a as (select x.doc_id, x.part, string_agg(y.title, ' > ' order by y.part) as path from g x join g y on y.doc_id = x.doc_id and y.part <= x.part and y.level is not null
 and not exists (select 1 from g z where z.doc_id = x.doc_id and z.part > y.part and z.part <= x.part and z.level <= y.level) group by 1, 2),
c as (select g.*, coalesce(a.path, '') as path, body or lead(g.part) over (partition by g.doc_id order by g.part) is null as closes from g left join a on a.doc_id = g.doc_id and a.part = g.part where start < stop),
n as (select *, coalesce(sum(closes::int) over (partition by doc_id order by part rows between unbounded preceding and 1 preceding), 0) as section_no from c)
select doc_id, section_no::bigint as section_no, min(start)::bigint as start, max(stop)::bigint as stop, arg_max(path, part) as path from n group by 1, 2""")
def section_paths(t: Tables) -> DataFrame:
    """Sections of texts with headings put in, and their paths."""
    d = t.documents.select("doc_id", F.expr(_MARKED.replace("chr(10)", "'\\n'")).alias("text"))
    return C.sections(d).select("doc_id", "section_no", "start", "stop", F.array_join("headings", " > ").alias("path"))


@query(rf"""with w as (select conv_id % 4 as strategy, regexp_extract_all(lower(text), '[\p{{L}}]+') as w from conversations where role = 'assistant'),
c as (select strategy, len(list_filter(w, lambda x: list_contains({X.FRENCH}, x))) as f, len(list_filter(w, lambda x: list_contains({X.ENGLISH}, x))) as e from w),
k as (select strategy, count(*) filter (where f >= 3 and f > e) as french, count(*) as replies from c group by 1)
select strategy, french, replies, (select case when a.french < b.french then 0 when b.french < a.french then 1 end from k a, k b where a.strategy = 0 and b.strategy = 1) as fewer_of_two from k""")
def french_replies(t: Tables) -> DataFrame:
    """French replies of each strategy, and which of the first two has fewer (null if as many)."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("([\\p{L}]+)"), F.lit(1))
    f, e = F.size(F.filter(w, lambda x: x.isin(X.FRENCH))), F.size(F.filter(w, lambda x: x.isin(X.ENGLISH)))
    k = t.turns.where("role = 'assistant'").select((F.col("conv_id") % 4).alias("strategy"), ((f >= 3) & (f > e)).alias("french")).groupBy("strategy").agg(F.count_if("french").alias("french"), F.count("*").alias("replies"))
    n = lambda s: F.max(F.when(F.col("strategy") == s, F.col("french")))
    two = k.agg(n(0).alias("a"), n(1).alias("b")).select(F.when(F.col("a") < F.col("b"), 0).when(F.col("b") < F.col("a"), 1).alias("fewer_of_two"))
    return k.join(F.broadcast(two))


@query(f"""with {_LOGITS}, z as (select vec_id, i, temperature, exp((x - max(x) over (partition by vec_id, temperature)) / temperature) as z from e, t), p as (select vec_id, temperature, i, z / sum(z) over (partition by vec_id, temperature) as p from z),
r as (select *, row_number() over (partition by vec_id, temperature order by round(p, 9) desc, i) as rank from p)
select vec_id, temperature, round(sum(p) filter (where rank <= 5), 6) as top_mass, max(case when i = 1 then rank end) as rank_of_first from r group by 1, 2""")
def token_rank_and_mass(t: Tables) -> DataFrame:
    """Mass of the five likeliest outcomes at each temperature, and the rank of one of them."""
    w = Window.partitionBy("vec_id", "temperature").orderBy(F.desc(F.round("p", 9)), "i")
    r = _softmax(t).withColumn("rank", F.row_number().over(w).cast("long"))
    return r.groupBy("vec_id", "temperature").agg(F.round(F.sum(F.when(F.col("rank") <= 5, F.col("p"))), 6).alias("top_mass"), F.max(F.when(F.col("i") == 1, F.col("rank"))).alias("rank_of_first"))


@query("""with d as (select user_id % 5 as temperature, count(distinct event_type || cast(floor(value) % 7 as varchar)) as answers from events group by 1), m as (select max(answers) as most from d)
select d.temperature, d.answers, case when (select count(*) from d, m where d.answers = m.most) = 1 then d.answers = m.most end as most_distinct from d, m""")
def most_distinct_answers(t: Tables) -> DataFrame:
    """How many different answers each temperature gives, and whether it gives the most; null for all on a tie."""
    d = t.events.groupBy((F.col("user_id") % 5).alias("temperature")).agg(F.countDistinct(F.concat("event_type", (F.floor("value") % 7).cast("string"))).alias("answers"))
    m = d.agg(F.max("answers").alias("most"))
    ties = d.join(F.broadcast(m)).agg(F.count_if(F.col("answers") == F.col("most")).alias("ties"), F.max("most").alias("most"))
    return d.join(F.broadcast(ties)).select("temperature", "answers", F.when(F.col("ties") == 1, F.col("answers") == F.col("most")).alias("most_distinct"))


@query("""with c as (select provider, mode, median(latency) as ms, median(output_tokens) as n from runs group by 1, 2), w as (select a.provider, a.ms as low_ms, b.ms as high_ms from c a join c b on a.provider = b.provider where a.mode = 'low' and b.mode = 'high')
select provider, round(low_ms, 6) as low_ms, round(high_ms, 6) as high_ms, case when high_ms > low_ms * 1.1 then 'slower' when high_ms < low_ms * 0.9 then 'faster' else 'alike' end as verdict from w""")
def timing_headline(t: Tables) -> DataFrame:
    """Median latency in two modes, called slower or faster outside a band of a tenth."""
    m = lambda k: F.median(F.when(F.col("mode") == k, F.col("latency")))
    w = t.runs.groupBy("provider").agg(m("low").alias("low_ms"), m("high").alias("high_ms")).where("low_ms is not null and high_ms is not null")
    verdict = F.when(F.col("high_ms") > F.col("low_ms") * 1.1, "slower").when(F.col("high_ms") < F.col("low_ms") * 0.9, "faster").otherwise("alike")
    return w.select("provider", F.round("low_ms", 6).alias("low_ms"), F.round("high_ms", 6).alias("high_ms"), verdict.alias("verdict"))


@query("""select arm, concat('chunker-', cast(64 * arm as varchar)) as label, count(*) filter (where type in ('t0', 't1') and answerable and evidence_rank <= 5) as policy_found, count(*) filter (where type in ('t0', 't1') and answerable) as policy_items,
 count(*) filter (where answerable and evidence_rank is null) as cut_items from arms group by arm""")
def chunker_report(t: Tables) -> DataFrame:
    """A chunker's label, recall on items about policies, and items whose passage it cuts."""
    policy = F.col("type").isin("t0", "t1") & F.col("answerable")
    return t.arms.groupBy("arm").agg(F.count_if(policy & (F.col("evidence_rank") <= 5)).alias("policy_found"), F.count_if(policy).alias("policy_items"), F.count_if(F.col("answerable") & F.col("evidence_rank").isNull()).alias("cut_items")).select(
        "arm", F.concat(F.lit("chunker-"), (F.col("arm") * 64).cast("string")).alias("label"), "policy_found", "policy_items", "cut_items"
    )


@query("""with l as (select *, row_number() over (partition by call_id, mode order by line_no desc) as r from runs where ok)
select l.mode as stage, count(*) as calls, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, case when count(*) filter (where p.provider is null) = 0 then round(sum(input_tokens * price_in + output_tokens * price_out) / 1000000, 6) end as cost
from l left join prices p on l.provider = p.provider where l.r = 1 group by l.mode""")
def stage_cost(t: Tables) -> DataFrame:
    """What each stage's calls cost: the last success of a call counts; without a price there is no cost."""
    last = t.runs.where("ok").groupBy("call_id", "mode").agg(F.max_by(F.struct("provider", "input_tokens", "output_tokens"), "line_no").alias("x")).select("mode", "x.*")
    p = last.join(F.broadcast(t.prices.withColumn("known", F.lit(True))), "provider", "left")
    cost = F.sum(F.col("input_tokens") * F.col("price_in") + F.col("output_tokens") * F.col("price_out")) / 1000000
    return p.groupBy(F.col("mode").alias("stage")).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.when(F.count_if(F.col("known").isNull()) == 0, F.round(cost, 6)).alias("cost"))


@query("""select provider, model, count(*) filter (where call_id % 20 = 0) as pilot_calls, count(*) as calls, coalesce(sum(input_tokens) filter (where call_id % 20 = 0), 0)::bigint as pilot_tokens, sum(input_tokens)::bigint as tokens, case when count(*) >= 50 then 'batch' else 'direct' end as note from runs group by 1, 2""")
def pilot_and_full(t: Tables) -> DataFrame:
    """The pilot's part of a run beside the whole, and whether a batch is worth while."""
    pilot = F.col("call_id") % 20 == 0
    return t.runs.groupBy("provider", "model").agg(
        F.count_if(pilot).alias("pilot_calls"), F.count("*").alias("calls"), F.coalesce(F.sum(F.when(pilot, F.col("input_tokens"))), F.lit(0)).alias("pilot_tokens"), F.sum("input_tokens").alias("tokens"),
        F.when(F.count("*") >= 50, "batch").otherwise("direct").alias("note"),
    )


@query("""with f as (select p_partkey - 1 as n, p_name as fact from part), a as (select conv_id, turn, text, (conv_id * 7 + turn) % (select count(*) from part) as n from conversations)
select conv_id, turn, contains(lower(text), lower(split_part(f.fact, ' ', 1))) as has_fact from a join f on f.n = a.n""")
def fact_by_index(t: Tables) -> DataFrame:
    """Answers looked up against the fact at their index."""
    n = t.part.count()
    f = t.part.select((F.col("p_partkey") - 1).alias("n"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("fact"))
    a = t.conversations.select("conv_id", "turn", "text", ((F.col("conv_id") * 7 + F.col("turn")) % n).alias("n")).join(f, "n")
    return a.select("conv_id", "turn", F.contains(F.lower("text"), F.lower("fact")).alias("has_fact"))


@query("""select concat(cast(item_id as varchar), '-', c.condition, '-', cast(r.run as varchar)) as call_id, substr(sha256(concat(text, chr(10), c.condition)), 1, 12) as request from benchmark, (select unnest(['bare', 'warned']) as condition) c, (select unnest([1, 2, 3]) as run) r""")
def call_fanout(t: Tables) -> DataFrame:
    """Every item under every condition, so many times each: runs of one request have one request id."""
    b = t.benchmark.withColumn("condition", F.explode(F.array(F.lit("bare"), F.lit("warned")))).withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(3))))
    request = F.substring(F.sha2(F.concat("text", F.lit("\n"), F.col("condition")), 256), 1, 12)
    return b.select(F.concat_ws("-", F.col("item_id").cast("string"), "condition", F.col("run").cast("string")).alias("call_id"), request.alias("request"))


@query("""select item_id, concat(case type when 't0' then 'Ask what came before. ' when 't1' then 'Ask for both parts. ' else 'Ask for the detail. ' end, 'It must name ', split_part(evidence, ' ', 1), '.') as prompt from items""")
def question_prompts(t: Tables) -> DataFrame:
    """What a question writer is told for each type of item, and the token that the question must hold."""
    task = F.when(F.col("type") == "t0", "Ask what came before. ").when(F.col("type") == "t1", "Ask for both parts. ").otherwise("Ask for the detail. ")
    return t.items.select("item_id", F.concat(task, F.lit("It must name "), F.split_part("evidence", F.lit(" "), F.lit(1)), F.lit(".")).alias("prompt"))


@query("""with d as (select item_id from marks where judge_correct <> hand_correct) select i.item_id, i.type, exists (select 1 from d where d.item_id = i.item_id) as disputed from items i""")
def disputed_items(t: Tables) -> DataFrame:
    """Items that the judge and the hand marks see differently."""
    d = t.marks.where("judge_correct <> hand_correct").select("item_id").distinct().withColumn("disputed", F.lit(True))
    return t.items.join(d, "item_id", "left").select("item_id", "type", F.coalesce("disputed", F.lit(False)).alias("disputed"))


@query(f"""with n as (select arm, count(*) filter (where answerable and evidence_rank <= 5) as search, count(*) filter (where answerable and {RIGHT}) as answer, count(*) filter (where not answerable and coalesce(declined, false)) as not_found, count(*) filter (where asker = 'public' and leaked) as leaks from arms group by arm)
select b.arm as episode, a.search as search_before, b.search as search_after, a.answer as answer_before, b.answer as answer_after, a.not_found as not_found_before, b.not_found as not_found_after, a.leaks as leaks_before, b.leaks as leaks_after, b.search > a.search and b.answer >= a.answer as joined from n b left join n a on a.arm = b.arm - 1""")
def scoreboard_rows(t: Tables) -> DataFrame:
    """Each episode's four numbers beside those of the one before it, and whether the change joins."""
    n = t.arms.groupBy("arm").agg(
        F.count_if(F.expr("answerable and evidence_rank <= 5")).alias("search"), F.count_if(F.expr(f"answerable and {RIGHT}")).alias("answer"),
        F.count_if(F.expr("not answerable and coalesce(declined, false)")).alias("not_found"), F.count_if(F.expr("asker = 'public' and leaked")).alias("leaks"),
    )
    before = n.select((F.col("arm") + 1).alias("arm"), *[F.col(c).alias(f"{c}_before") for c in ("search", "answer", "not_found", "leaks")])
    j = n.join(before, "arm", "left")
    both = [F.col(x).alias(y) for c in ("search", "answer", "not_found", "leaks") for x, y in ((f"{c}_before", f"{c}_before"), (c, f"{c}_after"))]
    return j.select(F.col("arm").alias("episode"), *both, (F.expr("search > search_before and answer >= answer_before")).alias("joined"))


@query(f"""with c as (select type, flag, arm, count(*) filter (where correct) as hits, count(*) as n from arms where arm in (1, 2) group by 1, 2, 3),
p as (select a.type, a.flag, a.hits as hits_1, b.hits as hits_2, a.n as n_1, b.n as n_2 from c a join c b on a.type = b.type and a.flag = b.flag and a.arm = 1 and b.arm = 2)
select type, flag, round(hits_1 / n_1, 6) as rate_1, round(hits_2 / n_2, 6) as rate_2, round({_w('hits_1', 'n_1', 'low')}, 6) as low_1, round({_w('hits_2', 'n_2', 'low')}, 6) as low_2, ({_w('hits_1', 'n_1', 'high')}) < ({_w('hits_2', 'n_2', 'low')}) as apart from p""")
def paired_grid(t: Tables) -> DataFrame:
    """Accuracy of two modes in each cell of a grid, with whether their intervals are apart."""
    c = t.arms.where("arm in (1, 2)").groupBy("type", "flag").pivot("arm", [1, 2]).agg(F.count_if("correct").alias("hits"), F.count(F.lit(1)).alias("n")).where("`1_n` > 0 and `2_n` > 0")
    w1, w2 = S.safe_wilson(F.col("1_hits"), F.col("1_n")), S.safe_wilson(F.col("2_hits"), F.col("2_n"))
    return c.select("type", "flag", F.round(F.col("1_hits") / F.col("1_n"), 6).alias("rate_1"), F.round(F.col("2_hits") / F.col("2_n"), 6).alias("rate_2"), F.round(w1["low"], 6).alias("low_1"), F.round(w2["low"], 6).alias("low_2"), (w1["high"] < w2["low"]).alias("apart"))


@query("""select call_id as item_id, event_type as stage, row_number() over (partition by call_id, event_type order by line_no) as place, concat(model, '/', mode) as call from runs""")
def call_lists(t: Tables) -> DataFrame:
    """The calls that each stage makes for an item, one a row, with their places in its list."""
    place = F.row_number().over(Window.partitionBy("call_id", "event_type").orderBy("line_no")).cast("long")
    return t.runs.select(F.col("call_id").alias("item_id"), F.col("event_type").alias("stage"), place.alias("place"), F.concat_ws("/", "model", "mode").alias("call"))


@query(f"""with a as (select arm, count(*) filter (where answerable and evidence_rank <= 5) as c, count(*) filter (where answerable) as n from arms group by arm),
w as (select arm, c / n as rate, {_w('c', 'n', 'low')} as low, {_w('c', 'n', 'high')} as high from a), ab as (select w.*, coalesce(w.low > r.high, false) as clear from w, w r where r.arm = 1),
h as (select arm from ab where clear order by rate desc, arm limit 1)
select ab.arm, round(rate, 6) as rate, round(low, 6) as low, round(high, 6) as high, ab.arm in (select arm from h) as highlighted from ab""")
def chart_interval_bars(t: Tables) -> DataFrame:
    """Bars with intervals; the best arm whose interval clears the reference's is highlighted, none if none does."""
    a = t.arms.where("answerable").groupBy("arm").agg(F.count_if(F.col("evidence_rank") <= 5).alias("c"), F.count("*").alias("n"))
    w = S.safe_wilson(F.col("c"), F.col("n"))
    bars = a.select("arm", (F.col("c") / F.col("n")).alias("rate"), w["low"].alias("low"), w["high"].alias("high"))
    bars = bars.join(F.broadcast(bars.where("arm = 1").select(F.col("high").alias("ref"))))
    best = bars.where("low > ref").orderBy(F.desc("rate"), "arm").limit(1).select("arm", F.lit(True).alias("best"))
    return bars.join(best, "arm", "left").select("arm", F.round("rate", 6).alias("rate"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.coalesce("best", F.lit(False)).alias("highlighted"))


_BARS = {"search": ("answerable and evidence_rank <= 5", "answerable"), "answer": (f"answerable and {RIGHT}", "answerable"), "not found": ("not answerable and coalesce(declined, false)", "not answerable"), "leaks": ("asker = 'public' and leaked", "asker = 'public'")}


@query("with a as (select arm, " + ", ".join(f"count(*) filter (where {c}) as c{i}, count(*) filter (where {n}) as n{i}" for i, (c, n) in enumerate(_BARS.values())) + " from arms where arm in (1, 7) group by arm) " + " union all ".join(f"select '{k}' as category, arm, round(c{i} / n{i}, 6) as rate from a" for i, k in enumerate(_BARS)))
def chart_grouped_bars(t: Tables) -> DataFrame:
    """The four numbers of the first and the final arm, as shares."""
    a = t.arms.where("arm in (1, 7)").groupBy("arm").agg(*[(F.count_if(F.expr(c)) / F.count_if(F.expr(n))).alias(k) for k, (c, n) in _BARS.items()])
    return a.select(F.inline(F.array(*[F.struct(F.lit(k).alias("category"), F.col("arm"), F.round(F.col(f"`{k}`"), 6).alias("rate")) for k in _BARS])))


@query("""with b as (select arm, count(*) filter (where correct) as x, count(*) filter (where faithful and answerable) as y from arms group by arm), r as (select arm, dense_rank() over (order by x desc) as before, dense_rank() over (order by y desc) as after from b)
select arm, before, after, case when after < before then 'rises' when after > before then 'falls' else 'stays' end as direction, before - after as places from r""")
def chart_slope(t: Tables) -> DataFrame:
    """Places in two orders, ties sharing one, and which way each arm moves."""
    b = t.arms.groupBy("arm").agg(F.count_if("correct").alias("x"), F.count_if(F.expr("faithful and answerable")).alias("y"))
    place = lambda c: F.dense_rank().over(Window.orderBy(F.desc(c))).cast("long")
    r = b.select("arm", place("x").alias("before"), place("y").alias("after"))
    direction = F.when(F.col("after") < F.col("before"), "rises").when(F.col("after") > F.col("before"), "falls").otherwise("stays")
    return r.select("arm", "before", "after", direction.alias("direction"), (F.col("before") - F.col("after")).alias("places"))
