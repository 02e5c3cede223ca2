"""Whole pipelines, and operators that SQL can't express: those have no oracle and are tested by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.functions import bpe
from tarnfield.operators import chunking as C
from tarnfield.operators import experiments as E
from tarnfield.plans import pipeline as P
from tarnfield.queries.evaluation import HOLM_SQL, _w
from tarnfield.queries.registry import QUERIES, Tables, query
from tarnfield.queries.retrieval import _BM25, _CHUNKS, _NEAR, _SPANS, _ranked, _top
from tarnfield.session import written


@query("""with recursive t as (select conv_id, turn, tokens, row_number() over (partition by conv_id order by turn) as n from turns),
b as (select conv_id, n, turn, 0::bigint as batch, 1 as inputs, tokens as held from t where n = 1
 union all select t.conv_id, t.n, t.turn, case when b.inputs = 4 or b.held + t.tokens > 2000 then b.batch + 1 else b.batch end,
  case when b.inputs = 4 or b.held + t.tokens > 2000 then 1 else b.inputs + 1 end, case when b.inputs = 4 or b.held + t.tokens > 2000 then t.tokens else b.held + t.tokens end
 from b join t on t.conv_id = b.conv_id and t.n = b.n + 1)
select conv_id, turn, batch from b""")
def batches(t: Tables) -> DataFrame:
    return E.batches(t.turns, "conv_id", "turn", "tokens", 4, 2000)


@query()
def bootstrap_tau(t: Tables) -> DataFrame:
    board = {a: float((a * 5) % 7) for a in range(1, 8)}
    out = E.bootstrap_tau(t.arms.select("item_id", "arm", F.col("correct").alias("hit")), board)
    return t.spark.createDataFrame([(out["tau_b"], out["low"], out["high"])], "tau_b double, low double, high double")


@query(f"""with recursive {HOLM_SQL}, o as (select arm, count(*) filter (where correct) as score, row_number() over (order by count(*) filter (where correct) desc, arm) as i from arms group by arm),
apart as (select arm1 as a1, arm2 as a2 from h where adjusted < 0.05 union all select arm2, arm1 from h where adjusted < 0.05),
w as (select 1::bigint as i, [arm] as heads from o where i = 1
 union all select o.i, case when (select count(*) from apart where a1 = o.arm and list_contains(w.heads, a2)) = len(w.heads) then list_append(w.heads, o.arm) else w.heads end from w join o on o.i = w.i + 1),
hd as (select unnest(heads) as head, generate_subscripts(heads, 1) as tier from (select heads from w order by i desc limit 1))
select o.arm as model, o.score, min(hd.tier)::bigint as tier from o join hd on not exists (select 1 from apart where a1 = o.arm and a2 = hd.head) group by 1, 2""")
def tiers(t: Tables) -> DataFrame:
    scores = t.arms.groupBy(F.col("arm").alias("model")).agg(F.count_if("correct").alias("score"))
    pairs = QUERIES["holm"](t.spark, t.sf_dir).select(F.col("arm1").alias("model1"), F.col("arm2").alias("model2"), F.col("adjusted").alias("p"))
    return E.tiers(scores, pairs)


@query()
def sentence_boundaries(t: Tables) -> DataFrame:
    return E.per_text(t.benchmark, "item_id", "text", E.sentence_ends, "ends", "array<long>")


@query()
def insert_fact(t: Tables) -> DataFrame:
    """A sentence put in half way through a filler of at most 40 tokens that ends with a sentence."""
    make = lambda b, i, x: [(i, E.insert_at(E.trimmed(x, min(40, b.count(x)), b), "The lamp is on the pier.", 50, b))]
    return bpe.each_text(t.benchmark, "item_id", "text", make, "item_id long, text string")


@query()
def bpe_token_counts(t: Tables) -> DataFrame:
    return bpe.token_counts(t.documents, "doc_id")


@query()
def chunk_bpe_windows(t: Tables) -> DataFrame:
    return C.bpe_windows(t.documents, 256, 32)


@query()
def changed_value(t: Tables) -> DataFrame:
    return E.per_text(t.benchmark, "item_id", "text", lambda x: "|".join(E.changed_value(x, x.replace(x[:20], x[:20].upper(), 1))), "values", "string")


def _spec_items(t: Tables) -> DataFrame:
    return t.items.select("item_id", F.col("evidence").alias("question"), "asker")


@query(f"with {_BM25}, {_ranked('reason is null', 5)} select query_id, pos, rank from top")
def search_keyword(t: Tables) -> DataFrame:
    spec = P.Spec(chunker=P.Chunker("whole"), search=P.Search("keyword", 5), filter=P.Filter("before"))
    return P.run(t.docs, _spec_items(t), spec)["searched"].select("query_id", "pos", F.col("rank").cast("long").alias("rank"))


def _vectors(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = t.embeddings
    return e.select(F.col("vec_id").alias("pos"), F.col("embedding").alias("v")), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))


@query(f"with {_NEAR} select query_id, pos, rank from vr where rank <= 5")
def search_vector(t: Tables) -> DataFrame:
    vectors, asks = _vectors(t)
    spec = P.Spec(chunker=P.Chunker("whole"), search=P.Search("vector", 5))
    out = P.run(t.docs, _spec_items(t), spec, vectors, asks)["searched"]
    return out.select("query_id", "pos", F.col("rank").cast("long").alias("rank"))


@query(f"""with {_BM25}, {_ranked('true', 10)}, {_NEAR},
l as (select query_id, pos, 1 as list_no, rank from top union all select query_id, pos, 2, rank from vr where rank <= 10),
f as (select query_id, pos, round(sum(1.0 / (60 + rank)), 9) as score, min(list_no * 1000 + rank) as first from l group by 1, 2),
rr as (select *, row_number() over (partition by query_id order by score desc, first) as rank2 from f)
select query_id, pos, rank2 as rank from rr where rank2 <= 10""")
def search_hybrid(t: Tables) -> DataFrame:
    vectors, asks = _vectors(t)
    spec = P.Spec(chunker=P.Chunker("whole"), search=P.Search("hybrid", 10, fuse_depth=10))
    out = P.run(t.docs, _spec_items(t), spec, vectors, asks)["searched"]
    return out.select("query_id", "pos", F.col("rank").cast("long").alias("rank"))


@query(f"""with {_BM25}, kr as (select query_id, pos, row_number() over (partition by query_id order by score desc, pos) as rank from al), {_NEAR},
l as (select query_id, pos, 1 as list_no, rank from kr union all select query_id, pos, 2, rank from vr),
f as (select query_id, pos, round(sum(1.0 / (60 + rank)), 9) as score, min(list_no * 10000000 + rank) as first from l group by 1, 2),
rr as (select *, row_number() over (partition by query_id order by score desc, first) as rank2 from f)
select query_id, pos, score, rank2 as rank from rr where rank2 <= 10""")
def search_hybrid_whole(t: Tables) -> DataFrame:
    """Fusion of both whole rankings: 81 rows of each are read for a query, and few places counted."""
    vectors, asks = _vectors(t)
    spec = P.Spec(chunker=P.Chunker("whole"), search=P.Search("hybrid", 10))
    out = P.run(t.docs, _spec_items(t), spec, vectors, asks)["searched"]
    return out.select("query_id", "pos", "score", F.col("rank").cast("long").alias("rank"))


_PARTS = """pa as (select item_id, asker, evidence, list_filter(list_transform(string_split(replace(evidence, '. ', chr(10)), chr(10)), lambda x: trim(trim(x, ' -*0123456789.'))), lambda x: x <> '')[1:3] as ps from items),
pd as (select item_id, asker, case when len(ps) > 0 then [ps[i] for i in range(1, len(ps) + 1) if list_position(ps, ps[i]) = i] else [evidence] end as ps from pa),
q as (select item_id * 10 + no as query_id, asker, text from (select item_id, asker, unnest(ps) as text, generate_subscripts(ps, 1) - 1 as no from pd))"""
_PLAIN = "q as (select item_id as query_id, asker, evidence as text from items)"


@query(f"""with {_BM25.replace(_PLAIN, _PARTS)}, {_ranked('true', 10)},
f as (select query_id // 10 as query_id, pos, round(sum(1.0 / (60 + rank)), 9) as score, min((query_id % 10) * 1000 + rank) as first from top group by 1, 2),
fr as (select *, row_number() over (partition by query_id order by score desc, first) as frank from f)
select query_id, pos, score, frank as rank from fr where frank <= 10""")
def multiquery_rrf(t: Tables) -> DataFrame:
    items = _spec_items(t)
    spec = P.Spec(chunker=P.Chunker("whole"), search=P.Search("keyword", 10), rewrite="split")
    return P.run(t.docs, items, spec)["searched"].select("query_id", "pos", "score", F.col("rank").cast("long").alias("rank"))


_BY_CHUNK = _BM25.replace("from docs", "from dc").replace("cross join docs", "cross join dc")


@query(f"""with {_CHUNKS}, dc as (select ck.doc_id * 1048576 + ck.chunk_no as doc_id, ck.text, d.access, d.status from ck join docs d on d.doc_id = ck.doc_id), {_BY_CHUNK}, {_ranked('true', 20)},
kept as (select query_id, pos, row_number() over (partition by query_id order by rank) as rank from top where reason is null), five as (select *, count(*) over (partition by query_id) as n from kept where rank <= 5)
select query_id, pos, rank, row_number() over (partition by query_id order by case when rank % 2 = 1 then rank else 2 * n + 1 - rank end) as place from five""")
def chunked_pipeline(t: Tables) -> DataFrame:
    """Word chunks, keyword search, filter after, prompt with the best passages at its ends."""
    spec = P.Spec(chunker=P.Chunker("words", 64), search=P.Search("keyword", 20), filter=P.Filter("after"), prompt=P.Prompt(5, "ends"))
    return P.run(t.docs, _spec_items(t), spec)["prompt"].select("query_id", "pos", F.col("rank").cast("long").alias("rank"), F.col("place").cast("long").alias("place"))


_PLACED = "select ck.doc_id * 1048576 + ck.chunk_no as doc_id, ck.text, d.access, d.status from ck join docs d on d.doc_id = ck.doc_id"
_NAME = "concat(pos // 1048576, '@1#', pos % 1048576)"


@query(f"""with {_CHUNKS}, dc as ({_PLACED}), {_BY_CHUNK}, {_SPANS}, cd as (select unnest(['off', 'after', 'before']) as condition),
rk as (select *, row_number() over (partition by query_id order by score desc, pos) as r0 from al), rb as (select *, row_number() over (partition by query_id order by score desc, pos) as r1 from al where reason is null),
se as (select condition, query_id, pos, access, reason, r0 as rank from rk cross join cd where r0 <= 20 and condition <> 'before' union all select 'before', query_id, pos, access, null, r1 from rb where r1 <= 20),
fi as (select condition, query_id, pos, access, row_number() over (partition by condition, query_id order by rank) as rank from se where condition = 'off' or reason is null),
ho as (select sp.*, ck.doc_id * 1048576 + ck.chunk_no as pos from sp join ck on sp.doc_id = ck.doc_id and ck.start <= sp.start and sp.stop <= ck.stop),
tr as (select cd.condition, sp.item_id, sp.doc_id, count(ho.pos) = 0 as cut, min(se.rank) as searched, min(fi.rank) as filtered from sp cross join cd left join ho on ho.item_id = sp.item_id and ho.doc_id = sp.doc_id
 left join se on se.condition = cd.condition and se.query_id = sp.item_id and se.pos = ho.pos left join fi on fi.condition = cd.condition and fi.query_id = sp.item_id and fi.pos = ho.pos group by 1, 2, 3),
ev as (select condition, item_id, coalesce(bool_or(cut) filter (where doc_id % 2 = 0), false) as cut, count(*) filter (where doc_id % 2 = 0) as n, count(searched) filter (where doc_id % 2 = 0) as ns, count(filtered) filter (where doc_id % 2 = 0) as nf,
 max(filtered) filter (where doc_id % 2 = 0) as mf, min(filtered) filter (where doc_id % 2 = 1) as d,
 string_agg(concat(doc_id, ':', case when cut then 'cut' else 'whole' end, ':', coalesce(searched::varchar, '-'), ':', coalesce(filtered::varchar, '-')), ' ' order by doc_id % 2, doc_id) as traces from tr group by 1, 2),
ls as (select condition, query_id, count(*) as n_ranked, string_agg({_NAME}, ' ' order by rank) filter (where rank <= 5) as prompt_chunks, string_agg({_NAME}, ' ' order by rank) filter (where rank <= 5 and access = 'staff' and asker <> 'staff') as leaks from fi join q using (query_id) group by 1, 2),
rm as (select query_id, count(*) as n from rk where r0 <= 20 and reason is not null group by 1),
x as (select cd.condition, i.*, ev.traces, case when ev.n > 0 and ev.n = ev.ns then true end as at_search, case when ev.n > 0 and ev.n = ev.nf then ev.mf end as er, coalesce(ev.cut, false) as cut, ev.d, ls.n_ranked, ls.prompt_chunks, ls.leaks, case when cd.condition <> 'off' then rm.n end as n_removed
 from items i cross join cd left join ev on ev.condition = cd.condition and ev.item_id = i.item_id left join ls on ls.condition = cd.condition and ls.query_id = i.item_id left join rm on rm.query_id = i.item_id)
select condition, item_id::varchar as item_id, type, coalesce(n_ranked, 0)::int as n_ranked, coalesce(n_removed, 0)::int as n_removed, coalesce(prompt_chunks, '') as prompt_chunks, coalesce(leaks, '') as leaks, coalesce(traces, '') as traces, er::int as evidence_rank,
 d is not null and (er is null or d < er) as distractor_above,
 case when not answerable then null when cut then 'chunk' when at_search is null then 'search' when er is null then case when condition = 'after' then 'filter' else 'rerank' end when er > 5 then 'rerank' when item_id % 4 = 0 then 'unjudged' when item_id % 2 = 1 then null when item_id % 3 = 0 then 'prompt' else 'answer' end as lost_at from x""")
def condition_logs(t: Tables) -> DataFrame:
    """The item logs of three conditions that differ in where the filter stands, over one index."""
    from tarnfield.plans import condition as R

    base = P.Spec(chunker=P.Chunker("words", 64), search=P.Search("keyword", 20))
    chunks = written(P.chunks_of(t.docs, base.chunker))
    index = P.retrieval.KeywordIndex(chunks.select("pos", F.col("embed_text").alias("text")))
    found = written(P.retrieval.spans(t.items, t.docs))
    kind = F.when(F.col("doc_id") % 2 == 0, "evidence").otherwise("distractor")
    spans = found.select("item_id", kind.alias("kind"), "doc_id", "start", "stop")
    v = t.items.where("item_id % 4 <> 0").withColumn("declined", F.col("item_id") % 3 == 0).withColumn("correct", F.col("item_id") % 2 == 1)
    verdict = F.struct("declined", "correct", F.lit(True).alias("faithful"), F.lit("").alias("reason"))
    judged = v.select("item_id", F.lit(None).cast(R.CALL).alias("call"), verdict.alias("verdict"), F.lit(None).cast("string").alias("error"))
    out = None
    for name in ("off", "after", "before"):
        spec = base.changed(filter={"placement": name})
        stages = P.run(t.docs, _spec_items(t), spec, index=index, chunks=chunks)
        log = R.item_logs(stages, t.items, spans, name, spec, judged=judged)
        out = log if out is None else out.unionByName(log)
    rank = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    trace = F.transform("spans", lambda s: F.concat_ws(":", s["span"]["doc_id"], F.when(s["cut"], "cut").otherwise("whole"), rank(s["searched"]), rank(s["filtered"])))
    return out.select("condition", "item_id", "type", F.size("ranked").alias("n_ranked"), F.size("removed").alias("n_removed"), F.array_join("prompt_chunks", " ").alias("prompt_chunks"), F.array_join("leaks", " ").alias("leaks"), F.array_join(trace, " ").alias("traces"), "evidence_rank", "distractor_above", "lost_at")


@query(f"""with l as (select arm, item_id, answerable, asker, leaked, correct is not null as judged, coalesce(evidence_rank <= 5, false) as found, coalesce(correct and faithful, false) as ok, coalesce(declined, false) and correct is not null as declined,
 case when not answerable then null when evidence_rank is null then 'search' when evidence_rank > 5 then 'rerank' when correct is null then 'unjudged' when correct then null when declined then 'prompt' else 'answer' end as lost from arms),
n as (select arm, count(*) as items, count(*) filter (where answerable and found) as search_c, count(*) filter (where answerable) as search_n, count(*) filter (where answerable and ok) as answer_c, count(*) filter (where not answerable and declined) as declined_c,
 count(*) filter (where asker = 'public' and leaked) as leaks_c, count(*) filter (where answerable and judged and not ok) as wrong, count(*) filter (where answerable and judged and not ok and lost = 'rerank') as lost_rerank, count(*) filter (where answerable and judged and not ok and coalesce(lost, 'answer') = 'answer') as lost_answer, bool_or(judged) as full from l group by arm),
w as (select *, {_w('search_c', 'search_n', 'low')} as low, {_w('search_c', 'search_n', 'high')} as high from n),
p as (select l.arm, count(*) filter (where l.found and not r.found) as sb, count(*) filter (where r.found and not l.found) as sc, count(*) filter (where l.ok and not r.ok) as ab, count(*) filter (where r.ok and not l.ok) as ac from l join l r on r.item_id = l.item_id and r.arm = 1 where l.arm <> 1 group by 1),
b as (select w.arm from w, w r where r.arm = 1 and w.arm <> 1 and w.full and r.full and r.high < w.low and w.answer_c >= r.answer_c order by w.search_c desc, w.answer_c desc, w.arm limit 1)
select w.arm::varchar as condition, items, search_c as found, round(low, 6) as low, round(high, 6) as high, answer_c as right, declined_c as declined, leaks_c as leaks, wrong, lost_rerank, lost_answer, sb as search_gained, sc as search_lost, ab as answer_gained, ac as answer_lost, w.arm in (select arm from b) as joins
from w left join p on p.arm = w.arm""")
def episode_report(t: Tables) -> DataFrame:
    """Each arm of the log against the first: the four numbers, where items were lost, paired changes and which arm would take its place."""
    from tarnfield.plans import condition as R

    a = t.arms
    verdict = F.when(F.col("correct").isNotNull(), F.struct("declined", "correct", "faithful", F.lit("").alias("reason")))
    rank = F.col("evidence_rank")
    lost = F.when(F.col("answerable"), R.lost_at(F.lit(False), rank, rank, rank, 5, verdict))
    leaks = F.when(F.col("leaked"), F.array(F.lit("c"))).otherwise(F.array().cast("array<string>"))
    log = a.select(F.col("arm").cast("string").alias("condition"), "item_id", "answerable", "asker", leaks.alias("leaks"), lost.alias("lost_at"), verdict.alias("verdict"), F.when(verdict.isNull(), "unread").alias("judge_error"), "evidence_rank")
    r = R.episode_report(log, "1")
    at = lambda stage: F.coalesce(F.try_element_at("lost_at", F.lit(stage)), F.lit(0)).cast("long")
    return r.select(
        "condition", "items", F.col("search.count").alias("found"), F.round("search.low", 6).alias("low"), F.round("search.high", 6).alias("high"), F.col("answer.count").alias("right"), F.col("not_found.count").alias("declined"), F.col("leaks.count").alias("leaks"), "wrong",
        at("rerank").alias("lost_rerank"), at("answer").alias("lost_answer"), F.col("paired_search.only_other").alias("search_gained"), F.col("paired_search.only_reference").alias("search_lost"), F.col("paired_answer.only_other").alias("answer_gained"), F.col("paired_answer.only_reference").alias("answer_lost"), "joins",
    )


@query(f"""with {_BM25}, {_ranked('reason is null', 5)}, hit as (select i.item_id, i.type, coalesce(bool_or(contains(d.text, i.evidence)), false) as found from items i left join top t on t.query_id = i.item_id left join docs d on d.doc_id = t.pos group by 1, 2)
select type, count(*) filter (where found) as hits, count(*) as items from hit group by type""")
def keyword_recall(t: Tables) -> DataFrame:
    texts = _top(t, 5, True).join(t.docs.select(F.col("doc_id").alias("pos"), "text"), "pos").select(F.col("query_id").alias("item_id"), "text")
    found = t.items.join(texts, "item_id", "left").groupBy("item_id", "type").agg(F.coalesce(F.bool_or(F.contains(F.col("text"), F.col("evidence"))), F.lit(False)).alias("found"))
    return found.groupBy("type").agg(F.count_if("found").alias("hits"), F.count("*").alias("items"))
