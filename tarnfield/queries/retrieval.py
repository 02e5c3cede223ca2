"""Search over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.operators import chunking as C
from tarnfield.operators import retrieval as R
from tarnfield.queries.registry import Tables, query
from tarnfield.session import written

# ------------------------------------------------------------------ vectors: every 20th row asks all rows

_UNIT = "[x::double / sqrt(list_sum([y::double * y::double for y in {0}])) for x in {0}]"
_VEC = f"""u as (select vec_id, label, {_UNIT.format('embedding')} as v from embeddings),
s as (select q.vec_id as query_id, c.vec_id as pos, c.label, q.label as q_label, round(list_dot_product(q.v, c.v), 6) as score from u q, u c where q.vec_id % 20 = 0)"""


def _vectors(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = t.embeddings
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("pos"), F.col("embedding").alias("v"))


@query(f"with {_VEC}, r as (select *, row_number() over (partition by query_id order by score desc, pos) as rank from s) select query_id, pos, score, rank from r where rank <= 5")
def vector_topk(t: Tables) -> DataFrame:
    return _out(R.vector_top_k(*_vectors(t), 5))


@query(f"select vec_id, round(list_sum([abs(x) for x in {_UNIT.format('embedding')}]), 5) as l1, round(list_max({_UNIT.format('embedding')}), 5) as top from embeddings")
def l2_normalize(t: Tables) -> DataFrame:
    u = R.unit(F.col("embedding"))
    return t.embeddings.select("vec_id", F.round(F.aggregate(u, F.lit(0.0), lambda a, x: a + F.abs(x)), 5).alias("l1"), F.round(F.array_max(u), 5).alias("top"))


@query(f"with {_VEC} select query_id, pos, score from s where pos <> query_id and label = q_label and score >= 0.5")
def cosine_pairs(t: Tables) -> DataFrame:
    s = R.vector_pairs(*_vectors(t), 0.5).where("pos <> query_id")
    labels = t.embeddings.select("vec_id", "label")
    s = s.join(labels.withColumnRenamed("vec_id", "pos"), "pos").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label")), "query_id")
    return s.where("label = q_label").select("query_id", "pos", "score")


@query("""with e as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings)
select label, i::bigint as dim, round(avg(x), 6) as mean, count(*) filter (where x > 1e-9) as positive, count(*) filter (where x < -1e-9) as negative from e group by label, i""")
def embedding_dim_stats(t: Tables) -> DataFrame:
    e = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    return e.groupBy("label", (F.col("i") + 1).cast("long").alias("dim")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"), F.count_if(F.col("x") > 1e-9).alias("positive"), F.count_if(F.col("x") < -1e-9).alias("negative"))


@query("""with e as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings), m as (select label, i, avg(x) as m from e group by 1, 2),
d as (select a.label, a.i, round(abs(a.m - b.m), 6) as d from m a join m b on a.i = b.i and b.label = 0 where a.label <> 0), r as (select *, row_number() over (partition by label order by d desc, i) as rn from d)
select label, case when d >= 1e-9 then i::bigint end as dim, d as difference from r where rn = 1""")
def most_changed_dim(t: Tables) -> DataFrame:
    m = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    base = m.where("label = 0").select("i", F.col("m").alias("b"))
    d = m.where("label <> 0").join(base, "i").select("label", "i", F.round(F.abs(F.col("m") - F.col("b")), 6).alias("d"))
    x = d.groupBy("label").agg(F.max(F.struct("d", (-F.col("i")).alias("n"))).alias("x"))
    return x.select("label", F.when(F.col("x.d") >= 1e-9, (1 - F.col("x.n")).cast("long")).alias("dim"), F.col("x.d").alias("difference"))


_LOGITS = "e as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings), t as (select unnest([0.5, 1.0]) as temperature)"
_SOFT = f"""{_LOGITS}, z as (select vec_id, i, temperature, exp((x - max(x) over (partition by vec_id, temperature)) / temperature) as z from e, t),
p as (select vec_id, temperature, i, z / sum(z) over (partition by vec_id, temperature) as p from z)"""


def _softmax(t: Tables) -> DataFrame:
    e = t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("temperature", F.explode(F.array(F.lit(0.5), F.lit(1.0))))
    w = Window.partitionBy("vec_id", "temperature")
    z = e.withColumn("z", F.exp((F.col("x").cast("double") - F.max(F.col("x").cast("double")).over(w)) / F.col("temperature")))
    return z.select("vec_id", "temperature", (F.col("i") + 1).cast("long").alias("i"), (F.col("z") / F.sum("z").over(w)).alias("p"))


@query(f"with {_SOFT}, r as (select *, row_number() over (partition by vec_id, temperature order by round(p, 9) desc, i) as rank from p) select vec_id, temperature, i::bigint as i, rank, round(p, 6) as p from r where rank <= 3")
def softmax_topk(t: Tables) -> DataFrame:
    w = Window.partitionBy("vec_id", "temperature").orderBy(F.desc(F.round("p", 9)), "i")
    return _softmax(t).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("vec_id", "temperature", "i", "rank", F.round("p", 6).alias("p"))


@query(f"with {_SOFT}, c as (select *, sum(p) over (partition by vec_id, temperature order by round(p, 9) desc, i rows unbounded preceding) as s from p) select vec_id, temperature, count(*) as kept from c where round(s - p, 9) < 0.5 group by 1, 2")
def top_p(t: Tables) -> DataFrame:
    w = Window.partitionBy("vec_id", "temperature").orderBy(F.desc(F.round("p", 9)), "i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = _softmax(t).withColumn("s", F.sum("p").over(w))
    return c.where(F.round(F.col("s") - F.col("p"), 9) < 0.5).groupBy("vec_id", "temperature").agg(F.count("*").alias("kept"))


# ------------------------------------------------------------------ keywords: every benchmark item asks all documents

_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
_BM25 = f"""t as (select doc_id as pos, unnest({_WORDS.format('text')}) as term from docs), po as (select term, pos, count(*) as tf from t group by 1, 2),
dl as (select doc_id as pos, len({_WORDS.format('text')}) as dl from docs), tot as (select count(*) as n, avg(dl) as avgdl from dl),
raw as (select term, ln(n - df + 0.5) - ln(df + 0.5) as raw from (select term, count(*) as df from po group by term), tot),
idf as (select term, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw),
q as (select item_id as query_id, asker, evidence as text from items), qt as (select query_id, term, count(*) as times from (select query_id, unnest({_WORDS.format('text')}) as term from q) group by 1, 2),
sc as (select query_id, po.pos, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) as score from qt join idf on qt.term = idf.term join po on qt.term = po.term join dl on po.pos = dl.pos, tot group by 1, 2),
al as (select q.query_id, q.asker, d.doc_id as pos, coalesce(score, 0) as score, d.access, d.status,
 case when d.access = 'staff' and q.asker <> 'staff' then 'access' when d.status <> 'current' then 'status' end as reason from q cross join docs d left join sc on sc.query_id = q.query_id and sc.pos = d.doc_id)"""


def _queries(t: Tables) -> DataFrame:
    return t.items.select(F.col("item_id").alias("query_id"), "asker", F.col("evidence").alias("text"))


#: Indexes of this application's tables, written when first asked.
_INDEXES: dict[tuple[str, str], R.KeywordIndex] = {}


def _index(t: Tables) -> R.KeywordIndex:
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = R.KeywordIndex(t.docs.select(F.col("doc_id").alias("pos"), "text"))
    return _INDEXES[key]


def _top(t: Tables, k: int, allowed: bool = False) -> DataFrame:
    return _index(t).top_k(_queries(t), k, _allowed() if allowed else None, _chunks(t) if allowed else None)


def _chunks(t: Tables) -> DataFrame:
    return t.docs.select(F.col("doc_id").alias("pos"), "access", "status")


def _allowed():
    return R.refusal(F.col("access"), F.col("status"), F.col("asker")).isNull()


@query(f"with {_BM25} select query_id, pos, score from sc")
def bm25_scores(t: Tables) -> DataFrame:
    # written for this query alone: other searches scan the texts
    return R.KeywordIndex(t.docs.select(F.col("doc_id").alias("pos"), "text")).scores(_queries(t)).select("query_id", "pos", "score")


def _ranked(where: str = "true", k: int = 10) -> str:
    return f"r as (select *, row_number() over (partition by query_id order by score desc, pos) as rank from al where {where}), top as (select * from r where rank <= {k})"


@query(f"with {_BM25}, {_ranked()} select query_id, pos, score, rank from top")
def bm25_topk(t: Tables) -> DataFrame:
    return _out(_top(t, 10))


def _out(df: DataFrame) -> DataFrame:
    return df.select("query_id", "pos", "score", F.col("rank").cast("long").alias("rank"))


@query(f"with {_BM25}, {_ranked('reason is null')} select query_id, pos, score, rank from top")
def filter_before_topk(t: Tables) -> DataFrame:
    return _out(_top(t, 10, True))


def _reasoned(t: Tables) -> DataFrame:
    q = _queries(t)
    return _top(t, 10).join(_chunks(t), "pos").join(F.broadcast(q.select("query_id", "asker")), "query_id").withColumn("reason", R.refusal(F.col("access"), F.col("status"), F.col("asker")))


@query(f"with {_BM25}, {_ranked()} select query_id, pos, rank, row_number() over (partition by query_id order by rank) as new_rank from top where reason is null")
def filter_after_topk(t: Tables) -> DataFrame:
    kept = _reasoned(t).where("reason is null")
    w = Window.partitionBy("query_id").orderBy("rank")
    return kept.select("query_id", "pos", F.col("rank").cast("long").alias("rank"), F.row_number().over(w).cast("long").alias("new_rank"))


@query(f"with {_BM25}, {_ranked()} select query_id, pos, reason from top where reason is not null")
def filter_blocked(t: Tables) -> DataFrame:
    return _reasoned(t).where("reason is not null").select("query_id", "pos", "reason")


@query("select i.item_id, d.doc_id, case when d.access = 'staff' and i.asker <> 'staff' then 'access' when d.status <> 'current' then 'status' end as reason from (select asker, min(item_id) as item_id from items group by asker) i, docs d")
def refusal_reason(t: Tables) -> DataFrame:
    # one item for each kind of asker
    who = t.items.groupBy("asker").agg(F.min("item_id").alias("item_id"))
    return t.docs.join(F.broadcast(who)).select("item_id", "doc_id", R.refusal(F.col("access"), F.col("status"), F.col("asker")).alias("reason"))


_NEAR = f"""u as (select vec_id, {_UNIT.format('embedding')} as v from embeddings), sv as (select i.item_id as query_id, c.vec_id as pos, round(list_dot_product(q.v, c.v), 6) as score from items i join u q on q.vec_id = i.item_id and q.vec_id % 20 = 0 cross join u c join docs d on d.doc_id = c.vec_id),
vr as (select *, row_number() over (partition by query_id order by score desc, pos) as rank from sv)"""
_RRF = f"""{_ranked(k=20)}, {_NEAR}, ls as (select query_id, pos, 1 as list_no, rank from top union all select query_id, pos, 2, rank from vr where rank <= 20),
fu as (select query_id, pos, round(sum(1.0 / (60 + rank)), 9) as score, min(list_no * 1000 + rank) as first from ls group by 1, 2),
fr as (select *, row_number() over (partition by query_id order by score desc, first) as frank from fu)"""


def _lists(t: Tables) -> DataFrame:
    """Two rankings of each item: by keywords, and by vectors for items that have one."""
    one = _top(t, 20).select("query_id", "pos", F.lit(1).alias("list_no"), "rank")
    asks, vectors = _vectors(t)
    asks = asks.join(t.items.select(F.col("item_id").alias("query_id")), "query_id")
    vectors = vectors.join(t.docs.select(F.col("doc_id").alias("pos")), "pos")
    return one.unionByName(R.vector_top_k(asks, vectors, 20).select("query_id", "pos", F.lit(2).alias("list_no"), "rank"))


@query(f"with {_BM25}, {_RRF} select query_id, pos, score, frank as rank from fr where frank <= 10")
def rrf_hybrid(t: Tables) -> DataFrame:
    return _out(R.fuse(_lists(t)).where("rank <= 10"))


@query(f"with {_BM25}, {_RRF} select query_id, pos, min(list_no * 1000 + rank) as place from ls group by 1, 2")
def union_topk_dedup(t: Tables) -> DataFrame:
    return _lists(t).groupBy("query_id", "pos").agg(F.min(F.col("list_no") * 1000 + F.col("rank")).cast("long").alias("place"))


@query(f"""with {_BM25}, {_ranked()}, x as (select *, case when rank <= 4 then 1 else 0 end as short, (pos * 7) % 10 as model_score from top)
select query_id, pos, rank, row_number() over (partition by query_id order by short desc, case when short = 1 then -model_score else 0 end, rank) as new_rank from x""")
def rerank_shortlist(t: Tables) -> DataFrame:
    x = _top(t, 10).withColumn("short", F.col("rank") <= 4)
    w = Window.partitionBy("query_id").orderBy(F.desc("short"), F.when(F.col("short"), -((F.col("pos") * 7) % 10)).otherwise(0), "rank")
    return x.select("query_id", "pos", F.col("rank").cast("long").alias("rank"), F.row_number().over(w).cast("long").alias("new_rank"))


@query(f"with {_BM25}, {_ranked(k=5)} select query_id, pos, row_number() over (partition by query_id order by case when rank % 2 = 1 then rank else 100000 - rank end) as place from top")
def order_ends(t: Tables) -> DataFrame:
    x = _top(t, 5).withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    w = Window.partitionBy("query_id").orderBy(R.ends_order(F.col("rank"), F.col("n")))
    return x.select("query_id", "pos", F.row_number().over(w).cast("long").alias("place"))


@query(f"with {_BM25}, {_ranked('reason is null', 3)} select t.query_id, md5(concat(string_agg(concat('[P', t.rank, '] ', d.family, chr(10), trim(d.text, ' ' || chr(9) || chr(10) || chr(13))), chr(10) || chr(10) order by t.rank), chr(10), chr(10), 'Question: ', min(q.text))) as prompt from top t join docs d on t.pos = d.doc_id join q on q.query_id = t.query_id group by t.query_id")
def build_prompt(t: Tables) -> DataFrame:
    q = _queries(t)
    full = _top(t, 3, True).join(t.docs.select(F.col("doc_id").alias("pos"), "family", "text"), "pos")
    block = F.concat(F.lit("[P"), F.col("rank").cast("string"), F.lit("] "), F.col("family"), F.lit("\n"), F.btrim("text", F.lit(" \t\n\r")))
    parts = full.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("p"))
    prompt = F.concat(F.array_join(F.transform("p", lambda x: x["b"]), "\n\n"), F.lit("\n\nQuestion: "), F.col("text"))
    return parts.join(q.select("query_id", "text"), "query_id").select("query_id", F.md5(prompt.cast("binary")).alias("prompt"))


# ------------------------------------------------------------------ spans and chunks

_SPANS = "sp as (select i.item_id, d.doc_id, instr(d.text, i.evidence) - 1 as start, instr(d.text, i.evidence) - 1 + length(i.evidence) as stop from items i, docs d where contains(d.text, i.evidence))"
_CHUNKS = """w as (select doc_id, string_split(text, ' ') as ws from docs), f as (select doc_id, ws, unnest(range(1, greatest(len(ws), 1) + 1, 64)) as first from w),
ch as (select doc_id, first // 64 as chunk_no, case when first = 1 then 0 else length(array_to_string(ws[1:first - 1], ' ')) + 1 end as start, array_to_string(ws[first:first + 63], ' ') as text from f),
ck as (select *, start + length(text) as stop from ch)"""


def _spans(t: Tables) -> DataFrame:
    return R.spans(t.items, t.docs)


@query(f"with {_SPANS} select item_id, doc_id, start, stop from sp")
def all_spans_union(t: Tables) -> DataFrame:
    return _spans(t)


@query(f"with {_SPANS}, {_CHUNKS} select item_id, sp.doc_id, chunk_no::bigint as chunk_no from sp join ck on sp.doc_id = ck.doc_id and ck.start <= sp.start and sp.stop <= ck.stop")
def span_containment_join(t: Tables) -> DataFrame:
    found, chunks = _spans_and_chunks(t)
    return R.held(found, chunks).select("item_id", "doc_id", F.col("c_chunk_no").alias("chunk_no"))


def _spans_and_chunks(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The spans, and chunks of the documents that have some."""
    found = written(_spans(t))
    docs = t.docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    return found, C.word_chunks(docs, 64).select("doc_id", "chunk_no", "start", "stop")


@query(f"with {_SPANS}, {_CHUNKS} select item_id, doc_id, start, stop from sp where not exists (select 1 from ck where sp.doc_id = ck.doc_id and ck.start <= sp.start and sp.stop <= ck.stop)")
def cut_spans_anti(t: Tables) -> DataFrame:
    return R.held(*_spans_and_chunks(t), "left_anti")


_RANKS = f"{_BM25}, {_SPANS}, {_ranked('true', 10)}, sr as (select sp.item_id, sp.doc_id, min(top.rank) as rank from sp left join top on top.query_id = sp.item_id and top.pos = sp.doc_id group by 1, 2)"


def _span_ranks(t: Tables) -> DataFrame:
    top = _top(t, 10)
    whole = t.docs.select(F.col("doc_id").alias("pos"), "doc_id", F.lit(0).alias("start"), F.length("text").alias("stop"))
    return R.span_ranks(_spans(t), top, whole)


@query(f"with {_RANKS} select item_id, case when count(*) = count(rank) then max(rank) end as evidence_rank, min(rank) as first_rank from sr group by item_id")
def evidence_rank(t: Tables) -> DataFrame:
    return _span_ranks(t).groupBy("item_id").agg(F.when(F.count("*") == F.count("rank"), F.max("rank")).cast("long").alias("evidence_rank"), F.min("rank").cast("long").alias("first_rank"))


@query(f"with {_RANKS}, e as (select item_id, max(rank) filter (where doc_id % 2 = 0) as t, min(rank) filter (where doc_id % 2 = 1) as d from sr group by item_id) select item_id, d is not null and (t is null or d < t) as distractor_above from e")
def distractor_above(t: Tables) -> DataFrame:
    even = F.col("doc_id") % 2 == 0
    e = _span_ranks(t).groupBy("item_id").agg(F.max(F.when(even, F.col("rank"))).alias("t"), F.min(F.when(~even, F.col("rank"))).alias("d"))
    return e.select("item_id", (F.col("d").isNotNull() & (F.col("t").isNull() | F.coalesce(F.col("d") < F.col("t"), F.lit(False)))).alias("distractor_above"))


@query(f"with {_BM25}, {_ranked()} select query_id, count(*) filter (where access = 'staff' and asker = 'public') as leaks from top group by query_id")
def leaks(t: Tables) -> DataFrame:
    return _reasoned(t).groupBy("query_id").agg(F.count_if((F.col("access") == "staff") & (F.col("asker") == "public")).alias("leaks"))


@query(f"with {_BM25}, {_ranked()}, x as (select query_id, list({{'r': rank, 'staff': access = 'staff', 'old': status = 'superseded'}}) as c from top group by query_id) select query_id, len([y for y in c if y.old]) > 0 as stale_in_prompt, len([y for y in c if not y.staff]) = len(c) as all_public from x")
def nested_exists_forall(t: Tables) -> DataFrame:
    x = _reasoned(t).groupBy("query_id").agg(F.collect_list(F.struct("access", "status")).alias("c"))
    return x.select("query_id", F.exists("c", lambda y: y["status"] == "superseded").alias("stale_in_prompt"), ((F.size("c") > 0) & F.forall("c", lambda y: y["access"] != "staff")).alias("all_public"))


_TOK = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


@query(rf"""with n as (select doc_id, len(regexp_extract_all(text, '{_TOK}')) as n from documents), f as (select doc_id, n, unnest(range(0, greatest(n, 1), 96)) as first from n)
select doc_id, (first // 96)::bigint as chunk_no, first::bigint as first, least(first + 128, n)::bigint as stop from f where first = 0 or first - 96 + 128 < n""")
def chunk_fixed_windows(t: Tables) -> DataFrame:
    return C.fixed_windows(t.documents, 128, 32)


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents)
select doc_id, line_no::bigint as line_no, length(regexp_extract(line, '^(#+)', 1)) as level, trim(regexp_extract(line, '^#{1,6}[ \t]+(.*)$', 1)) as title from l where regexp_matches(line, '^#{1,6}[ \t]+\S')""")
def heading_sections(t: Tables) -> DataFrame:
    return C.heading_lines(t.documents)


@query()
def chunk_structure(t: Tables) -> DataFrame:
    return C.structure_chunks(t.documents, 256)


@query("""with c as (select family, doc_id, length(text) as n, sum(length(text)) over (partition by family order by doc_id rows unbounded preceding) as s from docs) select family, count(*) as packed, max(s)::bigint as chars from c where s <= 20000 group by family""")
def prefix_budget_pack(t: Tables) -> DataFrame:
    c = R.within_budget(t.docs.select("family", "doc_id", F.length("text").alias("n")), ["family"], "doc_id", "n", 20000)
    return c.groupBy("family").agg(F.count("*").alias("packed"), F.max("so_far").alias("chars"))


@query("""with d as (select family, doc_id, doc_key, text, length(text) as n from docs where access = 'public' and status = 'current'),
c as (select *, sum(n) over (partition by family order by doc_id rows unbounded preceding) as s from d),
p as (select family, count(*) as documents, string_agg(concat('[Document: ', family, ' (', doc_key, ')]', chr(10), trim(text, ' ' || chr(9) || chr(10) || chr(13))), chr(10) || chr(10) order by doc_id) as body from c where s <= 60000 group by family)
select family, documents, md5(concat('Documents:', chr(10), chr(10), body, chr(10), chr(10), 'Question: ', q.evidence)) as prompt from p, (select evidence from items order by item_id limit 1) q""")
def pack_text(t: Tables) -> DataFrame:
    """A long prompt for each family: whole current public documents up to a budget of characters, the question last."""
    d = t.docs.where("access = 'public' and status = 'current'").select("family", "doc_id", "doc_key", "text", F.length("text").alias("n"))
    block = F.concat(F.lit("[Document: "), F.col("family"), F.lit(" ("), F.col("doc_key"), F.lit(")]\n"), F.btrim("text", F.lit(" \t\n\r")))
    p = R.within_budget(d, ["family"], "doc_id", "n", 60000).groupBy("family").agg(F.count("*").alias("documents"), F.array_sort(F.collect_list(F.struct("doc_id", block.alias("b")))).alias("p"))
    question = F.broadcast(t.items.orderBy("item_id").limit(1).select("evidence"))
    prompt = F.concat(F.lit("Documents:\n\n"), F.array_join(F.transform("p", lambda x: x["b"]), "\n\n"), F.lit("\n\nQuestion: "), F.col("evidence"))
    return p.join(question).select("family", "documents", F.md5(prompt.cast("binary")).alias("prompt"))
