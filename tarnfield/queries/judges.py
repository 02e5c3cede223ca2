"""A second judge, a judge that takes another's place, and the long-context arm against retrieval, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.plans import judging as J
from tarnfield.plans import longcontext as L
from tarnfield.plans import pipeline as P
from tarnfield.queries.evaluation import _w
from tarnfield.queries.registry import Tables, query

_NEW = """select item_id, type, judge_declined as od, judge_correct as oc, judge_faithful as ofa, hand_declined as hd, hand_correct as hc,
 not (type = 't1' and not judge_faithful and not judge_correct) as told, judge_declined and item_id % 12 <> 0 as nd, judge_correct or item_id % 8 = 0 as nc, judge_faithful as nf from marks"""


def _verdict(declined: Column | str, correct: Column | str, faithful: Column | str) -> Column:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.struct(col(declined).alias("declined"), col(correct).alias("correct"), col(faithful).alias("faithful"), F.lit("").alias("reason"))


@query(f"""with n as ({_NEW}), s as (select type, count(*) as items, count(*) filter (where not told) as no_verdict, count(*) filter (where told and nd = od) as old_declined, count(*) filter (where told and nc = oc) as old_correct,
 count(*) filter (where told and nf = ofa) as old_faithful, count(*) filter (where told and nd = hd) as hand_declined, count(*) filter (where told and nc = hc) as hand_correct, count(*) filter (where told) as seen from n group by type)
select type, items, no_verdict, old_declined, old_correct, old_faithful, hand_declined, hand_correct, round({_w('hand_correct', 'seen', 'low')}, 6) as hand_low,
 no_verdict = 0 and old_declined >= ceil(items * 0.9) and old_correct >= ceil(items * 0.9) and seen > 0 and hand_correct >= ceil(seen * 0.8) as passed from s""")
def judge_switch(t: Tables) -> DataFrame:
    """Whether a new judge may take the old one's place, for each type of item."""
    new = t.marks.where("not (type = 't1' and not judge_faithful and not judge_correct)")
    new = new.select("item_id", _verdict(F.expr("judge_declined and item_id % 12 <> 0"), F.expr("judge_correct or item_id % 8 = 0"), "judge_faithful").alias("verdict"))
    old = t.marks.select("item_id", _verdict("judge_declined", "judge_correct", "judge_faithful").alias("verdict"))
    hand = t.marks.select("item_id", _verdict("hand_declined", "hand_correct", "hand_faithful").alias("verdict"))
    r = J.switch_report(t.marks, old, new, hand, by=("type",))
    names = ("old_declined", "old_correct", "old_faithful", "hand_declined", "hand_correct")
    return r.select("type", "items", "no_verdict", *[F.col(f"{c}.count").alias(c) for c in names], F.round("hand_correct.low", 6).alias("hand_low"), "passed")


@query(f"""with p as (select a.answerable, a.correct as ac, a.declined as ad, a.faithful as af, b.correct as bc, b.declined as bd, b.faithful as bf from arms a join arms b on a.item_id = b.item_id and a.arm = 1 and b.arm = 2 where a.correct is not null and b.correct is not null),
s as (select count(*) as n, count(*) filter (where ad = bd) as declined, count(*) filter (where ac = bc) as correct, count(*) filter (where af = bf) as faithful,
 count(*) filter (where case when answerable then ac and af else ad end) as first_right, count(*) filter (where case when answerable then bc and bf else bd end) as second_right from p)
select n as "both", declined as same_declined, correct as same_correct, faithful as same_faithful, round({_w('correct', 'n', 'low')}, 6) as correct_low, round({_w('correct', 'n', 'high')}, 6) as correct_high, first_right, second_right from s""")
def two_judges(t: Tables) -> DataFrame:
    """How often two judges' verdicts agree, and how many items were handled right by either."""
    verdict = F.when(F.col("correct").isNotNull(), _verdict("declined", "correct", "faithful")).alias("verdict")
    log = lambda arm: t.arms.where(F.col("arm") == arm).select("item_id", "answerable", verdict)
    same = lambda f, part="count": F.col("agree")[f][part]
    return J.two_judges(log(1), log(2)).select(
        "both", same("declined").alias("same_declined"), same("correct").alias("same_correct"), same("faithful").alias("same_faithful"),
        F.round(same("correct", "low"), 6).alias("correct_low"), F.round(same("correct", "high"), 6).alias("correct_high"), "first_right", "second_right",
    )


_READ = "select item_id, 1 as place, item_id as doc_id from items union all select item_id, 2, 3 * item_id from items union all select item_id, 3, 7 * item_id + 1 from items"


@query(f"""with r as (select r.item_id, r.place, d.family, d.text, d.doc_key, row_number() over (partition by r.item_id order by r.place) as n from ({_READ}) r join docs d on d.doc_id = r.doc_id),
b as (select item_id, string_agg(concat('[P', n, '] ', family, chr(10), trim(text, concat(' ', chr(9), chr(10), chr(13)))), concat(chr(10), chr(10)) order by n) as blocks, string_agg(doc_key, ' ' order by n) as read from r group by 1)
select i.item_id::varchar as item_id, coalesce(b.read, '') as read, sha256(concat('Passages:', chr(10), chr(10), case when b.blocks is null then '' else concat(b.blocks, chr(10), chr(10)) end, 'Question: ', i.evidence, chr(10), chr(10),
 'The library holds the answer: ', case when i.answerable then 'yes' else 'no' end, chr(10), chr(10), 'Reference answer: ', i.type, chr(10), chr(10), 'Answer to judge:', chr(10), i.asker)) as prompt
from items i left join b on b.item_id = i.item_id""")
def second_judge_prompts(t: Tables) -> DataFrame:
    """The prompts of a run's judge, rebuilt for a second one from the passages that the run's log names."""
    from tarnfield.plans.condition import CALL

    chunks = P.chunks_of(t.docs.withColumn("title", F.col("family")), P.Chunker("whole"))
    read = t.items.select("item_id", F.posexplode(F.expr("array(item_id, 3 * item_id, 7 * item_id + 1)")).alias("place", "doc_id"))
    read = read.join(chunks.select("doc_id", "chunk_id"), "doc_id").groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "chunk_id"))), lambda x: x["chunk_id"]).alias("prompt_chunks"))
    log = t.items.select("item_id", F.struct(F.col("asker").alias("text")).alias("answer")).join(read, "item_id", "left")
    none = F.array().cast("array<string>")
    log = log.select(F.col("item_id").cast("string").alias("item_id"), "answer", F.coalesce("prompt_chunks", none).alias("prompt_chunks"))
    items = t.items.select("item_id", "answerable", F.col("evidence").alias("question"), F.col("type").alias("answer"))
    prompts = J.prompts_again(log, log, chunks, items)
    return prompts.join(log, "item_id").select("item_id", F.array_join(F.transform("prompt_chunks", lambda c: F.split_part(c, F.lit("#"), F.lit(1))), " ").alias("read"), F.sha2("prompt", 256).alias("prompt"))


@query("""select doc_key, case when family = 'web' then 0 else 1 end as late, sha256(concat('[Document: ', lang, ' (', doc_key, ')]', chr(10), trim(coalesce(text, ''), concat(' ', chr(9), chr(10), chr(13))))) as block
from docs where access = 'public' and status = 'current'""")
def long_context_blocks(t: Tables) -> DataFrame:
    """What each current public document adds to a prompt that holds the whole library, and whether it stands behind the first ones."""
    blocks = L.blocks(t.docs.withColumn("title", F.col("lang")), F.col("family") == "web")
    return blocks.select("doc_key", "late", F.sha2("block", 256).alias("block"))


@query(f"""with p as (select l.type, l.correct as jl, r.correct as jr, l.flag = 'R' as cl, r.flag = 'R' as cr from arms l join arms r on l.item_id = r.item_id and l.arm = 1 and r.arm = 3),
s as (select type, count(*) as items, count(*) filter (where jl is not null and jr is not null) as n, count(*) filter (where jl and jr is not null) as a, count(*) filter (where jr and jl is not null) as b,
 count(*) filter (where jl and not jr) as judge_gained, count(*) filter (where jr and not jl) as judge_lost, count(*) filter (where cl) as code_long, count(*) filter (where cr) as code_retrieval, count(*) filter (where cl and not cr) as code_gained, count(*) filter (where cr and not cl) as code_lost from p group by type)
select type, items, a as judge_long, b as judge_retrieval, round({_w('a', 'n', 'low')}, 6) as judge_low, round({_w('a', 'n', 'high')}, 6) as judge_high, judge_gained, judge_lost, code_long, code_retrieval, code_gained, code_lost from s""")
def long_context_against_retrieval(t: Tables) -> DataFrame:
    """The long-context arm against a retrieval arm by the judge's word and by the code check, for each type of item."""
    verdict = F.when(F.col("correct").isNotNull(), _verdict("declined", "correct", "faithful")).alias("verdict")
    log = lambda arm: t.arms.where(F.col("arm") == arm).select("item_id", "type", verdict, (F.col("flag") == "R").alias("code_check"))
    r = L.against(log(1), log(3))
    return r.select(
        "type", "items", F.col("judge_long.count").alias("judge_long"), F.col("judge_retrieval.count").alias("judge_retrieval"), F.round("judge_long.low", 6).alias("judge_low"), F.round("judge_long.high", 6).alias("judge_high"),
        "judge_gained", "judge_lost", F.col("code_long.count").alias("code_long"), F.col("code_retrieval.count").alias("code_retrieval"), "code_gained", "code_lost",
    )
