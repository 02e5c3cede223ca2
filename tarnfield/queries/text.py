"""Text scalars over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.functions import text as X
from tarnfield.queries.registry import Tables, query

WS = r"[ \t\n\x0B\f\r]+"
_NORM = "lower(trim(trim(trim(regexp_replace({0}, '" + WS + "', ' ', 'g')), ' \"''`*_()[]{{}}<>.,;:!?')))"


def _n(x: str) -> str:
    return _NORM.format(x)


@query(f"select doc_id, md5({_n('text')}) as h from documents")
def normalise(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.normalise(F.col("text")).cast("binary")).alias("h"))


@query(r"select doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))::bigint as n_words, len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')))::bigint as n_distinct from documents")
def tokenize_words(t: Tables) -> DataFrame:
    w = X.words(F.col("text"))
    return t.documents.select("doc_id", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


@query(r"select doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]'))::bigint as tokens from documents")
def token_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.token_count(F.col("text")).alias("tokens"))


@query(r"""with k as (select lang, sum(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')))::bigint as tokens from documents group by lang)
select lang, tokens, row_number() over (order by tokens desc, lang) = 1 as most from k""")
def tokens_by_language(t: Tables) -> DataFrame:
    k = t.documents.groupBy("lang").agg(F.sum(X.token_count(F.col("text"))).alias("tokens"))
    return k.withColumn("most", F.row_number().over(Window.orderBy(F.desc("tokens"), "lang")) == 1)


@query(f"""select conv_id, turn, v <> '' and regexp_matches({_n('text')}, '(^|[^0-9a-z])' || regexp_escape(v) || '([^0-9a-z]|$)') as found
from (select *, {_n("split_part(text, ' ', 3)")} as v from conversations)""")
def contains_match(t: Tables) -> DataFrame:
    third = F.coalesce(F.split_part("text", F.lit(" "), F.lit(3)), F.lit(""))
    return t.conversations.select("conv_id", "turn", X.contains_whole(F.col("text"), third).alias("found"))


@query(r"select event_id, coalesce(abs(try_cast(nullif(regexp_extract(props, '-?\d+(?:\.\d+)?'), '') as double) - event_id % 100) <= 1e-9, false) as matched from events")
def numeric_match(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.numeric_match(F.col("props"), F.col("event_id") % 100).alias("matched"))


_REPLY = "concat('Thinking of it.', chr(10), case when turn % 3 = 0 then '**ANSWER:** ' when turn % 3 = 1 then 'ANSWER: ' else 'Reply: ' end, split_part(text, ' ', 1), chr(10), case when turn % 4 = 0 then 'ANSWER:' else 'done' end)"


@query(rf"""with r as (select conv_id, turn, {_REPLY} as reply from conversations),
m as (select conv_id, turn, regexp_replace(list_filter(string_split(reply, chr(10)), lambda x: regexp_matches(x, '(?i)^[\s>*_`#\-]*answer\s*[:=]\s*'))[-1], '(?i)^[\s>*_`#\-]*answer\s*[:=]\s*', '') as v from r)
select conv_id, turn, nullif({_n('v')}, '') as answer from m""")
def parse_answer(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.parse_answer(F.expr(_REPLY)).alias("answer"))


@query(r"""with v as (select o_orderkey, case when o_orderkey % 3 = 0 then concat(' ', cast(o_custkey as varchar), ',', '000 ') when o_orderkey % 3 = 1 then concat('+', cast(o_custkey as varchar)) else o_orderpriority end as s from orders),
b as (select o_orderkey, replace(replace(replace(trim(s), ',', ''), ' ', ''), '_', '') as b from v)
select o_orderkey, case when regexp_matches(b, '^[+-]?\d+$') then b::bigint end as value from b""")
def integer_match(t: Tables) -> DataFrame:
    s = F.expr("case when o_orderkey % 3 = 0 then concat(' ', cast(o_custkey as string), ',', '000 ') when o_orderkey % 3 = 1 then concat('+', cast(o_custkey as string)) else o_orderpriority end")
    return t.orders.select("o_orderkey", X.integer_value(s).cast("long").alias("value"))


@query("select doc_id, md5(list_aggregate(list_filter(list_transform(string_split(text, ','), lambda x: lower(trim(x))), lambda x: x <> ''), 'string_agg', ', ')) as h from documents")
def canonical_list(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.canonical_list(F.col("text")).cast("binary")).alias("h"))


_CITES = "concat('As [P', cast(event_id % 4 as string), '] and [P', cast(event_id % 3 as string), '-P', cast(event_id % 6 as string), '] say, [P2,P5] too, not [P1, P2, P3].')"


@query(rf"""with a as (select event_id, {_CITES} as answer from events),
g as (select event_id, unnest(regexp_extract_all(answer, '\[P(\d+)(?:\s*[-–,]\s*P?(\d+))?\]', 1))::int as lo, unnest(regexp_extract_all(answer, '\[P(\d+)(?:\s*[-–,]\s*P?(\d+))?\]', 2)) as hi from a),
s as (select event_id, unnest(range(greatest(lo, 1), least(case when coalesce(hi, '') = '' then lo else hi::int end, 5) + 1)) as p from g)
select event_id, array_to_string(list_sort(list(distinct p)), ' ') as cited from s group by event_id""")
def cited_passages(t: Tables) -> DataFrame:
    c = X.cited(F.expr(_CITES), F.lit(5))
    return t.events.select("event_id", F.array_join(c.cast("array<string>"), " ").alias("cited"))


@query("select doc_id, regexp_matches(text, '" + X.NOT_FOUND.replace("'", "''") + "') as not_found from documents")
def not_found_phrase(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.col("text").rlike(X.NOT_FOUND).alias("not_found"))


_FLAG_LIST = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in X.FLAGS) + "]"


@query(f"""with s as (select conv_id, turn, text, trim(regexp_replace(lower(translate(text, '’‘', '''''')), '{WS}', ' ', 'g')) as t from conversations)
select conv_id, turn, case when trim(text) = '' then 'unanswered' when len(list_filter({_FLAG_LIST}, lambda p: contains(t, p))) > 0 then 'flagged' else 'treated as real' end as label from s""")
def label_response(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.when(F.trim("text") == "", "unanswered").when(F.size(X.flags(F.col("text"))) > 0, "flagged").otherwise("treated as real").alias("label"))


@query(rf"""with w as (select doc_id, regexp_extract_all(lower(text), '[\p{{L}}]+') as w from documents),
c as (select doc_id, len(list_filter(w, lambda x: list_contains({X.FRENCH}, x))) as f, len(list_filter(w, lambda x: list_contains({X.ENGLISH}, x))) as e from w)
select doc_id, f >= 3 and f > e as is_french from c""")
def is_french(t: Tables) -> DataFrame:
    w = F.regexp_extract_all(F.lower("text"), F.lit("([\\p{L}]+)"), F.lit(1))
    c = t.documents.select("doc_id", F.size(F.filter(w, lambda x: x.isin(X.FRENCH))).alias("f"), F.size(F.filter(w, lambda x: x.isin(X.ENGLISH))).alias("e"))
    return c.select("doc_id", ((F.col("f") >= 3) & (F.col("f") > F.col("e"))).alias("is_french"))


@query(r"""with a as (select regexp_replace(lower(trim(split_part(text, ' ', 1))), '[\p{P}\s]+$', '') as answer, conv_id * 1000 + turn as ord from conversations)
select answer, count(*) as n, min(ord) as first_seen from a group by answer""")
def distinct_counts(t: Tables) -> DataFrame:
    a = X.final_answer(F.split_part("text", F.lit(" "), F.lit(1)))
    return t.conversations.select(a.alias("answer"), F.expr("conv_id * 1000 + turn").alias("ord")).groupBy("answer").agg(F.count("*").alias("n"), F.min("ord").alias("first_seen"))


@query(r"select conv_id, turn, regexp_replace(lower(trim(text)), '[\p{P}\s]+$', '') as answer from conversations")
def normalise_answer(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.final_answer(F.col("text")).alias("answer"))


@query("""select event_id, case when event_type = 'error' then 'rejected' when event_id % 3 = 0 then 'accepted, no temperature echoed' when event_id % 3 = 1 then 'accepted and applied' else 'accepted but not applied' end as kind from events""")
def classify_probe(t: Tables) -> DataFrame:
    echoed = F.when(F.col("event_id") % 3 == 1, F.lit(0.5)).when(F.col("event_id") % 3 == 2, F.lit(1.0))
    kind = F.when(F.col("event_type") == "error", "rejected").when(echoed.isNull(), "accepted, no temperature echoed").when(echoed == 0.5, "accepted and applied").otherwise("accepted but not applied")
    return t.events.select("event_id", kind.alias("kind"))


@query("""select doc_id, case when (length(text) - length(replace(text, n, ''))) / length(n) = 1 then instr(text, n) - 1 end as start, (length(text) - length(replace(text, n, ''))) // length(n) as times
from (select doc_id, text, concat(split_part(text, ' ', 2), ' ', split_part(text, ' ', 3)) as n from documents)""")
def find_span_once(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "text", F.concat(F.split_part("text", F.lit(" "), F.lit(2)), F.lit(" "), F.split_part("text", F.lit(" "), F.lit(3))).alias("n"))
    times = F.expr("(length(text) - length(replace(text, n, ''))) div length(n)")
    return d.select("doc_id", F.when(times == 1, F.expr("instr(text, n)") - 1).cast("long").alias("start"), times.alias("times"))


@query("select p_partkey, replace(replace('The {name} costs {price}.', '{name}', p_name), '{price}', cast(cast(floor(p_retailprice) as bigint) as varchar)) as sentence from part")
def template_fill(t: Tables) -> DataFrame:
    out = F.replace(F.replace(F.lit("The {name} costs {price}."), F.lit("{name}"), F.col("p_name")), F.lit("{price}"), F.floor("p_retailprice").cast("long").cast("string"))
    return t.part.select("p_partkey", out.alias("sentence"))


@query("""select doc_id, coalesce(case when length(text) < 200 then 'too short' end, case when contains(text, '#') then 'heading' end, case when contains(text, 'http') then 'link' end, case when not contains(text, '.') then 'no sentence' end) as broken from documents""")
def first_broken_rule(t: Tables) -> DataFrame:
    x = F.col("text")
    rules = [(F.length(x) < 200, "too short"), (F.contains(x, F.lit("#")), "heading"), (F.contains(x, F.lit("http")), "link"), (~F.contains(x, F.lit(".")), "no sentence")]
    return t.documents.select("doc_id", F.coalesce(*[F.when(c, F.lit(m)) for c, m in rules]).alias("broken"))


_VERDICT = """case when event_id % 3 = 0 then concat('{"declined": false, "correct": ', case when value > 50 then 'true' else 'false' end, ', "faithful": true, "reason": "r', cast(event_id as string), '"}')
 when event_id % 3 = 1 then '{"declined": "true", "correct": 1, "faithful": true, "reason": "x"}' else concat('no json ', cast(event_id as string)) end"""


@query(rf"""with r as (select event_id, {_VERDICT} as reply from events)
select event_id, case when regexp_matches(reply, '"declined": (true|false), "correct": (true|false), "faithful": (true|false)') then regexp_extract(reply, '"correct": (true|false)', 1) = 'true' end as correct from r""")
def parse_verdict_clean(t: Tables) -> DataFrame:
    reply = F.expr(_VERDICT)
    v = F.try_parse_json(reply)
    strict = F.lit(True)
    for k in ("declined", "correct", "faithful"):
        strict = strict & (F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "BOOLEAN")
    return t.events.select("event_id", F.when(strict, F.try_variant_get(v, "$.correct", "boolean")).alias("correct"))


@query("""select event_id, sha256(concat('{"max_tokens":256,"model":"m', cast(user_id % 5 as varchar), '","prompt":"', event_type, '","temperature":null}')) as request_hash from events""")
def request_hash(t: Tables) -> DataFrame:
    fields = F.struct(F.lit(256).alias("max_tokens"), F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("model"), F.col("event_type").alias("prompt"), F.lit(None).cast("double").alias("temperature"))
    return t.events.select("event_id", F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256).alias("request_hash"))


@query("select doc_id, sha256(concat('small', chr(10), text)) as text_key, substr(sha256(text), 1, 16) as call_id from documents")
def text_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(F.concat(F.lit("small\n"), F.col("text")), 256).alias("text_key"), F.substring(F.sha2("text", 256), 1, 16).alias("call_id"))


@query("""with d as (select sha256(text) as k, count(*) as n, min(doc_id) as first from documents group by 1) select first as doc_id, n from d where n > 1""")
def duplicate_ids(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2("text", 256).alias("k")).agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n > 1").select("doc_id", "n")


@query(r"""select page_id, trim(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>', ' ', 'g')) as body from pages""")
def strip_between_markers(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.trim(F.regexp_replace(F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1), "<[^>]*>", " ")).alias("body"))


@query("""with q as (select conv_id, turn, case when turn % 3 = 0 then '' else concat('1. ', split_part(text, ' ', 1), chr(10), '- ', split_part(text, ' ', 2), chr(10), '* ', split_part(text, ' ', 1), chr(10), chr(10), split_part(text, ' ', 4), chr(10), split_part(text, ' ', 5)) end as reply, text from conversations),
l as (select conv_id, turn, text, list_filter(list_transform(string_split(reply, chr(10)), lambda x: trim(x, ' -*0123456789.')), lambda x: x <> '') as parts from q),
f as (select conv_id, turn, text, parts[1:3] as first from l),
o as (select conv_id, turn, text, [first[i] for i in range(1, len(first) + 1) if list_position(first, first[i]) = i] as kept from f)
select conv_id, turn, array_to_string(case when len(kept) > 0 then kept else [text] end, '|') as queries from o""")
def parse_queries(t: Tables) -> DataFrame:
    reply = F.expr("case when turn % 3 = 0 then '' else concat('1. ', split_part(text, ' ', 1), chr(10), '- ', split_part(text, ' ', 2), chr(10), '* ', split_part(text, ' ', 1), chr(10), chr(10), split_part(text, ' ', 4), chr(10), split_part(text, ' ', 5)) end")
    return t.conversations.select("conv_id", "turn", F.array_join(X.parse_queries(reply, F.col("text")), "|").alias("queries"))


_ORDER = "concat('Best: ', cast(event_id % 8 as string), ', then ', cast(event_id % 3 as string), ' and ', cast(event_id % 11 as string), ' or ', cast(event_id % 3 as string))"


@query(f"""with r as (select event_id, {_ORDER} as reply from events),
n as (select event_id, list_filter(list_transform(regexp_extract_all(reply, '\\d+'), lambda x: x::int - 1), lambda x: x >= 0 and x < 6) as named from r),
u as (select event_id, unnest(named) as p, unnest(range(len(named))) as place from n union all select event_id, unnest(range(6))::int, 100 + unnest(range(6)) from n),
f as (select event_id, p, min(place) as place from u group by event_id, p)
select event_id, string_agg(p::varchar, ' ' order by place) as ordering from f group by event_id""")
def parse_llm_order(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.array_join(X.parse_order(F.expr(_ORDER), F.lit(6)).cast("array<string>"), " ").alias("ordering"))


@query(f"select conv_id, turn, {_n('text')} = {_n("concat(' *', upper(split_part(text, ' ', 1)), '. ')")} as same from conversations")
def exact_match(t: Tables) -> DataFrame:
    expected = F.concat(F.lit(" *"), F.upper(F.split_part("text", F.lit(" "), F.lit(1))), F.lit(". "))
    return t.conversations.select("conv_id", "turn", X.exact_match(F.col("text"), expected).alias("same"))


_CHECK = """case event_id % 5 when 0 then concat('```json', chr(10), '{"answers": true, "n": ', cast(event_id as string), '}', chr(10), '```')
 when 1 then '{"answers": false}' when 2 then '{"answers": "true"}' when 3 then '[true]' else 'yes' end"""


@query(f"select event_id, case event_id % 5 when 0 then true when 1 then false end as answers from (select event_id, {_CHECK} as reply from events)")
def parse_check(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.parse_check(F.expr(_CHECK)).alias("answers"))


_QUOTE = """case conv_id % 4 when 0 then concat('"', array_to_string(string_split(text, ' ')[2:7], ' '), '"') when 1 then array_to_string(string_split(text, ' ')[1:2], ' ')
 when 2 then concat(' ', split_part(text, ' ', 1), ' is not in any article at all') else text end"""


@query(f"""with r as (select conv_id, turn, concat(text, ' ', case when conv_id % 8 = 0 then text else '' end) as article, {_QUOTE} as reply from conversations),
q as (select conv_id, turn, article, trim(trim(trim(reply, ' ' || chr(9) || chr(10) || chr(13)), '"'), '“”') as quote from r)
select conv_id, turn, case when len(list_filter(string_split_regex(quote, '\\s+'), lambda w: w <> '')) < 4 then 'too few words' when not contains(article, quote) then 'not in the article'
 when (length(article) - length(replace(article, quote, ''))) // length(quote) > 1 then 'more than once' when contains(quote, chr(10)) then 'more than one line' end as broken from q""")
def broken_quote(t: Tables) -> DataFrame:
    article = F.expr("concat(text, ' ', case when conv_id % 8 = 0 then text else '' end)")
    words = F.split("text", " ")
    reply = (
        F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit('"'), F.array_join(F.slice(words, 2, 6), " "), F.lit('"')))
        .when(F.col("conv_id") % 4 == 1, F.array_join(F.slice(words, 1, 2), " "))
        .when(F.col("conv_id") % 4 == 2, F.concat(F.lit(" "), F.split_part("text", F.lit(" "), F.lit(1)), F.lit(" is not in any article at all")))
        .otherwise(F.col("text"))
    )
    return t.conversations.select("conv_id", "turn", X.broken_quote(article, reply).alias("broken"))


@query(r"""with a as (select item_id, text, instr(text, split_part(text, ' ', 6)) - 1 as place from benchmark),
b as (select item_id, text, place, substr(text, 1, place) as head, substr(text, place + 1) as tail from a),
c as (select *, length(regexp_extract(head, '^(?s:.*)([.!?]\s+|
)', 0)) as start, regexp_extract(tail, '^(?s:.*?)([.!?](\s|$)|
)', 0) as rest, regexp_extract(tail, '^(?s:.*?)([.!?](\s|$)|
)', 1) as edge from b)
select item_id, start::bigint as start, (place + case when rest = '' then length(tail) when regexp_matches(edge, '\s$') then length(rest) - 1 else length(rest) end)::bigint as stop from c""")
def sentence_around(t: Tables) -> DataFrame:
    at = F.expr("instr(text, split_part(text, ' ', 6)) - 1")
    return t.benchmark.select("item_id", X.sentence_around(F.col("text"), at).alias("s")).select("item_id", "s.*")


@query("select p_partkey, case when p_size = 1 then '1 day' else concat(cast(p_size as varchar), ' days') end as value from part")
def value_text(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.value_text(F.lit("{n} days"), F.col("p_size")).alias("value"))


@query("""select item_id, bool_and(contains(lower(text), lower(v))) as code_check from (select item_id, text, unnest([split_part(text, ' ', 1), split_part(text, ' ', 2)]) as v from benchmark) group by item_id""")
def code_check(t: Tables) -> DataFrame:
    values = F.array(F.split_part("text", F.lit(" "), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(2)))
    low = F.lower("text")
    return t.benchmark.select("item_id", F.when(F.size(values) > 0, F.forall(values, lambda v: F.contains(low, F.lower(v)))).alias("code_check"))


@query("select doc_id, concat(family, ' > ', lang, chr(10), chr(10), text) as embed_text from docs")
def embed_text(t: Tables) -> DataFrame:
    return t.docs.select("doc_id", F.concat(F.concat_ws(" > ", F.array("family", "lang")), F.lit("\n\n"), F.col("text")).alias("embed_text"))


@query("select doc_id, 0::bigint as start, length(text)::bigint as stop from docs")
def chunk_whole(t: Tables) -> DataFrame:
    return t.docs.select("doc_id", F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("stop"))


@query("""with k as (select conv_id, lower(trim(regexp_replace(string_agg(text, ' ' order by turn), '[ \\t\\n\\r]+', ' ', 'g'))) as k from conversations group by conv_id),
r as (select conv_id, md5(k) as k, row_number() over (partition by k order by conv_id) as rn from k) select conv_id, k, rn > 1 as duplicate from r""")
def duplicate_questions(t: Tables) -> DataFrame:
    talk = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    k = t.conversations.groupBy("conv_id").agg(F.lower(F.trim(F.regexp_replace(talk, "[ \\t\\n\\r]+", " "))).alias("k"))
    k = k.select("conv_id", F.md5(F.col("k").cast("binary")).alias("k"))
    first = k.groupBy("k").agg(F.min("conv_id").alias("first"))
    return k.join(first, "k").select("conv_id", "k", (F.col("conv_id") > F.col("first")).alias("duplicate"))


@query("""select conv_id, string_agg(concat('[', role, '] ', text), chr(10) order by turn) as prompt from conversations group by conv_id""")
def judge_prompt(t: Tables) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: F.concat(F.lit("["), x["role"], F.lit("] "), x["text"])), "\n").alias("prompt"))
