"""Queries op1 to op13 over the driver's tables, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm import byte_bpe, fingerprints, line_dedup, mixing, ngram_join, piece_encoding, pitman_yor, quality_rules, suffix_dedup, tandem_runs, toxicity, warc, whitening
from tarnfield.llm.shared import NOT_WS, crc_mod


def _docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_docs(spark, sf_dir), min_chars=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(_docs(spark, sf_dir), n=4, percent=85)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.deduplicate(_docs(spark, sf_dir), length=100)
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(_docs(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.verdicts(_docs(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(_docs(spark, sf_dir)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = piece_encoding.encode(_docs(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_pieces", "piece_score", "exact", "piece_ids")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _docs(spark, sf_dir), _docs(spark, sf_dir, "labels")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = toxicity.trained(docs, labels.select("doc_id", "toxic").where(~held_out))
    out = toxicity.score(docs, model, spans=True)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(_docs(spark, sf_dir, "pages"), min_bytes=100)
    return warc.read_archives(spark, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _repeating(docs: DataFrame) -> DataFrame:
    """docs of which a tenth, by the crc32 of the id, repeat themselves from some word on."""
    h = crc_mod(F.col("doc_id"), 1 << 32)
    ws = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({NOT_WS})"), 1)

    def repeated(w):
        n, g = F.size(w).cast("long"), F.floor(h / 10).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        take = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, take(i))), " ")).otherwise("")

    # the words are bound to a lambda's name, so that they are split once
    return docs.withColumn("text", F.when(h % 10 == 0, F.get(F.transform(F.array(ws), repeated), F.lit(0))).otherwise(F.col("text")))


def op11_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tandem_runs.periodic_runs(_repeating(_docs(spark, sf_dir).select("doc_id", "text"))).drop("text")
    # runs come by start and period: the first of the greatest stays
    more = lambda x, b: b.isNull() | (x["length"] * b["period"] > b["length"] * x["period"])
    best = F.aggregate("runs", F.lit(None).cast(out.schema["runs"].dataType.elementType), lambda b, x: F.when(more(x, b), x).otherwise(b))
    line = lambda x: F.concat_ws(",", *(x[c].cast("string") for c in ("start", "length", "period")))
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    out = out.withColumn("best", best)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(_docs(spark, sf_dir, "embeddings").select("vec_id", "embedding"), count=32)
    one = out.select("vec_id", "n", "deviation", "identity_error", "explained", F.posexplode("whitened").alias("at", "whitened"))
    return one.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = byte_bpe.encode(_docs(spark, sf_dir).select("doc_id", "text")).drop("text")
    out = byte_bpe.decode(ids)
    return out.select("doc_id", "n_tokens", F.sha2(byte_bpe.ids_text(F.col("token_ids")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pitman_yor": op1_pitman_yor,
    "op2_piece_encoding": op2_piece_encoding,
    "op3_line_dedup": op3_line_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_ngram_join": op5_ngram_join,
    "op6_mixing": op6_mixing,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_fingerprints": op8_fingerprints,
    "op9_quality_rules": op9_quality_rules,
    "op10_warc": op10_warc,
    "op11_tandem_runs": op11_tandem_runs,
    "op12_whitening": op12_whitening,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": r"""
with l as (
  select doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents)),
owner as (select key, min(doc_id) as first, count(distinct doc_id) as n from l where length(key) >= 10 group by key),
f as (select l.*, coalesce(o.n >= 2 and l.doc_id > o.first, false) as drop
      from l left join owner o on l.key = o.key)
select doc_id, count(*) as n_lines, sum(drop::int)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not drop), '')) as kept_sha256
from f group by doc_id
""",
    "op5_ngram_join": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') as w from documents),
sh as (select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else []::varchar[] end) as g from w),
n as (select doc_id, count(*) as n from sh group by 1),
common as (select a.doc_id as a, b.doc_id as b, count(*) as k from sh a join sh b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from common c join n x on x.doc_id = c.a join n y on y.doc_id = c.b where 100 * k >= 85 * (x.n + y.n - k)),
e as (select a, b from link union all select b, a from link),
r as (select doc_id as id, doc_id as x from documents union select r.id, e.b from r join e on e.a = r.x)
select id as doc_id, coalesce(max(n.n), 0)::bigint as n_shingles, min(x) as component_id from r left join n on n.doc_id = r.id group by id
""",
    "op6_mixing": r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+'))::bigint as size from documents),
per as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, source_size * 2.0::double as lim,
        ([3.0, 1.0, 2.0]::double[])[((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::int] as w from per),
f as (select *, (sum(source_size) over ())::double * 1.5::double as budget, sum(w) over () as w_all,
        coalesce(sum(w) over o, 0) as w_before, coalesce(sum(lim) over o, 0) as lim_before
      from w window o as (order by lim / w, source is null, encode(source) rows between unbounded preceding and 1 preceding)),
g as (select *, (budget - lim_before) / (w_all - w_before) as level from f),
t as (select source, source_size, case when lim <= level * w then lim else max(case when lim > level * w then level end) over () * w end as target from g),
e as (select doc_id, d.source, size, source_size, target,
        least(2.0::double, case when source_size > 0 then target / source_size else 0 end) as e,
        (('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':0'), 1, 13))::bigint::double + 0.5::double) / 4503599627370496.0::double as u
      from d join t on d.source is not distinct from t.source),
r as (select *, floor(e)::bigint as sure, case when e - floor(e) > 0 then (u / (1 - u)) * (1 - (e - floor(e))) / (e - floor(e)) end as odds from e),
k as (select *, case when sure < 2 then coalesce(odds / (1 + odds), 1 - pow(2.0::double, -53)) end as rank,
        target - sum(sure * size) over (partition by source) as lft from r),
h as (select *, case when rank is not null and size > 0 and
          sum(case when rank is not null and size > 0 then size else 0 end) over (partition by source order by rank nulls last, doc_id) <= lft then 1 else 0 end as extra from k),
x as (select *, lft - sum(extra * size) over (partition by source) as gap from h),
c as (select source, min(struct_pack(off := abs(size - gap), rank := rank, doc_id := doc_id)) as c from x
      where extra = 0 and rank is not null and size > 0 and abs(size - gap) < gap group by source)
select x.doc_id, x.size, x.source_size, x.target,
  ((x.sure + x.extra + case when c.c.doc_id = x.doc_id and x.extra = 0 then 1 else 0 end) * x.size)::bigint as taken
from x left join c on x.source is not distinct from c.source
""",
    "op10_warc": r"""
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
o as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, p.payload_digest,
  case when page_id > o.first and payload_bytes >= 100 then 'revisit' else 'response' end as record_type,
  case when page_id > o.first and payload_bytes >= 100 then o.first end as refers_to
from p left join o on p.payload_digest = o.payload_digest
""",
}
