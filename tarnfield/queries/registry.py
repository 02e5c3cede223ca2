"""Registration of queries, and the views that stand for the library's entities over the driver's tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnfield.session import TABLES, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Entities as SQL that Spark and DuckDB both read; {name} is a table or another view.
VIEWS = {
    "docs": """select doc_id, concat(cast(doc_id as string), '@1') as doc_key,
        case when doc_id % 10 = 0 then 'staff' else 'public' end as access,
        case doc_id % 7 when 0 then 'superseded' when 1 then 'deleted' else 'current' end as status,
        source as family, lang, text from {documents}""",
    "items": """select item_id, text as evidence, concat('t', cast(item_id % 4 as string)) as type,
        case when item_id % 6 = 0 then 'staff' else 'public' end as asker, item_id % 5 <> 0 as answerable from {benchmark}""",
    "arms": """select l_orderkey as item_id, cast(l_linenumber as int) as arm, concat('t', cast(l_orderkey % 4 as string)) as type,
        l_orderkey % 5 <> 0 as answerable, case when l_orderkey % 3 = 0 then 'staff' else 'public' end as asker,
        case when max(l_quantity) < 3 then null else max(l_discount) >= 0.04 end as correct,
        case when max(l_quantity) < 3 then null else max(l_tax) >= 0.07 end as declined,
        case when max(l_quantity) < 3 then null else min(l_tax) <= 0.06 end as faithful,
        case when max(l_quantity) <= 40 then cast(max(l_quantity) as int) end as evidence_rank,
        max(l_extendedprice) / 1000.0 as latency, cast(max(l_quantity) as bigint) * 7 as out_tokens,
        cast(max(l_partkey) % 100 as bigint) as in_tokens, max(l_linestatus) = 'O' as leaked,
        max(l_returnflag) as flag from {lineitem} group by l_orderkey, l_linenumber""",
    "runs": """select event_id as line_no, user_id as call_id, concat('h', cast(event_id % 2 as string)) as request_hash,
        event_type <> 'error' as ok, event_type, concat('p', cast(user_id % 3 as string)) as provider,
        concat('m', cast(user_id % 5 as string)) as model, case when event_id % 3 = 0 then 'high' else 'low' end as mode,
        case when event_id % 4 = 0 then 'cache' else 'api' end as source, value as latency,
        cast(floor(value * 10) as bigint) as input_tokens, cast(event_id % 97 as bigint) as output_tokens,
        case when event_id % 5 = 0 then null else cast(event_id % 11 as bigint) end as reasoning_tokens,
        case when event_id % 7 = 0 then 'length' else 'stop' end as finish, ts from {events}""",
    "prices": """select concat('p', cast(r_regionkey as string)) as provider, 0.5 + r_regionkey as price_in,
        2.0 + r_regionkey as price_out from {region} where r_regionkey <> 2""",
    "cards": """select s_suppkey as id, s_name as name, s_nationkey % 4 <> 0 as gates_passed, s_acctbal as balance,
        case when s_suppkey % 17 = 0 then null else 1 + s_suppkey * 3 % 5 end as c1, 1 + s_suppkey * 7 % 5 as c2,
        1 + (s_suppkey + s_nationkey) % 5 as c3, 1 + s_nationkey % 5 as c4, 1 + s_suppkey * 11 % 5 as c5,
        1 + (s_suppkey + 2 * s_nationkey) % 5 as c6 from {supplier}""",
    "marks": """select doc_id as item_id, quality = 1 as judge_correct, toxic = 0 as judge_faithful,
        quality = 1 and doc_id % 9 <> 0 as hand_correct, toxic = 0 or doc_id % 2 = 0 as hand_faithful,
        doc_id % 4 = 0 as judge_declined, doc_id % 4 = 0 and doc_id % 16 <> 0 as hand_declined,
        concat('t', cast(doc_id % 3 as string)) as type from {labels}""",
    "turns": """select conv_id, turn, role, text, cast(length(text) as bigint) as tokens from {conversations}""",
}


class Tables:
    """The driver's tables and the views over them, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return table(self.spark, self.sf_dir, name)
        if name not in VIEWS:
            raise AttributeError(name)
        sql = VIEWS[name]
        return self.spark.sql(sql, **{n: getattr(self, n) for n in re.findall(r"\{(\w+)\}", sql)})


def with_views(sql: str) -> str:
    """sql with the views that it reads as common table expressions."""
    used = [v for v in VIEWS if re.search(rf"\b(from|join|,)\s+{v}\b", sql)]
    if not used:
        return sql
    heads = ", ".join(f"{v} as ({re.sub(r'[{}]', '', VIEWS[v])})" for v in used)
    start = re.match(r"\s*with\s+(recursive\s+)?", sql)
    return f"{start[0]}{heads}, {sql[start.end():]}" if start else f"with {heads} {sql}"


def query(sql: str | None = None) -> Callable:
    """Registers a function of Tables; sql is what DuckDB must give."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return register
