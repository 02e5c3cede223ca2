"""The registered queries: SQL where there is some, and the pipeline end to end."""

import duckdb
import pytest

import corpus_pipeline
from tarnfield.llm.entries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    key = got.columns[0]
    got, want = got.sort_values(key).reset_index(drop=True), want[got.columns].sort_values(key).reset_index(drop=True)
    for c in got.columns:
        if got[c].dtype == float and c not in ("refers_to",):
            assert abs(got[c] - want[c]).max() < 1e-6
        else:
            assert got[c].astype(str).str.removesuffix(".0").tolist() == want[c].astype(str).str.removesuffix(".0").str.replace("<NA>", "nan").tolist(), c


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    from tarnfield.llm.shared import stored

    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
        assert 0.5 * n < docs.count() <= n
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.where("not exact").count() == 0
