"""Registered queries against their SQL on the smallest tables, and the models' interface."""

import duckdb
import pytest

from threadloom.plans import registry
from threadloom.operators.distilling import distill
from threadloom.providers import StubProvider, ask, embed

SF = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "embeddings", "pages", "labels", "conversations", "benchmark")


def _values(rows, names):
    return sorted(repr(tuple(round(r[n], 6) if isinstance(r[n], float) else r[n] for n in sorted(names))) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF)
    want = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert _values([r.asDict() for r in got.collect()], names) == _values([dict(zip(names, r)) for r in want.fetchall()], names)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, SF).columns


def test_provider_isolates_errors(spark):
    class Broken(StubProvider):
        def chat_json(self, task, text):
            if "bad" in text:
                raise ValueError("no")
            return super().chat_json(task, text)

    df = spark.createDataFrame([("a", 1, "q\na"), ("a", 2, "bad\nx")], "chat string, root_msg_id bigint, text string")
    got = {x["root_msg_id"]: x["error"] for x in ask(df, Broken(), "distill", "text", "items array<struct<question:string>>").collect()}
    assert got == {1: None, 2: "no"}
    assert [x["question"] for x in distill(df, Broken()).collect()] == ["q"]
    assert len(embed(df, StubProvider(8), "text").first()["embedding"]) == 8


def test_stream_equals_batch(spark, tmp_path):
    from threadloom.streaming import events

    src = spark.read.parquet(f"{SF}/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    query = events.append_log(events.read_log(spark, str(tmp_path / "in"), src.schema), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == src.count()
