"""Scans, sinks and the remaining scalar functions."""

import pytest
from pyspark.sql import functions as F

from tests.test_functions import one
from threadloom import schemas
from threadloom.functions import text
from threadloom.operators import metrics
from threadloom.sources import tables


def test_json_scans(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "2", "query": "q"}\n\n{"id": "1", "query": "r", "more": 5}\nnot json\n')
    (tmp_path / "b.jsonl").write_text('{"id": "3"}\n')
    got = tables.scan_json(spark, str(tmp_path / "a.jsonl"), schemas.GOLDEN)
    assert sorted((x["id"] or "", x["query"]) for x in got.collect()) == [("", None), ("1", "r"), ("2", "q")]
    assert tables.scan_json(spark, str(tmp_path / "*.jsonl"), schemas.GOLDEN).where("id is not null").count() == 3
    assert tables.scan_json(spark, str(tmp_path / "none.jsonl"), schemas.GOLDEN).count() == 0
    with pytest.raises(FileNotFoundError):
        tables.scan_json(spark, str(tmp_path / "none.jsonl"), schemas.GOLDEN, missing_ok=False)


def test_stored_messages_come_by_id(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text("\n".join(f'{{"chat_username": "c", "msg_id": {k}, "text": "t"}}' for k in (5, 1, 9, 3)))
    assert [x["msg_id"] for x in tables.messages_of(spark, str(tmp_path / "m.jsonl"), schemas.MESSAGE).collect()] == [1, 3, 5, 9]
    assert tables.last_ids(tables.messages_of(spark, str(tmp_path / "m.jsonl"), schemas.MESSAGE)).first()["last_msg_id"] == 9


def test_keyed_maps(spark, tmp_path):
    (tmp_path / "ok.json").write_text('{"1:2024-01-01": 4, "2:2024-01-01": 1}')
    (tmp_path / "bad.json").write_text('{"1": ')
    assert sorted(map(tuple, tables.scan_map(spark, str(tmp_path / "ok.json"), "int").collect())) == [("1:2024-01-01", 4), ("2:2024-01-01", 1)]
    assert tables.scan_map(spark, str(tmp_path / "bad.json"), "int").count() == 0
    assert tables.scan_map(spark, str(tmp_path / "none.json"), "int").columns == ["key", "value"]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "out")
    for n, fresh in ((2, True), (3, False), (1, True), (2, False)):
        tables.append_or_overwrite(spark.range(n), path, fresh)
    assert spark.read.schema("id long").json(path).count() == 3
    table = str(tmp_path / "table")
    spark.range(4).write.parquet(table)
    tables.replace_table(spark.read.parquet(table).where("id > 1"), table)  # reads what it overwrites
    assert sorted(x["id"] for x in spark.read.parquet(table).collect()) == [2, 3]


@pytest.mark.parametrize("url, want", [("https://a.b/c).", ("https://a.b/c", ").")), ("https://a.b", ("https://a.b", "")), ("https://a.b/x?y=1!?", ("https://a.b/x?y=1", "!?"))])
def test_url_and_tail(spark, url, want):
    assert tuple(one(spark, text.url_and_tail(F.col("u")), u=url)) == want


@pytest.mark.parametrize("query, city, want", [("где рынок", "Батуми", "где рынок Батуми"), ("рынок в Тбилиси", "Батуми", "рынок в Тбилиси"), ("виза в Грузию", "Батуми", "виза в Грузию"), ("где рынок", "", "где рынок"), ("где рынок", None, "где рынок")])
def test_default_city(spark, query, city, want):
    df = spark.createDataFrame([(query, city)], "q string, c string")
    assert df.select(text.with_default_city(F.col("q"), F.col("c"), F.array(F.lit("Тбилиси"), F.lit("Батуми")))).first()[0] == want


@pytest.mark.parametrize("answer, left, date", [("see (https://t.me/a/1, май 2024)", False, False), ("в мае: май 2024", False, True), ("[3] left", True, False), ("[?] fine", False, False), ("(май 2024)", False, True), ("майский 2024", False, False)])
def test_checks_of_answers(spark, answer, left, date):
    assert one(spark, text.citation_left(F.col("a")), a=answer) is left
    assert one(spark, text.date_outside_citation(F.col("a")), a=answer) is date


def test_formats_and_non_answers(spark):
    assert [one(spark, text.pretty(F.lit(x).cast("double")), u=1) for x in (0.456, None)] == ["0.46", "  - "]
    assert one(spark, text.is_non_answer(F.col("a")), a="Информация о цене не указана") and one(spark, text.is_non_answer(F.col("a")), a="Это НЕИЗВЕСТНО")
    assert not one(spark, text.is_non_answer(F.col("a")), a="Рынок работает до шести")
    assert [one(spark, text.city_or_null(F.col("c")), c=c) for c in (" NULL ", "-", "", " Батуми ")] == [None, None, None, "Батуми"]
    assert one(spark, text.url_label(F.col("u"), [{"chat_id": -1001234, "username": "p", "title": "P", "private": True}, {"username": "open", "title": "O"}]), u="https://t.me/c/1234/5") == "P"
    assert one(spark, text.url_label(F.col("u"), [{"username": "open", "title": "O"}]), u="https://t.me/open/5") == "O"


def test_answer_fails_and_totals(spark):
    rows = spark.createDataFrame([(False, None, True, False, True), (True, False, False, False, False)], "faithful boolean, relevant boolean, scope_ok boolean, honest_uncertainty boolean, critical boolean")
    fails = [x[0] for x in rows.select(metrics.answer_fails(F.col("critical"), F.lit(False), F.lit(True))).collect()]
    assert fails == [["faithful", "honest_uncertainty", "date_suspect"], ["relevant", "scope_ok", "date_suspect"]]
    log = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, None)], "user_id int, username string")
    assert tuple(metrics.usage_totals(log).first()) == (4, 3) and tuple(metrics.usage_totals(log.where("false")).first()) == (0, 0)
