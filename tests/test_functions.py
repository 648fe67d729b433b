import math

import pytest
from pyspark.sql import functions as F

from quarry.config import EngineConfig, RetrievalConfig
from quarry.functions import jsonparse as js, metadata, text, validate, vectors
from quarry.functions.postprocess import post_process, valid_metrics
from quarry.operators.classify import bilingual_heading, chunk_type, split_by_type
from quarry.sources.pages import page_number


def one(spark, col, schema="x string", *row):
    return spark.createDataFrame([row or (None,)], schema).select(col.alias("r")).first()["r"]


def test_tokens_words_then_numbers(spark):
    s = "Социально-Экономический ЁЖ 2018-2021 abc 5a"
    assert one(spark, text.normalise(F.col("x")), "x string", s) == "социально-экономический ёж 2018 2021 5"
    assert one(spark, text.normalise(F.col("x")), "x string", None) == ""
    lemmas = text.dictionary_lemmas({"ёж": "ежи"})
    assert one(spark, text.normalise(F.col("x"), lemmas=lemmas), "x string", "Ёж 5 ёж") == "ежи ежи 5"


@pytest.mark.parametrize(
    "page, body, want",
    [
        (5, "", "metadata"), (9, "  \n ", "skip"), (9, "Содержание: ...", "metadata"), (9, "Первый список городов", "metadata"), (9, "x" * 150 + " a@b.by", "metadata"), (9, "x" * 250 + " a@b.by", "data"),
        (9, "предисловие", "metadata"), (9, "Население\nPOPULATION 2020\n1 2", "metadata"), (9, "данные", "data"), (9, None, "skip"),
    ],
)
def test_chunk_type(spark, page, body, want):
    assert one(spark, chunk_type(F.col("p"), F.col("t")), "p int, t string", page, body) == want


@pytest.mark.parametrize("body, want", [("Население\nPOPULATION 2020\n1 2", True), ("Население\nPopulation", False), ("Население", False), ("Население\nA B C D E F", False)])
def test_bilingual(spark, body, want):
    assert one(spark, bilingual_heading(F.col("x")), "x string", body) is want


def test_split_covers_all(spark):
    df = spark.createDataFrame([(1, "a"), (9, "b"), (9, " ")], "page int, text string")
    assert sum(d.count() for d in split_by_type(df).values()) == 3


def test_page_number(spark):
    rows = [("5", "6", None, 5), (None, " 7 ", None, 7), ("iv", "6", None, 0), (None, None, None, 0)]
    for a, b, c, want in rows:
        assert one(spark, page_number(F.col("a"), F.col("b"), F.col("c")), "a string, b string, c string", a, b, c) == want


@pytest.mark.parametrize(
    "raw, want",
    [('```json\n{"a":1}\n```', 1), ('text {"a":1} tail }', 1), ('{"a":1}', 1), ('{"b": ["x"],\n"', None), ('x {"a":"}"} y', None), ("[1]", None), (None, None), ("", None), ('x {"a":1} y {"a":2}', 1)],
)
def test_parse_answer(spark, raw, want):
    got = one(spark, js.string_field(js.parse_answer(F.col("x")), "a"), "x string", raw)
    assert got == (None if want is None else str(want))


def test_nested_object(spark):
    got = one(spark, F.to_json(js.parse_answer(F.col("x"))), "x string", 'text {"a":{"b":1}} tail }')
    assert got == '{"a":{"b":1}}'


def test_query_answer_is_strict(spark):
    assert one(spark, js.parse_query_answer(F.col("x")).isNull(), "x string", 'x {"a":1} y {"b":2}')
    assert one(spark, js.string_field(js.parse_query_answer(F.col("x")), "a"), "x string", 'x {"a":1} y') == "1"


def test_normalisers(spark):
    v = F.parse_json(F.lit('["a","Молоко ","Мясо",1,"Рожь","Лён"]'))
    assert one(spark, js.normalise_metrics(F.try_variant_get(v, "$", "array<string>"))) == ["Молоко", "Мясо", "Рожь"]
    assert one(spark, js.normalise_years(F.array(*[F.lit(x) for x in ("2020", "2021", None, "x", "2020.0", " 7 ")]))) == [2020, 2021, 7]
    assert one(spark, valid_metrics(F.array(F.lit(" Численность "), F.lit("Производство молока цельного"), F.lit(" ")))) == ["численность"]


def test_post_process_golden(spark):
    schema = "context string, text string, metrics array<string>, geo array<string>, years array<int>"
    run = lambda *r: post_process(spark.createDataFrame([r], schema)).first()
    r = run("Численность\nнаселения", "Занятость", ["Численность", "Производство молока цельного"], ["Минск", "Брест"], [2021, 2019])
    assert r["metrics"] == ["численность"]
    assert r["context"] == "Численность населения | население, работа | показатели: численность; география: Минск, Брест; годы: 2019-2021"
    assert run("", "unit price", None, None, [2020])["context"] == "цифровизация | годы: 2020"
    assert run("x" * 256, "", None, ["Минск"], None)["context"] == "x" * 256


def test_ids(spark):
    assert one(spark, text.stable_id(F.lit("a::page1::chunk0"))) == 3833071354841588005
    assert one(spark, text.normalise_id(F.lit("  ID: id:  a   b  c "))) == "a b c"


def test_validate(spark):
    bodies = ['{"context":"c"}', '{"metrics":"m"}', '{"context":5,"metrics":["abc",1],"years":["x",2020],"geo":["a"],"time_granularity":"week"}']
    df = spark.createDataFrame([("a", 0, bodies[0]), ("b", 1, bodies[1]), ("a", 2, bodies[2])], "chunk_id string, pos long, body string").withColumn("data", F.parse_json("body"))
    got = {r["pos"]: r for r in validate.validate(df).collect()}
    assert got[0]["is_valid"] and not got[1]["is_valid"]
    assert got[2]["errors"] == ["chunk_id 'a' дублируется", "context должен быть строкой", "metrics[1] должен быть строкой", "years[0] должен быть целым числом"]
    assert len(got[2]["warnings"]) == 3
    assert validate.all_valid(validate.validate(df.limit(0))).first()["all_valid"]


def test_metadata_rules(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    assert one(spark, metadata.geo_score(arr("минск", "брест"), arr("минск"))) == 1.0
    assert one(spark, metadata.geo_score(arr("минск"), arr("минск", "брест"))) == 0.5
    assert one(spark, metadata.geo_score(F.array().cast("array<string>"), arr("a"))) == 0.0
    assert one(spark, metadata.metrics_score(arr("a", "b"), arr("b", "c"))) == pytest.approx(1 / 3)
    for c, q, want in (([2018, 2019], [2019, 2020], 0.5), ([2018, 2022], [2020], 0.3), ([2010], [2020], 0), ([], [2020], 0)):
        assert one(spark, metadata.years_score(F.col("c"), F.col("q")), "c array<int>, q array<int>", c, q) == want
    for c, q, want in (("01.1", "01", 0.7), (" A ", "a", 1.0), ("02", "01", 0.0), (None, "1", 0.0)):
        assert one(spark, metadata.oked_score(F.col("c"), F.col("q")), "c string, q string", c, q) == want
    total = metadata.total_score({"geo": F.lit(1.0), "metrics": F.lit(1 / 3), "years": F.lit(0.3), "granularity": F.lit(1.0), "oked": F.lit(0.7)})
    assert one(spark, total) == pytest.approx(0.63)


def test_config():
    with pytest.raises(ValueError):
        RetrievalConfig(20, 20, 5, 0.5, 0.25, 0.2)
    with pytest.raises(ValueError):
        EngineConfig(dimension=0)
    assert RetrievalConfig().recall_top_k == 50


def test_vectors(spark):
    v = one(spark, vectors.l2_normalise(F.col("v")), "v array<float>", [3.0, 4.0])
    assert [round(x, 6) for x in v] == [0.6, 0.8]
    p, again = vectors.projection("m", 8, 4), vectors.projection("m", 8, 4)
    assert p.shape == (4, 8) and (p == again).all() and p.dtype.name == "float32"
    df = spark.createDataFrame([("a b",), ("  ",), (None,), ("a b",)], "t string")
    rows = [r["e"] for r in vectors.embed_column(df, "t", "e", 16).collect()]
    assert rows[1] is None and rows[2] is None and rows[0] == rows[3] and math.isclose(sum(x * x for x in rows[0]), 1, rel_tol=1e-4)
