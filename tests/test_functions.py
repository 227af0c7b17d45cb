import math

import pytest
from pyspark.sql import functions as F

from trovel.functions import scores as S
from trovel.functions import text as T


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("value, wanted", [("Oi<br>tudo<b>bem</b>", "Oi tudobem"), ("<p>A&amp;lt;b</p><br/>C", "A&lt;b C"), ("a<pre>x</pre>", "a x"), ("&lt;b&gt;y", "y"), (None, "")])
def test_clean_html(spark, value, wanted):
    assert one(spark, T.clean_html, value) == wanted


@pytest.mark.parametrize("value, wanted", [("Licitação de Técnica e Preço", "licitacao_de_tecnica_e_preco"), ("Lei nº 8.666", "lei_no_8_666"), ("--", ""), (None, "")])
def test_unicode_identifier(spark, value, wanted):
    assert one(spark, T.unicode_identifier, value) == wanted


@pytest.mark.parametrize("value, wanted", [("[A, B, C]", ["A", "B", "C"]), ("['A, x', 'B']", ["A, x", "B"]), ("[]", []), (None, []), ("A,,B", ["A", "B"]), ("5", ["5"])])
def test_bracket_list(spark, value, wanted):
    assert one(spark, T.bracket_list, value) == wanted


@pytest.mark.parametrize("value, wanted", [("21064", 21064), ("documento::21064", 21064), ("abc", None), (None, None)])
def test_number_in(spark, value, wanted):
    assert one(spark, T.number_in, value) == wanted


def test_prefix_fence_template(spark):
    assert one(spark, lambda c: T.with_prefix(c, "query: "), " Query: x ") == "Query: x"
    assert one(spark, lambda c: T.with_prefix(c, "query: "), "x") == "query: x"
    assert one(spark, lambda c: T.without_prefix(c, "passage:"), "Passage:  y") == "y"
    assert one(spark, T.without_fence, "```json\n{}\n```") == "{}"
    assert one(spark, lambda c: T.fill_template("Q {pergunta} C {contexto}", pergunta=c, contexto=F.lit("{pergunta}")), "a") == "Q a C {pergunta}"
    assert one(spark, lambda c: T.labelled_parts([("Area", c), ("", F.lit(" ")), ("Tema", F.lit("t"))]), "a") == "Area: a\n\nTema: t"


def test_formulas(spark):
    row = spark.range(1).select(
        S.rrf(F.lit(1)).alias("a"), S.rrf(F.lit(None).cast("int")).alias("b"), S.idf(F.lit(2.0), F.lit(2.0)).alias("c"), S.discounted(F.lit(3), F.lit(2)).alias("d"), S.relative_change(F.lit(0.0), F.lit(1.0)).alias("e"),
        S.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("f"), S.unit(F.array(F.lit(0.0))).alias("g"), S.winner(F.lit(1e-13)).alias("h"),
    ).first()
    assert row.a == 1 / 61 and row.b == 0 and math.isclose(row.c, math.log(1 + 2 / 3)) and math.isclose(row.d, 7 / math.log2(3))
    assert row.e is None and row.f == 11 and row.g == [0.0] and row.h == "tie"
