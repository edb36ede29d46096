"""Boxes written as text."""

from pyspark.sql import functions as F

from flightframe.functions import boxes as B
from flightframe.functions.numbers import finite_number

TEXTS = ["[1,2,3,4]", " ( 1.5 , 2e0, .3e2 ,4. ) ", "[1,2]", "[1,2,3,4,5]", "[3,2,1,4]", "[1,2,nan,4]", "[1,2,1e999,4]", "[a,2,3,4]", "[1d,2,3,4]", "1,2,3,4", "", None, "[,,,]"]


def test_parsed_boxes_are_the_expressions_boxes(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i long, t string")
    plain = {r.i: r.box for r in df.select("i", B.parse_box(F.col("t")).alias("box")).collect()}
    out = B.with_parsed_box(df, F.col("t"))
    assert out.columns == ["i", "t", "box"] and {r.i: r.box for r in out.collect()} == plain
    assert [i for i, box in plain.items() if box] == [0, 1] and tuple(plain[1]) == (1.5, 2.0, 30.0, 4.0)
    numbers = spark.createDataFrame([("nan",), ("1e999",), ("-1e999",), ("-7.5 ",), (None,)], "t string")
    assert [r[0] for r in numbers.select(finite_number(F.col("t"))).collect()] == [None, None, None, -7.5, None]


def test_samples_take_a_box_text_apart_once(spark, sf):
    """The text was taken apart for every number and every use of it."""
    from flightframe.sources.tables import with_parsed_box

    plan = with_parsed_box(spark.createDataFrame([("[1,2,3,4]",)], "t string"), F.col("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 1 and plan.count("RLIKE") == 4
