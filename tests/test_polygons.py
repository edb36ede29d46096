"""Projected boxes, polygons and matrices worked out in compiled steps: the same values as the plain expressions."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightframe.catalog import QUERIES, load_all
from flightframe.functions import polygons as P
from flightframe.functions.boxes import box

load_all()
rng = np.random.default_rng(5)
FRAME = (500, 400)


def _same(one, two):
    assert len(one) == len(two) and sorted(map(repr, one)) == sorted(map(repr, two))


def test_polygon_steps_give_the_expressions_values(spark):
    """Crossed, outer, touching and empty quadrilaterals, and corners that are no numbers, to the last bit."""
    corners = [tuple(map(float, p)) for p in np.concatenate([rng.uniform(-300, 900, (300, 8)), rng.choice([0.0, 100.0, 400.0, 500.0, -50.0], (300, 8))])]
    corners += [(None, *corners[0][1:]), (float("nan"), *corners[1][1:]), (float("inf"), *corners[2][1:])]
    names = [f"{a}{i}" for i in range(4) for a in "xy"]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(corners)], "i long, " + ", ".join(f"{n} double" for n in names))
    points = [(F.col(f"x{i}"), F.col(f"y{i}")) for i in range(4)]
    plain = df.select("i", F.explode(F.array(P.check_polygon(points, *map(F.lit, FRAME)))).alias("c")).select("i", "c.*")
    steps = P.with_polygon_check(df, points, *map(F.lit, FRAME))
    _same([tuple(r) for r in plain.collect()], [tuple(r) for r in steps.select("i", *[f"check_{n}" for n in plain.columns[1:]]).collect()])


def test_matrix_and_box_steps_give_the_expressions_values(spark):
    matrices = [*(np.eye(3) + rng.normal(0, s, (3, 3)) for s in (0.001, 0.1, 2.0) for _ in range(50)), np.eye(3), np.zeros((3, 3)), np.full((3, 3), np.nan)]
    df = spark.createDataFrame(
        [(i, *map(float, m.ravel()), 10.0, 20.0, 90.0, 70.0) for i, m in enumerate(matrices)], "i long, " + ", ".join(f"{n} double" for n in (*P.MATRIX, "x1", "y1", "x2", "y2")))
    h = P.matrix()
    plain = df.select("i", P.condition_number(h).alias("n"), P.matrix_fault(h, *map(F.lit, FRAME)).alias("fault"), P.project_box(h, box(), *map(F.lit, FRAME)).alias("b")).select("i", "n", "fault", "b.*")
    steps = P.with_projected_box(P.with_matrix_fault(P.with_condition_number(df, h, "own_"), h, *map(F.lit, FRAME), prefix="its_"), h, box(), *map(F.lit, FRAME))
    _same([tuple(r) for r in plain.collect()],
          [tuple(r) for r in steps.select("i", "own_condition_number", "its_fault", *[f"image_{n}" for n in plain.columns[3:]]).collect()])


@pytest.mark.parametrize("name", ["matrices_plausible", "boxes_projected", "polygons_validated", "polygon_gates"])
def test_steps_are_compiled(spark, sf, name, capsys):
    """Functions of arrays are interpreted row by row, and so is a compiled method above 8,000 bytes."""
    QUERIES[name](spark, sf).explain("codegen")
    told = capsys.readouterr().out
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", told)]
    assert sizes and max(sizes) < 8000 and told.count("Generate inline") >= 3
