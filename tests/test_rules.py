import pytest
from pyspark.sql import functions as F

from termloom.functions import rules as H

RULES = [H.HardRule("a", "no a", "절제\\.$", regex=True, penalty=0.25), H.HardRule("b", "no b", "상지", penalty=0.5), H.HardRule("c", "c", "상", enforce=False, freeze="keep c")]


def test_penalties(spark):
    row = spark.range(1).select(H.penalty(F.lit("상지 절제."), RULES).alias("p"), H.violations(F.lit("상지 절제."), RULES).alias("v"), H.penalty(F.lit("x"), RULES).alias("q")).first()
    assert (row["p"], row["q"]) == (0.75, 0.0) and row["v"] == ["a: no a", "b: no b"]
    assert "keep c" in H.frozen_block(RULES)
    assert H.frozen_block([]) == ""


def test_formula(spark):
    assert H.evaluate_formula("score * 2 + 1", {"score": 4}) == 9
    assert H.evaluate_formula("-7 % 3", {}) == 2
    assert H.evaluate_formula("round(0.5)", {}) == 0
    assert H.evaluate_formula("max(a.b, 1) ** 2", {"a.b": 3}) == 9
    for bad in ("1/0", "x", "__import__('os')", "a if b else c", "'s'", "1 +"):
        with pytest.raises(H.FormulaError):
            H.evaluate_formula(bad, {})
    row = spark.range(1).select(H.formula_column("-7 % 3 + round(2.5) + m", {"m": F.lit(1)}).alias("x"), H.formula_column("1 / m", {"m": F.lit(0)}).alias("y")).first()
    assert row["x"] == 5 and row["y"] is None


def test_hints(spark):
    got = spark.range(1).select(H.hints(F.lit("Left Arm"), [("arm", "h1"), ("leg", "h2"), ("left", "h1")]).alias("h")).first()["h"]
    assert got == ["h1"]
