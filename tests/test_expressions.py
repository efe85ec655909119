import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from scriptorium.functions import expressions as e
from scriptorium.functions.values import Fields


@pytest.mark.parametrize("text", ["x", "x = 3", "x in", "x in ['a'", "x in [a]", "x in ['a'] y", "not x in ['a']", "(x in ['a'])", "x in ['a",  "and"])
def test_malformed_conditions(text):
    with pytest.raises(e.SyntaxProblem):
        e.parse_condition(text)


@pytest.mark.parametrize("text", ["", "1 +", "(1", "1 < 2 < 3", "a.b", "1 ! 2", "--1", "1 == "])
def test_malformed_formulas(text):
    with pytest.raises(e.SyntaxProblem):
        e.parse_formula(text)


def test_condition_precedence():
    node = e.parse_condition("a in ['x'] or b in ['y'] and c not in []")
    assert e.evaluate_condition(node, {"a": "x"})
    assert e.evaluate_condition(node, {"b": "y"})
    assert not e.evaluate_condition(node, {"b": "z"})
    assert e.evaluate_condition(e.parse_condition("a.b in ['1']"), {"a": {"b": "1"}})
    assert not e.evaluate_condition(e.parse_condition("a in ['1']"), {"a": 1})


@given(st.floats(-1e6, 1e6), st.floats(-1e6, 1e6), st.floats(-1e6, 1e6))
def test_formula_is_arithmetic(a, b, c):
    got = e.evaluate_formula(e.parse_formula("a - b * -c + (a + b) * 2"), {"a": a, "b": b, "c": c})
    assert math.isclose(got, a - b * -c + (a + b) * 2, rel_tol=1e-9, abs_tol=1e-6)


def test_division_and_nan(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 2.0), (None, 1.0)], "a double, b double")
    value = Fields.of_table(df).value
    rows = [r[0] for r in df.select(e.formula_number(e.parse_formula("a / b"), value)).collect()]
    assert rows[0] == math.inf and rows[1] == -math.inf and math.isnan(rows[2]) and rows[3] == 3 and rows[4] is None
    violated = lambda t: [r[0] for r in df.select(e.formula_violated(e.parse_formula(t), value)).collect()]
    assert violated("a / b == 3") == [True, True, True, False, True]
    assert violated("a / b != 3") == [False, False, True, True, True]
    assert violated("a / b >= 3") == [False, True, True, False, True]
    assert violated("a + 1") == [False] * 4 + [True]
