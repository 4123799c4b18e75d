import math

import pytest

from rulewright.functions import expr, units
from rulewright.functions.options import OptionsError, parse_options, parse_vars
from rulewright.functions.vectors import Spline


def test_expressions(spark):
    assert expr.evaluate("2+3*4-6/2") == 11 and expr.evaluate("-(2-5)*pow(2,3)") == 24
    assert expr.evaluate("sin(pi/2)+ln(exp(2))+log10(1000)") == pytest.approx(6)
    assert expr.evaluate("log(x)", x=math.e) == pytest.approx(1)
    for bad in ("foo(1)", "y", "1+", "(2"):
        with pytest.raises(expr.ExprError):
            expr.evaluate(bad)
    row = spark.range(1).select(expr.column("sqrt(id+4)*2").alias("v")).first()
    assert row.v == 4.0


@pytest.mark.parametrize("text", ["x*x*sin(x)", "exp(x)/x", "pow(x,3)-ln(x)", "sqrt(x)*tan(x)", "atan(x)+tanh(x)+asin(x/3)", "pow(x,x)", "-cosh(x)"])
def test_derivative(text):
    n, h = expr.parse(text), 1e-6
    d = expr.derivative(n, "x")
    assert expr.evaluate(d, x=0.7) == pytest.approx((expr.evaluate(n, x=0.7 + h) - expr.evaluate(n, x=0.7 - h)) / (2 * h), rel=1e-6)


def test_simplify_latex_shared():
    assert str(expr.simplify(expr.parse("0*x+1*y+2*3"))) == "(y+6)"
    assert expr.latex(expr.parse("sqrt(x)/pi")) == r"\frac{\sqrt{x}}{\pi}"
    assert [str(n) for n in expr.shared([expr.parse("sin(x)+sin(x)")])] == ["sin(x)"]
    assert str(expr.substitute(expr.parse("a+b"), {"a": expr.num(2)})) == "(2+b)"


def test_units():
    assert units.parse_quantity("10 ft/s").get_value_in("m/s") == pytest.approx(3.048)
    assert units.parse_quantity("32 F").get_value_in("K") == pytest.approx(273.15)
    assert units.parse_quantity("0 C").get_value_in("F") == pytest.approx(32)
    assert units.parse_quantity("1 atm").compatible("psi") and not units.parse_quantity("1 m").compatible("s")
    with pytest.raises(units.UnitError):
        units.parse_quantity("1 m").get_value_in("kg")


def test_vars_and_options():
    v = parse_vars('{ dt: 1e-3, name: "x y", steps: 10, on: true, // comment\n boundary_conditions:<BC_1=specified(Twall=500 K, h=2), BC_2=symmetry>, v: [1, 2, 3], p: 2 atm }')
    assert v["dt"] == 1e-3 and v["steps"] == 10 and v["on"] is True and v["v"] == [1, 2, 3] and v["name"] == "x y"
    bc = v["boundary_conditions"]
    assert bc.get("BC_1").options.get_units("Twall", "K") == 500 and bc.check("BC_2", "symmetry")
    assert v["p"].get_value_in("Pa") == pytest.approx(202650)
    with pytest.raises(OptionsError):
        parse_options("<a=1,b=2>", {"a"})
    with pytest.raises(OptionsError):
        parse_vars("{ a 1 }")


def test_spline():
    s = Spline(math.exp, 0, 2, 1e-6)
    assert s(1.3) == pytest.approx(math.exp(1.3), abs=1e-5) and s.slope(1.0) == pytest.approx(math.e, rel=1e-2) and s.inverse(3.0) == pytest.approx(math.log(3), abs=1e-5)
