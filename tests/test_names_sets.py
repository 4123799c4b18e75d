import pytest
from hypothesis import given
from hypothesis import strategies as st

from rulewright.names import NameError_, parse_query, parse_signature, parse_variable
from rulewright.operators.sets import EMPTY, UNIVERSE, EntitySet, Sequence

items = st.lists(st.integers(-50, 50), max_size=20)


@pytest.mark.parametrize("text", ["x", "ns@x", "a::b::x", "f(X,Y)", "x{n}", "x{n+1}", "x{n-1}", "x{n=0}", "x{n,it}", "$n", "f(g(X),Y){n+1}"])
def test_names_round_trip(text):
    assert str(parse_variable(text)) == text


def test_signature_and_query():
    s = parse_signature("m->t, u <- (a,b)->c->x, y{n}")
    assert str(s) == "m->t, u <- (a,b)->c->x, y{n}"
    assert len(s.sources[0].paths()) == 2
    assert [v.name for v in parse_query("a, f(b),c")] == ["a", "f", "c"]
    for bad in ("", "x{", "<- y", "x y"):
        with pytest.raises((NameError_, ValueError)):
            parse_query(bad)


@given(items, items)
def test_set_algebra(a, b):
    x, y = EntitySet.of(*a), EntitySet.of(*b)
    sa, sb = set(a), set(b)
    assert set(x | y) == sa | sb and set(x & y) == sa & sb and set(x - y) == sa - sb and set(x ^ y) == sa ^ sb
    assert ~~x == x and (x & ~x) == EMPTY and (x | ~x) == UNIVERSE
    assert (x <= y) == (sa <= sb) and len(x) == len(sa) and set((x << 2) >> 2) == sa


def test_documented_sets():
    a, b, c = EntitySet.of((0, 9)), EntitySet.of(10, (14, 100)), EntitySet.of((5, 15))
    assert (a | b).parts == ((0, 10), (14, 100)) and (a & c).parts == ((5, 9),) and (a - c).parts == ((0, 4),) and (b | c).parts == ((5, 100),)
    v = EntitySet.of(1, 10, 12, (14, 17))
    assert (v.min, v.max, len(v), v.num_intervals) == (1, 17, 7, 4)
    assert (Sequence((3, 1)) + Sequence((1,))).reverse().ids == (1, 1, 3)
