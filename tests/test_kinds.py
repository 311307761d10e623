"""Kinds of columns, told before anything runs."""

import pytest

from clauseplan.api import Program, check, types
from clauseplan.errors import CheckError
from clauseplan.queries import Q

ON = '@Engine("duckdb", type_checking: true);\n'


@pytest.mark.parametrize(("text", "name", "kinds"), [
    ("P(a: 1, b: 'x', c: true, d: null);", "P", {"a": "number", "b": "string", "c": "bool", "d": "any"}),
    ("P(a:, b: a + 1) :- T(a:);", "P", {"a": "number", "b": "number"}),
    ("P(a:) :- T(a:), Length(a) > 3;", "P", {"a": "string"}),
    ("P(a:) :- a in [[1], [2]];", "P", {"a": "[number]"}),
    ("P(r:) :- r == {x: 1, y: ['a']};", "P", {"r": "{x: number, y: [string]}"}),
    ("P(z: r.x + 1, r:) :- T(r:);", "P", {"z": "number", "r": "{x: number}"}),
    ("P(a:, n? += 1) distinct :- Q(a:); Q(a: 'x');", "P", {"a": "string", "n": "number"}),
    ("P(l? List= a) distinct :- T(a:), a < 3;", "P", {"l": "[number]"}),
    ("P(l? ArgMax= a -> b) distinct :- T(a:, b:), Lower(a) == 'x';", "P", {"l": "string"}),
    ("F(x) = x + 1; P(a: F(2));", "P", {"a": "number"}),
    ("Same(x) = x; P(a: Same(1), b: Same('x'));", "P", {"a": "number", "b": "string"}),
    ("P(a: if b then 1 else 2, b:) :- T(b:);", "P", {"a": "number", "b": "bool"}),
    ("P(a: combine Max= x :- x in [1, 2]);", "P", {"a": "number"}),
    ("@Recursive(R, 3); R(a: 1); R(a: b) :- R(a:), E(a:, b:);", "R", {"a": "number"}),
])
def test_kinds(text, name, kinds):
    assert types(text)[name] == kinds


@pytest.mark.parametrize("text", [
    "P(a: 1 + 'x');",
    "P(a: 1); P(a: 'x');",
    "P(a:) :- T(a:), a < 3, Lower(a) == 'x';",
    "P(a:) :- Q(a:), a == 'x'; Q(a: 1);",
    "P(a:) :- a in [1, 'x'];",
    "P(a: if 1 then 2 else 3);",
    "P(a: 1 ++ 2);",
    "P(n? += a) distinct :- a in ['x'];",
    "P(a: Length(3));",
    "F(x) = x + 1; P(a: F('x'));",
    "P(r:) :- r == {x: 1}, r.y == 2;",
    "P(a:) :- T(a:), a < true;",
])
def test_mismatches(text):
    assert [x.split(":")[0] for x in check(ON + text, positional=False)].count("typeMismatch") >= 1
    assert not any(x.startswith("typeMismatch") for x in check(text, positional=False))


def test_list_of_itself_ends():
    assert types("P(a:) :- T(a:), a in a;")["P"] == {"a": "[any]"}


@pytest.mark.parametrize("name", sorted(Q.keys() - {"d14_truth_and_one"}))
def test_catalogue_has_no_mismatch(name):
    """Programs that run are sound, but for the one that equates true and 1 on purpose."""
    assert [x for x in check(ON + Q[name].program, positional=False) if x.startswith("typeMismatch")] == []


def test_tables_take_part(spark):
    t = spark.createDataFrame([(1, "x", [1.5])], "a int, s string, l array<double>")
    program = Program("P(a:, s:, l:, z: l[0]) :- T(a:, s:, l:);", spark, {"T": t})
    assert program.types()["P"] == {"a": "number", "s": "string", "l": "[number]", "z": "number"}
    with pytest.raises(CheckError, match="typeMismatch: string can't be number|typeMismatch: number can't be string"):
        Program(ON + "P(b: s + 1) :- T(s:);", spark, {"T": t})
    assert Program("P(b: s) :- T(s:);", spark, {"T": t}).run("P").count() == 1
