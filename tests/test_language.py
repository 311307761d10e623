"""Parsing and the checks."""

import pytest

from clauseplan.api import check, parse, resolved
from clauseplan.errors import ParseError, PlanError
from clauseplan.lang.tree import Atom, Call, Combine, Directive, IfExpr, Import, Lit, Make, Member, Not, Or, Rule, Test, Unify, Var


def expr(text):
    return parse(f"P(x: {text}) :- Q(a:, b:, c:);")[0].head.fields[0].expr


def shape(node):
    if isinstance(node, Call):
        return (node.name, *map(shape, node.values))
    return node.name if isinstance(node, Var) else node.value


@pytest.mark.parametrize(("text", "tree"), [
    ("a + b * c", ("+", "a", ("*", "b", "c"))),
    ("a * b % c", ("*", "a", ("%", "b", "c"))),
    ("a - b - c", ("-", ("-", "a", "b"), "c")),
    ("a ^ b ^ c", ("^", ("^", "a", "b"), "c")),
    ("a || b && c", ("||", "a", ("&&", "b", "c"))),
    ("a + 1 == b", ("==", ("+", "a", 1), "b")),
    ("a is not null", ("is not", "a", None)),
    ("-3", -3),
    ("1.5e2", 150.0),
    ("a ++ 'x\\n\\x41'", ("++", "a", "x\nA")),
    ('"""q"q"""', 'q"q'),
])
def test_expressions(text, tree):
    assert shape(expr(text)) == tree


def test_statements():
    text = """
    import lib.names.Full as F;
    @OrderBy(P, "a", "DESC");
    N := P(Q: R);
    P(a:, n? += 1) distinct :- Q(a:), ~R(a:), a in [1, 2], a > 1 | S(b: a); # end
    F(x) = if x > 0 then 1 else -1;
    G(a) --> a + 1; /* c */
    T() Max= a :- Q(a:);
    """
    kinds = [type(s) for s in parse(text)]
    assert kinds == [Import, Directive, Make, Rule, Rule, Directive, Rule, Rule]
    rule = parse(text)[3]
    assert isinstance(rule.body, Or) and [type(p) for p in rule.body.parts[0].parts] == [Atom, Not, Member, Test]
    assert isinstance(parse(text)[4].head.fields[1].expr, IfExpr)
    assert parse(text)[-1].head.distinct


def test_combines():
    body = parse("P(x:, y:) :- Q(x:), y += z :- R(x:, z:);")[0].body
    assert isinstance(body.parts[1], Unify) and isinstance(body.parts[1].right, Combine)
    assert isinstance(expr("Max{z :- R(z:)}"), Combine)
    assert expr("inf") == Lit(float("inf"))


@pytest.mark.parametrize("text", ["P(a: 1", 'P(a: "x)', "P(a:, n? += 1) :- Q(a:);", "P(..r, a:) :- Q(..r);", "P(x: {..r}) :- Q(r:);", "P(A:) :- Q(A:);", "P(x: if a then b);", "/* open", "P(a: 'x\\xzz');"])
def test_broken(text):
    with pytest.raises(ParseError):
        parse(text)


def kinds(text, **more):
    return sorted({p.split(":")[0] for p in check(text, **more)})


@pytest.mark.parametrize(("text", "kind"), [
    ("P(x:, y:) :- Q(x:);", "unboundHeadVar"),
    ("P(x:) :- Q(y:), x > y;", "unboundHeadVar"),
    ("P(x:) :- Q(x:) | R(y:);", "unboundHeadVar"),
    ("P(x:) :- Q(x:), ~R(x:, y:);", "unsafeNegation"),
    ("P(x:, n? += y) distinct :- Q(x:);", "unsafeAggregation"),
    ("@Recursive(P, 3); P(x:) :- Q(x:), ~P(x:); P(x:) :- Q(x:);", "negativeCycle"),
    ("P(x:) :- Q(x:); P(x:, y:) :- Q(x:, y:);", "arityMismatch"),
    ("P(x:) :- Q(x:); R(y:) :- P(y:);", "unknownColumn"),
    ("@Recursive(P, 3); P(x:) :- P(x: y), Q(x:, y:);", "noBaseCase"),
    ("@Recursive(P, 3); P(x:) :- Q(x:); P(x:) :- P(x:), Q(x:);", "trivialLoop"),
    ("P(x:) :- Q(x:); P(x:) :- P(x: y), Q(x:, y:);", "unboundedRecursion"),
    ("A(x:) :- Q(x:); A(x:) :- B(x:); B(x:) :- A(x:), Q(x:);", "unboundedRecursion"),
    ("Today(x:) :- Q(x:);", "reservedName"),
    ('P(x: SqlExpr("1", {a:})) :- Q(a:);', "unsafeSqlExpr"),
    ("P(x) :- Q(x:);", "positionalArgument"),
    ("P(x:) :- R(x); R(y) :- Q(y:);", "positionalArgument"),
    ("@Nothing(P); P(x: 1);", "ParseError"),
])
def test_problems(text, kind):
    assert kind in kinds(text)


@pytest.mark.parametrize("text", [
    "P(x:) :- Q(x:), ~R(x:);",
    "P(x:) :- Q(x:), ~(R(x:, y:), y > 3);",
    "P(x:, y:) :- Q(x:), y == x + 1;",
    "P(x:) :- x in [1, 2];",
    "F(x) = x + 1; P(y:) :- Q(x:), y == F(x);",
    "@Recursive(P, 3); P(x:) :- Q(x:); P(x:) :- P(x: y), Q(x:, y:);",
    "P(x:, n:) :- Q(x:), n == (combine += y :- R(x:, y:));",
    "P(a:, b:) :- Q(r:), r == {a:, b:};",
])
def test_sound(text):
    assert check(text) == []


def test_imports(tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "a.l").write_text("import lib.b.Base; Big(x:) :- Base(x:), x > 1; Help(x:) :- Base(x:);")
    (tmp_path / "lib" / "b.l").write_text("Base(x: 1); Base(x: 2);")
    (tmp_path / "lib" / "c.l").write_text("import lib.d.X; Y(x:) :- X(x:);")
    (tmp_path / "lib" / "d.l").write_text("import lib.c.Y; X(x:) :- Y(x:);")
    names = {s.head.name for s in resolved("import lib.a.Big as B; P(x:) :- B(x:);", [tmp_path])}
    assert names == {"P", "Lib_A_Big", "Lib_A_Help", "Lib_B_Base"}
    for text in ("import lib.a.None; P(x:) :- None(x:);", "import lib.a.Big; P(x: 1);", "import lib.none.X; P(x:) :- X(x:);", "import lib.c.Y; P(x:) :- Y(x:);"):
        with pytest.raises(ParseError):
            resolved(text, [tmp_path])


def test_flags_and_makes():
    text = '@DefineFlag("a", "x"); @DefineFlag("b", "${a}y"); P(v: FlagValue("b"), w: "<${a}>");'
    fields = resolved(text)[-1].head.fields
    assert [f.expr.value for f in fields] == ["xy", "<x>"]
    assert resolved(text, flags={"a": "z"})[-1].head.fields[0].expr.value == "zy"
    with pytest.raises(PlanError):
        resolved(text, flags={"none": 1})
    with pytest.raises(PlanError):
        resolved("A := B(C: D); B := A(C: D);")
    with pytest.raises(PlanError):
        resolved("B(x:) :- C(x:); A := B(Other: D);")
