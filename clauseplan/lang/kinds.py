"""Kinds of columns, inferred by unification before anything runs.

A kind is ``any``, ``atomic`` (a number, a text or a time), ``number``, ``string``, ``bool``, a list ``[kind]`` or a record
``{field: kind}``.  What a rule equates, compares or passes on shares a cell; a cell that would have to be two kinds is a
problem.  Predicates that take values from their caller are inferred anew at each call, so they work for any kind.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from ..functions.aggregates import named
from .tree import VALUE, And, Atom, Call, Combine, Directive, FieldOf, Head, IfExpr, ListExpr, Lit, Member, Node, Not, Or, RecordExpr, Rule, Test, Unify, Var, variables
from .verify import Problem, bound_variables

#: What functions take and give.  A capital stands for any kind, the same one wherever it is repeated; arguments
#: beyond those named can be anything.
SIGNATURES = """
number number -> number: + - * / % ^ Pow Mod Div IeeeDivide SafeDivide SafeAdd SafeSubtract SafeMultiply
number -> number: neg Abs Exp Sin Cos Tan Sqrt Ln Log Log10 Floor Ceil Ceiling Round Trunc Sign Num SafeNegate BitCount
number -> bool: IsInf IsNan
atomic=A A -> bool: < <= > >=
A A -> bool: == = != is Is
A [A] -> bool: in
bool bool -> bool: && ||
bool -> bool: !
string -> string: Upper Lower Trim Ltrim Rtrim Str QuoteIt
string -> number: Length CharLength ByteLength Ord
string number number -> string: Substr
string string -> [string]: Split RegexpExtractAll
[string] string -> string: Join ArrayToString JoinOrEmpty
string string string -> string: Replace RegexpReplace
number -> string: Chr Char
string string -> bool: Like ILike RMatch RegexpContains RegexpMatch StartsWith EndsWith
string string -> string: RExtract RegexpExtract
string string -> number: Strpos
string number -> string: Repeat Lpad Rpad
number -> [number]: Range
[A] -> number: Size ArrayLength
[A] -> [number]: RangeOf
[A] number -> A: Element
[A] [A] -> [A]: ArrayConcat
[A] -> [A]: Sort Unique
A A -> A: Coalesce IfNull NullIf
A -> bool: IsNull
bool A A -> A: If
A -> number: ToInt64 ToFloat64 ToUInt64
A -> string: ToString
-> number: Rand
"""

#: What aggregates take and give.
AGGREGATE_SIGNATURES = """
number -> number: Sum Avg Product Median StddevPop StddevSamp VarPop VarSamp BitAnd BitOr BitXor
A -> number: Count ApproxCountDistinct
bool -> number: CountIf
bool -> bool: LogicalOr LogicalAnd
A -> A: Min Max AnyValue
A -> [A]: List Set
[A] -> [A]: MergeList
A -> string: StringAgg
{arg:B,value:A} -> [A]: Array
{arg:A,value:B} -> A: ArgMax ArgMin
"""

RANK = {"any": 0, "atomic": 1, "number": 2, "string": 2, "bool": 2, "list": 2, "record": 2}


@dataclass(eq=False)
class Cell:
    """``open``: a record that may have more fields."""

    kind: str = "any"
    item: Cell | None = None
    fields: dict[str, Cell] = field(default_factory=dict)
    open: bool = False
    same: Cell | None = None

    def top(self) -> Cell:
        cell = self
        while cell.same is not None:
            cell = cell.same
        return cell

    def __str__(self) -> str:
        return self.text(frozenset())

    def text(self, above: frozenset) -> str:
        cell = self.top()
        if cell in above:  # a list of itself
            return "any"
        above |= {cell}
        if cell.kind == "list":
            return f"[{cell.item.text(above)}]"
        if cell.kind == "record":
            return "{" + ", ".join(f"{k}: {v.text(above)}" for k, v in sorted(cell.fields.items())) + "}"
        return cell.kind


class Mismatch(Exception):
    pass


def join(a: Cell, b: Cell) -> None:
    """Make two cells one; Mismatch if no kind fits both."""
    a, b = a.top(), b.top()
    if a is b:
        return
    if RANK[a.kind] > RANK[b.kind]:
        a, b = b, a
    if a.kind == "atomic" and b.kind not in ("atomic", "number", "string") or RANK[a.kind] == 2 and a.kind != b.kind:
        raise Mismatch(f"{a} can't be {b}")
    if a.kind == "record":
        lacking = ([] if b.open else a.fields.keys() - b.fields.keys()) or ([] if a.open else b.fields.keys() - a.fields.keys())
        if lacking:
            raise Mismatch(f"{a} and {b} don't both have {', '.join(sorted(lacking))}")
    a.same = b
    if a.kind == "list":
        join(a.item, b.item)
    elif a.kind == "record":
        b.open &= a.open
        for k, v in a.fields.items():
            if k in b.fields:
                join(v, b.fields[k])
            else:
                b.fields[k] = v


def _written(text: str, letters: dict[str, Cell]) -> Cell:
    """The cell that a word of a signature means."""
    kind, _, letter = text.rpartition("=")
    if kind:
        return letters.setdefault(letter, Cell(kind))
    if text.startswith("["):
        return Cell("list", _written(text[1:-1], letters))
    if text.startswith("{"):
        return Cell("record", fields={k: _written(v, letters) for k, v in (x.split(":") for x in text[1:-1].split(","))})
    return letters.setdefault(text, Cell()) if text.isupper() else Cell(text)


def _table(text: str) -> dict[str, tuple[list[str], str]]:
    out = {}
    for line in text.strip().splitlines():
        kinds, names = line.rsplit(": ", 1)
        takes, gives = kinds.split("->")
        out |= {n: (takes.split(), gives.strip()) for n in names.split()}
    return out


FUNCTION_KINDS, AGGREGATE_KINDS = _table(SIGNATURES), _table(AGGREGATE_SIGNATURES)


def of_schema(kind: object) -> Cell:
    """The cell of a column's type, as Spark's schemas write it in JSON."""
    if isinstance(kind, dict) and kind["type"] == "array":
        return Cell("list", of_schema(kind["elementType"]))
    if isinstance(kind, dict) and kind["type"] == "struct":
        return Cell("record", fields={f["name"]: of_schema(f["type"]) for f in kind["fields"]})
    if kind in ("byte", "short", "integer", "long", "float", "double") or str(kind).startswith("decimal"):
        return Cell("number")
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return Cell("atomic")
    return Cell({"string": "string", "boolean": "bool"}.get(str(kind), "any"))


class Inference:
    """Cells of all columns of a program; ``schemas`` gives those of tables, as ``of_schema`` makes them."""

    def __init__(self, statements: list[Node], schemas: dict[str, dict[str, Cell]] | None = None):
        self.rules: dict[str, list[Rule]] = defaultdict(list)
        for s in statements:
            if isinstance(s, Rule):
                self.rules[s.head.name].append(s)
        self.columns: dict[str, dict[str, Cell]] = defaultdict(dict, {n: dict(c) for n, c in (schemas or {}).items() if n not in self.rules})
        self.known = set(self.columns)
        self.generic = {n for n, rs in self.rules.items() if any(_takes(r) for r in rs)}
        self.open_calls: dict[str, dict[str, Cell]] = {}
        self.problems: list[Problem] = []
        for name, rules in self.rules.items():
            for r in rules:
                self.rule(r, self.columns[name])

    def same(self, a: Cell, b: Cell, rule: Rule, where: str) -> None:
        try:
            join(a, b)
        except Mismatch as e:
            self.problems.append(Problem("typeMismatch", f"{e} in {where} of {rule.head.name}", rule.text))

    def rule(self, rule: Rule, columns: dict[str, Cell]) -> None:
        names: dict[str, Cell] = defaultdict(Cell)
        self.body(rule.body, names, rule)
        for f in rule.head.fields:
            cell = self.expr(f.expr, names, rule)
            if f.op:
                cell = self.aggregate(f.op, cell, rule)
            shown = "the value" if f.name == VALUE else f"column {f.name}"
            self.same(columns.setdefault(f.name, Cell()), cell, rule, shown)

    def body(self, node: Node | None, names: dict[str, Cell], rule: Rule) -> None:
        if isinstance(node, And | Or):
            for p in node.parts:
                self.body(p, names, rule)
        elif isinstance(node, Not):
            self.body(node.body, names, rule)
        elif isinstance(node, Atom):
            if node.name in FUNCTION_KINDS and node.name not in self.rules and node.name not in self.known:
                self.expr(Call(node.name, node.args), names, rule)
                return
            columns = self.of(node.name)
            for k, e in node.args:
                self.same(columns.setdefault(k, Cell()), self.expr(e, names, rule), rule, f"{node.name}({k}:)")
        elif isinstance(node, Unify):
            self.same(self.expr(node.left, names, rule), self.expr(node.right, names, rule), rule, "an equality")
        elif isinstance(node, Member):
            self.same(Cell("list", self.expr(node.item, names, rule)), self.expr(node.items, names, rule), rule, "'in'")
        elif isinstance(node, Test):
            self.expr(node.expr, names, rule)

    def of(self, name: str) -> dict[str, Cell]:
        """A predicate's columns; those of one that takes values from its caller are made anew, once a nest of calls."""
        if name not in self.generic:
            return self.columns[name]
        if name in self.open_calls:
            return self.open_calls[name]
        columns = self.open_calls[name] = {}
        for r in self.rules[name]:
            self.rule(r, columns)
        del self.open_calls[name]
        return columns

    def expr(self, node: Node, names: dict[str, Cell], rule: Rule) -> Cell:
        if isinstance(node, Lit):
            v = node.value
            return Cell("any" if v is None else "bool" if isinstance(v, bool) else "string" if isinstance(v, str) else "number")
        if isinstance(node, Var):
            return Cell() if node.name == "_" else names[node.name]
        if isinstance(node, ListExpr):
            item = Cell()
            for x in node.items:
                self.same(item, self.expr(x, names, rule), rule, "a list")
            return Cell("list", item)
        if isinstance(node, RecordExpr):
            return Cell("record", fields={k: self.expr(v, names, rule) for k, v in node.items})
        if isinstance(node, FieldOf):
            out = Cell()
            self.same(Cell("record", fields={node.name: out}, open=True), self.expr(node.base, names, rule), rule, f".{node.name}")
            return out
        if isinstance(node, IfExpr):
            out = self.expr(node.other, names, rule)
            for test, value in node.branches:
                self.same(Cell("bool"), self.expr(test, names, rule), rule, "'if'")
                self.same(out, self.expr(value, names, rule), rule, "'then'")
            return out
        if isinstance(node, Combine):
            self.body(node.body, names, rule)
            return self.aggregate(node.op, self.expr(node.expr, names, rule), rule)
        if isinstance(node, Call):
            return self.call(node, names, rule)
        return Cell()

    def call(self, node: Call, names: dict[str, Cell], rule: Rule) -> Cell:
        given = [(k, self.expr(v, names, rule)) for k, v in node.args]
        if node.name in self.rules:
            columns = self.of(node.name)
            for k, cell in given:
                self.same(columns.setdefault(k, Cell()), cell, rule, f"{node.name}({k}:)")
            return columns.setdefault(VALUE, Cell())
        if node.name == "->" and len(given) == 2:
            return Cell("record", fields={"arg": given[0][1], "value": given[1][1]})
        if node.name in ("++", "++?"):  # texts, or lists of one kind
            for (_, a), (_, b) in zip(given, given[1:]):
                self.same(a, b, rule, f"'{node.name}'")
            if given[0][1].top().kind in ("number", "bool", "record"):
                self.problems.append(Problem("typeMismatch", f"{given[0][1]} can't be joined by '{node.name}' in {rule.head.name}", rule.text))
            return given[0][1]
        takes, gives = FUNCTION_KINDS.get(node.name, ([], "any"))
        letters: dict[str, Cell] = {}
        for word, (_, cell) in zip(takes, given):
            self.same(_written(word, letters), cell, rule, f"'{node.name}'")
        return _written(gives, letters)

    def aggregate(self, op: str, cell: Cell, rule: Rule) -> Cell:
        if op in self.rules:
            columns = self.of(op)
            first = next((f.name for f in self.rules[op][0].head.fields if f.name != VALUE), None)
            if first:
                self.same(columns.setdefault(first, Cell()), cell, rule, f"'{op}='")
            return columns.setdefault(VALUE, Cell())
        takes, gives = AGGREGATE_KINDS.get(named(op), ([], "any"))
        letters: dict[str, Cell] = {}
        for word in takes:
            self.same(_written(word, letters), cell, rule, f"'{op}='")
        return _written(gives, letters)

    def kinds(self) -> dict[str, dict[str, str]]:
        """Every predicate's columns and their kinds, as text."""
        return {n: {"value" if k == VALUE else k: str(c) for k, c in self.columns[n].items()} for n in self.rules}


def _takes(rule: Rule) -> bool:
    """Whether a rule needs values from its caller."""
    plain = Rule(Head(rule.head.name, ()), rule.body)
    return bool({v for f in rule.head.fields if not f.op and f.name != VALUE for v in variables(f.expr)} - bound_variables(plain))


def wanted(statements: list[Node]) -> bool:
    """Whether the program asks for a check of kinds: ``@Engine(..., type_checking: true)``."""
    return any(isinstance(s, Directive) and s.name == "Engine" and isinstance(v := dict(s.args).get("type_checking"), Lit) and bool(v.value) for s in statements)
