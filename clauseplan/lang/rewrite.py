"""Rewritings between parsing and planning: flags, parameterised predicates, disjunctions."""

from __future__ import annotations

import re
from dataclasses import replace
from itertools import product

from ..errors import ParseError, PlanError
from .modules import renamed
from .tree import VALUE, And, Atom, Call, Combine, Directive, Head, HeadField, Lit, Make, Node, Or, PredRef, Rule, mapped, walk

#: The directives there are.
DIRECTIVES = {
    "Limit", "OrderBy", "Ground", "Flag", "DefineFlag", "NoInject", "Make", "CompileAsTvf", "With", "NoWith", "CompileAsUdf", "ResetFlagValue", "Dataset", "AttachDatabase", "Engine", "Recursive", "Iteration", "BareAggregation",
}
#: Those that a parameterised predicate's copy takes along.
CARRIED = {"Limit", "OrderBy", "Ground", "NoInject", "Iteration"}
MOST_BRANCHES = 10_000


def flag_values(statements: list[Node], given: dict[str, object] | None = None) -> dict[str, object]:
    """Flags by name: the caller's value, else the program's reset value, else the default."""
    out: dict[str, object] = {}
    for kind in ("DefineFlag", "ResetFlagValue"):
        for s in statements:
            if isinstance(s, Directive) and s.name == kind:
                values = [v.value for _, v in s.args if isinstance(v, Lit)]
                if not values:
                    raise ParseError(f"@{kind} takes a name and a value")
                if kind == "ResetFlagValue" and values[0] not in out:
                    raise ParseError(f"flag {values[0]} is not defined")
                out[values[0]] = values[1] if len(values) > 1 else ""
    for name, value in (given or {}).items():
        if name not in out:
            raise PlanError(f"flag {name} is not defined")
        out[name] = value
    return out


def with_flags(statements: list[Node], flags: dict[str, object]) -> list[Node]:
    def text(value: str) -> str:
        for _ in range(100):
            new = re.sub(r"\$\{(\w+)\}", lambda m: str(flags[m[1]]) if m[1] in flags else m[0], value)
            if new == value:
                break
            value = new
        return value

    def change(node: Node) -> Node | None:
        if isinstance(node, Call) and node.name == "FlagValue":
            name = node.values[0]
            if not isinstance(name, Lit) or name.value not in flags:
                raise PlanError("FlagValue takes the name of a flag")
            value = flags[name.value]
            return Lit(text(value) if isinstance(value, str) else value)
        if isinstance(node, Lit) and isinstance(node.value, str) and "${" in node.value:
            return Lit(text(node.value))
        return None

    return [mapped(s, change) for s in statements]


def used_by(rule: Rule) -> set[str]:
    """Predicates and functions that a rule names."""
    out = {n.name for part in (rule.body, *(f.expr for f in rule.head.fields)) for n in walk(part) if isinstance(n, Atom | Call | PredRef)}
    out |= {n.op for part in (rule.body, *(f.expr for f in rule.head.fields)) for n in walk(part) if isinstance(n, Combine)}
    return out | {f.op for f in rule.head.fields if f.op}


def closure(name: str, uses: dict[str, set[str]]) -> set[str]:
    out, todo = set(), [name]
    while todo:
        n = todo.pop()
        if n not in out:
            out.add(n)
            todo += uses.get(n, ())
    return out


def with_makes(statements: list[Node]) -> list[Node]:
    """Each ``New := Old(Parameter: Value)`` as copies of what of ``Old`` depends on a parameter, each call made once."""
    makes = [s for s in statements if isinstance(s, Make)]
    rest = [s for s in statements if not isinstance(s, Make)]
    cache: dict[tuple, str] = {}
    while makes:
        names = {s.head.name for s in rest if isinstance(s, Rule)}
        waiting = {m.new for m in makes}
        ready = [m for m in makes if m.old in names and not closure(m.old, _uses(rest)) & waiting and not {v.name for _, v in m.args if isinstance(v, PredRef)} & waiting]
        if not ready:
            raise PlanError(f"can't make {', '.join(sorted(waiting))}: what they build on is missing or circular")
        for m in ready:
            rest += _made(m, rest, cache)
            makes.remove(m)
    return rest


def _uses(statements: list[Node]) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for s in statements:
        if isinstance(s, Rule):
            out.setdefault(s.head.name, set()).update(used_by(s))
    return out


def _made(make: Make, statements: list[Node], cache: dict) -> list[Node]:
    uses = _uses(statements)
    values: dict[str, str] = {}
    extra: list[Node] = []
    for parameter, value in make.args:
        if isinstance(value, PredRef):
            values[parameter] = value.name
        elif isinstance(value, Lit):
            name = f"{make.new}_{parameter}"
            extra.append(Rule(Head(name, (HeadField(VALUE, value),)), None, f"{name}() = ...;"))
            values[parameter] = name
        else:
            raise PlanError(f"{make.new}: a parameter is a predicate, a number or a string")
    reach = closure(make.old, uses)
    if unknown := set(values) - reach:
        raise PlanError(f"{make.old} doesn't depend on {', '.join(sorted(unknown))}")
    key = (make.old, tuple(sorted((k, v) for k, v in values.items() if not v.startswith(make.new + "_"))))
    if key in cache and not extra:
        old = cache[key]
        args = _columns(old, statements)
        return [Rule(Head(make.new, tuple(HeadField(a, v) for a, v in args)), Atom(old, args), f"{make.new} is {old};")]
    cache[key] = make.new
    moved = {n for n in reach if n in uses and n not in values and closure(n, uses) & set(values)} | {make.old}
    names = {n: make.new if n == make.old else f"{n}_of_{make.new}" for n in moved}
    own = [s for s in statements if isinstance(s, Rule) and s.head.name in moved or isinstance(s, Directive) and s.name in CARRIED and s.args and isinstance(s.args[0][1], PredRef) and s.args[0][1].name in moved]
    own += [s for s in statements if isinstance(s, Directive) and s.name == "Recursive" and isinstance(s.args[0][1], PredRef) and s.args[0][1].name in moved]
    return extra + renamed(own, names | values)


def _columns(name: str, statements: list[Node]) -> tuple:
    from .tree import Var

    head = next(s.head for s in statements if isinstance(s, Rule) and s.head.name == name)
    return tuple((f.name, Var(f"c{i}")) for i, f in enumerate(head.fields))


def branches(node: Node | None) -> list[list[Node]]:
    """The conjunctions of a body's disjunctive form; negations and combines stay whole."""
    if node is None:
        return [[]]
    if isinstance(node, Or):
        return [b for p in node.parts for b in branches(p)]
    if isinstance(node, And):
        parts = [branches(p) for p in node.parts]
        n = 1
        for p in parts:
            n *= len(p)
        if n > MOST_BRANCHES:
            raise PlanError(f"a rule has more than {MOST_BRANCHES} branches")
        return [[x for b in choice for x in b] for choice in product(*parts)]
    return [[node]]


def split_rules(statements: list[Node]) -> list[Node]:
    """Disjunctions as rules of their own."""
    out = []
    for s in statements:
        if isinstance(s, Rule):
            forms = branches(s.body)
            out += [s] if len(forms) == 1 else [replace(s, body=b[0] if len(b) == 1 else And(tuple(b))) for b in forms]
        else:
            out.append(s)
    return out


def checked_directives(statements: list[Node]) -> None:
    for s in statements:
        if isinstance(s, Directive) and s.name not in DIRECTIVES:
            raise ParseError(f"there is no directive @{s.name}; there are {', '.join(sorted('@' + d for d in DIRECTIVES))}")


def no_disjunction_inside(statements: list[Node]) -> None:
    for s in statements:
        for n in walk(s):
            if isinstance(n, Combine) and any(isinstance(x, Or) for x in walk(n.body)):
                raise ParseError("'|' can't stand in the body of an aggregate")
