"""Checks of a program before it is planned.  All problems are found and told together."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from ..functions import aggregates, scalar, windows
from .rewrite import used_by
from .tree import VALUE, Atom, Call, Combine, Directive, Member, Node, Not, PredRef, RecordExpr, Rule, Test, Unify, Var, conjuncts, variables, walk

RESERVED = {"Today", "Now"} | set(aggregates.AGGREGATES) | set(windows.WINDOWS) | set(scalar.FUNCTIONS) | set(scalar.TYPED) | set(scalar.LITERAL) | {"SqlExpr", "FlagValue", "ReadFile", "ReadJson"}


@dataclass(frozen=True)
class Problem:
    """``kind`` is one of: unboundHeadVar, unsafeNegation, unsafeAggregation, negativeCycle, arityMismatch, unknownColumn,
    noBaseCase, trivialLoop, unboundedRecursion, reservedName, unsafeSqlExpr, positionalArgument."""

    kind: str
    message: str
    rule: str = ""

    def __str__(self) -> str:
        return f"{self.kind}: {self.message}" + (f"\n    {self.rule}" if self.rule else "")


def _parameters(rule: Rule) -> set[str]:
    """A function's parameters come from its caller."""
    if not any(f.name == VALUE and not f.op for f in rule.head.fields):
        return set()
    return {v for f in rule.head.fields if f.name != VALUE for v in variables(f.expr)}


def bound_variables(rule: Rule) -> set[str]:
    """Variables that a rule's positive conjuncts bind: atoms, equalities, members of lists."""
    out = _parameters(rule)
    parts = conjuncts(rule.body)
    for p in parts:
        if isinstance(p, Atom):
            out |= {v for _, e in p.args for v in variables(e)} | ({p.rest} if p.rest else set())
    moved = True
    while moved:
        size = len(out)
        for p in parts:
            if isinstance(p, Unify):
                for a, b in ((p.left, p.right), (p.right, p.left)):
                    if isinstance(a, Var | RecordExpr) and (isinstance(b, Combine) or variables(b, inner=False) <= out):
                        out |= variables(a)
            elif isinstance(p, Member) and variables(p.items) <= out and isinstance(p.item, Var):
                out.add(p.item.name)
        moved = len(out) > size
    return out


def _safety(rules: list[Rule], callers: set[str]) -> list[Problem]:
    out = []
    for r in rules:
        bound = bound_variables(r)
        if r.body is not None or not callers or r.head.name not in callers:
            for f in r.head.fields:
                for v in sorted(variables(f.expr, inner=False) - bound - {"_"}):
                    if f.op:
                        out.append(Problem("unsafeAggregation", f"{v} is aggregated in {r.head.name} but not bound", r.text))
                    else:
                        out.append(Problem("unboundHeadVar", f"{v} in the head of {r.head.name} is not bound", r.text))
            if r.head.rest and r.head.rest not in bound:
                out.append(Problem("unboundHeadVar", f"..{r.head.rest} in the head of {r.head.name} is not bound", r.text))
        for p in conjuncts(r.body):
            if isinstance(p, Not):
                inner = _local(p.body)
                for v in sorted(variables(p) - bound - inner - {"_"}):
                    out.append(Problem("unsafeNegation", f"{v} stands under '~' in {r.head.name} but is not bound outside", r.text))
            elif isinstance(p, Test):
                for v in sorted(variables(p, inner=False) - bound - {"_"}):
                    out.append(Problem("unboundHeadVar", f"{v} in a condition of {r.head.name} is not bound", r.text))
        for n in (n for part in (r.body, *(f.expr for f in r.head.fields)) for n in walk(part)):
            if isinstance(n, Combine):
                inside = bound | set().union(*(bound_variables(Rule(r.head, c)) for c in [n.body]) if n.body is not None else set())
                for v in sorted(variables(n.expr) - inside - {"_"}):
                    out.append(Problem("unsafeAggregation", f"{v} is aggregated in {r.head.name} but not bound", r.text))
    return out


def _local(body: Node) -> set[str]:
    """Variables that stand in several places or with a condition inside a negation may be its own if an atom there binds
    them together with others; a single atom's variables must come from outside."""
    parts = conjuncts(body)
    if len(parts) < 2:
        return _local(parts[0].body) if parts and isinstance(parts[0], Not) else set()
    return {v for p in parts if isinstance(p, Atom) for v in variables(p)} | {v for p in parts if isinstance(p, Unify | Member) for v in variables(p)}


def components(graph: dict[str, set[str]]) -> list[set[str]]:
    """Strongly connected components (Tarjan), without recursion."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    on: set[str] = set()
    out = []
    for root in sorted(graph):
        if root in index:
            continue
        work = [(root, iter(sorted(graph[root])))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for n in rest:
                if n not in graph:
                    continue
                if n not in index:
                    index[n] = low[n] = len(index)
                    stack.append(n)
                    on.add(n)
                    work.append((n, iter(sorted(graph[n]))))
                    break
                if n in on:
                    low[node] = min(low[node], index[n])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    own = set()
                    while True:
                        n = stack.pop()
                        on.discard(n)
                        own.add(n)
                        if n == node:
                            break
                    out.append(own)
    return out


def _negative_uses(rule: Rule) -> set[str]:
    return {x.name for p in conjuncts(rule.body) for n in walk(p) if isinstance(n, Not) for x in walk(n) if isinstance(x, Atom | Call)}


def _recursion(rules: dict[str, list[Rule]], declared: set[str]) -> list[Problem]:
    graph = {n: set().union(*(used_by(r) for r in rs)) & rules.keys() for n, rs in rules.items()}
    out = []
    for loop in components(graph):
        if len(loop) == 1 and not graph[next(iter(loop))] & loop:
            continue
        names = ", ".join(sorted(loop))
        if any(_negative_uses(r) & loop for n in loop for r in rules[n]):
            out.append(Problem("negativeCycle", f"{names}: a predicate depends on its own negation"))
        if not any(not used_by(r) & loop for n in loop for r in rules[n]):
            out.append(Problem("noBaseCase", f"{names}: no rule does without the others"))
        for n in sorted(loop):
            for r in rules[n]:
                args = {f.name: f.expr for f in r.head.fields if not f.op}
                if any(isinstance(p, Atom) and p.name == n and p.args and dict(p.args) == args for p in conjuncts(r.body)):
                    out.append(Problem("trivialLoop", f"{n} calls itself with what it was given", r.text))
            if n not in declared:
                out.append(Problem("unboundedRecursion", f"{n} is recursive; say @Recursive({n}, depth)"))
    return out


def _arity(rules: dict[str, list[Rule]]) -> list[Problem]:
    out = []
    for name, rs in sorted(rules.items()):
        sizes = {len(r.head.fields) for r in rs if not r.head.rest}
        if len(sizes) > 1:
            out.append(Problem("arityMismatch", f"rules of {name} have {' and '.join(map(str, sorted(sizes)))} columns"))
    for rs in rules.values():
        for r in rs:
            for n in (n for part in (r.body, *(f.expr for f in r.head.fields)) for n in walk(part)):
                if not isinstance(n, Atom | Call) or n.name not in rules or any(x.head.rest for x in rules[n.name]):
                    continue
                fields = {f.name for x in rules[n.name] for f in x.head.fields}
                own = [f.name for f in rules[n.name][0].head.fields if f.name != VALUE]
                places = [k for k, _ in n.args if k.startswith("col") and k[3:].isdigit()]
                if places and len(places) == len(n.args) and not getattr(n, "rest", None) and all(f.startswith("col") for f in own) and len(places) != len(own):
                    out.append(Problem("arityMismatch", f"{n.name} has {len(own)} columns, here it has {len(places)}", r.text))
                    continue
                for k, _ in n.args:
                    if k not in fields:
                        out.append(Problem("unknownColumn", f"{n.name} has no column {k}", r.text))
    return out


def _positional(rules: dict[str, list[Rule]]) -> list[Problem]:
    out = []
    for name, rs in sorted(rules.items()):
        for r in rs:
            if any(f.name == VALUE for f in r.head.fields):
                continue
            if any(f.name.startswith("col") and f.name[3:].isdigit() for f in r.head.fields):
                out.append(Problem("positionalArgument", f"{name} has a column without a name", r.text))
    for rs in rules.values():
        for r in rs:
            for n in walk(r.body):
                if isinstance(n, Atom) and any(k.startswith("col") and k[3:].isdigit() for k, _ in n.args) and n.name not in RESERVED and not any(f.name == VALUE for x in rules.get(n.name, ()) for f in x.head.fields) and (n.name in rules or not n.name[:1].isupper()):
                    out.append(Problem("positionalArgument", f"{n.name} is used with an argument without a name", r.text))
    return out


def problems(statements: list[Node], positional: bool = True) -> list[Problem]:
    """All problems of a program whose imports, parameterised predicates and disjunctions are resolved."""
    rules: dict[str, list[Rule]] = defaultdict(list)
    for s in statements:
        if isinstance(s, Rule):
            rules[s.head.name].append(s)
    rules = dict(rules)
    declared = {s.args[0][1].name for s in statements if isinstance(s, Directive) and s.name == "Recursive" and s.args and isinstance(s.args[0][1], PredRef)}
    out = _safety([r for rs in rules.values() for r in rs], set())
    out += _recursion(rules, declared)
    out += _arity(rules)
    out += [Problem("reservedName", f"{n} is built in") for n in sorted(rules) if n in RESERVED]
    for rs in rules.values():
        for r in rs:
            if any(isinstance(n, Call | Atom) and n.name == "SqlExpr" for part in (r.body, *(f.expr for f in r.head.fields)) for n in walk(part)):
                out.append(Problem("unsafeSqlExpr", f"{r.head.name} splices SQL text", r.text))
    if positional:
        out += _positional(rules)
    return list(dict.fromkeys(out))


