"""Fixpoints of recursive predicates, as a driver loop over DataFrames.

With T the predicate's rules evaluated once and n the declared depth, the result is T applied n + 1 times to nothing; depth
-1 goes on until nothing changes.  A predicate whose rules each use it once at most, and not under a negation or an
aggregate, moves only what the last step found.  Every step is cut to shared storage, so plans stay short.
"""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PlanError
from ..lang.rewrite import used_by
from ..lang.tree import Atom, Call, Combine, Node, Not, Rule, Var, conjuncts, variables, walk
from ..operators.lineage import cut
from ..operators.relational import all_of, quoted, union_all

if TYPE_CHECKING:
    from .planner import Planner

FOREVER = 10**9
#: Steps after which what is known is written down as one table.
COMPACT = 8


def depth_of(planner: Planner, loop: set[str]) -> int:
    given = [planner.recursive[n]["depth"] for n in sorted(loop) if n in planner.recursive]
    if not given:
        raise PlanError(f"{', '.join(sorted(loop))}: recursion needs @Recursive(Predicate, depth)")
    return FOREVER if any(d < 0 for d in given) else max(given)


def _plain_uses(rule: Rule, loop: set[str]) -> int | None:
    """How often a rule's conjunction uses the loop; None if it does so elsewhere than as a plain atom."""
    parts = conjuncts(rule.body)
    plain = [p for p in parts if isinstance(p, Atom) and p.name in loop]
    every = [n for p in (rule.body, *(f.expr for f in rule.head.fields)) for n in walk(p) if isinstance(n, Atom | Call) and n.name in loop]
    return len(plain) if len(plain) == len(every) else None


def solved(planner: Planner, loop: set[str]) -> dict[str, DataFrame]:
    depth = depth_of(planner, loop)
    stop = next((planner.recursive[n].get("stop") for n in sorted(loop) if n in planner.recursive), None)
    if len(loop) == 1 and not stop:
        name = next(iter(loop))
        rules = planner.rules[name]
        uses = [_plain_uses(r, loop) for r in rules]
        if all(u is not None and u < 2 for u in uses):
            if not any(f.op for r in rules for f in r.head.fields):
                return {name: _stepwise(planner, name, depth, uses)}
            if column := _extreme(rules, name):
                return {name: _improving(planner, name, depth, uses, *column)}
    return _naive(planner, loop, depth, stop)


def _with(planner: Planner, values: dict[str, DataFrame | None], name: str, rules: list[Rule] | None = None) -> DataFrame:
    own, kept = planner.rules[name], planner.overrides
    planner.overrides = kept | values
    planner.rules[name] = own if rules is None else rules
    try:
        return planner.evaluated(name)
    finally:
        planner.overrides, planner.rules[name] = kept, own


def _stepwise(planner: Planner, name: str, depth: int, uses: list[int]) -> DataFrame:
    rules = planner.rules[name]
    base = [r for r, u in zip(rules, uses, strict=True) if not u]
    steps = [r for r, u in zip(rules, uses, strict=True) if u]
    if not base:
        raise PlanError(f"{name} has no rule without itself, so it is empty")
    distinct = rules[0].head.distinct
    new = cut(_with(planner, {name: None}, name, base))
    parts = [new]
    for _ in range(depth):
        if new.isEmpty():
            break
        found = _with(planner, {name: new}, name, steps)
        found = union_all([parts[0], found]).limit(0).unionByName(found) if found.columns == parts[0].columns else found.toDF(*parts[0].columns)
        if distinct:
            known = reduce(DataFrame.unionByName, parts)
            same = [F.col(f"_new.`{c}`").eqNullSafe(F.col(f"_old.`{c}`")) for c in found.columns]
            found = found.distinct().alias("_new").join(known.alias("_old"), reduce(lambda a, b: a & b, same), "left_anti")
        new = cut(found)
        parts.append(new)
        if len(parts) == COMPACT and distinct:
            parts = [cut(union_all(parts))]  # or each step would read one part more than the last
    return union_all(parts)


def _extreme(rules: list[Rule], name: str) -> tuple[str, str] | None:
    """The column and the aggregate of a predicate that keeps one least or greatest value a key, if each recursive rule only
    passes that value on, or adds to it or takes from it what does not depend on it: then a value that a better one has
    replaced can give nothing better, and a step has to move only keys that improved."""
    ops = {(f.name, f.op) for r in rules for f in r.head.fields if f.op}
    if len(ops) != 1 or not all(r.head.distinct for r in rules):
        return None
    column, op = ops.pop()
    if op not in ("Min", "Max"):
        return None
    for r in rules:
        atom = next((p for p in conjuncts(r.body) if isinstance(p, Atom) and p.name == name), None)
        if atom is None:
            continue
        was = dict(atom.args).get(column)
        if atom.rest or not isinstance(was, Var):
            return None
        others = [p for p in conjuncts(r.body) if p is not atom] + [f.expr for f in r.head.fields if f.name != column] + [v for k, v in atom.args if k != column]
        value = next(f.expr for f in r.head.fields if f.name == column)
        if any(was.name in variables(x) for x in others) or not _moved_only(value, was.name):
            return None
    return column, op


def _moved_only(value: Node, name: str) -> bool:
    if isinstance(value, Var):
        return value.name == name
    if isinstance(value, Call) and value.name in ("+", "-") and len(value.values) == 2:
        a, b = value.values
        if _moved_only(a, name):
            return name not in variables(b)
        return value.name == "+" and _moved_only(b, name) and name not in variables(a)
    return False


def _improving(planner: Planner, name: str, depth: int, uses: list[int], column: str, op: str) -> DataFrame:
    """The fixpoint of a least or greatest value a key; each step starts from the keys that the last one improved."""
    rules = planner.rules[name]
    base = [r for r, u in zip(rules, uses, strict=True) if not u]
    steps = [r for r, u in zip(rules, uses, strict=True) if u]
    if not base:
        raise PlanError(f"{name} has no rule without itself, so it is empty")
    best = F.min if op == "Min" else F.max
    new = cut(_with(planner, {name: None}, name, base))
    keys = [c for c in new.columns if c != column]

    def merged(frames: list[DataFrame]) -> DataFrame:
        every = union_all(frames)
        own = best(quoted(column)).alias(column)
        return (every.groupBy(*map(quoted, keys)).agg(own) if keys else every.agg(own)).select(*map(quoted, new.columns))

    parts = [new]
    for _ in range(depth):
        if not steps or new.isEmpty():
            break
        found = _with(planner, {name: new}, name, steps).select(*map(quoted, new.columns))
        old = merged(parts).select(*[quoted(k).alias(f"_old{i}") for i, k in enumerate(keys)], quoted(column).alias("_best"))
        same = all_of([quoted(k).eqNullSafe(F.col(f"_old{i}")) for i, k in enumerate(keys)])
        better = quoted(column) < F.col("_best") if op == "Min" else quoted(column) > F.col("_best")
        joined = found.join(old, same, "left").filter(F.col("_best").isNull() | better)
        new = cut(joined.select(*map(quoted, found.columns)))
        parts.append(new)
        if len(parts) == COMPACT:
            parts = [cut(merged(parts))]
    return merged(parts)


def _state(frame: DataFrame) -> tuple:
    """A count and two sums of 64-bit hashes: equal for equal bags."""
    row = F.struct(*[quoted(c) for c in frame.columns])
    sums = [F.sum(F.xxhash64(row, F.lit(seed)).cast("decimal(20,0)")).alias(f"s{seed}") for seed in (1, 2)]
    return tuple(frame.agg(F.count("*").alias("n"), *sums).first())


def _naive(planner: Planner, loop: set[str], depth: int, stop: str | None) -> dict[str, DataFrame]:
    names = sorted(loop)
    values: dict[str, DataFrame | None] = dict.fromkeys(names)
    before = None
    for _ in range(depth + 1):
        values = {n: cut(_with(planner, values, n)) for n in names}
        now = [_state(values[n]) for n in names]
        if now == before or all(s[0] == 0 for s in now):
            break
        before = now
        if stop and _holds(planner, values, stop):
            break
    if all(v is not None and v.isEmpty() for v in values.values()) and not any(not (used_by(r) & loop) for n in names for r in planner.rules[n]):
        raise PlanError(f"{', '.join(names)} has no rule without itself, so it is empty")
    return values


def _holds(planner: Planner, values: dict, stop: str) -> bool:
    kept, memo = planner.overrides, planner.memo
    planner.overrides, planner.memo = kept | values, dict(memo)
    try:
        return not planner.relation(stop).isEmpty()
    finally:
        planner.overrides, planner.memo = kept, memo


def is_negative(rule: Rule, name: str) -> bool:
    """Whether a rule uses ``name`` under a negation or inside a combine."""
    return any(isinstance(n, Not | Combine) and any(isinstance(x, Atom | Call) and x.name == name for x in walk(n)) for p in (rule.body, *(f.expr for f in rule.head.fields)) for n in walk(p))
