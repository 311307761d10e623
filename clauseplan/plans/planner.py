"""Rules to lazy DataFrames.

A rule's conjuncts are planned as soon as what they need is bound: filters and bindings first, then atoms that share a
variable with what is there, then unnested lists, then combines and negations.  Catalyst orders joins and picks their
kind.  Each variable lives in a column of its own with a unique name, so a self join is never ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError
from ..functions import aggregates, scalar, windows
from ..lang.rewrite import closure, used_by
from ..lang.tree import (
    VALUE, And, Atom, Call, Combine, FieldOf, Head, IfExpr, ListExpr, Lit, Member, Node, Not, Or, PredRef, RecordExpr, Rule, Test, Unify, Var, conjuncts, mapped, variables, walk,
)
from ..operators.lineage import cut
from ..sources import load
from ..operators.relational import all_of, anti_join, attach_row, quoted, searched, sorted_by, union_all

#: The names of Spark's own functions, asked for once.
_FUNCTIONS: set[str] = set()
#: Table reads that a predicate's plan may hold before it is written down for its users.
MOST_SCANS = 16
SPECIAL = {"Today": ("date",), "Now": ("timestamp",)}


@dataclass
class Frame:
    """A DataFrame and the columns of the variables bound in it."""

    df: DataFrame | None = None
    bound: dict[str, str] = field(default_factory=dict)
    rest: dict[str, list[tuple[str, str]]] = field(default_factory=dict)

    def copy(self) -> Frame:
        return Frame(self.df, dict(self.bound), dict(self.rest))


class Planner:
    def __init__(self, spark: SparkSession, rules: dict[str, list[Rule]], tables: dict[str, DataFrame | str], order: dict[str, list[str]], limit: dict[str, int], ground: dict[str, dict], recursive: dict[str, dict], unsafe: bool = False):
        self.spark, self.rules, self.tables, self.unsafe = spark, rules, tables, unsafe
        self.order, self.limit, self.ground, self.recursive = order, limit, ground, recursive
        self.memo: dict[str, DataFrame] = {}
        self.overrides: dict[str, DataFrame | None] = {}
        self.uses = {n: set().union(*(used_by(r) for r in rs)) for n, rs in rules.items()}
        self.attached: dict[str, str] = {}
        self.shared: set[str] = set()
        self.scans = self.weighed()
        self.numbers = count()
        self._macro: dict[str, bool] = {}

    def weighed(self) -> set[str]:
        """Predicates that others name twice or more and whose plan, written out, reads more than ``MOST_SCANS`` tables: they
        are written down once, or a diamond of n levels would be a plan of 2**n scans."""
        named = {n: [x.name for r in rules for part in (r.body, *(f.expr for f in r.head.fields)) for x in walk(part) if isinstance(x, Atom | Call) and x.name in self.rules] for n, rules in self.rules.items()}
        users: dict[str, int] = {}
        for names in named.values():
            for x in names:
                users[x] = users.get(x, 0) + 1
        weight: dict[str, int] = {}
        out = set()

        def visit(start: str) -> None:
            todo = [(start, iter(named[start]))]
            weight[start] = 1  # also what a recursive use counts
            while todo:
                name, rest = todo[-1]
                x = next(rest, None)
                if x is not None:
                    if x not in weight:
                        weight[x] = 1
                        todo.append((x, iter(named[x])))
                    continue
                todo.pop()
                own = sum(weight[c] for c in named[name]) or 1
                if own > MOST_SCANS and users.get(name, 0) > 1:
                    out.add(name)
                    own = 1
                weight[name] = own

        for n in self.rules:
            if n not in weight:
                visit(n)
        return out

    # -- names

    @property
    def spark_functions(self) -> set[str]:
        if not _FUNCTIONS:
            _FUNCTIONS.update(r[0] for r in self.spark.sql("SHOW SYSTEM FUNCTIONS").collect())  # a few hundred names
        return _FUNCTIONS

    def fresh(self, hint: str = "") -> str:
        return f"_{next(self.numbers)}_{hint}" if hint else f"_{next(self.numbers)}"

    def is_relation(self, name: str) -> bool:
        if name in self.rules or name in self.tables or name in SPECIAL or name == "nil" or name in self.overrides:
            return True
        if name in aggregates.AGGREGATES or name in windows.WINDOWS or name in ("SqlExpr", "ReadFile", "ReadJson") or scalar.known_name(name, self.spark_functions):
            return False
        return True

    # -- relations

    def relation(self, name: str) -> DataFrame:
        """A predicate's rows."""
        if name in self.overrides:
            own = self.overrides[name]
            return own if own is not None else self.empty(name)
        if name in self.memo:
            return self.memo[name]
        if name in self.tables:
            table = self.tables[name]
            out = table if isinstance(table, DataFrame) else self.spark.table(table)
        elif name == "nil":
            out = self.spark.range(0).select(F.lit("yes").alias("atom"))
        elif name == "Today" and name not in self.rules:
            out = self.spark.range(1).select(F.current_date().cast("string").alias("date"))
        elif name == "Now" and name not in self.rules:
            out = self.spark.range(1).select(F.current_timestamp().alias("timestamp"))
        elif name in self.rules:
            loop = self.loop_of(name)
            if loop:
                from .recursion import solved

                for n, df in solved(self, loop).items():
                    self.memo[n] = self.finished(n, df)
                return self.memo[name]
            out = self.finished(name, self.evaluated(name))
        else:
            out = self.external(name)
        self.memo[name] = out
        return out

    def external(self, name: str) -> DataFrame:
        if name.startswith("("):
            if not self.unsafe:
                raise PlanError("SQL in backticks needs unsafe=True")
            return self.spark.sql(name[1:-1])
        database, _, table = name.partition(".")
        if table and database in self.attached:
            return load.attached(self.spark, self.attached[database], table)
        try:
            return self.spark.table(name)
        except Exception as e:
            if "NOT_FOUND" in str(e):
                raise PlanError(f"there is no predicate or table {name}") from e
            raise

    def finished(self, name: str, df: DataFrame) -> DataFrame:
        """With its limit, which counts for dependents too, and materialised if grounded."""
        if name in self.limit:
            df = (sorted_by(df, self.order[name]) if name in self.order else df).limit(self.limit[name])
        if name in self.ground:
            how = self.ground[name]
            if table := how.get("table"):
                df.write.mode("overwrite" if how.get("overwrite", True) else "errorifexists").saveAsTable(table)
                df = self.spark.table(table)
            else:
                df = cut(df)
            if path := how.get("copy_to_file"):
                load.write(df, path, "array" if path.endswith(".json") else "jsonl")  # one JSON array, or lines that many tasks write
        elif (name in self.scans or name in self.shared) and not df.isStreaming:
            df = cut(df)
        return df

    def loop_of(self, name: str) -> set[str]:
        """The predicates that depend on ``name`` and it on them; empty if it does not depend on itself."""
        reach = set().union(*(closure(n, self.uses) for n in self.uses.get(name, ()))) if name in self.uses else set()
        if name not in reach:
            return set()
        return {n for n in reach if n in self.uses and name in closure(n, self.uses)}

    def columns(self, name: str) -> list[str]:
        if name in self.rules:
            head = self.rules[name][0].head
            if not head.rest:
                return [f.name for f in head.fields] or ["atom"]
        return self.relation(name).columns

    def empty(self, name: str) -> DataFrame:
        return self.spark.range(0).select(*[F.lit(None).alias(c) for c in self.columns(name)])

    def evaluated(self, name: str) -> DataFrame:
        """The union of a predicate's rules, aggregated if they say so."""
        rules = self.rules[name]
        if len({r.head.distinct for r in rules}) > 1:
            raise PlanError(f"some rules of {name} are distinct, others not")
        first = rules[0].head
        if all(r.body is None and not r.head.rest and all(_constant(f.expr) for f in r.head.fields) for r in rules) and first.fields:
            frames = [self.facts(rules)]
        else:
            frames = [f for r in rules if (f := self.projected(r)) is not None]
        if not frames:
            return self.empty(name)
        df = union_all(frames)
        if not first.distinct:
            return df
        ops = {f.name: f.op for f in first.fields if f.op}
        for r in rules[1:]:
            if {f.name: f.op for f in r.head.fields if f.op} != ops:
                raise PlanError(f"rules of {name} aggregate differently")
        if not ops:
            return df.distinct()
        keys = [c for c in df.columns if c not in ops]
        bounded = [c for c, op in ops.items() if self.is_bounded(op)]
        others = {c: op for c, op in ops.items() if c not in bounded}
        out = self.grouped(df, keys, others) if others else None
        for c in bounded:  # each by itself, so that no group is gathered whole
            one = self.grouped(self.best_rows(df.select(*map(quoted, [*keys, c])), keys, c, ops[c]), keys, {c: ops[c]})
            if out is None:
                out = one
            elif keys:
                names = {k: self.fresh(k) for k in keys}
                one = one.select(*[quoted(k).alias(n) for k, n in names.items()], quoted(c))
                out = out.join(one, all_of([quoted(k).eqNullSafe(F.col(n)) for k, n in names.items()])).drop(*names.values())
            else:
                out = attach_row(out, one)
        return out.select(*map(quoted, df.columns))

    def grouped(self, df: DataFrame, keys: list[str], ops: dict[str, str]) -> DataFrame:
        made = [self.aggregated(op, quoted(c), df).alias(c) for c, op in ops.items()]
        return df.groupBy(*map(quoted, keys)).agg(*made) if keys else df.agg(*made)

    def is_bounded(self, op: str) -> bool:
        """Whether an aggregate asks for a fixed number of a group's best items."""
        name, extra = self.built_in(op)
        return name in ("ArgMaxK", "ArgMinK") and len(extra) == 1 and isinstance(extra[0], Lit)

    def best_rows(self, df: DataFrame, keys: list[str], column: str, op: str) -> DataFrame:
        """The rows of a group's k best items; Spark drops the others before it shuffles."""
        name, extra = self.built_in(op)
        score = quoted(column)["value"]
        order = score.desc_nulls_last() if name == "ArgMaxK" else score.asc_nulls_last()
        if not keys:
            return df.orderBy(order).limit(int(extra[0].value))
        place = self.fresh("place")
        return df.withColumn(place, F.row_number().over(Window.partitionBy(*map(quoted, keys)).orderBy(order))).filter(F.col(place) <= int(extra[0].value)).drop(place)

    def built_in(self, op: str, depth: int = 0) -> tuple[str | None, list[Node]]:
        """The built-in aggregate behind a name, through functions ``Own(x) = BuiltIn(x, ...)``, and its further arguments."""
        if op in self.rules and depth < 20:
            rule = self.rules[op][0]
            fields = {f.name: f.expr for f in rule.head.fields}
            body, parameter = fields.get(VALUE), fields.get("col0")
            if len(self.rules[op]) == 1 and rule.body is None and isinstance(body, Call) and isinstance(parameter, Var) and body.values and body.values[0] == parameter:
                name, extra = self.built_in(body.name, depth + 1)
                return name, body.values[1:] or extra
        return aggregates.named(op), []

    def facts(self, rules: list[Rule]) -> DataFrame:
        """Constant rows as one local relation."""
        names = [f.name for f in rules[0].head.fields]
        for r in rules:
            if len(r.head.fields) != len(names):
                raise PlanError(f"facts of {r.head.name} have different numbers of columns")
        rows = []
        for r in rules:
            by = {f.name: f.expr for f in r.head.fields}
            own = [by[n] for n in names] if set(by) == set(names) else [f.expr for f in r.head.fields]
            rows.append(own)
        text = [len({isinstance(r[i].value, str) for r in rows if isinstance(r[i], Lit) and r[i].value is not None}) > 1 for i in range(len(names))]
        values = [[self.value(x, Frame()).cast("string") if t else self.value(x, Frame()) for x, t in zip(r, text, strict=True)] for r in rows]
        rows = [F.struct(*[v.alias(n) for n, v in zip(names, r, strict=True)]) for r in values]
        if len(rows) == 1:
            one = rules[0].head.fields
            return self.spark.range(1).select(*[self.value(f.expr, Frame()).alias(f.name) for f in one])
        return self.spark.range(1).select(F.inline(F.array(*rows)))

    def projected(self, rule: Rule) -> DataFrame | None:
        """A rule's head columns (aggregates as what they aggregate) over its body; None if it can hold nothing."""
        head, parts = self.prepared(rule)
        if any(isinstance(p, Atom) and p.name == "nil" for p in parts):
            return None
        frame, left = self.planned(parts, Frame(), variables(head) | set().union(*map(_outside, parts)) if parts else variables(head))
        if left:
            raise PlanError(f"no way to bind the variables of: {rule.text}")
        if frame.df is None:
            frame.df = self.spark.range(1)
        columns = []
        for f in head.fields:
            missing = variables(f.expr) - frame.bound.keys()
            if missing:
                raise PlanError(f"{', '.join(sorted(missing))} not bound in: {rule.text}")
            columns.append(self.value(f.expr, frame).alias(f.name))
        if head.rest:
            if head.rest not in frame.rest:
                raise PlanError(f"..{head.rest} is not bound in: {rule.text}")
            columns += [F.col(c).alias(n) for n, c in frame.rest[head.rest]]
        return frame.df.select(*columns) if columns else frame.df.select(F.lit("yes").alias("atom"))

    # -- preparing

    def prepared(self, rule: Rule) -> tuple[Head, list[Node]]:
        """The rule with macros inlined, functional calls and combines as conjuncts, and atoms over variables alone."""
        parts: list[Node] = []
        head_fields = []
        for f in rule.head.fields:
            head_fields.append(replace(f, expr=self.lifted(f.expr, parts)))
        for p in conjuncts(rule.body):
            self.prepare(p, parts)
        return replace(rule.head, fields=tuple(head_fields)), parts

    def prepare(self, p: Node, out: list[Node], depth: int = 0) -> None:
        if depth > 200:
            raise PlanError("functions call each other without end")
        if isinstance(p, And):
            for x in p.parts:
                self.prepare(x, out, depth)
        elif isinstance(p, Atom):
            if not self.is_relation(p.name):
                return self.prepare(Test(Call(p.name, p.args)), out, depth)
            if self.is_macro(p.name):
                return self.inline(p, out, depth)
            args, seen = [], set()
            for name, expr in p.args:
                if isinstance(expr, Var) and expr.name == "_":
                    continue
                if isinstance(expr, Lit) and expr.value is not None:
                    args.append((name, expr))
                elif isinstance(expr, Var) and expr.name not in seen:
                    seen.add(expr.name)
                    args.append((name, expr))
                else:
                    own = Var(self.fresh("arg"))
                    args.append((name, own))
                    self.prepare(Unify(own, expr), out, depth)
            out.append(Atom(p.name, tuple(args), p.rest))
        elif isinstance(p, Unify):
            if isinstance(p.left, RecordExpr) and isinstance(p.right, RecordExpr) and {k for k, _ in p.left.items} == {k for k, _ in p.right.items}:
                right = dict(p.right.items)
                for k, v in p.left.items:
                    self.prepare(Unify(v, right[k]), out, depth)
            elif isinstance(p.left, Combine) and isinstance(p.right, Var):
                self.prepare(Unify(p.right, p.left), out, depth)
            elif isinstance(p.left, Var) and isinstance(p.right, Combine):
                out.append(p)
            else:
                out.append(Unify(self.lifted(p.left, out, depth), self.lifted(p.right, out, depth)))
        elif isinstance(p, Member):
            out.append(Member(self.lifted(p.item, out, depth), self.lifted(p.items, out, depth)))
        elif isinstance(p, Test):
            if isinstance(p.expr, Call) and p.expr.name == "~":
                return  # a type, which nothing checks
            out.append(Test(self.lifted(p.expr, out, depth)))
        elif isinstance(p, Not):
            if isinstance(p.body, Or):
                for x in p.body.parts:
                    self.prepare(Not(x), out, depth)
            else:
                out.append(p)
        elif isinstance(p, Or):
            raise PlanError("'|' can't stand here")
        else:
            raise PlanError(f"{type(p).__name__} is no proposition")

    def lifted(self, expr: Node, out: list[Node], depth: int = 0) -> Node:
        """The expression with functional predicates and combines replaced by variables that ``out`` binds."""
        if depth > 200:
            raise PlanError("functions call each other without end")

        def change(node: Node) -> Node | None:
            if isinstance(node, Combine):
                own = Var(self.fresh("combine"))
                out.append(Unify(own, node))
                return own
            if isinstance(node, Call) and node.name in self.rules and VALUE in self.columns_known(node.name):
                own = Var(self.fresh("value"))
                args = tuple((k, self.lifted(v, out, depth + 1)) for k, v in node.args)
                self.prepare(Atom(node.name, (*args, (VALUE, own))), out, depth + 1)
                return own
            return None

        return mapped(expr, change)

    def columns_known(self, name: str) -> set[str]:
        return {f.name for f in self.rules[name][0].head.fields}

    def is_macro(self, name: str) -> bool:
        """One plain rule that cannot stand alone, as its parameters come from its caller."""
        if name not in self.rules or name in self.overrides or name in self.tables:
            return False
        if name not in self._macro:
            self._macro[name] = False  # a recursive predicate is none
            rules = self.rules[name]
            head = rules[0].head
            plain = len(rules) == 1 and not head.distinct and not head.rest and not any(f.op for f in head.fields)
            if plain and not self.loop_of(name):
                self._macro[name] = rules[0].body is None and any(f.name == VALUE for f in head.fields) or not self.stands_alone(rules[0])
        return self._macro[name]

    def stands_alone(self, rule: Rule) -> bool:
        head, parts = self.prepared(rule)
        bound: set[str] = set()
        todo = [p for p in parts if not isinstance(p, Not)]
        moved = True
        while moved:
            moved = False
            for p in list(todo):
                if isinstance(p, Atom):
                    bound |= variables(p)
                elif isinstance(p, Unify) and isinstance(p.right, Combine):
                    bound |= variables(p.left)
                elif isinstance(p, Unify):
                    left, right = variables(p.left), variables(p.right)
                    if not (left <= bound or right <= bound):
                        continue
                    bound |= left | right
                elif isinstance(p, Member):
                    if not variables(p.items) <= bound:
                        continue
                    bound |= variables(p.item)
                elif not variables(p) <= bound:
                    continue
                todo.remove(p)
                moved = True
        return not todo and {v for f in head.fields for v in variables(f.expr)} <= bound

    def inline(self, atom: Atom, out: list[Node], depth: int) -> None:
        rule = self.rules[atom.name][0]
        names = {v: self.fresh(v) for f in rule.head.fields for v in variables(f.expr)} | {v: self.fresh(v) for v in variables(rule.body)}

        def change(node: Node) -> Node | None:
            return Var(names[node.name]) if isinstance(node, Var) and node.name in names and node.name != "_" else None

        fields = {f.name: f.expr for f in rule.head.fields}
        for name, value in atom.args:
            if name not in fields:
                raise PlanError(f"{atom.name} has no field {name}")
            if isinstance(value, Var) and value.name == "_":
                continue
            self.prepare(Unify(mapped(fields[name], change), value), out, depth + 1)
        for p in conjuncts(rule.body):
            self.prepare(mapped(p, change), out, depth + 1)

    # -- bodies

    def planned(self, parts: list[Node], frame: Frame, scope: set[str], partial: bool = False) -> tuple[Frame, list[Node]]:
        """Plan conjuncts onto a frame.  What cannot be bound comes back; ``scope`` holds the variables that combines and
        negations may share with what is around them."""
        frame = frame.copy()
        todo = list(parts)
        while todo:
            done = next((p for p in todo if self.simple(p, frame)), None)
            if done is None:
                done = self.next_atom(todo, frame)
            if done is None:
                done = next((p for p in todo if isinstance(p, Member) and self.unnest(p, frame)), None)
            if done is None:
                done = next((p for p in todo if isinstance(p, Unify) and isinstance(p.right, Combine) and self.combine(p, frame, scope)), None)
            if done is None:
                done = next((p for p in todo if isinstance(p, Not) and variables(p) & scope <= frame.bound.keys() and self.negate(p, frame)), None)
            if done is None:
                break
            todo.remove(done)
        return frame, todo

    def simple(self, p: Node, frame: Frame) -> bool:
        """Filters, bindings, and members of constant lists without repeats."""
        if isinstance(p, Test) and variables(p) <= frame.bound.keys():
            self.filter(frame, self.value(p.expr, frame))
            return True
        if isinstance(p, Member) and isinstance(p.items, ListExpr) and variables(p) <= frame.bound.keys() and frame.df is not None:
            values = [x.value for x in p.items.items if isinstance(x, Lit)]
            if len(values) == len(p.items.items) == len({(type(v), v) for v in values}) and None not in values:
                self.filter(frame, self.value(p.item, frame).isin(values))
                return True
        if not isinstance(p, Unify) or isinstance(p.right, Combine):
            return False
        left, right = variables(p.left) <= frame.bound.keys(), variables(p.right) <= frame.bound.keys()
        if left and right:
            self.filter(frame, self.condition(p, frame))
            return True
        for known, a, b in ((right, p.left, p.right), (left, p.right, p.left)):
            if known and isinstance(a, Var):
                self.bind(frame, a.name, self.value(b, frame))
                return True
            if known and isinstance(a, RecordExpr):
                own = Var(self.fresh("record"))
                self.bind(frame, own.name, self.value(b, frame))
                for k, v in a.items:
                    if not self.simple(Unify(v, FieldOf(own, k)), frame):
                        return False
                return True
        return False

    def filter(self, frame: Frame, condition: Column) -> None:
        frame.df = (self.spark.range(1) if frame.df is None else frame.df).filter(condition)

    def bind(self, frame: Frame, name: str, value: Column) -> None:
        own = self.fresh(name)
        frame.df = (self.spark.range(1) if frame.df is None else frame.df).withColumn(own, value)
        frame.bound[name] = own

    def next_atom(self, todo: list[Node], frame: Frame) -> Atom | None:
        atoms = [p for p in todo if isinstance(p, Atom)]
        if not atoms:
            return None
        one = next((a for a in atoms if variables(a) & frame.bound.keys()), None)
        if one is None and frame.bound:  # rather one that a condition ties to what is there than the next in the text
            tied = [p for p in todo if isinstance(p, Test | Unify) and variables(p) & frame.bound.keys()]
            one = next((a for a in atoms if any(variables(p) <= frame.bound.keys() | variables(a) for p in tied)), None)
        if one is None and frame.bound and any(isinstance(p, Member) and variables(p.items) <= frame.bound.keys() and variables(p.item) & set().union(*map(variables, atoms)) for p in todo):
            return None
        self.join(one or atoms[0], frame)
        return one or atoms[0]

    def source(self, atom: Atom) -> tuple[DataFrame, dict[str, str], list[tuple[str, str]]]:
        """The atom's rows with one column for each of its variables, and the columns of its rest."""
        df = self.relation(atom.name)
        have = df.columns
        conditions, select, bound = [], [], {}
        for name, expr in atom.args:
            if name not in have:
                raise PlanError(f"{atom.name} has no column {name}; it has {', '.join(have)}")
            if isinstance(expr, Lit):
                conditions.append(quoted(name) == F.lit(expr.value))
            else:
                own = self.fresh(expr.name)
                bound[expr.name] = own
                select.append(quoted(name).alias(own))
        rest = []
        if atom.rest:
            named = {n for n, _ in atom.args}
            for c in have:
                if c not in named:
                    own = self.fresh(c)
                    rest.append((c, own))
                    select.append(quoted(c).alias(own))
        if conditions:
            df = df.filter(all_of(conditions))
        return df.select(*select), bound, rest

    def join(self, atom: Atom, frame: Frame) -> None:
        df, own, rest = self.source(atom)
        if frame.df is None:
            frame.df = df
        else:
            shared = [v for v in own if v in frame.bound]
            if shared:
                frame.df = frame.df.join(df, all_of([F.col(frame.bound[v]) == F.col(own[v]) for v in shared]), "inner")
            else:
                frame.df = frame.df.crossJoin(df)
        frame.bound = own | frame.bound
        if atom.rest:
            frame.rest[atom.rest] = rest

    def unnest(self, p: Member, frame: Frame) -> bool:
        if not variables(p.items) <= frame.bound.keys():
            return False
        own = self.fresh("item")
        df = self.spark.range(1) if frame.df is None else frame.df
        frame.df = df.select("*", F.explode(self.value(p.items, frame)).alias(own))
        if isinstance(p.item, Var) and p.item.name not in frame.bound:
            frame.bound[p.item.name] = own
            return True
        item = Var(self.fresh("item"))
        frame.bound[item.name] = own
        return self.simple(Unify(p.item, item), frame)

    def negate(self, p: Not, frame: Frame) -> bool:
        parts: list[Node] = []
        keep = False
        body = p.body
        while isinstance(body, Not):
            keep, body = not keep, body.body
        self.prepare(body, parts)
        if frame.df is None:
            frame.df = self.spark.range(1)
        if all(isinstance(x, Test | Unify) and not isinstance(getattr(x, "right", None), Combine) for x in parts) and all(variables(x) <= frame.bound.keys() for x in parts):
            held = F.coalesce(all_of([self.condition(x, frame) for x in parts]), F.lit(False))
            frame.df = frame.df.filter(held if keep else ~held)
            return True
        inner, left = self.planned(parts, Frame(), set())
        shared = [v for v in inner.bound if v in frame.bound and v in variables(body)]
        both = Frame(None, frame.bound | {v: c for v, c in inner.bound.items() if v not in frame.bound})
        if inner.df is not None and all(isinstance(x, Test | Unify) and not isinstance(getattr(x, "right", None), Combine) and variables(x) <= both.bound.keys() for x in left):
            conditions = [F.col(frame.bound[v]) == F.col(inner.bound[v]) for v in shared] + [self.condition(x, both) for x in left]
            frame.df = anti_join(frame.df, inner.df, conditions, keep)
            return True
        keys = [v for v in frame.bound if v in variables(body)]
        names = {v: self.fresh(v) for v in keys}
        outer = frame.df.select(*[F.col(frame.bound[v]).alias(names[v]) for v in keys]).distinct()
        inner, left = self.planned(parts, Frame(outer, dict(names)), set(keys))
        if left:
            return False
        found = inner.df.select(*names.values()).distinct()
        frame.df = frame.df.join(found, all_of([F.col(frame.bound[v]).eqNullSafe(F.col(names[v])) for v in keys]), "left_semi" if keep else "left_anti")
        return True

    def condition(self, p: Node, frame: Frame) -> Column:
        if isinstance(p, Test):
            return self.value(p.expr, frame)
        a, b = self.comparable([p.left, p.right], [self.value(p.left, frame), self.value(p.right, frame)], frame)
        return a == b

    def combine(self, p: Unify, frame: Frame, scope: set[str]) -> bool:
        target, node = p.left.name, p.right
        inside = variables(node.body) | variables(node.expr)
        shared = [v for v in sorted(inside & scope) if v != target]
        if not set(shared) <= frame.bound.keys():
            return False
        parts: list[Node] = []
        expr = self.lifted(node.expr, parts)
        self.prepare(node.body, parts) if node.body is not None else None
        inner, left = self.planned(parts, Frame(), set())
        own = self.fresh(target)
        if node.body is not None and not left and inner.df is not None and set(shared) <= inner.bound.keys() and variables(expr) <= inner.bound.keys():
            pre = inner.df.select(*[F.col(inner.bound[v]) for v in shared], self.value(expr, inner).alias("__in"))
            made = self.aggregated(node.op, F.col("__in"), pre).alias(own)
            if not shared:
                row = pre.agg(made)
                frame.df = row if frame.df is None else attach_row(frame.df, row)
            else:
                groups = pre.groupBy(*[inner.bound[v] for v in shared]).agg(made)
                frame.df = frame.df.join(groups, all_of([F.col(frame.bound[v]) == F.col(inner.bound[v]) for v in shared]), "left")
        else:
            names = {v: self.fresh(v) for v in shared}
            if shared:
                outer = frame.df.select(*[F.col(frame.bound[v]).alias(names[v]) for v in shared]).distinct()
            else:
                outer = self.spark.range(1)
            inner, left = self.planned(parts, Frame(outer, dict(names)), set(shared))
            if left or not variables(expr) <= inner.bound.keys():
                return False
            pre = inner.df.select(*names.values(), self.value(expr, inner).alias("__in"))
            made = self.aggregated(node.op, F.col("__in"), pre).alias(own)
            if shared:
                groups = pre.groupBy(*names.values()).agg(made)
                frame.df = frame.df.join(groups, all_of([F.col(frame.bound[v]).eqNullSafe(F.col(names[v])) for v in shared]), "left")
            else:
                row = pre.agg(made)
                frame.df = row if frame.df is None else attach_row(frame.df, row)
        if target in frame.bound:
            self.filter(frame, F.col(frame.bound[target]) == F.col(own))
        else:
            frame.bound[target] = own
        return True

    # -- expressions

    def aggregated(self, op: str, value: Column, df: DataFrame) -> Column:
        """The aggregate of a column of ``df``."""
        name, extra = self.built_in(op)
        if name is None:
            raise PlanError(f"there is no aggregate {op}")
        pair = df.select(value).schema[0].dataType if name == "ArgMax" else None
        kind = pair["value"].dataType if isinstance(pair, T.StructType) and "value" in pair.names else None
        return aggregates.call(name, [value, *[self.value(x, Frame()) for x in extra]], kind)

    def value(self, node: Node, frame: Frame) -> Column:
        """The column of an expression whose variables are bound."""
        if isinstance(node, Lit):
            return F.lit(node.value)
        if isinstance(node, Var):
            if node.name not in frame.bound:
                raise PlanError(f"{node.name} is not bound")
            return F.col(frame.bound[node.name])
        if isinstance(node, ListExpr):
            return F.array(*[self.value(x, frame) for x in node.items])
        if isinstance(node, RecordExpr):
            return F.struct(*[self.value(x, frame).alias(k) for k, x in node.items])
        if isinstance(node, FieldOf):
            if isinstance(node.base, RecordExpr) and node.name in dict(node.base.items):
                return self.value(dict(node.base.items)[node.name], frame)
            return self.value(node.base, frame).getField(node.name)
        if isinstance(node, IfExpr):
            out = None
            for condition, x in node.branches:
                pair = (self.value(condition, frame), self.value(x, frame))
                out = F.when(*pair) if out is None else out.when(*pair)
            return out.otherwise(self.value(node.other, frame))
        if isinstance(node, Call):
            return self.called(node, frame)
        if isinstance(node, PredRef):
            raise PlanError(f"{node.name} can't stand as a value")
        raise PlanError(f"{type(node).__name__} can't stand as a value")

    def called(self, node: Call, frame: Frame) -> Column:
        name, args = node.name, node.values
        if name in windows.WINDOWS:
            lists = [x.items if isinstance(x, ListExpr) else (x,) for x in args[1:3]]
            if len(lists) < 2:
                raise PlanError(f"{name} takes a value, a partition list and an order list")
            n = args[3].value if len(args) > 3 and isinstance(args[3], Lit) else None
            return windows.call(name, self.value(args[0], frame), *[[self.value(x, frame) for x in own] for own in lists], n)
        if name == "SqlExpr":
            if not self.unsafe:
                raise PlanError("SqlExpr needs unsafe=True")
            names = {k: f"`{self.fresh(k)}`" for k, _ in args[1].items}
            text = re.sub(r"\{(\w+)\}", lambda m: f"({self._sql(dict(args[1].items)[m[1]], frame)})", args[0].value)
            del names
            return F.expr(text)
        if name in scalar.LITERAL:
            at, function = scalar.LITERAL[name]
            if len(args) <= at or not isinstance(args[at], Lit):
                raise PlanError(f"{name} takes a literal as argument {at + 1}")
            try:
                return function(args[at].value, *[self.value(x, frame) for i, x in enumerate(args) if i != at])
            except TypeError as e:
                raise PlanError(f"{name} can't take {len(args)} arguments") from e
        if name in ("is", "is not") and isinstance(args[1], Lit) and args[1].value is None:
            own = self.value(args[0], frame)
            return own.isNull() if name == "is" else own.isNotNull()
        if name in ("ReadFile", "ReadJson"):
            if len(args) != 1 or not isinstance(args[0], Lit) or not isinstance(args[0].value, str):
                raise PlanError(f"{name} takes the path of one file as text; for many files use Program.load")
            return F.lit(load.file_text(self.spark, args[0].value))
        values = [self.value(x, frame) for x in args]
        if name in ("==", "!=", "=") and (len(args) == 2):
            values = self.comparable(args, values, frame)
        return scalar.call(name, values, lambda c: self.kind(c, frame), self.spark_functions)

    def comparable(self, args: list[Node], values: list[Column], frame: Frame) -> list[Column]:
        """A truth value beside a number counts as 0 or 1."""
        flags = [isinstance(a, Lit) and isinstance(a.value, bool) for a in args]
        numbers = [isinstance(a, Lit) and isinstance(a.value, int | float) and not isinstance(a.value, bool) for a in args]
        if any(flags) and any(numbers):
            return [v.cast("int") if f else v for v, f in zip(values, flags, strict=True)]
        return values

    def _sql(self, node: Node, frame: Frame) -> str:
        if isinstance(node, Var):
            return f"`{frame.bound[node.name]}`"
        if isinstance(node, Lit):
            return "NULL" if node.value is None else repr(node.value)
        raise PlanError("SqlExpr takes variables and literals")

    def kind(self, column: Column, frame: Frame) -> T.DataType:
        df = self.spark.range(1) if frame.df is None else frame.df
        return df.select(column).schema[0].dataType

    # -- results

    def result(self, name: str, limit: int | None = None, offset: int | None = None, pattern: str | None = None) -> DataFrame:
        df = self.relation(name)
        if pattern is not None:
            df = searched(df, pattern)
        if name in self.order:
            df = sorted_by(df, self.order[name])
        if limit is not None:
            df = df.offset(offset).limit(limit) if offset else df.limit(limit)
        elif offset:
            df = df.offset(offset)
        return df.withColumnRenamed(VALUE, "value") if VALUE in df.columns else df


def _constant(node: Node) -> bool:
    return all(isinstance(n, Lit | ListExpr | RecordExpr) for n in walk(node))


def _outside(p: Node) -> set[str]:
    """The variables of a conjunct that count as the rule's own: not those inside a combine or a negation only."""
    if isinstance(p, Unify) and isinstance(p.right, Combine):
        return variables(p.left)
    return set() if isinstance(p, Not) else variables(p)


