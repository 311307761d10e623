"""The public interface: parse, check, and run rule programs."""

from __future__ import annotations

from collections import defaultdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .errors import CheckError, ParseError, PlanError, RuleError
from .lang import kinds, modules, rewrite, verify
from .lang.parser import parse as parse_statements
from .lang.tree import Directive, Lit, Node, PredRef, Rule
from .plans.planner import Planner
from .sources import load


def parse(source: str) -> list[Node]:
    """The statements of a program, as written."""
    return parse_statements(source)


def resolved(source: str, roots: list[str | Path] = (), flags: dict[str, object] | None = None) -> list[Node]:
    """The statements with imports, flags, parameterised predicates and disjunctions worked in."""
    statements = modules.loaded(source, list(roots))
    rewrite.checked_directives(statements)
    rewrite.no_disjunction_inside(statements)
    statements = rewrite.with_flags(statements, rewrite.flag_values(statements, flags))
    return rewrite.split_rules(rewrite.with_makes(statements))


def check(source: str, roots: list[str | Path] = (), positional: bool = True) -> list[str]:
    """Every problem of a program, as text; an empty list for a sound one."""
    try:
        statements = resolved(source, roots)
    except RuleError as e:
        return [f"{type(e).__name__}: {e}"]
    found = verify.problems(statements, positional)
    if kinds.wanted(statements):
        found += kinds.Inference(statements).problems
    return [str(p) for p in found]


def types(source: str, roots: list[str | Path] = ()) -> dict[str, dict[str, str]]:
    """The kind of every column that a program defines, as far as the program alone tells."""
    return kinds.Inference(resolved(source, roots)).kinds()


def _target(d: Directive) -> str:
    if not d.args or not isinstance(d.args[0][1], PredRef):
        raise ParseError(f"@{d.name} takes a predicate first: {d.text}")
    return d.args[0][1].name


class Program:
    """A program and the tables it reads.

    ``tables`` maps predicate names to DataFrames or catalog names; other undefined predicates are catalog tables.
    ``strict``: check first, and refuse positional arguments too.  ``unsafe`` lets SQL text in.
    """

    def __init__(self, source: str, spark: SparkSession | None = None, tables: dict[str, DataFrame | str] | None = None, roots: list[str | Path] = (), flags: dict[str, object] | None = None, strict: bool = False, unsafe: bool = False):
        self.spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        self.statements = resolved(source, roots, flags)
        if strict and (found := verify.problems(self.statements)):
            raise CheckError(found)
        self.tables = dict(tables or {})
        if kinds.wanted(self.statements) and (found := self._inferred().problems):
            raise CheckError(found)
        self.unsafe = unsafe
        rules: dict[str, list[Rule]] = defaultdict(list)
        order: dict[str, list[str]] = {}
        limit: dict[str, int] = {}
        ground: dict[str, dict] = {}
        recursive: dict[str, dict] = {}
        attached: dict[str, str] = {}
        shared: set[str] = set()
        self.database = None
        for s in self.statements:
            if isinstance(s, Rule):
                rules[s.head.name].append(s)
            elif isinstance(s, Directive):
                values = [v for _, v in s.args]
                if s.name == "OrderBy":
                    order[_target(s)] = [v.value if isinstance(v, Lit) else getattr(v, "name", "") for v in values[1:]]
                elif s.name == "Limit":
                    limit[_target(s)] = int(values[1].value)
                elif s.name == "Ground":
                    how = {k: v.value if isinstance(v, Lit) else getattr(v, "name", None) for k, v in s.args[1:]}
                    if "col1" in how:
                        how["table"] = how.pop("col1")
                    ground[_target(s)] = how
                elif s.name == "Recursive":
                    named = {k: v for k, v in s.args[1:] if not k.startswith("col")}
                    depth = values[1].value if len(values) > 1 and isinstance(values[1], Lit) else 8
                    stop = named.get("stop") or (values[2] if len(values) > 2 else None)
                    recursive[_target(s)] = {"depth": int(depth), "stop": stop.name if isinstance(stop, PredRef) else None}
                elif s.name == "Dataset":
                    self.database = values[0].value
                elif s.name == "AttachDatabase":
                    if len(values) != 2 or not isinstance(values[1], Lit):
                        raise ParseError(f"@AttachDatabase takes a name and a path or JDBC address: {s.text}")
                    attached[values[0].name if isinstance(values[0], PredRef) else str(getattr(values[0], "value", getattr(values[0], "name", "")))] = values[1].value
                elif s.name == "With":
                    shared.add(_target(s))
        for name, how in ground.items():
            if how.get("table") in ground:  # another grounded predicate stands for its table
                how["table"] = ground[how["table"]].get("table") or how["table"].lower()
            if how.get("table") and self.database and "." not in how["table"]:
                how["table"] = f"{self.database}.{how['table']}"
        self.planner = Planner(self.spark, dict(rules), self.tables, order, limit, ground, recursive, unsafe)
        self.planner.attached, self.planner.shared = attached, shared

    @property
    def predicates(self) -> list[str]:
        """The defined predicates, in the order of their first rules."""
        return list(self.planner.rules)

    def _inferred(self) -> kinds.Inference:
        schemas = {n: {f["name"]: kinds.of_schema(f["type"]) for f in t.schema.jsonValue()["fields"]} for n, t in self.tables.items() if isinstance(t, DataFrame)}
        return kinds.Inference(self.statements, schemas)

    def types(self) -> dict[str, dict[str, str]]:
        """The kind of every column of the defined predicates, from the program and the tables given as DataFrames."""
        return self._inferred().kinds()

    def load(self, name: str, path: str, kind: str | None = None) -> Program:
        """Make a file the table ``name``."""
        self.tables[name] = self.planner.tables[name] = load.read(self.spark, path, kind)
        return self

    def run(self, predicate: str, limit: int | None = None, offset: int | None = None) -> DataFrame:
        """A predicate's rows, lazily; sorted if the program orders them."""
        self._defined(predicate)
        return self.planner.result(predicate, limit, offset)

    def search(self, predicate: str, pattern: str, limit: int | None = None, offset: int | None = None) -> DataFrame:
        """The rows of which some column's text matches a regular expression."""
        self._defined(predicate)
        return self.planner.result(predicate, limit, offset, pattern)

    def run_all(self) -> dict[str, DataFrame]:
        """Every predicate that can stand alone."""
        return {n: self.run(n) for n in self.predicates if not self.planner.is_macro(n)}

    def _defined(self, predicate: str) -> None:
        if not self.planner.is_relation(predicate):
            raise PlanError(f"there is no predicate {predicate}")
        if self.planner.is_macro(predicate):
            raise PlanError(f"{predicate} needs values from a caller, so it can't be run alone")


__all__ = ["CheckError", "ParseError", "PlanError", "Program", "RuleError", "check", "parse", "resolved", "types"]
