"""The syntax tree: frozen dataclasses, so that rewriting always makes new nodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, is_dataclass, replace
from typing import Any

#: The column of a functional predicate's value, inside plans; results call it ``value``.
VALUE = "__value"


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Lit(Node):
    value: Any


@dataclass(frozen=True)
class Var(Node):
    name: str


@dataclass(frozen=True)
class PredRef(Node):
    """A predicate's name as a value, in directives and parameter lists."""

    name: str


@dataclass(frozen=True)
class ListExpr(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class RecordExpr(Node):
    items: tuple[tuple[str, Node], ...]


@dataclass(frozen=True)
class FieldOf(Node):
    base: Node
    name: str


@dataclass(frozen=True)
class IfExpr(Node):
    branches: tuple[tuple[Node, Node], ...]
    other: Node


@dataclass(frozen=True)
class Call(Node):
    """An operator, a function or a functional predicate: ``args`` are (field, expression)."""

    name: str
    args: tuple[tuple[str, Node], ...]

    @property
    def values(self) -> list[Node]:
        return [v for _, v in self.args]


@dataclass(frozen=True)
class Combine(Node):
    """An aggregate of ``expr`` over ``body``, evaluated for each outer row."""

    op: str
    expr: Node
    body: Node | None


@dataclass(frozen=True)
class Atom(Node):
    """A predicate in a body.  ``rest`` is the variable of ``..rest``."""

    name: str
    args: tuple[tuple[str, Node], ...]
    rest: str | None = None


@dataclass(frozen=True)
class Unify(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Member(Node):
    item: Node
    items: Node


@dataclass(frozen=True)
class Test(Node):
    __test__ = False  # no test class, whatever pytest thinks
    expr: Node


@dataclass(frozen=True)
class Not(Node):
    body: Node


@dataclass(frozen=True)
class And(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Or(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class HeadField(Node):
    """A column of a head; ``op`` names its aggregate, if it has one."""

    name: str
    expr: Node
    op: str | None = None


@dataclass(frozen=True)
class Head(Node):
    name: str
    fields: tuple[HeadField, ...]
    rest: str | None = None
    distinct: bool = False


@dataclass(frozen=True)
class Rule(Node):
    head: Head
    body: Node | None
    text: str = ""
    line: int = 0


@dataclass(frozen=True)
class Directive(Node):
    name: str
    args: tuple[tuple[str, Node], ...]
    text: str = ""


@dataclass(frozen=True)
class Import(Node):
    path: tuple[str, ...]
    name: str
    alias: str | None


@dataclass(frozen=True)
class Make(Node):
    """``new := old(Parameter: Value)``."""

    new: str
    old: str
    args: tuple[tuple[str, Node], ...]


def children(node: Any) -> Iterator[Node]:
    if isinstance(node, Node):
        for f in fields(node):
            yield from _nested(getattr(node, f.name))


def _nested(value: Any) -> Iterator[Node]:
    if isinstance(value, Node):
        yield value
    elif isinstance(value, tuple):
        for v in value:
            yield from _nested(v)


def walk(node: Node | None) -> Iterator[Node]:
    if node is not None:
        yield node
        for c in children(node):
            yield from walk(c)


def mapped(node: Any, change: Callable[[Node], Node | None]) -> Any:
    """The tree with ``change`` applied from the top; where it returns None, the node's parts are changed instead."""
    if isinstance(node, tuple):
        return tuple(mapped(v, change) for v in node)
    if not is_dataclass(node):
        return node
    new = change(node)
    if new is not None:
        return new
    return replace(node, **{f.name: mapped(getattr(node, f.name), change) for f in fields(node)})


def variables(node: Node | None, inner: bool = True) -> set[str]:
    """The variables of a node; ``inner=False`` leaves out those inside combines and negations."""
    if node is None:
        return set()
    if isinstance(node, Var):
        return {node.name}
    if not inner and isinstance(node, Combine | Not):
        return set()
    out = {node.rest} if isinstance(node, Atom | Head) and node.rest else set()
    for c in children(node):
        out |= variables(c, inner)
    return out


def conjuncts(node: Node | None) -> list[Node]:
    if node is None:
        return []
    if isinstance(node, And):
        return [x for p in node.parts for x in conjuncts(p)]
    return [node]
