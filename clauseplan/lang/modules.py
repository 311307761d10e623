"""Imports: files of rules under import roots, their predicates renamed so that they can't clash."""

from __future__ import annotations

from dataclasses import replace
from pathlib import Path

from ..errors import ParseError
from .parser import parse
from .tree import Atom, Call, Combine, Directive, Head, Import, Make, Node, PredRef, Rule, mapped, walk


def defined(statements: list[Node]) -> set[str]:
    return {s.head.name for s in statements if isinstance(s, Rule)} | {s.new for s in statements if isinstance(s, Make)}


def renamed(statements: list[Node], names: dict[str, str]) -> list[Node]:
    """Every use of the named predicates, as definition, atom, call, aggregate or value, under its new name."""
    if not names:
        return statements

    def change(node: Node) -> Node | None:
        own = getattr(node, "name", None)
        if isinstance(node, Atom | Call | Head | PredRef) and own in names:
            inner = {f: mapped(getattr(node, f), change) for f in ("args", "fields") if hasattr(node, f)}
            return replace(node, name=names[own], **inner)
        if isinstance(node, Combine) and node.op in names:
            return Combine(names[node.op], mapped(node.expr, change), mapped(node.body, change))
        return None

    out = []
    for s in statements:
        s = mapped(s, change)
        if isinstance(s, Make):
            args = tuple((names.get(k, k), v) for k, v in s.args)
            s = Make(names.get(s.new, s.new), names.get(s.old, s.old), args)
        elif isinstance(s, Rule):
            s = replace(s, head=replace(s.head, fields=tuple(replace(f, op=names.get(f.op, f.op)) for f in s.head.fields)))
        out.append(s)
    return out


def loaded(source: str, roots: list[str | Path] = ()) -> list[Node]:
    """The statements of a program with all it imports."""
    return _resolved(parse(source), [Path(r) for r in roots or ["."]], {}, ())


def _resolved(statements: list[Node], roots: list[Path], done: dict, trail: tuple) -> list[Node]:
    own = defined(statements)
    out: list[Node] = []
    names: dict[str, str] = {}
    used = {n.name for s in statements if not isinstance(s, Import) for n in walk(s) if isinstance(n, Atom | Call | PredRef | Head)} | {n.op for s in statements for n in walk(s) if isinstance(n, Combine)}
    used |= {s.old for s in statements if isinstance(s, Make)} | {f.op for s in statements if isinstance(s, Rule) for f in s.head.fields if f.op}
    for s in statements:
        if not isinstance(s, Import):
            continue
        local = s.alias or s.name
        if s.path in trail:
            raise ParseError(f"circular import: {' -> '.join('.'.join(p) for p in (*trail, s.path))}")
        if local not in used:
            raise ParseError(f"import {'.'.join(s.path)}.{s.name} is not used")
        prefix = "_".join(p[:1].upper() + p[1:] for p in s.path) + "_"
        if s.path not in done:
            file = next((f for r in roots if (f := r.joinpath(*s.path).with_suffix(".l")).is_file()), None)
            if file is None:
                raise ParseError(f"no file for import {'.'.join(s.path)}")
            inner = parse(file.read_text())
            there = defined(inner)
            body = _resolved(inner, roots, done, (*trail, s.path))
            done[s.path] = there
            out += renamed([x for x in body if not (isinstance(x, Directive) and x.name == "Engine")], {n: prefix + n for n in there})
        if s.name not in done[s.path]:
            raise ParseError(f"{'.'.join(s.path)} does not define {s.name}")
        if local in own and s.alias:
            raise ParseError(f"{local} is imported and defined")
        names[local] = prefix + s.name
    return out + renamed([s for s in statements if not isinstance(s, Import)], names)
