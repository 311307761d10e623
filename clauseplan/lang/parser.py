"""Program text to syntax tree."""

from __future__ import annotations

from ..errors import ParseError
from .lexer import NUMBER_WORDS, Token, tokens
from .tree import (
    VALUE, And, Atom, Call, Combine, Directive, FieldOf, Head, HeadField, IfExpr, Import, Lit, ListExpr, Make, Member, Node, Not, Or, PredRef, RecordExpr, Rule, Test, Unify, Var,
)

#: Binary operators from loosest to tightest, each a level of its own, all grouping to the left.
LEVELS = ("||", "&&", "->", "==", "<=", ">=", "<", ">", "!=", "=", "~", "in", "is not", "is", "++?", "++", "+", "-", "*", "/", "%", "^")
STRENGTH = {op: i + 1 for i, op in enumerate(LEVELS)}
TIGHTEST = len(LEVELS) + 1
AGGREGATE_SIGNS = {"+=": "+", "++=": "++", "*=": "*"}
KEYWORDS = {"combine", "if", "then", "else", "distinct", "order_by", "limit", "import", "as", "in", "is", "not", "true", "false", "null", "couldbe", "cantbe", "shouldbe"}
EXPRESSIONS = (Lit, Var, PredRef, ListExpr, RecordExpr, FieldOf, IfExpr, Call, Combine)


class Parser:
    def __init__(self, source: str):
        self.source, self.tokens, self.at = source, tokens(source), 0
        self.fresh = 0

    # -- tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def peek(self, ahead: int = 1) -> Token:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def fail(self, message: str) -> ParseError:
        shown = "the end" if self.now.kind == "end" else repr(self.source[self.now.start : self.now.end])
        return ParseError(f"{message}, found {shown}", self.now.line)

    def sign(self, *values: str) -> str | None:
        if self.now.kind == "sign" and self.now.value in values:
            self.at += 1
            return self.tokens[self.at - 1].value
        return None

    def word(self, *values: str) -> str | None:
        if self.now.kind == "name" and self.now.value in values:
            self.at += 1
            return self.tokens[self.at - 1].value
        return None

    def need(self, value: str) -> None:
        if not self.sign(value):
            raise self.fail(f"{value!r} is missing")

    def is_sign(self, *values: str) -> bool:
        return self.now.kind == "sign" and self.now.value in values

    def name(self) -> str:
        if self.now.kind not in ("name", "quoted"):
            raise self.fail("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1].value

    # -- statements

    def program(self) -> list[Node]:
        out: list[Node] = []
        while self.now.kind != "end":
            if self.sign(";"):
                continue
            start = self.now
            made = self.statement()
            text = self.source[start.start : self.tokens[self.at - 1].end]
            for node in made:
                if isinstance(node, Rule):
                    node = Rule(node.head, node.body, text, start.line)
                elif isinstance(node, Directive):
                    node = Directive(node.name, node.args, text)
                out.append(node)
            if self.now.kind != "end":
                self.need(";")
        return out

    def statement(self) -> list[Node]:
        if self.now.kind == "name" and self.now.value == "import" and self.peek().kind == "name":
            return [self.import_()]
        if self.is_sign("@") and self.peek().kind == "name":
            self.at += 1
            name = self.name()
            args, _ = self.arguments()
            return [self.make_(args) if name == "Make" else Directive(name, args)]
        if self.peek().kind == "sign" and self.peek().value == ":=":
            new = self.name()
            self.need(":=")
            old = self.dotted()
            args, _ = self.arguments()
            return [Make(new, old, args)]
        return self.rule()

    def import_(self) -> Import:
        self.at += 1
        path = [self.name()]
        while self.sign("."):
            path.append(self.name())
        if len(path) < 2:
            raise self.fail("an import names a file and a predicate")
        alias = self.name() if self.word("as") else None
        return Import(tuple(path[:-1]), path[-1], alias)

    def make_(self, args) -> Make:
        values = [v for _, v in args]
        if len(values) != 3 or not all(isinstance(v, PredRef) for v in values[:2]) or not isinstance(values[2], RecordExpr):
            raise self.fail("@Make takes a new predicate, a predicate and a record")
        return Make(values[0].name, values[1].name, values[2].items)

    def rule(self) -> list[Node]:
        head, arrow = self.head()
        extra: list[Node] = []
        while True:
            if self.word("order_by"):
                extra.append(Directive("OrderBy", (("col0", PredRef(head.name)), *self.denoted())))
            elif self.word("limit"):
                extra.append(Directive("Limit", (("col0", PredRef(head.name)), *self.denoted())))
            elif self.word("couldbe", "cantbe", "shouldbe"):
                if self.is_sign("("):
                    self.denoted()
                else:
                    self.expression()
            elif self.word("distinct"):
                head = Head(head.name, head.fields, head.rest, True)
            else:
                break
        body = self.proposition() if self.sign(":-") else None
        if any(f.op for f in head.fields) and not head.distinct:
            raise self.fail(f"{head.name} aggregates, so it needs 'distinct'")
        if arrow:
            extra.append(Directive("CompileAsUdf", (("col0", PredRef(head.name)),)))
        return [*extra, Rule(head, body)]

    def denoted(self) -> tuple:
        if self.is_sign("("):
            args, _ = self.arguments()
            return tuple((f"col{i + 1}", v) for i, (_, v) in enumerate(args))
        out = [self.expression()]
        while self.is_sign(",") and self.peek().kind in ("string", "name"):
            self.at += 1
            out.append(self.expression())
        return tuple((f"col{i + 1}", v) for i, v in enumerate(out))

    def head(self) -> tuple[Head, bool]:
        name = self.dotted()
        self.need("(")
        fields, rest, place = [], None, 0
        while not self.sign(")"):
            if self.sign(".."):
                rest = self.name()
                if not self.is_sign(")"):
                    raise self.fail("'..' comes last")
                continue
            field, op = None, None
            if self.now.kind in ("name", "quoted") and self.peek().kind == "sign" and self.peek().value in (":", "?"):
                quoted = self.now.kind == "quoted"
                field = self.name()
                if self.sign("?"):
                    op = self.aggregate_op()
                    expr = self.expression()
                else:
                    self.need(":")
                    expr = self.shorthand(field, quoted) if self.is_sign(",", ")") else self.expression()
            else:
                field, expr, place = f"col{place}", self.expression(), place + 1
            fields.append(HeadField(field, expr, op))
            if not self.is_sign(")"):
                self.need(",")
        arrow = False
        if self.is_sign("+=", "++=", "*=") or self.now.kind in ("name", "number") and self.peek().kind == "sign" and self.peek().value == "=" and self.now.value not in KEYWORDS:
            op = self.aggregate_op()
            return Head(name, (*fields, HeadField(VALUE, self.expression(), op)), rest, True), False
        if self.is_sign("=", "-->"):
            arrow = self.sign("=", "-->") == "-->"
            fields.append(HeadField(VALUE, self.expression()))
        return Head(name, tuple(fields), rest), arrow

    def shorthand(self, field: str, quoted: bool) -> Var:
        if quoted or field[:1].isupper():
            raise self.fail(f"{field} can't be a variable too; write '{field}: variable'")
        return Var(field)

    def aggregate_op(self) -> str:
        if op := self.sign("+=", "++=", "*="):
            return AGGREGATE_SIGNS[op]
        if self.now.kind == "number" and self.now.value == 1 or self.now.kind in ("name", "quoted"):
            op = str(self.now.value)
            self.at += 1
            self.need("=")
            return op
        raise self.fail("an aggregate such as '+=' or 'Max=' is missing")

    def dotted(self) -> str:
        out = self.name()
        while self.is_sign(".") and self.peek().kind in ("name", "quoted"):
            self.at += 1
            out += "." + self.name()
        return out

    def arguments(self) -> tuple[tuple, str | None]:
        """The arguments in parentheses as (field, expression), and the variable of ``..rest``."""
        self.need("(")
        args, rest, place = [], None, 0
        while not self.sign(")"):
            if self.sign(".."):
                rest = self.name()
                if not self.is_sign(")"):
                    raise self.fail("'..' comes last")
                continue
            if self.now.kind in ("name", "quoted") and self.peek().kind == "sign" and self.peek().value == ":":
                quoted = self.now.kind == "quoted"
                field = self.name()
                self.at += 1
                args.append((field, self.shorthand(field, quoted) if self.is_sign(",", ")") else self.expression()))
            else:
                args.append((f"col{place}", self.expression()))
                place += 1
            if not self.is_sign(")"):
                self.need(",")
        return tuple(args), rest

    # -- propositions

    def proposition(self) -> Node:
        left = self.disjunction()
        if sign := self.sign("=>", "<=>"):
            right = self.disjunction()
            forward = Not(And((left, Not(right))))
            return forward if sign == "=>" else And((forward, Not(And((right, Not(left))))))
        return left

    def disjunction(self) -> Node:
        parts = [self.conjunction()]
        while self.sign("|"):
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def conjunction(self) -> Node:
        parts = [self.single()]
        while self.sign(","):
            parts.append(self.single())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def single(self) -> Node:
        if self.sign("~"):
            return Not(self.single())
        if self.is_sign("("):
            start = self.at
            self.at += 1
            try:
                inner = self.proposition()
                self.need(")")
                if self.is_sign(",", "|", ")", ";", "=>", "<=>", "}") or self.now.kind == "end":
                    return inner
            except ParseError:
                pass
            self.at = start
        if self.now.kind == "name" and self.now.value not in KEYWORDS and self.combines():
            target = Var(self.name())
            op = self.aggregate_op()
            expr = self.expression()
            return Unify(target, Combine(op, expr, self.proposition() if self.sign(":-") else None))
        start = self.now
        expr = self.expression(atoms=True)
        if isinstance(expr, Call):
            v = expr.values
            if expr.name in ("==", "=") and len(v) == 2:
                return Unify(*map(_plain, v))
            if expr.name == "in" and len(v) == 2:
                return Member(*map(_plain, v))
        if isinstance(expr, Atom):
            if expr.name == "Constraint" and len(expr.args) == 1:
                return Test(_plain(expr.args[0][1]))
            return expr
        if isinstance(expr, PredRef):
            raise ParseError(f"{expr.name} needs arguments", start.line)
        return Test(expr)

    def combines(self) -> bool:
        after = self.peek()
        if after.kind == "sign" and after.value in AGGREGATE_SIGNS:
            return True
        return after.kind == "name" and after.value[:1].isupper() and self.peek(2).kind == "sign" and self.peek(2).value == "="

    # -- expressions

    def expression(self, least: int = 0, atoms: bool = False) -> Node:
        left = self.prefix(atoms)
        while op := self.operator():
            power = STRENGTH[op]
            if power <= least:
                break
            self.at += 2 if op == "is not" else 1
            right = self.expression(power)
            left = Call(op, (("left", _plain(left)), ("right", _plain(right))))
        return left if atoms else _plain(left)

    def operator(self) -> str | None:
        t = self.now
        if t.kind == "sign" and t.value in STRENGTH:
            return t.value
        if t.kind == "name" and t.value == "is":
            return "is not" if self.peek().kind == "name" and self.peek().value == "not" else "is"
        return "in" if t.kind == "name" and t.value == "in" else None

    def prefix(self, atoms: bool = False) -> Node:
        if self.sign("!"):
            return Call("!", (("col0", self.prefix()),))
        if self.is_sign("-"):
            if self.peek().kind == "number":
                self.at += 2
                return self.suffixes(Lit(-self.tokens[self.at - 1].value))
            self.at += 1
            return Call("neg", (("col0", self.expression(STRENGTH["-"])),))
        return self.suffixes(self.primary(atoms))

    def suffixes(self, node: Node) -> Node:
        while True:
            if self.is_sign(".") and self.peek().kind == "name":
                self.at += 1
                field = self.name()
                if field[:1].isupper():
                    raise self.fail(f"field {field} must be lower-case")
                node = FieldOf(_plain(node), field)
            elif self.sign("["):
                while True:
                    node = Call("Element", (("col0", _plain(node)), ("col1", self.expression())))
                    if not self.sign(","):
                        break
                self.need("]")
            else:
                return node

    def primary(self, atoms: bool) -> Node:
        t = self.now
        if t.kind in ("number", "string"):
            self.at += 1
            return Lit(t.value)
        if self.sign("("):
            inner = self.expression()
            if self.sign(":-"):
                raise self.fail("':-' belongs to 'combine'")
            self.need(")")
            return inner
        if self.sign("["):
            items = []
            while not self.sign("]"):
                items.append(self.expression())
                if not self.is_sign("]"):
                    self.need(",")
            return ListExpr(tuple(items))
        if self.sign("{"):
            return self.record()
        if t.kind == "quoted":
            self.at += 1
            if self.is_sign("("):
                args, rest = self.arguments()
                return Atom(t.value, args, rest)
            return PredRef(t.value)
        if t.kind != "name":
            raise self.fail("a value is missing")
        if t.value == "combine":
            self.at += 1
            op = self.aggregate_op()
            expr = self.expression()
            return Combine(op, expr, self.proposition() if self.sign(":-") else None)
        if t.value == "if":
            return self.conditional()
        if t.value in ("true", "false", "null"):
            self.at += 1
            return Lit({"true": True, "false": False, "null": None}[t.value])
        if t.value.lower() in NUMBER_WORDS and not (self.peek().kind == "sign" and self.peek().value in ("(", ":")):
            self.at += 1
            return Lit(NUMBER_WORDS[t.value.lower()])
        if t.value in KEYWORDS:
            raise self.fail("a value is missing")
        start = self.at
        name = self.dotted()
        if self.is_sign("("):
            args, rest = self.arguments()
            return Atom(name, args, rest)
        if self.is_sign("{") and name[:1].isupper():
            self.at += 1
            expr = self.expression()
            body = self.proposition() if self.sign(":-") else None
            self.need("}")
            return Combine(name, expr, body)
        if name[:1].isupper() or name == "nil":
            return PredRef(name)
        self.at = start + 1
        return Var(t.value)

    def record(self) -> Node:
        items = []
        while not self.sign("}"):
            if self.is_sign(".."):
                raise self.fail("'..' can't stand in a record")
            field = self.name()
            self.need(":")
            items.append((field, self.shorthand(field, False) if self.is_sign(",", "}") else self.expression()))
            if not self.is_sign("}"):
                self.need(",")
        return RecordExpr(tuple(items))

    def conditional(self) -> Node:
        branches = []
        while True:
            self.at += 1
            condition = self.expression()
            if not self.word("then"):
                raise self.fail("'then' is missing")
            branches.append((condition, self.expression()))
            if not self.word("else"):
                raise self.fail("'else' is missing")
            if not (self.now.kind == "name" and self.now.value == "if"):
                return IfExpr(tuple(branches), self.expression())


def _plain(node: Node) -> Node:
    """An atom in the place of a value is a call."""
    if isinstance(node, Atom):
        if node.rest:
            raise ParseError("'..' can't stand in a value")
        return Call(node.name, node.args)
    return node


def parse(source: str) -> list[Node]:
    """The statements of a program."""
    return Parser(source).program()
