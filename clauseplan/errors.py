"""Errors a rule program can cause."""

from __future__ import annotations


class RuleError(Exception):
    """Anything wrong with a program."""


class ParseError(RuleError):
    """The text is no program."""

    def __init__(self, message: str, line: int | None = None):
        super().__init__(f"line {line}: {message}" if line else message)
        self.line = line


class PlanError(RuleError):
    """A sound program cannot be planned as asked."""


class CheckError(RuleError):
    """The checks found problems; ``problems`` lists them."""

    def __init__(self, problems: list):
        super().__init__("\n".join(map(str, problems)))
        self.problems = problems
