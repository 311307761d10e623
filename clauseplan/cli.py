"""Command line: ``python -m clauseplan.cli run program.l Predicate --load Orders=orders.csv``."""

from __future__ import annotations

import argparse
import csv
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .api import Program, check, parse, types
from .errors import RuleError
from .sources.introspect import table_rules


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("rules").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def show(df: DataFrame, as_csv: bool) -> None:
    """Print every row, as it arrives: one partition is on the driver at a time.  The number of rows goes to standard error."""
    out = csv.writer(sys.stdout, lineterminator="\n") if as_csv else None
    line = out.writerow if out else lambda row: print("\t".join(map(_cell, row)))
    line(df.columns)
    n = 0
    for row in df.toLocalIterator():
        line(row)
        n += 1
    sys.stdout.flush()
    print(f"{n} row{'s' * (n != 1)}", file=sys.stderr)


def _cell(value: object) -> str:
    return "" if value is None else str(value)


def repl(spark: SparkSession, source: str = "") -> None:
    """Statements end with ``;``.  ``?Predicate`` runs one, ``.load name path`` adds a table, ``.list`` and ``.quit``."""
    tables: dict[str, DataFrame] = {}
    held = ""
    while True:
        try:
            line = input("... " if held else "> ")
        except EOFError:
            return
        command = line.strip()
        try:
            if command in (".quit", ".exit"):
                return
            if command.startswith(".load "):
                _, name, path = command.split(maxsplit=2)
                tables[name] = Program("", spark).load(name, path).tables[name]
            elif command == ".list":
                print("\n".join(Program(source, spark, tables).predicates))
            elif command.startswith("?"):
                show(Program(source, spark, tables).run(command[1:].strip(" ;")), False)
            elif command:
                held += line + "\n"
                if command.endswith(";"):
                    parse(held)
                    source, held = source + held, ""
        except (RuleError, ValueError) as e:
            print(e)
            held = ""


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="clauseplan", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "check", "search", "parse", "types"):
        p = sub.add_parser(name)
        p.add_argument("program")
        p.add_argument("--root", action="append", default=[])
        if name in ("run", "search"):
            p.add_argument("predicate", nargs="*" if name == "run" else 1)
            p.add_argument("--load", action="append", default=[], metavar="NAME=PATH")
            p.add_argument("--flag", action="append", default=[], metavar="NAME=VALUE")
            p.add_argument("--limit", type=int)
            p.add_argument("--offset", type=int)
            p.add_argument("--csv", action="store_true")
            p.add_argument("--no-check", action="store_true")
        if name == "search":
            p.add_argument("pattern")
    p = sub.add_parser("introspect")
    p.add_argument("--database")
    p = sub.add_parser("repl")
    p.add_argument("program", nargs="?")
    args = parser.parse_args(argv)
    if args.command == "introspect":
        print(table_rules(_session(), args.database), end="")
        return 0
    if args.command == "repl":
        repl(_session(), Path(args.program).read_text() if args.program else "")
        return 0
    source = sys.stdin.read() if args.program == "-" else Path(args.program).read_text()
    roots = args.root or [str(Path(args.program).parent)]
    try:
        if args.command == "parse":
            for statement in parse(source):
                print(statement)
            return 0
        if args.command == "types":
            for name, columns in types(source, roots).items():
                print(f"{name}({', '.join(f'{k}: {v}' for k, v in columns.items())})")
            return 0
        found = [] if getattr(args, "no_check", False) else check(source, roots)
        if found or args.command == "check":
            print("\n".join(found) or "no problems")
            return int(bool(found))
        program = Program(source, _session(), roots=roots, flags=dict(x.split("=", 1) for x in args.flag))
        for x in args.load:
            program.load(*x.split("=", 1))
        for name in args.predicate or program.run_all():
            df = program.run(name, args.limit, args.offset) if args.command == "run" else program.search(name, args.pattern, args.limit, args.offset)
            show(df, args.csv)
        return 0
    except RuleError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
