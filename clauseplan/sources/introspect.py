"""Rules that name the columns of a catalog's tables."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import SparkSession

from ..lang.lexer import NUMBER_WORDS

#: Words of the language that can't be variables.
WORDS = {"combine", "distinct", "else", "false", "if", "import", "in", "is", "limit", "not", "null", "order_by", "then", "true", *NUMBER_WORDS}


def catalogue(spark: SparkSession, database: str | None = None) -> list[tuple[str, str, list[str]]]:
    """(database, table, columns) of one database, or of all; temporary views have no database and come first."""
    databases = [database] if database else [d.name for d in spark.catalog.listDatabases()]
    found = {}
    for d in databases:
        for t in spark.catalog.listTables(d):
            place = "" if t.isTemporary else ".".join(t.namespace or [d])
            full = ".".join(f"`{p}`" for p in [*place.split("."), t.name] if p)
            found[place, t.name] = [c.name for c in spark.catalog.listColumns(full)]
    return [(place, name, columns) for (place, name), columns in sorted(found.items())]


def camel(text: str) -> str:
    """``order_items`` to ``OrderItems``."""
    name = "".join(p[:1].upper() + p[1:] for p in re.split(r"\W|_", text) if p)
    return name if name[:1].isalpha() else f"Table{name}"


def table_rules(spark: SparkSession, database: str | None = None) -> str:
    """One rule for each table: ``ShopOrders(id:, amount:) :- shop.orders(id:, amount:);``.  The name leads with the database,
    unless that is the current one or the table is a temporary view; the second table of one name gets a 2 behind it, and so on."""
    here = spark.catalog.currentDatabase()
    taken: Counter[str] = Counter()
    lines = []
    for place, table, columns in catalogue(spark, database):
        name = camel(table) if place in ("", here) or database else camel(place) + camel(table)
        taken[name] += 1
        name = name if taken[name] == 1 else f"{name}{taken[name]}"
        variables: Counter[str] = Counter()
        fields = []
        for c in columns:
            variable = re.sub(r"\W+", "_", c).lower().strip("_") or "column"
            variable = f"c_{variable}" if variable[0].isdigit() or variable in WORDS else variable
            variables[variable] += 1
            variable += str(variables[variable]) if variables[variable] > 1 else ""
            plain = re.fullmatch(r"[a-z_][a-z0-9_]*", c)
            fields.append(f"{c}:" if c == variable else f"{c}: {variable}" if plain and c not in WORDS else f"`{c}`: {variable}")
        source = f"{place}.{table}" if place else table
        lines.append(f"{name}({', '.join(fields)}) :- {source}({', '.join(fields)});")
    return f"# {len(lines)} tables of the catalog\n" + "".join(f"{x}\n" for x in lines)
