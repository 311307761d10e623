"""Shared predicates, grounded tables, attached folders, recursion by improvement, and errors."""

import random

import pytest

from clauseplan.api import Program
from clauseplan.errors import PlanError
from clauseplan.plans.recursion import _extreme
from clauseplan.sources import load


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_diamond_is_small(spark):
    """Twelve levels that each use the one below twice read a few tables, not 4096."""
    text = "L0(k:) :- T(k:); " + " ".join(f"L{i + 1}(k:) distinct :- L{i}(k:), L{i}(k:);" for i in range(12)) + " Out(k:) :- L12(k:);"
    df = Program(text, spark, {"T": spark.range(7).toDF("k")}).run("Out")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") <= 32 and "Range" not in plan
    assert rows(df) == [(i,) for i in range(7)]


def test_aggregate_without_its_number(spark):
    with pytest.raises(PlanError):
        Program("Out(t? ArgMaxK= k -> k) distinct :- T(k:);", spark, {"T": spark.range(3).toDF("k")}).run("Out")
    with pytest.raises(PlanError):
        Program("Out(t: DatetimeAdd(k, 1)) :- T(k:);", spark, {"T": spark.range(3).toDF("k")}).run("Out")
    with pytest.raises(PlanError):
        Program('Out(t: DatetimeAdd(k, 1, "FORTNIGHT")) :- T(k:);', spark, {"T": spark.range(3).toDF("k")}).run("Out")


def test_best_items_beside_other_aggregates(spark):
    """Top items are cut before the shuffle, null keys and repeated aggregates included."""
    data = [(None if i % 5 == 0 else i % 5, i) for i in range(40)]
    text = "Top(x) = ArgMaxK(x, 2); Out(g:, n? += 1, t? Top= v -> v) distinct :- T(g:, v:);"
    df = Program(text, spark, {"T": spark.createDataFrame(data, "g int, v int")}).run("Out")
    assert {r.g: (r.n, r.t) for r in df.collect()} == {g: (8, [35 + (g or 0), 30 + (g or 0)]) for g in (None, 1, 2, 3, 4)}
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
    whole = Program("Top(x) = ArgMaxK(x, 2); Out(n? += 1, t? Top= v -> v) distinct :- T(g:, v:);", spark, {"T": spark.createDataFrame(data, "g int, v int")}).run("Out")
    assert rows(whole) == [(40, [39, 38])]


def test_ground_of_another_predicate(spark, tmp_path):
    text = '@Ground(A, "kept_rows"); @Ground(B, A); A(k:) :- T(k:); B(k:) :- T(k:), k > 1; Out(k:) :- B(k:);'
    assert rows(Program(text, spark, {"T": spark.range(4).toDF("k")}).run("Out")) == [(2,), (3,)]
    assert rows(spark.table("kept_rows")) == [(2,), (3,)]


def test_json_array_and_attached_folder(spark, tmp_path):
    data = spark.createDataFrame([(i, None if i == 2 else f"x{i}") for i in range(5)], "k int, s string").repartition(3)
    load.write(data, f"{tmp_path}/db/t.json", "array")
    load.write(data.limit(0), f"{tmp_path}/none.json", "array")
    text = "".join(r.value + "\n" for r in spark.read.text(f"{tmp_path}/db/t.json").collect())
    import json

    assert sorted(r["k"] for r in json.loads(text)) == [0, 1, 2, 3, 4]
    assert json.loads("".join(r.value for r in spark.read.text(f"{tmp_path}/none.json").collect())) == []
    out = Program(f'@AttachDatabase(db, "{tmp_path}/db"); Out(k:) :- db.t(k:, s: null);', spark).run("Out")
    assert rows(out) == [] or out.count() == 0
    with pytest.raises(PlanError):
        Program(f'@AttachDatabase(db, "{tmp_path}/db"); Out(k:) :- db.missing(k:);', spark).run("Out")


EDGES = "Dist(x:, d? Min= 0) distinct :- Start(x:); Dist(x:, d? Min= e + w) distinct :- Dist(x: y, d: e), Edge(a: y, b: x, w:); @Recursive(Dist, -1);"


def test_shortest_paths_move_only_what_improved(spark):
    rng = random.Random(8)
    for _ in range(3):
        edges = [(rng.randrange(12), rng.randrange(12), rng.randint(1, 9)) for _ in range(30)]
        program = Program(EDGES, spark, {"Edge": spark.createDataFrame(edges, "a int, b int, w int"), "Start": spark.createDataFrame([(0,)], "x int")})
        assert _extreme(program.planner.rules["Dist"], "Dist") == ("d", "Min")
        best = {0: 0}
        for _ in range(20):
            for a, b, w in edges:
                if a in best and best[a] + w < best.get(b, 10**9):
                    best[b] = best[a] + w
        assert rows(program.run("Dist")) == sorted(best.items())


def test_values_that_do_not_move_one_way_are_solved_plainly(spark):
    for value in ("10 - e", "e * 2", "e + e", "y + 1"):
        program = Program(EDGES.replace("e + w", value), spark)
        assert _extreme(program.planner.rules["Dist"], "Dist") is None


def test_a_condition_picks_the_next_atom(spark):
    """B has nothing to do with A, C is tied to it by a condition: C comes before B."""
    text = "Out(a:, b:, c:) :- A(a:), B(b:), C(c:), a + 0 < c, b == c;"
    tables = {n: spark.range(k).toDF(n.lower()) for n, k in (("A", 3), ("B", 4), ("C", 5))}
    assert rows(Program(text, spark, tables).run("Out")) == sorted((a, c, c) for a in range(3) for c in range(4) if a < c)
