"""Files, catalogs, streams and the command line."""

import json

import pytest

from clauseplan.api import Program
from clauseplan.cli import main
from clauseplan.errors import PlanError
from clauseplan.sources import introspect, load
from clauseplan.streaming.rules import started, streamed

TEXT = "Out(name:, total? += n) distinct :- T(name:, n:);"


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,n\n"x, y",1\nb,2\n')
    (tmp_path / "a.tsv").write_text("name\tn\nx, y\t1\nb\t2\n")
    (tmp_path / "a.json").write_text(json.dumps([{"name": "x, y", "n": 1}, {"name": "b", "n": 2}]))
    (tmp_path / "a.jsonl").write_text('{"name": "x, y", "n": 1}\n{"name": "b", "n": 2}\n')
    for kind in ("parquet", "orc", "csv", "tsv", "json"):
        load.write(spark.createDataFrame([("x, y", 1), ("b", 2)], "name string, n int"), f"{tmp_path}/out.{kind}", kind)
    for path in ("a.csv", "a.tsv", "a.json", "a.jsonl", "out.parquet", "out.orc", "out.csv", "out.tsv"):
        got = Program(TEXT, spark).load("T", f"{tmp_path}/{path}").run("Out")
        assert sorted(map(tuple, got.collect())) == [("b", 2), ("x, y", 1)], path
    assert load.read_whole(spark, f"{tmp_path}/a.csv").first().content.startswith("name,n")
    with pytest.raises(PlanError):
        load.read(spark, "x.unknown")
    with pytest.raises(PlanError):
        load.write(spark.range(1), "x.unknown")


def test_introspection(spark):
    spark.createDataFrame([(1, "x")], "id int, `Full Name` string").createOrReplaceTempView("some_people")
    spark.createDataFrame([(1, 2, 3)], "`if` int, `Full Name` int, full_name int").createOrReplaceTempView("some_people_")
    text = introspect.table_rules(spark)
    assert "SomePeople2(`if`: c_if, `Full Name`: full_name, full_name: full_name2) :- some_people_(" in text and text.startswith("# ")
    assert Program(text, spark).run("SomePeople2").first()["if"] == 1
    assert "SomePeople(id:, `Full Name`: full_name) :- some_people(id:, `Full Name`: full_name);" in text
    assert Program(text, spark).run("SomePeople").first()["Full Name"] == "x"


def test_streams(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 5)], "name string, n int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("name string, n int").parquet(f"{tmp_path}/in")
    program = Program("Out(name:, n:) :- T(name:, n:), n > 2;", spark)
    query = started(streamed(program, "Out", {"T": stream}), f"{tmp_path}/out", f"{tmp_path}/state")
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("b", 5)]
    with pytest.raises(PlanError):
        streamed(Program("@Ground(Out); Out(name:) :- T(name:);", spark), "Out", {"T": stream})
    with pytest.raises(PlanError):
        streamed(program, "Out", {"T": spark.range(1)})


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "p.l").write_text("Out(name:, n:) :- T(name:, n:), n > 1; Bad(x:) :- T(name: x, n:);")
    (tmp_path / "t.csv").write_text("name,n\na,1\nb,2\n")
    assert main(["check", f"{tmp_path}/p.l"]) == 0
    assert main(["run", f"{tmp_path}/p.l", "Out", "--load", f"T={tmp_path}/t.csv", "--csv"]) == 0
    assert "b,2" in capsys.readouterr().out
    assert main(["search", f"{tmp_path}/p.l", "Bad", "^a$", "--load", f"T={tmp_path}/t.csv"]) == 0
    assert main(["parse", f"{tmp_path}/p.l"]) == 0
    (tmp_path / "q.l").write_text("Out(x:, y:) :- T(x:);")
    assert main(["check", f"{tmp_path}/q.l"]) == 1 and "unboundHeadVar" in capsys.readouterr().out
    (tmp_path / "many.csv").write_text("name,n\n" + "".join(f"r{i},{i + 2}\n" for i in range(1500)))
    assert main(["run", f"{tmp_path}/p.l", "Out", "--load", f"T={tmp_path}/many.csv", "--csv"]) == 0
    printed = capsys.readouterr()
    assert len(printed.out.splitlines()) == 1501 and "1500 rows" in printed.err
    (tmp_path / "r.l").write_text("Out(x:")
    assert main(["run", f"{tmp_path}/r.l", "--no-check"]) == 1
