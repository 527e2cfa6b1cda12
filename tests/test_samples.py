"""Lines of our own in the shapes of typical samples: listings, access logs, topic counts, timetables, courses."""

import json

import pytest

from loglathe import api, cli
from loglathe.plans import types
from loglathe.sources import text


def topics():
    plain = [f"en page{'abcdefgh'[i % 8]}x {i + 1} {i * 3 + 10}" for i in range(33)]
    meta = [f"en talk(page {i}) {i + 2} {i + 20}" for i in range(3)]
    return [*plain, *meta, "en one, two 5 17"]


def listing():
    rows = [f"-rw-r--r--   1 ines  crew   {100 + i} Jun {i % 9 + 10} 09:{i + 10} file.n{'abcdefghijklmnopqrst'[i]}" for i in range(19)]
    return ["total 52", *rows, "drwxr-x---   4 ines  crew   17 Jun 12 06:07 attic"]


def courses():
    return ["algebra one ", "history of early maps ", "x1 y1 ", "botany and soil and water and light ", "music " * 9]


CASES = {"topics": (topics, 3, 37), "listing": (listing, 3, 21)}


def frame(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")


@pytest.mark.parametrize("name", CASES)
def test_samples_are_unions_of_their_shapes(spark, name):
    make, branches, lines = CASES[name]
    df = frame(spark, make())
    learned = api.infer(df, order="line_no")
    assert len(make()) == lines and isinstance(learned.root, types.Union) and len(learned.root.branches) == branches
    good, bad = learned.parse(df)
    assert good.count() == lines and bad.count() == 0


def test_histograms_of_topics(spark):
    got = {r.id: (r.width, round(r.residual, 3), r.coverage, r.is_struct, r.is_array) for r in api.token_histograms(frame(spark, topics())).collect()}
    assert got["int"] == (1, 0.0, 37, True, False)
    assert got["string"] == (2, 0.027, 37, True, False)
    assert got["meta"] == (1, 0.919, 3, False, False)
    assert got["char,"] == (1, 0.973, 1, False, False)


def test_courses_are_an_array(spark):
    learned = api.infer(frame(spark, courses()), order="line_no")
    assert any(isinstance(n, types.Array) for n in learned.root.walk())
    assert learned.parse(frame(spark, courses()))[1].count() == 0


def test_lines_of_many_files_are_numbered(spark, tmp_path):
    for name, lines in (("b.txt", ["3", "4", "5"]), ("a.txt", ["0", "1", "2"]), ("c.txt", [str(i) for i in range(6, 500)])):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    assert all(r.line == str(r.line_no) for r in text.read_lines(spark, str(tmp_path)).collect())


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in.txt").write_text("\n".join(listing()) + "\n")
    source, out = str(tmp_path / "in.txt"), str(tmp_path / "out")
    assert cli.main(["learn", source, out]) == 0
    assert json.loads(capsys.readouterr().out)["parsed"] == 21
    assert cli.main(["learn", source, out]) == 1
    assert cli.main(["parse", out, source, str(tmp_path / "again")]) == 0
    assert cli.main(["tokens", source]) == 0 and json.loads(capsys.readouterr().out.splitlines()[-1])["lines"] == 21
    assert cli.main(["infer", source]) == 0 and json.loads(capsys.readouterr().out)["profiles"] == 3
    for name, columns in (("ships", "id long, hull string, crew int"), ("songs", "title string, seconds double")):
        spark.createDataFrame([(1, "a", 3) if name == "ships" else ("t", 2.5)], columns).write.parquet(str(tmp_path / f"{name}.parquet"))
        assert cli.main(["dict", str(tmp_path / "dict"), "-a", str(tmp_path / f"{name}.parquet"), "-m", name]) == 0
    assert cli.main(["dict", str(tmp_path / "dict"), "-a", "x"]) == 2
    assert cli.main(["dict", str(tmp_path / "dict"), "-d"]) == 0 and "songs" in capsys.readouterr().out
    spark.createDataFrame([(7, "b", 3)], "x long, y string, z int").write.parquet(str(tmp_path / "unnamed.parquet"))
    assert cli.main(["suggest", str(tmp_path / "dict"), str(tmp_path / "unnamed.parquet"), "-k", "2", "-d", "-f", str(tmp_path / "named")]) == 0
    assert "ships" in capsys.readouterr().out.splitlines()[0]
    assert spark.read.parquet(str(tmp_path / "named")).columns == ["id", "hull", "crew"]
