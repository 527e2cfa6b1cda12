import random

import pytest

from loglathe import api
from loglathe.operators import profiles
from loglathe.operators.profiles import LineProfile
from loglathe.plans import discover, parser, types

LOG = [
    '172.20.9.41 ~ ottoline {07/Feb/2019:21:40:02 +0100} "PUT /depot/crate.csv FTP/2" 301 77',
    '172.20.9.55 ~ perpetua {19/Jun/2021:02:15:59 +0100} "DEL /attic/lamp.bin FTP/2" 226 90411',
    '172.20.9.73 ~ quillon {30/Aug/2022:17:03:44 +0100} "PUT /depot/rope.csv FTP/2" 550',
]
LISTING = ["blocks 52", "drwx--x---   7 zelda  harbor   90210 Sep  9 23:51 Quay.rs", "-rwxrw-r--   2 zelda  harbor     31 Nov 27 06:07 tide"]


def tree(lines):
    from collections import defaultdict

    from loglathe.functions.lexer import lex

    def key(line):
        return tuple((t.id, key(t.inner) if t.cls == "meta" else None) for t in lex(line))

    groups = defaultdict(list)
    for i, x in enumerate(lines):
        groups[key(x)].append((i, x))
    return discover.infer([LineProfile(len(g), tuple(g[:3])) for g in sorted(groups.values())])


def frame(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "n long, line string")


@pytest.mark.parametrize("lines", [LOG, LISTING])
def test_all_lines_parse_back(spark, lines):
    learned = api.infer(frame(spark, lines), order="n")
    good, bad = learned.parse(frame(spark, lines))
    assert good.count() == len(lines) and bad.count() == 0
    assert learned.root == tree(lines)


def test_one_shape_is_one_record(spark):
    learned = api.infer(frame(spark, LOG[:2]), order="n")
    assert isinstance(learned.root, types.Struct)
    r = learned.records(frame(spark, LOG[:2])).first().asDict(recursive=True)
    flat = str(r)
    assert "'month': 2" in flat and "ottoline" in flat and "100" in flat


def test_order_and_partitions_do_not_matter(spark):
    rows = list(enumerate(LOG + LISTING))
    a = api.infer(spark.createDataFrame(rows, "n long, line string"), order="n").to_json()
    random.Random(1).shuffle(rows)
    assert api.infer(spark.createDataFrame(rows, "n long, line string").repartition(5), order="n").to_json() == a


def test_json_round_trip():
    root = tree(LOG)
    assert types.from_json(types.to_json(root)) == root
    with pytest.raises(ValueError):
        types.from_json('{"version": 99, "root": {}}')


def test_arrays_advance_and_keep_a_last_partial_group(spark):
    lines = ["1,2,3", "4,5,6,7", "8,9", "1,2,3,4,5,6", "7,8,9,1,2,3,4", "1,2,3,4,5,6,7,8"]
    learned = api.infer(frame(spark, lines), order="n")
    assert any(isinstance(n, types.Array) for n in learned.root.walk())
    good, bad = learned.parse(frame(spark, lines))
    assert bad.count() == 0
    for r in good.collect():
        d = r.parsed.asDict(recursive=True)
        first = next(v for v in d.values() if isinstance(v, dict))
        rest = next(v for v in d.values() if isinstance(v, list))
        assert [*first.values(), *(next(iter(x.values())) for x in rest)] == [int(x) for x in r.line.split(",")]


def test_literal_lines_are_rejected(spark):
    lines = [";;", "; |", ";;"]
    learned = api.infer(frame(spark, lines), order="n")
    good, bad = learned.parse(frame(spark, lines))
    assert good.count() == 0 and bad.count() == 3 and not learned.schema.fields


def test_empty_input_and_blank_lines(spark):
    learned = api.infer(frame(spark, [""]), order="n")
    assert learned.root.cls == "noop"
    assert api.infer(spark.createDataFrame([], "n long, line string"), order="n").root.cls == "noop"


def test_empty_groups_parse(spark):
    lines = ["a1 ()", "bb ()"]
    learned = api.infer(frame(spark, lines), order="n")
    assert learned.parse(frame(spark, lines))[0].count() == 2


def test_int_overflow_is_null(spark):
    lines = ["x1 99999999999", "y2 3"]
    learned = api.infer(frame(spark, lines), order="n")
    values = {r.line: r.parsed[1] for r in learned.parse(frame(spark, lines))[0].collect()}
    assert values == {"x1 99999999999": None, "y2 3": 3}


def test_separator_in_a_line_takes_the_slow_way(spark):
    lines = ["ab 1", "c\x01d 2"]
    learned = api.infer(frame(spark, lines), order="n")
    assert sorted(tuple(r.parsed) for r in learned.parse(frame(spark, lines))[0].collect()) == [("ab", 1), ("c\x01d", 2)]


def test_nested_unions_are_hoisted():
    u = types.Union(branches=(types.Union(branches=(types.Base(cls="int"), types.Base(cls="string"))), types.Base(cls="float")))
    flat = types.hoisted(types.Union(branches=(u, types.Base(cls="time"))))
    assert [b.cls for b in flat.branches] == ["int", "string", "float", "time"]


def test_meta_by_delimiter_tells_groups_apart(spark):
    lines = ["(1)", "[2]"]
    assert api.infer(frame(spark, lines), order="n", meta_by_delimiter=True).parse(frame(spark, lines))[0].count() == 2


def test_nullable_groups_accept_empty_ones(spark):
    lines = ["a1 (5)", "b2 ()", "c3 (7)"]
    df = frame(spark, lines)
    strict, loose = api.infer(df, order="n"), api.infer(df, order="n", nullable_groups=True)
    assert [r.line for r in strict.parse(df)[1].collect()] == ["b2 ()"]
    good, bad = loose.parse(df)
    assert bad.count() == 0
    assert {r.line: "5" in str(r.parsed) or "7" in str(r.parsed) for r in good.collect()} == {"a1 (5)": True, "b2 ()": False, "c3 (7)": True}


def test_profiles_count_id_sequences(spark):
    rows = {r.profile: r.n for r in api.profiles(frame(spark, ["a1 2", "bb 3", "4", None])).collect()}
    assert rows == {"string ws int": 2, "int": 1}


def test_parse_is_native(spark):
    root = tree(LOG)
    plan = parser.with_parsed(frame(spark, LOG), root, "line")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_entropy_of_known_forms():
    assert discover.entropy([0, 37], [0, 36, 1]) == pytest.approx(0.350, abs=1e-3)
    assert discover.entropy([0, 5], [0, 5]) == 0


def test_learn_writes_all_outputs(spark, tmp_path):
    (tmp_path / "in.txt").write_text("\n".join([*LOG, ";;"]) + "\n")
    counts = api.learn(spark, str(tmp_path / "in.txt"), str(tmp_path / "out"))
    assert counts["lines"] == 4 and counts["parsed"] == 3
    from loglathe.sources import sinks

    assert sinks.read_parser(spark, str(tmp_path / "out")).has_data
    assert spark.read.json(str(tmp_path / "out/data.json")).count() == 3
    with pytest.raises(FileExistsError):
        api.learn(spark, str(tmp_path / "in.txt"), str(tmp_path / "out"))


def test_reports(spark):
    df = frame(spark, [*LOG, None])
    assert api.tokenize_report(df)["failed"] == 1
    assert api.infer_report(df, order="n")["profiles"] >= 1
    assert api.token_histograms(df.where("line is not null")).where("id = 'ipaddr' and is_struct").count() == 1


def test_all_profiles_are_learned_from(spark):
    import itertools

    from loglathe.functions.lexer import lex

    lines = ["".join(x) for x in itertools.product(";|,!", repeat=8)]
    n = len({tuple(t.id for t in lex(x)) for x in lines})
    assert n > 50_000
    dominant = "1"
    df = frame(spark, lines + [dominant] * 60_000)
    found, sampled = profiles.collect_profiles(df, "line", "n")
    assert not sampled and len(found) == n + 1 and sum(p.count for p in found) == len(lines) + 60_000
    few, sampled = profiles.collect_profiles(df, "line", "n", most=1)
    assert sampled and [(p.count, p.first[0][1]) for p in few] == [(60_000, dominant)]
