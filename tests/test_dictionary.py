import itertools

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglathe.operators import summary
from loglathe.operators.summary import SummaryNode
from loglathe.plans import treedist
from loglathe.sources import dictionary, generators


def leaf(kind, name="x", mean=None, n=1):
    return SummaryNode(kind, name, n, {} if mean is None else {"total": mean * n})


def rec(*kids, name="r"):
    return SummaryNode("record", name, 1, {}, tuple(kids))


def size(n):
    return sum(1 for _ in n.walk())


def brute(a, b):
    """The least cost over all order- and ancestor-preserving mappings of small trees, roots mapped for free."""

    def nodes(t):
        out = []

        def visit(n, anc):
            i = len(out)
            out.append((n, anc))
            for c in n.matched():
                visit(c, anc | {i})

        visit(t, frozenset())
        return out

    x, y = nodes(a), nodes(b)
    best = float("inf")
    for k in range(min(len(x), len(y))):
        for xs in itertools.combinations(range(1, len(x)), k):
            for ys in itertools.permutations(range(1, len(y)), k):
                pairs = list(zip(xs, ys))
                ok = all((i in x[j][1]) == (p in y[q][1]) and ((i < j) == (p < q)) for (i, p), (j, q) in itertools.permutations(pairs, 2))
                if ok:
                    cost = sum(treedist.change_cost(x[i][0], y[p][0]) for i, p in pairs) + 1000 * (len(x) - 1 - k) + 1000 * (len(y) - 1 - k)
                    best = min(best, cost)
    return best


TREES = [
    rec(),
    rec(leaf("string")),
    rec(leaf("int", mean=3), leaf("string")),
    rec(leaf("string"), leaf("int", mean=5), leaf("double")),
    rec(rec(leaf("int", mean=1), leaf("int", mean=2), name="a"), leaf("string")),
    rec(leaf("string"), rec(leaf("int", mean=20), name="b")),
    rec(rec(rec(leaf("double"), name="d"), name="c")),
]


@pytest.mark.parametrize("a,b", list(itertools.product(range(len(TREES)), repeat=2)))
def test_distance_equals_brute_force(a, b):
    m = treedist.best_mapping(TREES[a], TREES[b])
    assert m.distance == pytest.approx(brute(TREES[a], TREES[b]))
    cost = {"CREATE": 1000, "DELETE": 1000}
    paths_a, paths_b = dict(TREES[a].walk()), dict(TREES[b].walk())
    assert {o.source for o in m.ops if o.source} == set(paths_a) and {o.target for o in m.ops if o.target} == set(paths_b)
    if len(paths_a) == size(TREES[a]) and len(paths_b) == size(TREES[b]):
        total = sum(cost.get(o.op) or (0 if o.source == "r" else treedist.change_cost(paths_a[o.source], paths_b[o.target])) for o in m.ops)
        assert total == pytest.approx(m.distance)


def test_toy_costs():
    a = rec(leaf("string", "a"), leaf("int", "b", 3))
    assert treedist.best_mapping(rec(leaf("string", "a"), leaf("double", "c"), leaf("int", "b", 3)), rec(leaf("string", "a"), leaf("double", "c"), leaf("int", "b", 3))).distance == 1.0
    assert treedist.best_mapping(a, rec(leaf("string", "a"), leaf("int", "b", 5), leaf("double", "c"))).distance == 1002.5


def test_empty_means_do_not_poison():
    assert treedist.change_cost(leaf("int", n=0, mean=0), leaf("int", mean=4)) == 0.5


def test_summary_of_all_kinds(spark):
    schema = T.StructType(
        [
            T.StructField("s", T.StringType()),
            T.StructField("i", T.IntegerType()),
            T.StructField("l", T.LongType()),
            T.StructField("d", T.DoubleType()),
            T.StructField("f", T.FloatType()),
            T.StructField("b", T.BooleanType()),
            T.StructField("y", T.BinaryType()),
            T.StructField("e", T.StringType(), True, {"enum": True}),
            T.StructField("x", T.BinaryType(), True, {"fixed": 2}),
            T.StructField("a", T.ArrayType(T.ArrayType(T.IntegerType()))),
            T.StructField("m", T.MapType(T.StringType(), T.IntegerType())),
            T.StructField("u", T.StructType([T.StructField("p", T.IntegerType()), T.StructField("q", T.StringType())]), True, {"union": True}),
            T.StructField("r", T.StructType([T.StructField("z", T.IntegerType())])),
        ]
    )
    rows = [
        ("é", 2**31 - 1, 2**62, 0.5, 1.5, True, b"abc", "A", b"xy", [[1, 2], [3]], {"k": 1, "j": 2}, (1, None), (7,)),
        ("bc", 2**31 - 1, 2**62, None, 2.5, False, b"", "A", b"zz", [[], None], {"k": 5}, (None, "w"), None),
        (None,) * 13,
    ]
    tree = summary.summarize(spark.createDataFrame(rows, schema))
    got = {p: n for p, n in tree.walk()}
    assert tree.num_data == 3
    assert got["root.s"].stats == {"total_length": 4} and got["root.s"].num_data == 2
    assert got["root.i"].stats["total"] == 2 * (2**31 - 1)
    assert got["root.l"].stats["total"] == 2**63
    assert got["root.b"].stats == {"num_true": 1, "num_false": 1}
    assert got["root.e"].stats["symbols"] == {"A": 3}
    assert got["root.x"].stats == {"total_length": 4, "size": 2}
    assert got["root.a"].stats["total_size"] == 4 and got["root.a.element.element"].stats["total"] == 6
    assert got["root.m.k"].stats["total"] == 6 and got["root.m.j"].num_data == 1
    assert got["root.u"].stats["branches"] == {"p": 1, "q": 1}
    assert got["root.r"].num_data == 1
    assert summary.from_json(summary.to_json(tree)) == tree


def test_summary_of_an_empty_table(spark):
    tree = summary.summarize(spark.createDataFrame([], "a int, b array<string>"))
    assert tree.num_data == 0 and tree.children[0].stats == {"total": 0}


def test_a_table_suggests_itself(spark, tmp_path):
    folder = str(tmp_path / "dict")
    for g in generators.GENRES:
        dictionary.add(spark, folder, generators.genre(spark, g, 50), g)
    for g in ("webcrawl", "purchase"):
        df = generators.genre(spark, g, 50)
        anonymous = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
        best = dictionary.suggest(dictionary.contents(spark, folder), anonymous, 0).collect()
        assert [r["info"] for r in best] == [g]
        assert dictionary.renamed(anonymous, best[0]["ops"]).columns == df.columns
        assert {r["section"] for r in dictionary.report(dictionary.suggest(dictionary.contents(spark, folder), anonymous, 1)).collect()} == {"rename"}


def test_entries_need_rows_and_fields(spark):
    with pytest.raises(ValueError):
        dictionary.entry(spark.createDataFrame([], "a int"), "none")


def test_generators_repeat(spark):
    a = generators.random_records(spark, "a int, b array<double>, c struct<d:string>, m map<string,int>, t timestamp", 20).collect()
    assert a == generators.random_records(spark, "a int, b array<double>, c struct<d:string>, m map<string,int>, t timestamp", 20).collect()
    codes = generators.genre(spark, "webcrawl", 2000).groupBy("lastResultCode").agg(F.count("*").alias("n")).collect()
    assert {r["lastResultCode"] for r in codes} == {200, 401, 501, 301, 403}
