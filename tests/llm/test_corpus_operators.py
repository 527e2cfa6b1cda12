import collections
import math
import random

import duckdb
import numpy as np
import pytest
from oracle import assert_equal, connect
from pyspark.sql import functions as F

from loglathe.llm import balanced_ann, chat_format, common, components, exact_dedup, line_dedup, minhash_bayes, mixing, rendezvous
from loglathe.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, con, name):
    assert_equal(QUERIES[name](spark, sf), con, SQL[name])


# ---- sharding


def test_one_more_shard_takes_rows_only_into_itself(spark):
    rows = rendezvous.assign(spark.range(5000), "id", [1.0, 2.0, 1.0], grown="grown", next_weight=2.0).collect()
    assert all(r.grown == r.shard or r.grown == 3 for r in rows)
    share = collections.Counter(r.shard for r in rows)
    assert abs(share[1] / 5000 - 0.5) < 0.04 and 0.28 < sum(r.grown == 3 for r in rows) / 5000 < 0.39


def test_slots_are_gapless_and_hard_rows_pass(spark, docs):
    more = docs.unionAll(docs).unionAll(docs.select(F.lit(None).cast("long"), "text", "source", "size"))
    rows = rendezvous.with_slots(rendezvous.assign(more, "doc_id", [1.0] * 3), "doc_id").collect()
    assert len(rows) == 24
    for s, group in collections.Counter(r.shard for r in rows).items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(group))
    assert rendezvous.with_slots(rendezvous.assign(docs.limit(0), "doc_id", [1.0]), "doc_id").count() == 0
    with pytest.raises(ValueError):
        rendezvous.shard_of(F.lit("x"), [0.0])


# ---- exact dedup


@pytest.mark.parametrize("rows,bits", [(exact_dedup.MAX_ROWS, exact_dedup.MAX_BITS), (100, exact_dedup.MAX_BITS), (100, exact_dedup.BITMAP_BITS)])
def test_groups_of_equal_texts(spark, docs, rows, bits):
    many = docs.unionByName(spark.range(100, 3100).select(F.col("id").alias("doc_id"), (F.col("id") % 1500).cast("string").alias("text"), F.lit("a").alias("source"), F.lit(1).alias("size")))
    many = many.unionByName(spark.range(5000, 7500).select(F.col("id").alias("doc_id"), F.lit("hot").alias("text"), F.lit("a").alias("source"), F.lit(1).alias("size"))).withColumn("kept", F.lit("clash"))
    want = collections.defaultdict(list)
    for r in many.collect():
        want[r.text or ""].append(r.doc_id)
    got = exact_dedup.mark_duplicates(many, F.col("text"), "doc_id", rows, bits).collect()
    assert len(got) == many.count()
    for r in got:
        ids = want[r.text or ""]
        assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), r.doc_id == max(ids))
    assert exact_dedup.mark_duplicates(docs.limit(0), F.col("text"), "doc_id").count() == 0


def test_filter_lets_repeats_through_and_hardly_any_other(spark):
    rows = spark.range(20_000).select(F.xxhash64(F.col("id") % 18_000).alias("h"))
    ranges = -(-20_000 // exact_dedup.RANGE_ROWS)
    sketches = exact_dedup.counting_filter(rows, "h", ranges)
    counted = sketches.select(F.conv(F.hex(F.substring("sketch", 5, 8)), 16, 10).cast("long").alias("n"), F.length("sketch").alias("bytes")).collect()
    assert sum(r.n for r in counted) == 20_000
    assert {r.bytes for r in counted} == {exact_dedup.HEAD + 8 * exact_dedup.PROBES * (1 + exact_dedup.CELLS)}
    marked = exact_dedup.maybe_repeated(rows, "h", "maybe")
    got = marked.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("maybe").alias("maybe")).collect()
    assert all(r.maybe for r in got if r.n > 1)
    assert sum(r.maybe for r in got if r.n == 1) < 0.1 * sum(r.n == 1 for r in got)


# ---- mixing


def fill(sizes, weights, most=3):
    """Targets by sharing again until none is above its cap."""
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        w = sum(weights[s] for s in sizes if s not in full)
        target = {s: most * sizes[s] if s in full else left * weights[s] / w for s in sizes}
        over = {s for s in sizes if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixture_comes_near_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("aaaaaaabbbcd") if i % 50 else None, rng.randint(0, 400)) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    got = mixing.mix(df, "doc_id", "source", F.col("n")).collect()
    sizes = collections.Counter()
    for _, s, n in rows:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = fill(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    taken, shards = collections.Counter(), collections.Counter()
    for r in got:
        assert 0 <= r.copies <= 3 and r.taken == r.size * r.copies and len(r.shards) == r.copies
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
        shards.update(r.shards)
    assert all(abs(taken[s] - want[s]) <= 400 for s in order)
    assert set(shards) == set(range(8))
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(7), "doc_id", "source", F.col("n")).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_splitting_tree_keeps_exact_quotas(spark):
    units = [(s, 0, u, u < k) for s, n, k in ((0, 400, 160), (1, 90, 40), (2, 1, 0), (3, 30, 8)) for u in range(n)]
    rows = mixing.split_quotas(spark.createDataFrame(units, "rank int, epoch int, unit long, drawn boolean")).collect()
    assert sorted((r["rank"], r.epoch, r.unit, r.drawn) for r in rows) == sorted(units)
    assert set(collections.Counter(r.shard for r in rows if r.drawn).values()) == {208 // 8}
    assert set(collections.Counter(r.shard for r in rows if not r.drawn).values()) <= {313 // 8, 313 // 8 + 1}
    # counts by source vary as the hypergeometric law says: 26 of 208, of which 160 are of source 0
    of_0 = [c for _, c in collections.Counter(r.shard for r in rows if r.drawn and r["rank"] == 0).items()]
    assert 1 < np.std(of_0) < 5 or len(set(of_0)) > 1


def test_taken_and_shards_follow_the_tree(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, rng.choice("aaabc"), rng.randint(1, 9)) for i in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    before = {r.doc_id: r for r in mixing.mix(df, "doc_id", "source", F.col("n")).collect()}
    real = mixing.split_quotas
    monkeypatch.setattr(mixing, "split_quotas", lambda units, levels, seed: real(units, levels, "another tree"))
    other = {r.doc_id: r for r in mixing.mix(df, "doc_id", "source", F.col("n")).collect()}
    assert any(before[i].taken != other[i].taken for i in before) and any(before[i].shards != other[i].shards for i in before)
    for got in (before, other):
        per = collections.Counter(s for r in got.values() for s in r.shards)
        assert set(per) == set(range(8)) and max(per.values()) < 1.6 * min(per.values())
        for s in "abc":
            mine = [r for r in got.values() if r.source == s]
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= 9


def test_rows_are_dealt_to_shards(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"), F.lit("x").alias("__copy"), F.lit(1).alias("size"))
    mixed = mixing.mix(df, "doc_id", "source", F.lit(2).cast("long"))
    want = collections.Counter({r.doc_id: r.copies for r in mixed.collect()})
    out = mixing.in_shards(mixed, "doc_id")
    got = collections.Counter(r.doc_id for r in out.collect())
    assert got == +want and set(out.columns) == {"doc_id", "source", "__copy"}
    first = [r.doc_id for r in out.limit(50).collect()]
    assert first != sorted(first)


def test_mixing_hard_rows(spark, docs):
    rows = mixing.mix(docs, "doc_id", "source", F.length(F.coalesce("text", F.lit(""))).cast("long")).collect()
    assert len(rows) == 8
    assert mixing.mix(docs.limit(0), "doc_id", "source", F.lit(1).cast("long")).count() == 0


# ---- chat


LAYOUTS = {
    '{"messages":[{"role":"user","content":"a"},{"content":"b","role":"assistant"}]}': [("user", "a"), ("assistant", "b")],
    '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}': [("user", "a"), ("assistant", "b")],
    '{"prompt":"a","completion":"b"}': [("user", "a"), ("assistant", "b")],
    '{"instruction":"i","input":"x","output":"o"}': [("user", "i\n\nx"), ("assistant", "o")],
    '{"instruction":"i","input":"","output":""}': [("user", "i"), ("assistant", "")],
    '{"messages":[{"role":"user","content":"a","at":3},{"content":"b"}],"id":"7","meta":{"text":"x","role":"y"}}': [("user", "a"), ("user", "b")],
    '{"messages":[{"content":"only"}]}': [("user", "only")],
    '{"messages":[]}': [],
    '{"id":1,"question":"a","answer":null}': [("user", "a"), ("assistant", "")],
    '{"messages":[{"role":"user","content":"a"}],"prompt":"b"}': None,
    '{"unknown":1}': None,
    "[1]": None,
    "no json": None,
}


def test_layouts_become_canonical_turns(spark):
    df = spark.createDataFrame([(x,) for x in LAYOUTS] + [(None,)], "r string")
    for r in df.select("r", chat_format.canonical_turns(F.col("r")).alias("t")).collect():
        want = LAYOUTS.get(r.r)
        assert (None if r.t is None else [tuple(x) for x in r.t]) == want


def test_records_in_columns_become_canonical_turns(spark):
    kinds = {
        "struct<messages:array<struct<content:string,role:string>>>": (([("a", None), (None, "assistant")],), [("user", "a"), ("assistant", "")]),
        "struct<conversations:array<struct<`from`:string,value:string>>>": (([("human", "a"), ("gpt", "b")],), [("user", "a"), ("assistant", "b")]),
        "struct<instruction:string,output:string,input:string>": (("i", "o", "x"), [("user", "i\n\nx"), ("assistant", "o")]),
        "struct<id:int,messages:array<struct<content:string>>>": ((1, [("a",)]), [("user", "a")]),
        "struct<unknown:int>": ((1,), None),
    }
    for kind, (value, want) in kinds.items():
        df = spark.createDataFrame([(value,)], f"r {kind}")
        t = df.select(chat_format.struct_turns(df, "r").alias("t")).first().t
        assert (None if t is None else [tuple(x) for x in t]) == want


def test_op8_keeps_null_roles_and_very_long_texts(spark, tmp_path):
    rows = [(-1, 0, "user", "of the table"), (None, None, None, "x"), (9, 1, "user", "twice"), (9, 1, "user", "twice"), (1, 0, None, "only"), (1, 1, None, "nulls"), (2, 0, "assistant", "z"), (2, 0, None, "a"), (2, 0, "x", "tie"), (3, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    long = spark.range(6).selectExpr("4L conv_id", "cast(id as int) turn", "if(id % 2 = 0, 'user', 'assistant') role", "repeat('<s> x', 5000000) text")
    df.unionByName(long).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert_equal(QUERIES["op8_chat_format"](spark, str(tmp_path)), con, SQL["op8_chat_format"])


def test_op8_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn int, role string, text string, added string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [(r.conv_id, r.n_turns) for r in QUERIES["op8_chat_format"](spark, str(tmp_path)).collect()] == [(-1, 2)]


def test_each_record_of_a_column_has_the_mapping_of_its_fingerprint(spark):
    kind = "struct<id:int,messages:array<struct<role:string,content:string,text:string>>,prompt:string,completion:string,instruction:string,output:string,table_rows:array<struct<turn:int,role:string,text:string>>>"
    empty = dict.fromkeys(("id", "messages", "prompt", "completion", "instruction", "output", "table_rows"))
    cases = [
        ({"messages": [("human", "a", None), (None, None, None)]}, [("user", "a"), ("user", "")]),
        ({"messages": [("assistant", None, "b")], "id": 1}, [("assistant", "b")]),
        ({"messages": [("assistant", None, None)]}, [("assistant", "")]),
        ({"prompt": "a", "completion": "b"}, [("user", "a"), ("assistant", "b")]),
        ({"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]),
        ({"table_rows": [(None, "gpt", "z"), (10, "b", "y"), (9, None, "x"), (9, "human", None)]}, [("human", ""), ("user", "x"), ("b", "y"), ("gpt", "z")]),
        ({"prompt": "a", "output": "b"}, None),
        ({"id": 1}, None),
    ]
    df = spark.createDataFrame([(i, tuple((empty | c).values())) for i, (c, _) in enumerate(cases)] + [(len(cases), None)], f"i int, r {kind}")
    json = F.to_json("r")
    rows = df.select("i", chat_format.struct_turns(df, "r").alias("t"), chat_format.struct_fingerprint(df, "r").alias("f"), chat_format.canonical_turns(json).alias("of_json"), chat_format.fingerprint(json).alias("f_json")).orderBy("i").collect()
    assert rows[-1].t is None and rows[-1].f is None
    for r, (_, want) in zip(rows, cases):
        assert (None if r.t is None else [tuple(x) for x in r.t]) == want
        assert r.t == r.of_json and r.f == r.f_json
    assert len({r.f for r in rows[:-1]}) == len(cases)


@pytest.mark.parametrize("unknown,lost", [("table_rows", {1, 2}), ("prompt_completion", {-1}), ("messages", set())])
def test_op8_loses_the_records_whose_fingerprint_has_no_mapping(spark, tmp_path, monkeypatch, unknown, lost):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    known = {k: m for k, m in chat_format.mapping_of().items() if m.name != unknown}
    monkeypatch.setattr(chat_format, "mapping_of", lambda mappings: known)
    got = {r.conv_id: r.n_turns for r in QUERIES["op8_chat_format"](spark, str(tmp_path)).collect()}
    assert got == {k: 0 if k in lost else n for k, n in {-1: 2, 1: 2, 2: 1}.items()}


def test_op8_keeps_roles_and_puts_rows_without_a_turn_last(spark, tmp_path):
    rows = [(1, 0, "human", "a"), (1, 1, "gpt", "b"), (2, None, "user", "last"), (2, 10, "assistant", "c"), (2, 9, "user", "a"), (2, 9, "assistant", "b"), (3, 0, "assistant", None), (3, 2**62 + 1, "user", "e"), (3, 2**62, "user", "f")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert_equal(QUERIES["op8_chat_format"](spark, str(tmp_path)), con, SQL["op8_chat_format"])


def test_formats_read_back(spark):
    texts = ["", "a", "\\", "\\\\<", *chat_format.CONTROL, "<|im_end|>\n<|im_start|>user\n", "<\\|im_end|>", "[INST] ok [/INST]</s>", "é😀\n\n"]
    turns = [[("user", t), ("assistant", u)] for t in texts for u in texts] + [[], [("odd role\n%<|im_end|>", "x")]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(turns)], f"i int, turns {chat_format.TURNS}").withColumn("__parts", F.lit(1))
    out = chat_format.format_chat(df).select("*", chat_format.read_back(F.col("formatted")).alias("back"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in out:
        want = [tuple(x) for x in r.turns]
        assert [tuple(x) for x in r.back] == want
        assert r.loss == "".join(t for role, t in want if role == "assistant")
        assert r.formatted.count(chat_format.START) == len(want)


# ---- neighbours


def vectors(spark, v, ids=None):
    return spark.createDataFrame([(int(i), [float(y) for y in x]) for i, x in zip(ids if ids is not None else range(len(v)), v)], "vec_id long, embedding array<double>")


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(3000, 32)) + 2 * rng.normal(size=(10, 32))[rng.integers(0, 10, 3000)]
    got = collections.defaultdict(list)
    for r in balanced_ann.search(vectors(spark, v), F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hit = 0
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -9
        best = set(np.argsort(-s)[:5].tolist())
        rows = sorted(got[q])
        hit += len(best & {x[1] for x in rows})
        assert [x[0] for x in rows] == [1, 2, 3, 4, 5] and all(abs(s[x[1]] - x[2]) < 1e-12 for x in rows)
    assert hit >= 0.9 * 300


def near_brute(rows, k=5):
    """Of rows (id, vector) the k nearest of each query row, for vectors of any lengths."""
    rows = sorted({(i, tuple(map(float, v))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = collections.defaultdict(list)
    by_len = collections.defaultdict(list)
    for i, v in rows:
        by_len[len(v)].append((i, v))
    for group in by_len.values():
        ids, m = np.array([i for i, _ in group]), np.array([v for _, v in group])
        norms = np.sqrt((m * m).sum(1))
        for n, (i, _) in enumerate(group):
            if i % 50 == 0:
                s = (m * m[n]).sum(1) / (norms * norms[n])
                order = [j for j in np.lexsort((ids, -s)) if j != n][:k]
                out[i] += [(r + 1, int(ids[j]), float(s[j])) for r, j in enumerate(order)]
    return {q: sorted(x) for q, x in out.items()}


def test_op3_recall_on_the_given_tables(spark, sf):
    for folder in (sf, sf.replace("sf0.001", "sf0.1")):
        t = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
        want = near_brute([(r.vec_id, r.embedding) for r in t.collect()])
        got = collections.defaultdict(list)
        for r in QUERIES["op3_balanced_ann"](spark, folder).collect():
            got[r.query_id].append((r["rank"], r.vec_id, r.score))
        assert set(got) == set(want)
        hit = 0
        for q, best in want.items():
            assert [x[0] for x in sorted(got[q])] == list(range(1, len(best) + 1))
            hit += sum(x[2] >= best[-1][2] for x in got[q])
        assert hit >= 0.9 * sum(map(len, want.values()))


def test_share_of_vectors_read_falls_with_the_size():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(16_000, 24))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    shares = []
    for n in (1000, 4000, 16_000):
        c = balanced_ann.fit_centroids(v[:n], n // balanced_ann.LIST)
        held = np.bincount([x for lists in balanced_ann._lists_of(c, u[:n]) for x in lists], minlength=len(c.points))
        assert n / len(c.points) < 2 * balanced_ann.LIST and held.max() < 40 * balanced_ann.LIST
        shares.append(np.mean([held[x].sum() for x in balanced_ann._lists_for(c, u[:100], balanced_ann.RATIO)]) / n)
    assert shares[0] > shares[1] > shares[2]


def test_shared_ids_lengths_and_clashing_names(spark):
    rng = random.Random(6)
    rows = [(rng.choice([0, 50, i]), [rng.gauss(0, 1) for _ in range(rng.choice([4, 4, 4, 3, 7]))]) for i in range(400)]
    rows += rows[:60]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({x: F.lit("clash") for x in ("id", "v", "q", "mark", "grp", "lists", "score")})
    got = collections.defaultdict(list)
    for r in balanced_ann.search(df, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert {q: sorted(x) for q, x in got.items()} == near_brute(rows)


def test_ties_copies_and_invalid_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(1, 3000)] + [(0, [1.0, 2.0]), (9001, None), (9002, [0.0, 0.0]), (9003, [float("nan"), 1.0]), (9004, [None, 1.0]), (9005, [float("inf"), 1.0]), (9006, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = balanced_ann.search(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5]
    few = balanced_ann.search(df.where("vec_id in (0, 1, 2, 9002)"), F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert balanced_ann.search(df.limit(0), F.lit(True)).count() == 0


# ---- near duplicates


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    top = {i: i for i in texts}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                top[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rng, n, words, edits):
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    for _ in range(n):
        out = list(base)
        for _ in range(rng.randint(0, edits)):
            out[rng.randrange(len(out))] = f"x{rng.randint(0, 10**6)}"
        yield " ".join(out)


def test_components_equal_brute_force(spark, docs):
    rng = random.Random(4)
    texts = [t for n, w, e in ((60, 60, 4), (150, 100, 6), (40, 12, 1), (30, 5, 1), (200, 80, 5)) for t in family(rng, n, w, e)] + ["A b C d", "a B c D", "a b c", None, "", " "]
    rng.shuffle(texts)
    by_id = {100 + i: t for i, t in enumerate(texts)} | {r.doc_id: r.text for r in docs.collect()}
    df = spark.createDataFrame(list(by_id.items()), "doc_id long, text string").repartition(6)
    want = brute_components(by_id)
    got = {r.id: (r.n_shingles, r.component_id) for r in minhash_bayes.cluster(df).collect()}
    assert got == want
    assert {r.doc_id for r in minhash_bayes.keep_one(df).collect()} == {i for i, (_, c) in want.items() if i == c}
    assert minhash_bayes.cluster(df.limit(0)).count() == 0


def test_blocks_smaller_than_a_family_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash_bayes, "BLOCK", 20)
    monkeypatch.setattr(minhash_bayes, "FAMILY_BLOCK", 7)
    rng = random.Random(9)
    by_id = dict(enumerate(family(rng, 150, 70, 6)))
    df = spark.createDataFrame(list(by_id.items()), "doc_id long, text string")
    assert {r.id: (r.n_shingles, r.component_id) for r in minhash_bayes.cluster(df).collect()} == brute_components(by_id)


def test_op6_equals_brute_force_on_the_given_documents(spark, sf):
    want = brute_components({r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op6_minhash_bayes"](spark, sf).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)


def test_rows_that_share_an_id_keep_their_links(spark):
    rng = random.Random(12)
    texts = [t for _ in range(12) for t in family(rng, 5, 50, 2)]
    rng.shuffle(texts)
    rows = [(rng.randint(0, 20), t) for t in texts] + [(3, None), (3, ""), (None, texts[0]), (7, texts[1]), (7, texts[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({x: F.lit(1) for x in ("id", "mark", "set_key", "__id", "kept")}).repartition(4)
    sets = brute_components(dict(enumerate(t if i is not None else None for i, t in rows)))  # by place
    least = collections.defaultdict(lambda: 99)
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[sets[n][1]] = min(least[sets[n][1]], i)
    want = collections.Counter((i, least[sets[n][1]] if i is not None and sets[n][0] else i) for n, (i, _) in enumerate(rows))
    assert collections.Counter((r.id, r.component_id) for r in minhash_bayes.cluster(df).collect()) == want
    out = minhash_bayes.keep_one(df)
    kept = collections.Counter((i, t) for n, (i, t) in enumerate(rows) if i is None or not sets[n][0] or least[sets[n][1]] == i)
    assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == kept and out.columns == df.columns


def test_hot_nodes_and_hot_groups(spark, monkeypatch):
    edges = [(0, i) for i in range(1, 3000)] + [(20_000 + i, 30_000 + i) for i in range(1500)]
    df = spark.createDataFrame(edges, "u long, v long")
    for most in (100_000, 1):
        monkeypatch.setattr(common, "HOT_GROUPS", most)
        got = {r.node: r.component for r in components.components(df).collect()}
        assert all(got[i] == 0 for i in range(3000)) and all(got[30_000 + i] == 20_000 + i for i in range(1500))
    rows = spark.range(6000).select((F.col("id") % 3).alias("g"), F.col("id").alias("x"))
    groups = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("top"))
    assert sorted((r.g, r.x, r.top) for r in common.join_groups(rows, groups, ["g"], "n", ["x"]).collect()) == [(i % 3, i, 5997 + i % 3) for i in sorted(range(6000), key=lambda i: i % 3)]


def test_pruning_bound_is_the_posterior(spark):
    need = minhash_bayes.least_matches()
    for n, m in need.items():
        grid = np.linspace(0, 1, 20001)
        like = grid ** (m - 1) * (1 - grid) ** (n - m + 1) if m else (1 - grid) ** n
        below = grid ** m * (1 - grid) ** (n - m)
        tail = lambda y: y[grid >= 0.75].sum() / y.sum()
        assert tail(below) >= minhash_bayes.MISS * 0.9 and (m == 0 or tail(like) < minhash_bayes.MISS * 1.1)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(500, 500)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[200 + i] == 100 for i in range(50)) and 500 not in got


# ---- lines


def word_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            before, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, before + (x != y))
    return d[-1]


def brute_lines(texts):
    lines = [((i, n), tuple(x.encode().split())) for i, t in sorted(texts.items()) if t is not None for n, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[1]]
    gone = {}
    for k, (p, w) in enumerate(lines):
        for q, v in lines[:k]:
            if w == v or (min(len(w), len(v)) >= 8 and abs(len(w) - len(v)) <= 1 and word_distance(w, v) <= 1):
                gone[p] = q
                break
    return gone


def test_lines_equal_brute_force(spark, docs):
    rng = random.Random(8)
    pool = [[f"w{rng.randint(0, 60)}" for _ in range(n)] for n in (1, 3, 7, 8, 9, 12, 13, 14, 15, 16, 30, 60) for _ in range(3)]
    texts = {}
    for i in range(60):
        lines = []
        for _ in range(6):
            x = list(rng.choice(pool))
            kind = rng.randint(0, 4)
            at = rng.randrange(len(x))
            if kind == 1:
                x[at] = "new"
            elif kind == 2:
                x.insert(at, rng.choice(["new", x[at]]))
            elif kind == 3:
                del x[at]
            elif kind == 4:
                x[0], x[-1] = "p", "q"
            lines.append(" ".join(x))
        texts[1000 + i] = "\n".join(lines)
    texts |= {r.doc_id: r.text for r in docs.collect()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).withColumn("line", F.lit(1)).repartition(5)
    want = brute_lines(texts)
    assert len(want) > 100
    got = {(r.doc, r.line): (r.keep_doc, r.keep_line) for r in line_dedup.duplicate_lines(df).collect()}
    assert got == want
    kept = {r.doc_id: r for r in line_dedup.drop_lines(df).collect()}
    for i, t in texts.items():
        left = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in want)
        if left == t or left.split():
            assert kept[i].text == left and (t is None or kept[i].n_chars == len(left))
        else:
            assert i not in kept
    assert line_dedup.drop_lines(df.limit(0)).count() == 0


def test_repeated_lines_out_of_order_equal_brute_force(spark):
    x = "a b c d e f g h i j"
    rows = [(10, x), (5, x), (7, x.replace("j", "k"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {(r.doc, r.line): (r.keep_doc, r.keep_line) for r in line_dedup.duplicate_lines(df).collect()} == {(10, 0): (5, 0), (7, 0): (5, 0)}
    for seed in range(6):
        rng = random.Random(seed)
        pool = [[f"w{rng.randint(0, 60)}" for _ in range(n)] for n in range(8, 15) for _ in range(2)]
        texts = {}
        for i in range(60):
            lines = [list(rng.choice(pool)) for _ in range(3)]
            if rng.random() < 0.5:
                lines[1][rng.randrange(len(lines[1]))] = f"new{rng.randint(0, 3)}"
            texts[i] = "\n".join(map(" ".join, lines))
        rows = list(texts.items())
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1 + seed % 3)
        assert {(r.doc, r.line): (r.keep_doc, r.keep_line) for r in line_dedup.duplicate_lines(df).collect()} == brute_lines(texts)


def test_rows_that_share_an_id_lose_no_line(spark):
    a, other = "one line of two rows here it is repeated once", "totally different words that no other line has at all"
    rows = [(0, a), (1, f"{a}\nkeep one"), (1, f"{other}\nkeep two"), (2, other.replace("at all", "here all")), (1, f"{other}\nkeep two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({x: F.lit(7) for x in ("doc", "x", "line", "__doc", "t")})
    out = line_dedup.drop_lines(df)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(0, a), (1, "keep one"), (1, f"{other}\nkeep two"), (1, f"{other}\nkeep two")]
    assert out.columns == df.columns


def test_many_lines_of_one_variant(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "REMEMBERED", 10)
    words = "the user with this name logged in at noon from home".split()
    texts = {i: " ".join(words[:4] + [f"n{i}"] + words[5:]) for i in range(3000)} | {5000: " ".join(words[:4] + words[5:])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {(r.doc, r.line): (r.keep_doc, r.keep_line) for r in line_dedup.duplicate_lines(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(i, 0): (0, 0) for i in [*range(1, 3000), 5000]}


def test_within_one_edit():
    rng = random.Random(1)
    for _ in range(3000):
        a = [rng.choice("ab").encode() for _ in range(rng.randint(0, 6))]
        b = [rng.choice("ab").encode() for _ in range(rng.randint(0, 6))]
        assert line_dedup.within_one(a, b) == (word_distance(a, b) <= 1)


def test_variants_are_lines_without_a_word():
    import xxhash

    words = [b"a", b"bb", b"c", b"bb"]
    assert line_dedup.variants(words) == [xxhash.xxh3_128_intdigest(b" ".join(words[:i] + words[i + 1 :])) for i in range(4)]
    assert line_dedup.variants([b"x"]) == [xxhash.xxh3_128_intdigest(b"")]
