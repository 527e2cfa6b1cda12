import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loglathe.functions import lexer

PIECES = ["10", "/", "Oct", "2000", ":", "13", ".", "-", "+", " ", "\t", "[", "]", "(", ")", '"', "'", "<", ">", "abc", "d", "rwxr-xr-x", "1", "9", "39", "Mar", "jan", "*.", "1.2.3.4", ",", ";", "{", "}", "1970", "1969", "é", "\n", "0.5", "Dec 5", "12/31/1999"]

GOLDEN = {
    "10/Oct/2000:13:55:36": ["date", "string"],
    "4:55:22": ["int", "string"],
    "2011-01-15": ["int", "char-", "int", "int"],
    "300-1100": ["int", "char-", "int"],
    "0.5-1.5": ["float", "char-", "float"],
    "Mar 3 08:38": ["date", "ws", "time"],
    "Mar 39": ["string", "ws", "int"],
    "Mar 00": ["string", "ws", "int"],
    "January 5 2001": ["date"],
    "(a,b)": ["meta"],
    "[x": ["char[", "charx"],
    "99999999999": ["int"],
    "-rw-r--r-- x": ["permissionbits", "ws", "charx"],
    "*.10.2 1.2.3.4": ["ipaddr", "ws", "ipaddr"],
    "": [],
}


@pytest.mark.parametrize("line,ids", GOLDEN.items())
def test_golden_ids(line, ids):
    assert [t.id for t in lexer.lex(line)] == ids


def test_year_before_the_first_is_no_date():
    assert "date" not in [t.cls for t in lexer.lex("1969/01/01")]


@given(st.text(max_size=60))
def test_lexemes_make_up_the_line(line):
    tokens = lexer.lex(line)
    assert "".join(t.text for t in tokens) == line


@given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_lexemes_make_up_adversarial_lines(pieces):
    assert "".join(t.text for t in lexer.lex("".join(pieces))) == "".join(pieces)


def test_spark_and_driver_lexers_agree(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, s string")
    got = {r.i: [(t.cls, t.param, t.text) for t in r.t] for r in df.select("i", lexer.tokenize(F.col("s")).alias("t")).collect()}
    for i, x in enumerate(lines):
        assert got[i] == [(t.cls, t.param, t.text) for t in lexer.lex(x)], x


def test_dates_and_times_decode_alike(spark):
    dates = ["10/Oct/2000", "Mar 3", "3 Mar", "2001/5/12", "12/31/1999", "31/12/1999", "2001 Jan 3", "5.6.2001", "January 5 2001", "1/2/2001", "19/5/2001"]
    for r in spark.createDataFrame([(x,) for x in dates], "s string").select("s", lexer.date_value(F.col("s")).alias("d")).collect():
        assert tuple(r.d) == lexer.decode_date(r.s)
    assert lexer.decode_time("08:38") == (8, 38, 0)


def test_nulls_stay_null(spark):
    r = spark.createDataFrame([(None,)], "s string").select(lexer.tokenize(F.col("s")).alias("t"), lexer.token_ids(F.col("s")).alias("i")).first()
    assert r.t is None and r.i is None


def test_no_python_runs_on_the_executors(spark):
    plan = spark.range(1).select(lexer.tokenize(F.col("id").cast("string")).alias("t"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
