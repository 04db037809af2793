"""The quality rules' spellings for Spark: equal to the other engine's on odd texts, and without what made them slow."""

import random

import duckdb
import pyarrow as pa
import pytest

from docloom.functions import rules as R
from docloom.functions.dialect import DUCK, SPARK
from docloom.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(9)
    words = ["a", "Ab", "ab.", "x1", "É", "été", "😀A", "A😀", "\u200bB", "9", "--", "(iv)", "Zz", "\\", "'q'", "ÀÀÀ", "A", "\x1c", "\ufeff", "ß"]
    gaps = [*R.WS_CHARS, "  ", " \n\t ", "\t\n", "\n\t", "\u3000\u3000"]
    made = [rnd.choice(["", rnd.choice(gaps)]) + "".join(rnd.choice(words) + rnd.choice(gaps) for _ in range(rnd.randint(0, 30))) for _ in range(400)]
    long = ["word " * 3000, "àé" * 9000, "ab " * 700 + "é " * 400, "😀 " * 5000, "Ab\u2003" * 600]
    return [None, "", " ", "\n\t", "\t\n\t\n", *R.WS_CHARS, *words, *made, *long]


def both(spark, texts, rule):
    con = duckdb.connect()
    con.register("t", pa.table({"i": range(len(texts)), "x": pa.array(texts, pa.string())}))
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, x string")
    got = {r.i: r.v for r in rows.select("i", R.column(rule, "x").alias("v")).collect()}
    return got, dict(con.execute(f"SELECT i, {rule(DUCK, 'x')} FROM t").fetchall())


def plan(spark, name):
    return catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("rule", [R.readable_ratio, R.client_garbage, R.words, R.title_case_ratio, R.word_like_ratio])
def test_same_measures(spark, texts, rule):
    got, want = both(spark, texts, rule)
    assert got == want


def test_same_gate(spark, texts):
    con = duckdb.connect()
    con.register("t", pa.table({"i": range(len(texts)), "text": pa.array(texts, pa.string())}))
    spark.createDataFrame(list(enumerate(texts)), "i long, text string").createOrReplaceTempView("gate_texts")
    shown = "i, readable, word_like, spaces"
    want = con.execute(f"SELECT {shown}, {R.garbage(DUCK)} FROM {R.measured(DUCK, 't')} AS g ORDER BY i").fetchall()
    assert [tuple(r) for r in spark.sql(f"SELECT {shown}, {R.garbage(SPARK)} FROM {R.measured(SPARK, 'gate_texts')} AS g ORDER BY i").collect()] == want


def test_gate_replaces_no_matches(spark):
    """Character by character, replacing matches took most of the time; characters are looked up instead."""
    assert "regexp_replace" not in plan(spark, "garbage_gate")


def test_preview_measures_without_replacing(spark):
    assert "[^A-Za-z" not in plan(spark, "garbage_preview")


def test_title_case_splits_lines_alone(spark):
    """Words are counted in the line as it is; they were split three times, and their capitals matched one by one."""
    shown = plan(spark, "title_case_ratio")
    assert shown.count("split(") == 1 and "RLIKE" not in shown and "regexp" not in shown


def test_word_like_splits_a_text_once(spark):
    """The words occur three times in the rule, and were split as often."""
    shown = plan(spark, "word_like_ratio")
    assert shown.count("split(") == 1 and "regexp" not in shown
