"""Lines in capitals: the spelling for Spark equals the other engine's, and looks no further than the first small letter."""

import duckdb
import pyarrow as pa

from docloom.functions import rules as R
from docloom.functions.dialect import DUCK
from docloom.plans import catalogue


def test_same_lines(spark):
    parts = ["A", "É", "a", "ß", "ǅ", "ʰ", "中", "1", " ", ".", "😀", "𝐀", "𝐚", "́", "-"]
    lines = [None, "", *parts, *(x * n for x in ("A", "É", "A ", "1A-", "中", "𝐀") for n in (2, 3, 79, 80, 81, 200))]
    lines += [a + b + c + d for a in parts for b in parts for c in ("A", "AB", "Ab") for d in ("", ".", "C")]
    lines += ["A" * 5000 + "a", "A. " * 40, "1 " * 3000, "SAFETY FIRST", "SAFETY FIRST.", "ONE TWO"]
    con = duckdb.connect()
    con.register("t", pa.table({"i": range(len(lines)), "x": pa.array(lines, pa.string())}))
    want = dict(con.execute(f"SELECT i, {R.all_caps(DUCK, 'x')} FROM t").fetchall())
    rows = spark.createDataFrame(list(enumerate(lines)), "i long, x string").select("i", R.column(R.all_caps, "x").alias("v"))
    assert {r.i: r.v for r in rows.collect()} == want


def test_groups_replace_matches_in_whole_texts_alone(spark):
    """Of each line all letters were replaced twice; the one replacement left makes the wrapped text."""
    plan = catalogue.QUERIES["paragraph_groups"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
