import random

from docloom.operators.ordinal import with_ordinal


def test_ordinals_are_those_of_one_sorted_group(spark):
    """One hot key, a null key, negative and far-apart orders, blocks of every size: the same places as a plain count."""
    rnd = random.Random(3)
    orders = rnd.sample(range(-500, 100_000), 300)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", None]), o, f"x{o}") for o in orders]
    df = spark.createDataFrame(rows, "k string, o long, x string")
    want = {}
    for k in ("hot", "a", None):
        want |= {x: i for i, (_, x) in enumerate(sorted((o, x) for q, o, x in rows if q == k), 1)}
    for block in (1, 7, 1000, 1 << 20):
        got = with_ordinal(df, df.select("k", "o"), "k", "o", "n", block)
        assert got.columns == ["k", "o", "x", "n"]
        assert {r.x: r.n for r in got.collect()} == want


def test_empty_and_null_orders(spark):
    df = spark.createDataFrame([], "k string, o long")
    assert with_ordinal(df, df, "k", "o", "n").collect() == []
    df = spark.createDataFrame([("a", None), ("a", None), ("a", 5), (None, None)], "k string, o long")
    got = [(r.k or "", -1 if r.o is None else r.o, r.n) for r in with_ordinal(df, df, "k", "o", "n", 2).collect()]
    assert sorted(got) == [("", -1, 1), ("a", -1, 1), ("a", -1, 2), ("a", 5, 3)]
