import math
import random
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from kinforge.operators.hotkeys import exact_selection, hot_keys, per_key


def test_exact_selection_against_sorting(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(9)}", rng.choice([5, 5, 5, rng.randrange(-(10**12), 10**12)])) for _ in range(3000)] + [(None, 3), ("none", None)]
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r["k"], r["prob"]): (r["value"], r["n_equal"]) for r in exact_selection(spark.createDataFrame(rows, "k string, v long"), ["k"], "v", probs, bits=4).collect()}
    by = defaultdict(list)
    for k, v in rows:
        if v is not None:
            by[k].append(v)
    want = {}
    for k, vs in by.items():
        vs.sort()
        for p in probs:
            x = vs[max(1, math.ceil(p * len(vs))) - 1]
            want[k, p] = (x, vs.count(x))
    assert got == want


def test_selection_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, v long")
    assert exact_selection(empty, ["k"], "v", [0.5]).count() == 0


def test_hot_keys(spark):
    rows = [("a",)] * 40 + [("b",)] * 4 + [("c",)] * 3 + [(f"x{i}",) for i in range(43)] + [(None,)] * 5 + [("",)] * 5
    got = {(r["field_name"], r["key_value"], r["n_rows"]) for r in hot_keys(spark.createDataFrame(rows, "z string"), {"z": F.col("z")}, 0.04).collect()}
    assert got == {("z", "a", 40), ("z", "b", 4)}
    assert hot_keys(spark.createDataFrame([], "z string"), {"z": F.col("z")}, 0.04).count() == 0


def test_per_key(spark):
    rows = [("a", "p", 1, 0), ("a", "p", 3, 1), ("a", "q", 3, 2), ("b", None, None, 3)]
    got = {r["k"]: (r["n_rows"], r["n_persons"], r["latest_id"]) for r in per_key(spark.createDataFrame(rows, "k string, p string, t int, i long"), ["k"], "p", "t", "i").collect()}
    assert got == {"a": (3, 2, 2), "b": (1, 0, 3)}


def test_values_exactly_at_the_threshold(spark):
    # 0.04 of 100 rows are 4; as binary fractions some multiples of it come out a little too large
    rows = [("x", f"one{i}") for i in range(28)] + [("x", "four")] * 4 + [("x", f"two{i}") for i in range(68)]
    found = hot_keys(spark.createDataFrame(rows, "f string, v string"), {"v": F.col("v")}, 0.04)
    assert [tuple(r) for r in found.collect()] == [("v", "four", 4)]
    for n in (25, 175, 10_000):  # every multiple of 4 % is a rank of its own
        df = spark.range(1, n + 1).select(F.lit("k").alias("k"), "id")
        got = {r["rank"]: r["value"] for r in exact_selection(df, ["k"], "id", [Fraction(i, 25) for i in range(1, 26)]).collect()}
        assert got == {i * n // 25: i * n // 25 for i in range(1, 26)}
    df = spark.range(1, 101).select(F.lit("k").alias("k"), "id")
    assert {r["rank"] for r in exact_selection(df, ["k"], "id", [0.07, 0.14, 0.28, 0.29]).collect()} == {7, 14, 28, 29}
