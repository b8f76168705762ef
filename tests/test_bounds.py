"""Pairs that names can't make acceptable are left out before names are compared: same results, short code."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kinforge.config import LEVELS, MatchConfig
from kinforge.functions.similarity import jaro_winkler_text, jaro_winkler_texts
from kinforge.operators import blocking, report
from kinforge.operators import results as res
from kinforge.operators.accept import possible

TEXTS = ["", "A", "ANNA", "ANA", "ANNE MARIE", "MARIANNE", "É日𝒳", "O\x00B", "JOHANNES", "JOHANES", "X" * 40, "X" * 39 + "Y", "AB" * 40, "BA" * 41]
PEOPLE = "idx long, indv_id string, common_id string, fname string, mname string, lname string, altlname string, minitial string, xf string, xl string, byear_txt string, byear double, bmonth_txt string, bmonth double, bday_txt string, bday double, zipcode string, county string"


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(7)
    names = [t for t in TEXTS if "\x00" not in t] + [None]
    rows = []
    for i in range(400):
        f, n, m, o = (rng.choice(names) for _ in range(4))
        y, mo, d = rng.choice(["1990", "1991", None]), rng.choice(["1", "2"]), rng.choice(["1", "2", ""])
        num = [x for t in (y, mo, d) for x in (t, float(t) if t else None)]
        rows.append((i, f"p{i % 300}", rng.choice(["", None, "123456789", "123456780", str(i)]), f, m, n, o, (m or "")[:1], (f or "")[:1], (n or "")[:1], *num, rng.choice(["1", "2", ""]), rng.choice(["7", None])))
    return spark.createDataFrame(rows, PEOPLE)


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def whole(people):
    """All results, without bounds."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(res, "possible", lambda *a: None)
        return res.stash(res.results(people, None, MatchConfig()))


def test_scores_of_batches_are_those_of_texts():
    pairs = [(x, y) for x in TEXTS for y in TEXTS]
    assert jaro_winkler_texts(*map(list, zip(*pairs))).tolist() == [jaro_winkler_text(*p) for p in pairs]


def test_groups_read_the_pairs_of_their_level_only(people, whole):
    for level in ("strict", "relaxed"):
        want = rows(whole.where(f"match_{level}"))
        assert rows(res.results(people, None, MatchConfig(), level)) == want and want


def test_bounds_leave_out_nothing(people, whole):
    got = rows(res.results(people, None, MatchConfig()))
    assert got == rows(whole)
    assert {1, 2, 3, 4} <= {r["pass_order"] for r in whole.collect()}


def test_lost_pairs_need_only_the_rows_of_their_ids(spark, people, whole):
    rng = random.Random(3)
    theirs = spark.createDataFrame([(f"p{rng.randrange(40)}", f"p{rng.randrange(40)}") for _ in range(900)], "indv_id_a string, indv_id_b string")
    config = MatchConfig()
    some = res.results(people, None, config, among=theirs)
    cand, few = blocking.candidates(people, None, config), blocking.candidates(people, None, config, theirs)
    want = rows(report.lost_pairs(theirs, cand, whole, dedup=True))
    assert rows(report.lost_pairs(theirs, few, some, dedup=True)) == want and 0 < few.count() < cand.count()


@pytest.mark.parametrize("levels", [LEVELS, LEVELS[:1]])
def test_bounds_are_short_enough_to_be_compiled(spark, people, levels):
    config = MatchConfig()
    a = res.lettered(people)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for number, _, pairs in blocking.all_passes(a, None, config)[2:]:
            can = possible(int(number), config.comp_names_by_pass[int(number)], config, levels, {"fname", "lname"})
            made = pairs.where((F.col("a_idx") < F.col("b_idx")) & can).hint("merge").selectExpr("count(1)")
            code = spark._jvm.PythonSQLUtils.explainString(made._jdf.queryExecution(), "codegen")
            assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
