import random

import pytest
from pyspark.sql import functions as F

from kinforge.config import DatasetSpec, MatchConfig
from kinforge.functions.similarity import compare, jaro_winkler_text
from kinforge.operators import blocking, preprocess, report, resolve
from kinforge.operators.results import counts, first_per_pair, results

PAIRS = "indv_id_a string, indv_id_b string, weight double, passnum string, pass_order int, idx_a long, idx_b long, match_strict boolean"


def pairs(spark, rows):
    return spark.createDataFrame([(str(a), str(b), float(w), "2", 2, i, i, True) for i, (a, b, w) in enumerate(rows)], PAIRS)


CASES_121 = [
    ([(1, "x", 9), (2, "x", 8), (2, "y", 7)], {("1", "x"), ("2", "y")}),
    ([(1, "x", 9), (1, "y", 9)], set()),
    ([(1, "x", 9), (1, "y", 9), (1, "z", 9)], set()),
    ([(1, "x", 9), (2, "x", 9)], set()),
    ([(1, "x", 9), (1, "x", 9)], {("1", "x")}),
    ([(9, "y", 10), (1, "x", 7), (1, "y", 7)], set()),
    ([(2, "z", 2), (3, "x", 1), (3, "z", 1)], set()),
    ([], set()),
]


@pytest.mark.parametrize("rows,expected", CASES_121)
def test_one_to_one(spark, rows, expected):
    got = resolve.one_to_one(pairs(spark, rows)).collect()
    assert {(r["indv_id_a"], r["indv_id_b"]) for r in got} == expected


def by_weight(rows):
    """One-to-one matches by definition, weight by weight over sets."""
    entry, free, late = {}, set(), set()
    for w in sorted({w for _, _, w in rows}, reverse=True):
        here = {(("a", str(a)), ("b", b)) for a, b, x in rows if x == w}
        now = {p for p in here if not any(e in entry for e in p)}
        settled = dict.fromkeys((e for p in now for e in p), w)
        late |= {e for p in here - now for e in p if sum(x in settled for x in p) == 1}
        entry.update(settled)
        free |= {p for p in now if sum(p[0] == q[0] or p[1] == q[1] for q in now) == 1}
    return {(a[1], b[1]) for a, b in free if a not in late and b not in late}


@pytest.mark.parametrize("seed", range(3))
def test_one_to_one_is_the_same_in_rounds(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(40), f"b{rng.randrange(40)}", rng.randrange(12)) for _ in range(90)]
    rows += [(100 + i, f"c{i + j}", 2 * i + j) for i in range(8) for j in range(2)]  # a chain of rising weights
    want = by_weight(rows)
    rng.shuffle(rows)
    for most in (200_000, 30, 0):
        got = resolve.one_to_one(pairs(spark, rows), pairs_per_task=most).collect()
        assert {(r["indv_id_a"], r["indv_id_b"]) for r in got} == want and len(got) == len(want)


def test_one_to_one_nulls_and_passes(spark):
    rows = [("1", "x", 9.0, "3", 3, 0, 0, True), ("1", "x", 9.0, "1", 1, 0, 0, True), (None, "x", 10.0, "1", 1, 0, 0, True), ("2", "y", None, "1", 1, 0, 0, True), ("3", "z", 5.0, "1", 1, 0, 0, False), ("4", "w", 5.0, "1", 1, 0, 0, None)]
    assert sorted(map(tuple, resolve.one_to_one(spark.createDataFrame(rows, PAIRS)).collect())) == [("1", "x", "1"), ("4", "w", "1")]


@pytest.mark.parametrize("rows,expected", [([(1, "x", 9), (2, "x", 9)], set()), ([(1, "x", 9), (2, "x", 8)], {("1", "x")}), ([(1, "x", 9), (1, "y", 5)], {("1", "x"), ("1", "y")}), ([], set())])
def test_best_unique(spark, rows, expected):
    assert {(r[0], r[1]) for r in resolve.best_unique(pairs(spark, rows), "a").collect()} == expected
    turned = [(b, a, w) for a, b, w in rows]
    assert {(r[1], r[0]) for r in resolve.best_unique(pairs(spark, turned), "b").collect()} == expected


def test_many_to_many(spark):
    got = resolve.many_to_many(pairs(spark, [(1, "x", 1), (2, "x", 1), (2, "y", 1), (3, "z", 1)])).collect()
    groups = {(r["indv_id_a"], r["indv_id_b"]): r["ch_id"] for r in got}
    assert len(groups) == 4 and len(set(groups.values())) == 2 and groups["1", "x"] == groups["2", "y"] != groups["3", "z"]


def test_dedup_keeps_singletons(spark):
    ids = spark.createDataFrame([(str(i),) for i in range(1, 6)] + [(None,)], "indv_id string")
    got = {r["orig_id"]: r["ch_id"] for r in resolve.dedup(pairs(spark, [(1, 2, 1), (3, 4, 1), (2, 3, 1)]), ids).collect()}
    assert got == {"1": 0, "2": 0, "3": 0, "4": 0, "5": 1}
    assert resolve.dedup(pairs(spark, []), ids).count() == 5


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(1)
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)] + [("hub", f"h{i}") for i in range(50)]
    rng.shuffle(edges)
    edges += [("alone", "alone"), (None, "c001"), (" c001", "c000 "), ("c001", "c001")]
    for most in (400_000, 0):
        got = resolve.components(spark.createDataFrame(edges, "x string, y string"), "x", "y", most).collect()
        roots = {r["node"]: r["root"] for r in got}
        assert len(got) == len(roots) == 121 + 51 + 1 and roots["alone"] == "alone"
        assert {v for k, v in roots.items() if k.startswith("c")} == {"c000"} and len(set(roots.values())) == 3


def people(spark, rows):
    names = ("idx", "indv_id", "common_id", "fname", "mname", "lname", "altlname", "xf", "xl", "byear", "bmonth", "bday", "zipcode", "county")
    df = spark.createDataFrame(rows, "idx long, " + ", ".join(f"{n} string" for n in names[1:]))
    return preprocess.match_input(df)


ROWS = [
    (0, "p0", "123456789", "ANNA", "MAY", "SMITH", None, "A5", "S53", "1980", "5", "6", "60601", "1"),
    (1, "p1", "123456789", "ANNA", "M", "SMITH", None, "A5", "S53", "1980", "5", "6", "60601", "1"),
    (2, "p2", "", "SMITH", "", "ANNA", None, "S53", "A5", "1980", "5", "6", "60601", "1"),
    (3, "p3", None, "BOB", "", "JONES", "", "B1", "J52", "1980", "5", "6", "", ""),
    (4, "p4", "", "", "", "", "", "", "", "", "", "", "", ""),
    (5, "p0", "123456789", "ANN", "MAY", "SMITH", None, "A5", "S53", "1980", "6", "5", "60601", "1"),
]


def test_blocking_and_results(spark):
    a = people(spark, ROWS)
    got = blocking.candidates(a, None, MatchConfig()).collect()
    seen = [(r["idx_a"], r["idx_b"]) for r in got]
    assert all(x < y for x, y in seen) and (0, 5) not in seen and len(seen) == len(set(seen))
    found = results(a, None, MatchConfig())
    rows = {(r["idx_a"], r["idx_b"]): r for r in found.collect()}
    assert rows[0, 1]["passnum"] == "0" and rows[0, 1]["match_strict"] and rows[0, 1]["weight"] == 100004
    assert rows[0, 2]["passnum"] == "3" and rows[0, 2]["fnamelname"] == 1
    for r in rows.values():
        flags = [r[f"match_{x}"] for x in ("strict", "moderate", "relaxed", "review")]
        assert flags == sorted(flags) and flags[-1]
    total = {(r["passnum"], r["strictness"]): r["n_matches"] for r in counts(found).collect()}
    assert total["all", "review"] == len(rows)
    assert first_per_pair(found).count() == len({(r["indv_id_a"], r["indv_id_b"]) for r in rows.values()})


def test_null_logic_of_exclusion(spark):
    a = people(spark, [(0, "a", "1", "X", "", "Y", "", "X1", "Y1", "1", "1", "1", "", "")])
    b = people(spark, [(0, "b", None, "X", "", "Y", "", "X1", "Y1", "1", "1", "1", "", "")])
    config = MatchConfig(match_type="M2M", blocks_by_pass=[["common_id"], ["xf", "xl"]], comp_names_by_pass=[[], []])
    assert blocking.candidates(a, b, config).count() == 0
    config.null_safe_exclusion = True
    assert blocking.candidates(a, b, config).count() == 1
    config.blocks_by_pass, config.reset_on_empty_pass = [["xf", "xl"], [], ["xf"]], True
    assert [r["passnum"] for r in blocking.candidates(a, b, config).collect()] == ["0", "2"]


def test_similarities(spark):
    assert jaro_winkler_text("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4) and jaro_winkler_text("", "A") == 0
    df = spark.createDataFrame([(None, "A", 1.0, 2.0, 3.0, 4.0)], "a_x string, b_x string, a_bmonth double, a_bday double, b_bmonth double, b_bday double")
    row = df.select(
        compare("x", {"comparer": "jarowinkler", "missing_value": -1}).alias("n"),
        compare("bmonthbday", MatchConfig().sim_param["bmonthbday"]).alias("d"),
    ).first()
    assert row["n"] == -1 and row["d"] == 0
    with pytest.raises(ValueError):
        compare("x", {"comparer": "nothing", "missing_value": 0})


def test_reports(spark):
    a = people(spark, ROWS)
    found = results(a, None, MatchConfig())
    sample = report.review_sample(found, 2)
    text = report.review_text(report.review_records(sample, a))
    assert "== cutoff" in text and "ANNA" in text
    assert report.review_text(report.review_records(sample.limit(0), a)) == ""
    xwalk = resolve.dedup(found, a)
    row = report.dedup_rate(xwalk, "strict").first()
    assert row["n_total"] == 5 and row["n_unique"] + row["n_duplicates"] == 5
    joined = report.join_to_original(a.select("indv_id", "fname"), xwalk, "indv_id", "orig_id", "ch_id")
    assert joined.count() == 6


def test_preparation(spark):
    raw = spark.createDataFrame([("Ann Lee", "m", "Smith/Jones", "2001-02-03", "606011234", "0"), ("Ann Lee", "m", "Smith/Jones", "2001-02-03", "606011234", "0"), (None, None, None, "x", None, None)], "f string, m string, l string, d string, z string, c string")
    spec = preprocess.PreprocessSpec(vars={"fname": "f", "mname": "m", "lname": "l", "zipcode": "z", "common_id": "c"}, dob="d", year="2020", file_num="001", bad_values={"ids": ["0"]}, other_ids=["common_id"])
    rows = preprocess.preprocess(raw, spec).collect()
    one = [r for r in rows if r["lname"] == "SMITH"]
    assert {r["altlname"] for r in one} == {"JONES"} and one[0]["zipcode"] == "60601" and one[0]["bmonth"] == "2" and one[0]["common_id"] == ""
    assert any(r["lname"] == "JONES" and r["altlname"] is None for r in rows)
    assert len({r["source_id"] for r in rows}) == 3
    both = preprocess.combine([raw, raw.withColumn("extra", F.lit("1"))])
    assert sorted(r["idx"] for r in both.collect()) == list(range(4))
    words = preprocess.middle_aliases(spark.createDataFrame([(1, "A B"), (2, None), (3, "")], "i int, mname string")).collect()
    assert sorted((r[0], r[1] or "") for r in words) == [(1, "A"), (1, "A B"), (1, "B"), (2, ""), (3, "")]


def test_config_round_trip():
    config = MatchConfig(datasets=[DatasetSpec("a", "/x", vars={"fname": "f"}, fwf_widths=(1, 2))])
    assert MatchConfig.from_json(config.to_json()) == config
    with pytest.raises(ValueError):
        MatchConfig(match_type="other")


def test_sources_and_run(spark, tmp_path):
    from kinforge.plans.pipeline import run
    from kinforge.sources.files import import_prepared, load_dataset, read_crosswalk, read_pair_lines

    (tmp_path / "p.txt").write_text("ANN  Smith19800102\nBOB  Jones19810203\n")
    fixed = DatasetSpec("f", str(tmp_path / "p.txt"), "fwf", {"fname": "f", "lname": "l", "dob_str": "d"}, (5, 5, 8), ("f", "l", "d"))
    rows = import_prepared(spark, fixed, "dob_str").orderBy("idx").collect()
    assert [(r["fname"], r["byear"], r["idx"]) for r in rows] == [("ANN", 1980.0, 0), ("BOB", 1981.0, 1)]
    with pytest.raises(ValueError):
        load_dataset(spark, DatasetSpec("x", "y", "nothing"))
    people(spark, ROWS).drop("byear_txt", "bmonth_txt", "bday_txt").write.parquet(str(tmp_path / "a"))
    made = run(spark, MatchConfig(datasets=[DatasetSpec("a", str(tmp_path / "a"))]), str(tmp_path / "out"))
    assert made["rates"].count() == 4 and spark.read.parquet(str(tmp_path / "out/crosswalk_strict")).count() == 5
    (tmp_path / "x.csv").write_text("1, a\n2,b\n")
    assert read_crosswalk(spark, str(tmp_path / "x.csv"), ["p", "q"]).first()["q"] == "a"
    (tmp_path / "d.dat").write_text("xx0002yy0001\n")
    assert tuple(read_pair_lines(spark, str(tmp_path / "d.dat"), (2, 6), (8, 12), dedup=True).first()) == ("0001", "0002")
