"""Every command once, on small files."""

import json
import warnings

import pytest
from pyspark.sql import functions as F

from kinforge.__main__ import main
from kinforge.config import DatasetSpec, MatchConfig
from kinforge.operators import report
from kinforge.operators.preprocess import PreprocessSpec, preprocess
from kinforge.operators.results import results
from kinforge.sources import files

LINES = ["id,first,middle,last,zip,born,extra"]
LINES += ["1,Anna Lee,,Quill,606011234,1980-02-03,a", "1,Anna Lee,,Quill,606011234,1980-02-03,a", "2,Anna,Lee,Quil,60601,1980-02-03,b", "3,Bo,,Vane Jr,60602,1990-07-08,c", "4,,,,,x,"]
VARS = {"source_id": "id", "fname": "first", "mname": "middle", "lname": "last", "zipcode": "zip", "byear": "born", "bmonth": "born", "bday": "born"}
MATCH = {"indv_id": "source_id", "idx": "idx", **{c: c for c in ("fname", "mname", "lname", "altlname", "minitial", "xf", "xl", "byear", "bmonth", "bday", "zipcode", "county")}}


def run(tmp_path, command, config, *more):
    path = tmp_path / f"{command}.json"
    path.write_text(config if isinstance(config, str) else json.dumps(config))
    main([command, "-c", str(path), "-o", str(tmp_path / "out"), *more])


@pytest.fixture(scope="module")
def out(spark, tmp_path_factory):
    """The results of preprocess and of match, resolve and rates for M21 and dedup."""
    tmp = tmp_path_factory.mktemp("commands")
    (tmp / "raw.csv").write_text("\n".join(LINES) + "\n")
    source = {"dataset": {"name": "a", "path": str(tmp / "raw.csv"), "filetype": "csv"}, "spec": {"vars": VARS, "aliases": False}}
    run(tmp, "preprocess", {"name": "a", "sources": [source]})
    run(tmp, "preprocess", {"name": "b", "sources": [], "earlier_tables": [str(tmp / "out/a")], "earlier_csvs": [str(tmp / "out/preprocess_a.csv")]})
    return tmp


def test_preprocess(spark, out):
    rows = spark.read.parquet(str(out / "out/a")).orderBy("source_id").collect()
    assert [(r["source_id"], r["fname"], r["mname"], r["lname"], r["suffix"], r["zipcode"], r["byear"]) for r in rows] == [("1", "ANNA", "LEE", "QUILL", "", "60601", "1980"), ("2", "ANNA", "LEE", "QUIL", "", "60601", "1980"), ("3", "BO", "", "VANE", "JR", "60602", "1990"), ("4", "", "", "", "", "", "")]
    assert sorted(r["idx"] for r in rows) == [0, 1, 2, 3]
    assert {r["source_id"] for r in files.read_csv(spark, str(out / "out/preprocess_b.csv")).collect()} == {"1", "2", "3", "4"}


def config(out, match_type):
    names = ("a", "b") if match_type != "dedup" else ("a",)
    return MatchConfig(match_type=match_type, datasets=[DatasetSpec(n, str(out / f"out/{n}"), vars=MATCH) for n in names]).to_json()


@pytest.mark.parametrize("match_type", ["dedup", "M21"])
def test_match_to_rates(spark, out, match_type):
    text = config(out, match_type)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        run(out, "block", text)
        run(out, "match", text, "--csv")
    assert spark.read.parquet(str(out / "out/candidates")).count() > 0
    weights = [float(r["weight"]) for r in files.read_csv(spark, str(out / "out/match_results_with_pairwise_scores")).collect()]
    assert weights == sorted(weights, reverse=True) and weights
    run(out, "resolve", text)
    other = spark.read.parquet(str(out / "out/crosswalk_strict"))
    other.select(other.columns[:2]).write.mode("overwrite").csv(str(out / "theirs"))
    run(out, "rates", text, "--other", str(out / "theirs"))
    assert files.read_csv(spark, str(out / "out/rates")).count() == 4
    compared = files.read_csv(spark, str(out / "out/compared")).first()
    assert int(compared["n_both"]) == other.count() and compared["n_theirs_only"] == "0"
    for dataset in range(1 if match_type == "dedup" else 2):
        run(out, "join", text, "-d", str(dataset), "--csv")
        name = "ab"[dataset]
        assert {r["source_id"] for r in files.read_csv(spark, str(out / f"out/joined_{name}.csv")).collect()} == {"1", "2", "3", "4"}
    run(out, "review", text)
    assert "cutoff" in (out / "out/review.txt").read_text()


def test_import(spark, out):
    (out / "prepared.txt").write_text("X1ANNA 19800203\nX2BO   19900708\n")
    spec = {"name": "p", "path": str(out / "prepared.txt"), "filetype": "fwf", "vars": {"indv_id": "i", "fname": "f", "dob_str": "d"}, "fwf_widths": [2, 5, 8], "fwf_names": ["i", "f", "d"]}
    run(out, "import", {"dataset": spec, "dob_text": "dob_str"})
    assert [(r["idx"], r["indv_id"], r["byear"], r["bday"]) for r in spark.read.parquet(str(out / "out/p")).orderBy("idx").collect()] == [(0, "X1", 1980.0, 3.0), (1, "X2", 1990.0, 8.0)]


def test_run(spark, out):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        run(out, "run", config(out, "dedup"))
    assert spark.read.parquet(str(out / "out/crosswalk_review")).count() == 4


def test_latest(spark, tmp_path):
    for name in ("crosswalk_a_strict_1", "crosswalk_a_strict_2", "crosswalk_a_review_3"):
        (tmp_path / name).write_text("x")
    import os

    os.utime(tmp_path / "crosswalk_a_strict_1", (10, 10))
    os.utime(tmp_path / "crosswalk_a_strict_2", (20, 20))
    assert files.latest(spark, str(tmp_path), "crosswalk", "strict").endswith("crosswalk_a_strict_2")
    with pytest.raises(FileNotFoundError):
        files.latest(spark, str(tmp_path), "dedup")


def test_groups_and_excel_and_jdbc_options(spark, tmp_path):
    groups = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "group_id long, item string")
    files.save_groups(groups, str(tmp_path / "g"))
    assert sorted((r[0], r[1] or "") for r in files.load_groups(spark, str(tmp_path / "g")).collect()) == [("1", "a"), ("1", "b"), ("2", "")]
    pd = pytest.importorskip("pandas")
    pytest.importorskip("openpyxl")
    pd.DataFrame({"a": ["1"], "b": [None]}).to_excel(tmp_path / "x.xlsx", index=False)
    assert files.read_excel(spark, str(tmp_path / "x.xlsx"), ["a", "b", "a"]).collect() == [("1", None)]


def test_rules_of_a_run_and_warnings(spark, tmp_path):
    (tmp_path / "accept_functions.py").write_text("def accept_p2_strict(scores):\n    return scores.is_one('fname')\n")
    person = "idx long, indv_id string, fname string, lname string, xf string, xl string"
    a = spark.createDataFrame([(0, "a", "ANN", "QUILL", "A5", "Q4")], person)
    b = spark.createDataFrame([(0, "b", "ANN", "QUALE", "A5", "Q4")], person)
    made = dict(match_type="M2M", blocks_by_pass=[[], [], ["xf", "xl"]], comp_names_by_pass=[[], [], ["fname", "lname", "county"]])
    with pytest.warns(UserWarning, match="county"):
        assert not results(a, b, MatchConfig(**made)).where("match_strict").count()
    assert results(a, b, MatchConfig(**made, rules_path=str(tmp_path))).first()["match_strict"]
    assert not results(a, b, MatchConfig(**made)).where("match_strict").count()


def test_parity_switches(spark):
    raw = spark.createDataFrame([("1", "Ann Jr", "Quill")], "i string, f string, l string")
    vars = {"source_id": "i", "fname": "f", "lname": "l"}
    assert preprocess(raw, PreprocessSpec(vars)).first()["suffix"] == "JR"
    assert preprocess(raw, PreprocessSpec(vars, suffix_of_last_only=True)).first()["suffix"] is None
    from kinforge.functions.similarity import compare

    pair = spark.createDataFrame([("", "")], "a_zipcode string, b_zipcode string")
    score = lambda c: pair.select(compare("zipcode", c.params("zipcode"))).first()[0]
    assert score(MatchConfig()) == 0.5 and score(MatchConfig(empty_equals_empty=True)) == 1
    assert PreprocessSpec.from_json(PreprocessSpec(vars).to_json()) == PreprocessSpec(vars)


def test_final_matches_and_widths(spark):
    pairs = spark.createDataFrame([("1", "x", 7), ("2", "x", 7)], "indv_id_a string, indv_id_b string, ch_id long")
    got = lambda x, t: sorted(map(tuple, report.final_matches(x, t).collect()))
    assert got(pairs, "M21") == [("1", "x"), ("2", "x")] and got(pairs, "12M") == [("x", "1"), ("x", "2")]
    assert got(pairs, "M2M") == [(7, "1_a"), (7, "2_a"), (7, "x_b")]
    dedup = spark.createDataFrame([("1", 7), ("2", 7), ("2", 7), ("3", 8)], "orig_id string, ch_id long")
    assert got(dedup, "dedup") == [(7, "1"), (7, "2")]
    assert tuple(report.widths(dedup.withColumn("note", F.lit("x" * 9))).first()) == (7, 5, 9)
    assert tuple(report.widths(dedup.limit(0)).first()) == (7, 5)
