"""python -m kinforge <command> -c config.json -o folder

preprocess  raw files to one person table, with tables and CSVs of earlier runs     import  a prepared file to a person table
block       candidate pairs only        match   blocking, scores, flags, counts     resolve crosswalks of written matches
run         match, resolve and rates    join    a crosswalk back to a dataset       rates   match rates, other matcher
review      sample of pairs around the cutoffs, as text
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from kinforge.config import LEVELS, DatasetSpec, MatchConfig
from kinforge.operators.blocking import candidates
from kinforge.operators.preprocess import PreprocessSpec, combine, match_input, preprocess
from kinforge.operators.report import compare_crosswalks, join_to_original, review_records, review_sample, review_text
from kinforge.operators.results import counts, results
from kinforge.plans.pipeline import crosswalks, level_rates, run
from kinforge.session import stash
from kinforge.sources.files import earlier, import_prepared, latest, load_dataset, load_raw, read_crosswalk, write_csv, write_scored, write_table


def _sides(spark: SparkSession, config: MatchConfig) -> tuple[DataFrame, DataFrame | None]:
    sides = [match_input(load_dataset(spark, d)) for d in config.datasets]
    return sides[0], sides[1] if len(sides) > 1 else None


def _preprocess(spark: SparkSession, got: argparse.Namespace) -> None:
    """The config holds sources (each a dataset with a spec), earlier_tables and earlier_csvs."""
    given = json.loads(Path(got.config).read_text())
    frames = [preprocess(load_raw(spark, DatasetSpec(**s["dataset"])), PreprocessSpec(**s["spec"])) for s in given.get("sources", [])]
    whole = stash(combine([*frames, *earlier(spark, given.get("earlier_tables", []), given.get("earlier_csvs", []))]), "preprocessed")
    write_table(whole, f"{got.out}/{given['name']}")
    write_csv(whole, f"{got.out}/preprocess_{given['name']}.csv")


def _import(spark: SparkSession, got: argparse.Namespace) -> None:
    given = json.loads(Path(got.config).read_text())
    spec = DatasetSpec(**{**given["dataset"], "fwf_widths": tuple(given["dataset"].get("fwf_widths", ())), "fwf_names": tuple(given["dataset"].get("fwf_names", ()))})
    write_table(import_prepared(spark, spec, given.get("dob_text")), f"{got.out}/{spec.name}")


def _match(spark: SparkSession, got: argparse.Namespace, config: MatchConfig) -> None:
    found = stash(results(*_sides(spark, config), config), "results")
    write_table(found, f"{got.out}/results")
    write_csv(counts(found), f"{got.out}/counts")
    if got.csv:
        write_scored(found, f"{got.out}/match_results_with_pairwise_scores")


def _join(spark: SparkSession, got: argparse.Namespace, config: MatchConfig) -> None:
    xwalk = spark.read.parquet(latest(spark, got.out, "crosswalk", got.strictness))
    second = got.dataset == 1
    spec = config.datasets[got.dataset]
    own, other = ("indv_id_b", "indv_id_a") if second else ("indv_id_a", "indv_id_b")
    key, new = ("orig_id", "ch_id") if config.dedup else (own, "ch_id" if config.match_type == "M2M" else other)
    joined = stash(join_to_original(load_raw(spark, spec), xwalk, spec.vars.get("indv_id", "indv_id"), key, new), "joined")
    write_table(joined, f"{got.out}/joined_{spec.name}")
    if got.csv:
        write_csv(joined, f"{got.out}/joined_{spec.name}.csv")


def _rates(spark: SparkSession, got: argparse.Namespace, config: MatchConfig) -> None:
    made = {level: spark.read.parquet(f"{got.out}/crosswalk_{level}") for level in LEVELS}
    rated = level_rates(made, *_sides(spark, config), config)
    if rated is not None:
        write_csv(rated, f"{got.out}/rates")
    if got.other:
        cols = ["orig_id", "ch_id"] if config.dedup else ["indv_id_a", "indv_id_b"]
        write_csv(compare_crosswalks(made[got.strictness], read_crosswalk(spark, got.other, cols), cols), f"{got.out}/compared")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="kinforge", description="Record linkage on Spark")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("preprocess", "import", "block", "match", "resolve", "run", "join", "rates", "review"):
        p = commands.add_parser(name)
        p.add_argument("-c", "--config", required=True)
        p.add_argument("-o", "--out", required=True)
        p.add_argument("-s", "--strictness", default="strict", choices=LEVELS)
        p.add_argument("-d", "--dataset", type=int, default=0, choices=(0, 1))
        p.add_argument("--csv", action="store_true")
        p.add_argument("--other", help="crosswalk of another matcher, CSV without header")
    got = parser.parse_args(args)
    spark = SparkSession.builder.appName("kinforge").getOrCreate()
    if got.command in ("preprocess", "import"):
        return (_preprocess if got.command == "preprocess" else _import)(spark, got)
    config = MatchConfig.from_json(Path(got.config).read_text())
    if got.command == "block":
        write_table(candidates(*_sides(spark, config), config), f"{got.out}/candidates")
    elif got.command == "match":
        _match(spark, got, config)
    elif got.command == "resolve":
        for level, xwalk in crosswalks(spark.read.parquet(f"{got.out}/results"), _sides(spark, config)[0], config).items():
            write_table(xwalk, f"{got.out}/crosswalk_{level}")
    elif got.command == "run":
        run(spark, config, got.out)
    elif got.command == "join":
        _join(spark, got, config)
    elif got.command == "rates":
        _rates(spark, got, config)
    else:
        sample = review_sample(spark.read.parquet(f"{got.out}/results"))
        Path(f"{got.out}/review.txt").write_text(review_text(review_records(sample, *_sides(spark, config))))
    return None


if __name__ == "__main__":
    main()
