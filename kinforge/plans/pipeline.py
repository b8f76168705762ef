"""A whole run: load, block, score, accept, resolve, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinforge.config import LEVELS, MatchConfig
from kinforge.operators.preprocess import match_input
from kinforge.operators.report import dedup_rate, match_rate, rates
from kinforge.operators.resolve import crosswalk
from kinforge.operators.results import counts, ordered, results
from kinforge.session import stash
from kinforge.sources.files import load_dataset, write_csv, write_table


def crosswalks(found: DataFrame, a: DataFrame, config: MatchConfig) -> dict[str, DataFrame]:
    """The crosswalk of each level."""
    return {level: stash(crosswalk(found, config.match_type, level, a.select("indv_id")), "crosswalk") for level in LEVELS}


def level_rates(made: dict[str, DataFrame], a: DataFrame, b: DataFrame | None, config: MatchConfig) -> DataFrame | None:
    """One row for each level; None for M2M, which has no rate."""
    if config.match_type == "M2M":
        return None
    if config.dedup:
        return rates({level: dedup_rate(x, level) for level, x in made.items()})
    many = b if config.match_type == "12M" else a
    return rates({level: match_rate(x, many, "indv_id", level) for level, x in made.items()})


def run(spark: SparkSession, config: MatchConfig, out: str | None = None) -> dict[str, DataFrame]:
    """results, counts, crosswalk_<level> and rates; written under out if it is given.

    Results are written once (stash) because every level is resolved from them."""
    sides = [match_input(load_dataset(spark, d)) for d in config.datasets]
    a, b = sides[0], sides[1] if len(sides) > 1 else None
    found = stash(results(a, b, config), "results")
    made = {"results": ordered(found), "counts": counts(found)}
    per_level = crosswalks(found, a, config)
    made |= {f"crosswalk_{level}": x for level, x in per_level.items()}
    rated = level_rates(per_level, a, b, config)
    if rated is not None:
        made["rates"] = rated
    if out:
        for name, df in made.items():
            (write_csv if name == "rates" else write_table)(df, f"{out}/{name}")
    return made
