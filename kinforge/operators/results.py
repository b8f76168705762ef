"""Scored, accepted and weighted pairs of all passes in one schema, and counts over them."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinforge.config import LEVELS, MatchConfig
from kinforge.functions.similarity import compare, inputs, letter_columns
from kinforge.operators.accept import flags, level_columns, possible
from kinforge.operators.blocking import all_passes
from kinforge.session import stash

FLAGS = [f"match_{level}" for level in LEVELS]
#: Names of which the letters are written with the sides.
_BOUNDED = ("fname", "lname")


def score_columns(config: MatchConfig) -> list[str]:
    """All comparisons in the order they first occur in the passes."""
    return list(dict.fromkeys(n for names in config.comp_names_by_pass for n in names))


def valid_comparisons(names: list[str], config: MatchConfig, a: DataFrame, b: DataFrame) -> list[str]:
    """The comparisons whose inputs both sides have; a warning names the others."""
    ok = []
    for n in names:
        left, right = inputs(n, config.sim_param[n]["comparer"])
        if set(left) <= set(a.columns) and set(right) <= set(b.columns):
            ok.append(n)
    if len(ok) < len(names):
        warnings.warn(f"comparisons without their columns on both sides are left out: {', '.join(n for n in names if n not in ok)}", stacklevel=2)
    return ok


def weight(config: MatchConfig, order: Column) -> Column:
    """10 to the passes that follow, plus flags, plus scores (-1 counts as 0.5, a comparison not made as 0); ground-truth
    pairs weigh more than any pass. Terms are added in one fixed order, so equal pairs have equal weights."""
    passes = len(config.blocks_by_pass)
    total = F.pow(F.lit(10.0), F.lit(passes) - order)
    for f in FLAGS:
        total = total + F.col(f).cast("double")
    for n in score_columns(config):
        total = total + F.coalesce(F.when(F.col(n) == -1, 0.5).otherwise(F.col(n)), F.lit(0.0))
    return F.when(order < 0, F.lit(10.0 ** (passes + 1))).otherwise(total)


def scored_pass(pairs: DataFrame, passnum: str, order: int, made: list[str], config: MatchConfig) -> DataFrame:
    ids = [F.col(f"{s}_{c}").alias(f"{c}_{s}") for c in ("indv_id", "idx") for s in ("a", "b")]
    scores = [compare(n, config.params(n)).alias(n) for n in made]
    return pairs.select(F.lit(passnum).alias("passnum"), F.lit(order).alias("pass_order"), *ids, *scores)


def lettered(df: DataFrame) -> DataFrame:
    """df, written, with the letters of the names that every pass's bounds read."""
    kinds = dict(df.dtypes)
    return stash(df.withColumns({k: v for c in _BOUNDED if kinds.get(c) == "string" for k, v in letter_columns(c).items()}), "side")


def results(a: DataFrame, b: DataFrame | None, config: MatchConfig, level: str = "review", among: DataFrame | None = None) -> DataFrame:
    """passnum, pass_order, ids, four flags, weight and one column for each comparison: the pairs of all passes that the
    level accepts, among: only those between ids that are a pair there. The sides are written, with the letters of their names; what
    follows is one lazy plan; persist or stash it if several levels are resolved from it.

    Pairs that a pass's rules can't accept, whatever their names' scores are, are left out in the join, before names are compared."""
    frames = []
    asked = LEVELS[: LEVELS.index(level) + 1]
    a, b = lettered(a), None if b is None else lettered(b)
    other = a if b is None else b
    letters = {c for c in _BOUNDED if {f"_letters_{c}"} <= {*a.columns} & {*other.columns}}
    for passnum, order, pairs in all_passes(a, b, config, among):
        made = valid_comparisons(config.comp_names_by_pass[order] if 0 <= order < len(config.comp_names_by_pass) else [], config, a, other)
        if order >= 0 and (can := possible(order, made, config, asked, letters)) is not None:
            pairs = pairs.where((F.col("a_idx") < F.col("b_idx")) & can if config.dedup else can)
        df = scored_pass(pairs, passnum, order, made, config)
        if order < 0:
            df = df.withColumns(dict.fromkeys(FLAGS, F.lit(True)))
        else:
            levels = level_columns(order, made, config)
            df = df.withColumns(levels).where(" or ".join(f"_{x}" for x in asked)).withColumns(flags()).drop(*levels)
        frames.append(df.withColumns({n: F.lit(None).cast("double") for n in score_columns(config) if n not in made}))
    if not frames:
        raise ValueError("no blocking pass has its variables on both sides")
    whole = reduce(DataFrame.unionByName, frames)
    return whole.withColumn("weight", weight(config, F.col("pass_order"))).select("passnum", "pass_order", "indv_id_a", "indv_id_b", "idx_a", "idx_b", *FLAGS, "weight", *score_columns(config))


def counts(found: DataFrame) -> DataFrame:
    """(passnum, strictness, n_matches); passnum 'all' sums over the passes. found is read once: flags are summed by pass, the few
    sums are then turned into rows."""
    sums = found.rollup("passnum").agg(*[F.sum(F.col(f"match_{level}").cast("bigint")).alias(level) for level in LEVELS], F.grouping("passnum").alias("_all"))
    named = sums.where("_all = 0 or strict is not null").select(F.when(F.col("_all") == 1, "all").otherwise(F.col("passnum")).alias("passnum"), *LEVELS)
    return named.unpivot("passnum", LEVELS, "strictness", "n_matches")


def first_per_pair(found: DataFrame) -> DataFrame:
    """The best row of each pair of individual ids: greatest weight, then earliest pass, then smallest row ids."""
    best = Window.partitionBy("indv_id_a", "indv_id_b").orderBy(F.desc("weight"), "pass_order", "idx_a", "idx_b")
    return found.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def ordered(found: DataFrame) -> DataFrame:
    """All pairs, heaviest first, in a total order."""
    return found.orderBy(F.desc("weight"), "pass_order", "indv_id_a", "indv_id_b", "idx_a", "idx_b")
