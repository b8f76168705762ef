"""Candidate pairs by equality of keys, in passes. Every pass is one equi-join; pairs of earlier passes are excluded by a
predicate on the two rows, so that all passes are independent and one lazy union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.config import MatchConfig
from kinforge.session import stash

INVERTED = "_inv"


def pass_keys(block: list[str], columns: dict[str, str]) -> list[tuple[str, str]]:
    """(column of a, column of b) for each blocking variable; inverted variables meet in the opposite order."""
    if block and all(v.endswith(INVERTED) for v in block):
        plain = [v[: -len(INVERTED)] for v in block]
        return [(columns.get(x, x), columns.get(y, y)) for x, y in zip(plain, reversed(plain))]
    return [(columns.get(v, v), columns.get(v, v)) for v in block]


def block_condition(keys: list[tuple[str, str]]) -> Column:
    """Every key is equal, not empty and not NULL on side a."""
    parts = [(F.col(f"a_{x}") == F.col(f"b_{y}")) & (F.col(f"a_{x}") != "") & F.col(f"a_{x}").isNotNull() for x, y in keys]
    return reduce(lambda p, q: p & q, parts)


def side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def _present(df: DataFrame, keys: list[str]) -> bool:
    return set(keys) <= set(df.columns)


def pass_pairs(a: DataFrame, b: DataFrame, keys: list[tuple[str, str]], past: list[Column], dedup: bool, null_safe: bool = False, met: DataFrame | None = None) -> DataFrame:
    """All columns of both sides for the pairs of one pass. In dedup a pair comes once, the smaller idx first, and never
    with one individual id twice. Equality keys are plain join keys, so the planner picks the join and splits hot keys. met: the
    pairs of rows to choose from, instead of all."""
    condition = block_condition(keys)
    if past:
        earlier = reduce(lambda p, q: p | q, past)
        condition = condition & ~(F.coalesce(earlier, F.lit(False)) if null_safe else earlier)
    if dedup:
        condition = condition & (F.col("a_idx") < F.col("b_idx")) & (F.col("a_indv_id") != F.col("b_indv_id"))
    return side(a, "a").join(side(b, "b"), condition, "inner") if met is None else met.where(condition)


def rows_among(a: DataFrame, b: DataFrame, among: DataFrame, dedup: bool) -> DataFrame:
    """All columns of both sides for the rows whose ids are a pair (indv_id_a, indv_id_b) of among; in dedup in either direction."""
    asked = among.select(F.col("indv_id_a").alias("_x"), F.col("indv_id_b").alias("_y"))
    asked = (asked.unionByName(asked.select(F.col("_y").alias("_x"), F.col("_x").alias("_y"))) if dedup else asked).distinct()
    left = side(a, "a").join(asked, F.col("a_indv_id") == F.col("_x"))
    return left.join(side(b, "b"), F.col("_y") == F.col("b_indv_id")).drop("_x", "_y")


def all_passes(a: DataFrame, b: DataFrame | None, config: MatchConfig, among: DataFrame | None = None) -> list[tuple[str, int, DataFrame]]:
    """(passnum, order, pairs) of the ground-truth passes and of every pass whose variables both sides have; among: only of
    rows whose ids are a pair there, which are then joined and written once for all passes."""
    b = a if b is None else b
    met = None if among is None else stash(rows_among(a, b, among, config.dedup), "among")
    past: list[Column] = []
    out = []
    for gid in config.ground_truth_ids:
        if _present(a, [gid]) and _present(b, [gid]):
            out.append((f"dup_{gid}", -1, pass_pairs(a, b, [(gid, gid)], past, config.dedup, config.null_safe_exclusion, met)))
            past = [*past, block_condition([(gid, gid)])]
    for number, block in enumerate(config.blocks_by_pass):
        if not block:
            past = [] if config.reset_on_empty_pass else past
            continue
        keys = pass_keys(block, config.block_columns)
        if not (_present(a, [x for x, _ in keys]) and _present(b, [y for _, y in keys])):
            continue
        out.append((str(number), number, pass_pairs(a, b, keys, past, config.dedup, config.null_safe_exclusion, met)))
        past = [*past, block_condition(keys)]
    return out


def candidates(a: DataFrame, b: DataFrame | None, config: MatchConfig, among: DataFrame | None = None) -> DataFrame:
    """(passnum, pass_order, indv_id_a, indv_id_b, idx_a, idx_b) of all passes, among: only between ids that are a pair there."""
    ids = lambda p, o, df: df.select(F.lit(p).alias("passnum"), F.lit(o).alias("pass_order"), *[F.col(f"{s}_{c}").alias(f"{c}_{s}") for c in ("indv_id", "idx") for s in ("a", "b")])
    frames = [ids(*x) for x in all_passes(a, b, config, among)]
    if not frames:
        raise ValueError("no blocking pass has its variables on both sides")
    return reduce(DataFrame.unionByName, frames)
