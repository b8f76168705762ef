"""Reports on a run: rates, review samples, joins back to the data, comparison with another matcher's result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinforge.config import LEVELS

STEPS = (("strict", "moderate"), ("moderate", "relaxed"), ("relaxed", "review"))


def match_rate(xwalk: DataFrame, ids: DataFrame, id_col: str, strictness: str) -> DataFrame:
    """(strictness, n_total, n_matched, n_unmatched, rate) of a 121, 12M or M21 crosswalk; rate in percent."""
    total = ids.agg(F.countDistinct(id_col).alias("n_total"))
    matched = xwalk.agg(F.count("*").alias("n_matched"))
    both = total.join(matched)
    rate = F.when(F.col("n_total") > 0, F.round(F.col("n_matched") * 100.0 / F.col("n_total"), 2))
    return both.select(F.lit(strictness).alias("strictness"), "n_total", "n_matched", (F.col("n_total") - F.col("n_matched")).alias("n_unmatched"), rate.alias("rate"))


def dedup_rate(xwalk: DataFrame, strictness: str) -> DataFrame:
    """(strictness, n_total, n_unmatched, n_unique, n_duplicates, rate) of a dedup crosswalk."""
    sizes = xwalk.groupBy("ch_id").agg(F.countDistinct("orig_id").alias("size"))
    sums = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n_total"), F.count_if(F.col("size") == 1).alias("n_unmatched"), F.count("*").alias("n_unique"))
    duplicates = F.col("n_total") - F.col("n_unique")
    rate = F.when(F.col("n_total") > 0, F.round(duplicates * 100.0 / F.col("n_total"), 2))
    return sums.select(F.lit(strictness).alias("strictness"), "n_total", "n_unmatched", "n_unique", duplicates.alias("n_duplicates"), rate.alias("rate"))


def group_sizes(xwalk: DataFrame) -> DataFrame:
    return xwalk.groupBy("ch_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_groups"))


def final_matches(xwalk: DataFrame, match_type: str) -> DataFrame:
    """A written crosswalk as matches: (id, match) for 121 and M21 by side a, for 12M by side b; (group_id, id) for M2M, ids marked by
    their side, and for dedup, groups of more than one id."""
    if match_type in ("121", "M21"):
        return xwalk.select(F.col("indv_id_a").alias("id"), F.col("indv_id_b").alias("match"))
    if match_type == "12M":
        return xwalk.select(F.col("indv_id_b").alias("id"), F.col("indv_id_a").alias("match"))
    if match_type == "M2M":
        ends = F.array(F.concat("indv_id_a", F.lit("_a")), F.concat("indv_id_b", F.lit("_b")))
        return xwalk.select(F.col("ch_id").alias("group_id"), F.explode(ends).alias("id")).distinct()
    several = xwalk.groupBy("ch_id").agg(F.countDistinct("orig_id").alias("n")).where("n > 1").select("ch_id")
    return xwalk.join(several, "ch_id").select(F.col("ch_id").alias("group_id"), F.col("orig_id").alias("id")).distinct()


def widths(df: DataFrame) -> DataFrame:
    """One row: the greatest length of each column's values as text, at least that of its name."""
    return df.agg(*[F.greatest(F.lit(len(c)), F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0))).alias(c) for c in df.columns])


def rates(per_level: dict[str, DataFrame]) -> DataFrame:
    """One row for each level, of match_rate or dedup_rate results."""
    return reduce(DataFrame.unionByName, per_level.values())


def join_to_original(original: DataFrame, xwalk: DataFrame, id_col: str, xwalk_id: str, new_id: str) -> DataFrame:
    """original with the crosswalk's new id for each row; rows without match stay, several matches fan out."""
    links = xwalk.select(F.col(xwalk_id).alias("_id"), F.col(new_id).alias(f"new_{new_id}")).distinct()
    return original.join(links, original[id_col] == F.col("_id"), "left").drop("_id")


def review_sample(found: DataFrame, size: int = 100) -> DataFrame:
    """Around each cutoff and in each pass: the size lightest pairs of the stricter level (side 'in') and the size heaviest
    that only the laxer level accepts ('out'). found is read once, each pair under the at most three cutoffs that it is near;
    two-stage top-k: every partition keeps its best before the windows meet."""
    near = []
    for stricter, laxer in STEPS:
        inside, outside = F.col(f"match_{stricter}"), F.col(f"match_{laxer}") & ~F.col(f"match_{stricter}")
        key = F.when(inside, F.col("weight")).when(outside, -F.col("weight"))
        near.append(F.struct(F.lit(f"{stricter}_{laxer}").alias("cutoff"), F.when(inside, "in").otherwise("out").alias("side"), key.alias("_key")))
    ids = ("indv_id_a", "indv_id_b", "idx_a", "idx_b")
    each = found.select("passnum", "weight", *ids, F.inline(F.array(*near))).where("_key is not null")
    order = ("_key", *ids)
    each = each.withColumn("_part", F.spark_partition_id())
    best = F.row_number().over(Window.partitionBy("cutoff", "side", "passnum", "_part").orderBy(*order))
    some = each.withColumn("_r", best).where(F.col("_r") <= size)
    rank = F.row_number().over(Window.partitionBy("cutoff", "side", "passnum").orderBy(*order))
    return some.withColumn("rank", rank).where(F.col("rank") <= size).select("cutoff", "side", "passnum", "rank", "weight", *ids)


def review_records(sample: DataFrame, a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """Two rows for each sampled pair: the records of a and b, one under the other. The sample is joined from its own side,
    small as it is."""
    b = a if b is None else b
    shared = [c for c in a.columns if c in b.columns and c not in ("idx", "indv_id")]
    keys = ["cutoff", "side", "passnum", "rank"]
    one = lambda s, df: sample.select(*keys, F.col(f"idx_{s}").alias("idx")).join(df.select("idx", "indv_id", *[F.col(c).cast("string").alias(c) for c in shared]), "idx").withColumn("record", F.lit(s))
    return one("a", a).unionByName(one("b", b)).select(*keys, "record", "idx", "indv_id", *shared)


def review_text(records: DataFrame) -> str:
    """The sample as a text of fixed-width columns with a header for each pass; the sample is bounded by its size."""
    rows = records.orderBy("cutoff", "passnum", F.col("side").desc(), "rank", "record").collect()
    if not rows:
        return ""
    names = [c for c in records.columns if c not in ("cutoff", "passnum")]
    text = [[("" if r[c] is None else str(r[c])) for c in names] for r in rows]
    width = [max(len(n), *(len(t[i]) for t in text)) for i, n in enumerate(names)]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, width)).rstrip()
    out, held = [], None
    for r, t in zip(rows, text):
        here = (r["cutoff"], r["passnum"])
        if here != held:
            out += ["", f"== cutoff {r['cutoff']}, pass {r['passnum']} ==", line(names)]
        elif side != r["side"]:
            out.append("-" * 10 + " cutoff " + "-" * 10)
        held, side = here, r["side"]
        out.append(line(t))
    return "\n".join(out).lstrip("\n") + "\n"


def compare_crosswalks(ours: DataFrame, theirs: DataFrame, cols: list[str]) -> DataFrame:
    """(n_both, n_ours_only, n_theirs_only, share_of_theirs) over distinct rows of cols."""
    x = ours.select(*cols).distinct().withColumn("_o", F.lit(1))
    y = theirs.select(*cols).distinct().withColumn("_t", F.lit(1))
    both = x.join(y, cols, "full").agg(F.count_if(F.col("_o").isNotNull() & F.col("_t").isNotNull()).alias("n_both"), F.count_if(F.col("_t").isNull()).alias("n_ours_only"), F.count_if(F.col("_o").isNull()).alias("n_theirs_only"))
    total = F.col("n_both") + F.col("n_theirs_only")
    return both.withColumn("share_of_theirs", F.when(total > 0, F.round(F.col("n_both") * 100.0 / total, 2)))


def lost_pairs(theirs: DataFrame, candidates: DataFrame, found: DataFrame, dedup: bool = False) -> DataFrame:
    """(strictness, n_lost): pairs of another matcher that were candidates but that a level didn't accept."""
    canon = lambda df: df.select(F.least("indv_id_a", "indv_id_b").alias("x"), F.greatest("indv_id_a", "indv_id_b").alias("y")).distinct() if dedup else df.select(F.col("indv_id_a").alias("x"), F.col("indv_id_b").alias("y")).distinct()
    tried = canon(theirs).join(canon(candidates), ["x", "y"], "left_semi")
    frames = [tried.join(canon(found.where(F.col(f"match_{level}"))), ["x", "y"], "left_anti").agg(F.count("*").alias("n_lost")).withColumn("strictness", F.lit(level)) for level in LEVELS]
    return reduce(DataFrame.unionByName, frames).select("strictness", "n_lost")
