"""Complete per-key results when a few keys hold most rows.

Nothing here gathers the rows of a key: counts, latest rows and distinct persons are partial aggregates on a finer
key first, and quantiles are found by distributed exact selection. A selection round counts rows per (key, bin of the value), a
mergeable histogram of at most 2**bits bins a key, finds for every wanted rank the bin that holds it, and the next round
splits only these bins. A rank is resolved once its bin holds a single value. Rows meet the wanted bins by a join on
(key, bin), so a hot key's rows are spread over its bins.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinforge.session import stash

#: Bits of the value that one round resolves.
BITS = 10


def by_field(df: DataFrame, fields: dict[str, Column], *keep: Column) -> DataFrame:
    """(field_name, key_value, keep...): one row for each field with a value, neither NULL nor empty."""
    each = F.array(*[F.struct(F.lit(n).alias("field_name"), c.cast("string").alias("key_value")) for n, c in fields.items()])
    return df.select(F.inline(each), *keep).where("key_value <> ''")


def person_fields() -> dict[str, Column]:
    """The skewed keys of the person table; zip codes count by their first five characters."""
    return {"byear": F.col("byear"), "county": F.col("county"), "zipcode": F.substring("zipcode", 1, 5)}


def per_key(df: DataFrame, keys: list[str], person: str, at: str, row_id: str) -> DataFrame:
    """keys, n_rows, n_persons, latest_id, latest_at.

    Rows are reduced per (key, person) first, so that a hot key is spread over its persons; then per key with map-side
    partial aggregates. NULL persons aren't counted as persons. The latest row is the one with the greatest time, of
    these the greatest id; rows without a time come before all others. Empty input gives no row.
    """
    latest = F.max(F.struct(F.col(at).alias("at"), F.col(row_id).alias("id")))
    fine = df.groupBy(*keys, F.col(person).alias("_person")).agg(F.count("*").alias("n"), latest.alias("last"))
    coarse = fine.groupBy(*keys).agg(F.sum("n").alias("n_rows"), F.count("_person").alias("n_persons"), F.max("last").alias("last"))
    return coarse.select(*keys, "n_rows", "n_persons", F.col("last.id").alias("latest_id"), F.col("last.at").alias("latest_at"))


def _exact(p: float | str | Fraction) -> Fraction:
    """The decimal number that p is written as: 0.28 is 28/100, not the nearest binary fraction."""
    return p if isinstance(p, Fraction) else Fraction(str(p))


def _ceiling(p: Fraction, n: str) -> Column:
    """ceil(p * n) in whole numbers."""
    return F.expr(f"cast((cast({n} as decimal(19,0)) * {p.numerator} + {p.denominator - 1}) div {p.denominator} as bigint)")


def exact_selection(df: DataFrame, keys: list[str], value: str, probs: list, bits: int = BITS) -> DataFrame:
    """keys, prob, n, rank, value, n_equal: per key the exact discrete quantiles of a bigint column.

    The quantile at prob (a number as written, or a Fraction) is the smallest value with at least prob * n of the key's n values
    at or below it (rank = ceil(prob * n) in whole numbers, at least 1); n_equal counts the values equal to it. NULL values are left out; keys may be NULL and
    form a key of their own; a key without values gives no row. Ties need no rule, since equal values resolve together.
    """
    probs = [_exact(p) for p in probs]
    if not probs or any(not 0 <= p <= 1 for p in probs):
        raise ValueError("probs must lie between 0 and 1")
    ks = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(a) for k, a in zip(keys, ks)], F.col(value).cast("bigint").alias("v")).where("v is not null")
    low, high = rows.agg(F.min("v"), F.max("v")).first()
    types = {k: t for k, t in df.dtypes}
    out_keys = [F.when(F.col(a) != "\0", F.col(a)).cast(types[k]).alias(k) for k, a in zip(keys, ks)]
    if low is None:
        return df.sparkSession.createDataFrame([], df.select(*keys).schema.add("prob", "double").add("n", "long").add("rank", "long").add("value", "long").add("n_equal", "long"))
    if high - low >= 1 << 63:
        raise ValueError("the values span more than 63 bits")
    rows = rows.withColumn("v", F.col("v") - F.lit(low))
    shift = max(0, (high - low).bit_length() - bits)
    running = Window.partitionBy(*ks, "_in").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows, wanted, done = rows.withColumn("_in", F.lit(0).cast("bigint")), None, []
    while True:
        hist = rows.withColumn("bin", F.shiftright("v", shift)).groupBy(*ks, "_in", "bin").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        hist = hist.withColumn("upto", F.sum("c").over(running))
        if wanted is None:
            total = F.sum("c").over(Window.partitionBy(*ks))
            each = F.inline(F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.greatest(F.lit(1).cast("bigint"), _ceiling(p, "n")).alias("rank")) for p in probs]))
            found = hist.withColumn("n", total).select("*", each).withColumn("r", F.col("rank"))
        else:
            found = hist.join(wanted, [*ks, "_in"])
        found = found.where("upto >= r and upto - c < r").withColumn("r", F.col("r") - (F.col("upto") - F.col("c")))
        found = stash(found.select(*ks, "bin", "prob", "n", "rank", "r", "c", "lo", "hi"), "p2-ranks")
        done.append(found.where("lo = hi").select(*ks, "prob", "n", "rank", (F.col("lo") + F.lit(low)).alias("value"), F.col("c").alias("n_equal")))
        wanted = found.where("lo < hi").select(*ks, F.col("bin").alias("_in"), "prob", "n", "rank", "r")
        if shift == 0 or wanted.isEmpty():
            break
        rows = rows.withColumn("_in", F.shiftright("v", shift)).join(wanted.select(*ks, "_in").distinct(), [*ks, "_in"], "left_semi").select(*ks, "v", "_in")
        rows = stash(rows, "p2-open")
        shift = max(0, shift - bits)
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.select(*out_keys, "prob", "n", "rank", "value", "n_equal")


def hot_keys(df: DataFrame, fields: dict[str, Column], share: float | Fraction) -> DataFrame:
    """(field_name, key_value, n_rows): values that at least share of all rows of df have.

    Order a field's values by a 62-bit hash: a value with that many rows covers one of the ranks at multiples of share,
    so exact selection at these ranks, with the field as key, meets every such value, however the rest is spread. The few values
    it finds are then counted as strings, which also settles hash collisions.
    """
    n, share = df.count(), _exact(share)
    enough = lambda c: F.col(c) >= -(-share.numerator * n // share.denominator)
    long = by_field(df, fields)
    coded = long.withColumn("code", F.shiftrightunsigned(F.xxhash64("key_value"), 2))
    probs = [i * share for i in range(1, int(1 / share) + 1)]
    met = exact_selection(coded, ["field_name"], "code", probs).where(enough("n_equal")).select("field_name", F.col("value").alias("code")).distinct()
    counts = coded.join(stash(met, "p2-met"), ["field_name", "code"], "left_semi").groupBy("field_name", "key_value").agg(F.count("*").alias("n_rows"))
    return counts.where(enough("n_rows"))
