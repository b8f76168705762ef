"""The test tables as match input, in expressions that Spark SQL and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: What stands for a missing id in the test tables.
PLACEHOLDER_IDS = ("0", "n/a", "NULL", "99999999")
_FROM, _TO = "ÉÖÁÑÍÓÚÈÀÜÄ  　“”’‐", "EOANIOUEAUA   "


def name(c: str) -> str:
    return f"trim(translate(upper({c}), '{_FROM}', '{_TO}'))"


_NAMES = [f"{name(c)} as {c}" for c in ("fname", "mname", "lname", "altlname")] + [f"substr({name('mname')}, 1, 1) as minitial", "xf", "xl"]
FIRST = [
    "idx",
    "source_id as indv_id",
    # placeholders would pair all their holders
    f"case when common_id in ({', '.join(map(repr, PLACEHOLDER_IDS))}) then '' else common_id end as common_id",
    *_NAMES,
    *[x for p in ("byear", "bmonth", "bday") for x in (f"{p} as {p}_txt", f"try_cast({p} as double) as {p}")],
    "zipcode",
    "county",
]
SECOND = [
    "cast(substr(indv_id, 2) as bigint) as idx",
    "indv_id",
    *_NAMES,
    *[x for p in ("byear", "bmonth", "bday") for x in (f"cast(try_cast({p} as bigint) as string) as {p}_txt", p)],
    "zipcode",
    "county",
]


def first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/preprocess_file_template.parquet").selectExpr(*FIRST)


def second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/match_input_b.parquet").selectExpr(*SECOND)


def first_sql() -> str:
    return f"select {', '.join(FIRST)} from preprocess_file_template"


def second_sql() -> str:
    return f"select {', '.join(SECOND)} from match_input_b"
