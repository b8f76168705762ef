"""Queries on the skewed keys of the person table, with the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.operators.hotkeys import by_field, exact_selection, hot_keys, per_key, person_fields


def _people(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/preprocess_file_template.parquet")


def p2_found(spark, sf_dir: str) -> DataFrame:
    return hot_keys(_people(spark, sf_dir), person_fields(), 0.04).select("field_name", "key_value")


def p2_per_key(spark, sf_dir: str) -> DataFrame:
    long = by_field(_people(spark, sf_dir), person_fields(), F.col("source_id"), F.col("received_at"), F.col("idx"))
    return per_key(long, ["field_name", "key_value"], "source_id", "received_at", "idx")


def p2_quantiles(spark, sf_dir: str) -> DataFrame:
    """Quartiles of the time of receipt, in microseconds."""
    long = by_field(_people(spark, sf_dir), person_fields(), F.unix_micros(F.col("received_at").cast("timestamp")).alias("at"))
    found = exact_selection(long, ["field_name", "key_value"], "at", [0.25, 0.5, 0.75])
    return found.select("field_name", "key_value", "prob", F.col("n").alias("n_rows"), F.col("value").alias("received_us"))


_LONG = """select 'byear' field_name, byear key_value, * exclude (byear), byear b from preprocess_file_template where byear <> ''
 union all by name select 'county' field_name, county key_value, * exclude (byear), byear b from preprocess_file_template where county <> ''
 union all by name select 'zipcode' field_name, substr(zipcode, 1, 5) key_value, * exclude (byear), byear b from preprocess_file_template where zipcode <> ''"""

QUERIES = {"p2_found": p2_found, "p2_per_key": p2_per_key, "p2_quantiles": p2_quantiles}

SQL = {
    "p2_found": f"select field_name, key_value from ({_LONG}) group by 1, 2 having count(*) >= 0.04 * (select count(*) from preprocess_file_template)",
    "p2_per_key": f"""select field_name, key_value, cast(count(*) as bigint) n_rows, count(distinct source_id) n_persons,
 arg_max(idx, struct_pack(a := received_at, b := idx)) latest_id, max(received_at) latest_at from ({_LONG}) group by 1, 2""",
    "p2_quantiles": f"""select field_name, key_value, prob, cast(count(*) as bigint) n_rows,
 list_sort(list(epoch_us(received_at)))[greatest(1, cast(ceil(prob * count(*)) as int))] received_us
 from ({_LONG}) l, (values (0.25::double), (0.5::double), (0.75::double)) q(prob) group by 1, 2, 3""",
}
