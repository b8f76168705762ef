"""Readers and writers of person files and crosswalks. Only mapped columns are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.config import DatasetSpec
from kinforge.operators.preprocess import indexed, split_dob_text, strip_control
from kinforge.operators.results import ordered

#: Sources of the caller's own, by name: session in, table out.
PLUGINS: dict[str, Callable[[SparkSession], DataFrame]] = {}


def plugin(name: str) -> Callable:
    """Register a function as the source of a dataset."""

    def keep(f: Callable[[SparkSession], DataFrame]) -> Callable[[SparkSession], DataFrame]:
        PLUGINS[name] = f
        return f

    return keep


def read_fixed_width(spark: SparkSession, path: str, names: list[str], widths: list[int], encoding: str = "UTF-8") -> DataFrame:
    """Columns of fixed width, trimmed, '' as NULL; widths count characters."""
    lines = spark.read.option("encoding", encoding).text(path)
    at, cols = 1, []
    for name, width in zip(names, widths):
        cols.append(F.nullif(F.trim(F.substring("value", at, width)), F.lit("")).alias(name))
        at += width
    return lines.select(*cols)


def read_csv(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False, **options)


def read_excel(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Sheets are small and read on the driver; needs pandas with an Excel engine."""
    import pandas as pd

    pdf = pd.read_excel(path, dtype=str, usecols=list(dict.fromkeys(columns)) if columns else None)
    return spark.createDataFrame(pdf.where(pdf.notna(), None), ", ".join(f"`{c}` string" for c in pdf.columns))


def read_jdbc(spark: SparkSession, table: str, **options: str) -> DataFrame:
    """A database table; with partitionColumn, numPartitions and, if known, lowerBound and upperBound in parallel ranges. Bounds
    that aren't given are asked of the database first."""
    reader = lambda t, more: spark.read.format("jdbc").options(**more, dbtable=t).load()
    column = options.get("partitionColumn")
    if column and not {"lowerBound", "upperBound"} <= set(options):
        plain = {k: v for k, v in options.items() if k not in ("partitionColumn", "numPartitions", "lowerBound", "upperBound")}
        low, high = reader(f"(select min({column}) lo, max({column}) hi from {table}) bounds", plain).first()
        if low is None:
            return reader(table, plain)
        options = {**options, "lowerBound": str(low), "upperBound": str(high)}
    return reader(table, options)


def earlier(spark: SparkSession, tables: list[str] = (), csvs: list[str] = ()) -> list[DataFrame]:
    """Person tables of earlier runs, by path or name of a table, and by path of a CSV."""
    return [spark.read.parquet(t) if "/" in t else spark.table(t) for t in tables] + [read_csv(spark, c) for c in csvs]


def latest(spark: SparkSession, folder: str, *parts: str) -> str:
    """The path of the newest file or table in folder whose name contains all parts; of equally new ones the last by name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = [(f.getModificationTime(), f.getPath().getName(), f.getPath().toString()) for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    named = [f for f in found if all(p in f[1] for p in parts)]
    if not named:
        raise FileNotFoundError(f"nothing in {folder} is named with {', '.join(parts)}")
    return max(named)[2]


def load_raw(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    """All columns of a dataset, by its file type."""
    if spec.name in PLUGINS and spec.filetype == "plugin":
        return PLUGINS[spec.name](spark)
    if spec.filetype == "parquet":
        return spark.read.parquet(spec.path)
    if spec.filetype == "csv":
        return read_csv(spark, spec.path, **spec.options)
    if spec.filetype == "fwf":
        return read_fixed_width(spark, spec.path, list(spec.fwf_names), list(spec.fwf_widths), **spec.options)
    if spec.filetype == "table":
        return spark.table(spec.path)
    if spec.filetype == "jdbc":
        return read_jdbc(spark, spec.path, **spec.options)
    if spec.filetype == "excel":
        return read_excel(spark, spec.path, list(spec.vars.values()) or None)
    raise ValueError(f"unknown file type {spec.filetype}")


def load_dataset(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    """The mapped columns under their standard names (idx too, if the data has it)."""
    raw = load_raw(spark, spec)
    if not spec.vars:
        return raw
    keep = {**spec.vars, **({"idx": "idx"} if "idx" in raw.columns and "idx" not in spec.vars else {})}
    return raw.select(*[F.col(src).alias(std) for std, src in keep.items()])


def import_prepared(spark: SparkSession, spec: DatasetSpec, dob_text: str | None = None) -> DataFrame:
    """A prepared file as text, without null bytes and carriage returns, with idx and, if it has one, the date split."""
    df = load_dataset(spark, spec)
    df = df.select(*[strip_control(F.col(c).cast("string")).alias(c) for c in df.columns])
    if dob_text:
        df = df.withColumns(split_dob_text(F.col(dob_text)))
    return df if "idx" in df.columns else indexed(df, df.columns)


def read_crosswalk(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A crosswalk without header, columns by position."""
    df = spark.read.csv(path, header=False, inferSchema=False)
    return df.select(*[F.trim(F.col(df.columns[i])).alias(n) for i, n in enumerate(names)])


def read_pair_lines(spark: SparkSession, path: str, first: tuple[int, int], second: tuple[int, int], dedup: bool = False) -> DataFrame:
    """(indv_id_a, indv_id_b) at fixed offsets (from, to; from 0) of each line; in dedup the smaller id first."""
    at = lambda r: F.trim(F.substring("value", r[0] + 1, r[1] - r[0]))
    df = spark.read.text(path).select(at(first).alias("x"), at(second).alias("y"))
    return df.select(F.least("x", "y").alias("indv_id_a"), F.greatest("x", "y").alias("indv_id_b")) if dedup else df.toDF("indv_id_a", "indv_id_b")


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet, missing text as ''."""
    texts = [c for c, t in df.dtypes if t == "string"]
    df.na.fill("", texts).write.mode(mode).parquet(path)


def write_scored(found: DataFrame, path: str) -> None:
    """Scored pairs as CSV, heaviest first: parts in the order of their names are one sorted sequence."""
    write_csv(ordered(found), path)


def save_groups(groups: DataFrame, path: str, group: str = "group_id", item: str = "item") -> None:
    """(group, item) of a grouping as CSV."""
    write_csv(groups.select(F.col(group).alias("group_id"), F.col(item).alias("item")), path)


def load_groups(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path).select("group_id", "item")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True)
