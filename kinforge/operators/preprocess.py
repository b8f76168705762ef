"""Preparation of raw person files: standard names, blanking, cleaning, aliases, row ids."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinforge.functions.cleaning import clean_fname, clean_lname, soundex_key
from kinforge.session import stash

# The columns of a person table, in order.
OUTPUT = ("source_id", "fname", "xf", "mname", "minitial", "lname", "xl", "altlname", "suffix", "byear", "bmonth", "bday", "zipcode", "county")


@dataclass
class PreprocessSpec:
    """How a raw file becomes a person table."""

    vars: dict[str, str]
    dob: str | None = None
    dob_format: str = "yyyy-MM-dd"
    constants: dict[str, str] = field(default_factory=dict)
    bad_values: dict[str, list[str]] = field(default_factory=dict)
    bad_first_names: list[str] = field(default_factory=list)
    bad_last_names: list[str] = field(default_factory=list)
    year: str = ""
    file_num: str = ""
    aliases: bool = True
    other_ids: list[str] = field(default_factory=list)
    #: Take the last name's suffix only, even where it is missing.
    suffix_of_last_only: bool = False

    def __post_init__(self) -> None:
        parts = [s for s in ("byear", "bmonth", "bday") if s in self.vars]
        if not self.dob and len(parts) == 3 and len({self.vars[s] for s in parts}) == 1:  # several birth parts in one column are a date
            self.dob, self.vars = self.vars["byear"], {k: v for k, v in self.vars.items() if k not in parts}

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @classmethod
    def from_json(cls, text: str) -> PreprocessSpec:
        return cls(**json.loads(text))


def rename(df: DataFrame, vars: dict[str, str]) -> DataFrame:
    """Only the mapped columns, under their standard names, as strings, missing as ''."""
    return df.select(*[F.coalesce(F.col(src).cast("string"), F.lit("")).alias(std) for std, src in vars.items()])


def constants(df: DataFrame, values: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.lit(v) for c, v in values.items()}) if values else df


def placeholders(df: DataFrame, cols: list[str]) -> DataFrame:
    """Standard columns that are absent, as ''."""
    absent = [c for c in cols if c not in df.columns]
    return df.withColumns({c: F.lit("") for c in absent}) if absent else df


def blank(df: DataFrame, bad: dict[str, list[str]], named: set[str] | None = None) -> DataFrame:
    """Bad values become ''. The list under 'ids' holds for all columns that have no list of their own and aren't standard."""
    standard = set(OUTPUT) if named is None else named
    lists = {c: bad.get(c) or (bad.get("ids", []) if c not in standard else []) for c in df.columns}
    return df.withColumns({c: F.when(F.col(c).isin(v), "").otherwise(F.col(c)) for c, v in lists.items() if v}) if any(lists.values()) else df


def short_zip(c: Column) -> Column:
    return F.when(F.length(c) > 5, F.substring(c, 1, 5)).otherwise(c)


def split_dob(df: DataFrame, col: str, fmt: str) -> DataFrame:
    """byear, bmonth, bday without leading zeros; '' where the date can't be read."""
    at = F.try_to_timestamp(F.col(col), F.lit(fmt))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return df.withColumns({"byear": text(F.year(at)), "bmonth": text(F.month(at)), "bday": text(F.dayofmonth(at))})


def split_dob_text(c: Column) -> dict[str, Column]:
    """byear, bmonth, bday as double from YYYYMMDD."""
    return {"byear": F.substring(c, 1, 4).try_cast("double"), "bmonth": F.substring(c, 5, 2).try_cast("double"), "bday": F.substring(c, 7, 2).try_cast("double")}


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, "[\\x00\\r]", "")


def indexed(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """A 0-based row number in the order of the given columns, without a task that sees all rows: numbers come from the counts of a
    range partition."""
    parts = stash(df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "indexed")
    start = parts.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_at", at).join(start, "_part").withColumn(name, (F.col("_at") + F.col("_before")).cast("bigint")).drop("_part", "_n", "_before", "_at")


def with_source_id(df: DataFrame, order: list[str], year: str, file_num: str) -> DataFrame:
    numbered = indexed(df, order, "_i")
    return numbered.withColumn("source_id", F.concat(F.lit(year), F.lit(file_num), F.lpad(F.col("_i").cast("string"), 7, "0"))).drop("_i")


def name_aliases(df: DataFrame, name: str, alternative: str) -> DataFrame:
    """Each row with its names, and where it has an alternative a second row that bears only that."""
    own = F.struct(F.col(name).alias(name), F.col(alternative).alias(alternative))
    other = F.struct(F.col(alternative).alias(name), F.lit(None).cast("string").alias(alternative))
    both = F.when(F.col(alternative).isNull(), F.array(own)).otherwise(F.array(own, other))
    rest = [c for c in df.columns if c not in (name, alternative)]
    return df.select(*rest, F.inline(both))


def middle_aliases(df: DataFrame, name: str = "mname") -> DataFrame:
    """Each row with its whole middle name and one row for each word of it; rows that are equal come once."""
    words = F.filter(F.split(F.col(name), " "), lambda w: w != "")
    each = F.array_union(F.array(F.col(name)), F.coalesce(words, F.array().cast("array<string>")))
    return df.withColumn(name, F.explode(each)).distinct()


def minitial(c: Column) -> Column:
    return F.coalesce(F.substring(c, 1, 1), F.lit(""))


def cleaned(df: DataFrame, spec: PreprocessSpec) -> DataFrame:
    """Clean names, suffix (of the last name, else of the first) and altfname."""
    first = clean_fname(F.col("fname"), F.col("mname"), spec.bad_first_names)
    last = clean_lname(F.col("lname"), F.col("altlname"), [*spec.bad_first_names, *spec.bad_last_names])
    df = df.withColumn("_f", first).withColumn("_l", last)
    out = df.withColumns({"fname": F.col("_f.fname"), "mname": F.col("_f.mname"), "altfname": F.col("_f.altfname"), "lname": F.col("_l.lname"), "altlname": F.col("_l.altlname"), "suffix": F.col("_l.suffix") if spec.suffix_of_last_only else F.coalesce("_l.suffix", "_f.suffix")})
    return out.drop("_f", "_l")


def preprocess(raw: DataFrame, spec: PreprocessSpec) -> DataFrame:
    """A person table in the standard column order, all text, without repeated rows."""
    df = rename(raw, {**spec.vars, **({"_dob": spec.dob} if spec.dob else {})})
    df = split_dob(df, "_dob", spec.dob_format).drop("_dob") if spec.dob else df
    if "source_id" not in df.columns:
        df = with_source_id(df, df.columns, spec.year, spec.file_num)
    df = constants(df, spec.constants)
    df = placeholders(df, [*OUTPUT, *spec.other_ids])
    df = cleaned(blank(df, spec.bad_values), spec).withColumn("zipcode", short_zip(F.col("zipcode")))
    if spec.aliases:
        df = name_aliases(name_aliases(df, "fname", "altfname"), "lname", "altlname")
    df = df.withColumns({"minitial": minitial(F.col("mname")), "xf": soundex_key(F.col("fname")), "xl": soundex_key(F.col("lname"))})
    return df.select(*OUTPUT, *spec.other_ids).distinct()


def combine(frames: list[DataFrame], order: list[str] | None = None) -> DataFrame:
    """Several person tables (new ones and those of earlier runs) in one, without repeated rows, with idx in the order of the
    given columns (all by default); a column that a table hasn't is NULL in its rows."""
    whole = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames).drop("idx").distinct()
    return indexed(whole, [*(order or []), *[c for c in whole.columns if c not in (order or [])]])


def match_input(df: DataFrame) -> DataFrame:
    """A person table as comparisons read it: birth parts as double (what is no number is NULL) beside their text, the
    middle initial where it is missing, idx as bigint."""
    parts = [c for c in ("byear", "bmonth", "bday") if c in df.columns]
    df = df.withColumns({**{f"{c}_txt": F.col(c).cast("string") for c in parts}, **{c: F.col(c).try_cast("double") for c in parts}})
    if "minitial" not in df.columns and "mname" in df.columns:
        df = df.withColumn("minitial", minitial(F.col("mname")))
    return df.withColumn("idx", F.col("idx").cast("bigint"))
