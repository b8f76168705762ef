"""Person rows as numbers, and statistics of their names."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.session import drop_stash, stash

#: Share of all records (and least number) from which a name word is an established name.
ESTABLISHED, ESTABLISHED_LEAST = 3e-4, 8
#: Stands for a missing year in a packed birth date; missing months and days are 0.
NO_YEAR = 127


def text(df: DataFrame, c: str) -> Column:
    """A column as text, '' where it is missing."""
    return F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")


def born(byear: Column, bmonth: Column, bday: Column) -> Column:
    """Year (its last two digits), month and day in seven bits each; what is missing, zero or no number is missing."""
    year = F.substring_index(F.trim(byear.cast("string")), ".", 1)
    y = F.when(F.length(year).isin(2, 4) & (year != "0000"), F.pmod(year.try_cast("int"), F.lit(100)))
    count = lambda c: F.least(F.coalesce(F.when(F.trim(c.cast("string")).try_cast("double") >= 1, F.trim(c.cast("string")).try_cast("double").cast("int")), F.lit(0)), F.lit(127))
    return F.shiftleft(F.coalesce(y, F.lit(NO_YEAR)), 14) + F.shiftleft(count(bmonth), 7) + count(bday)


def parts(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return packed >> 14, packed >> 7 & 127, packed & 127


def zip_number(zipcode: Column) -> Column:
    """The first five digits, 0 if there aren't five or if they are one digit."""
    z = F.substring(F.trim(zipcode), 1, 5)
    n = F.when((F.length(z) == 5) & ~z.contains("-") & ~z.contains("+"), z.try_cast("int"))
    return F.coalesce(F.when(F.pmod(n, F.lit(11111)) != 0, n), F.lit(0))


def numbers(df: DataFrame, county: Column) -> list[Column]:
    """born, zip and county; a county is a number of its name's hash."""
    of = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    place = F.when(county != "", 1 + F.pmod(F.xxhash64(county), F.lit((1 << 24) - 1)).cast("int"))
    return [born(of("byear"), of("bmonth"), of("bday")).alias("born"), zip_number(of("zipcode")).alias("zip"), F.coalesce(place, F.lit(0)).alias("county")]


#: Stands between the names of a record in one text.
SEPARATOR = "\0"


def packed(names: list[str], born: str = "born", zips: str = "zip", county: str = "county") -> list[Column]:
    """A record in two columns instead of eight, which is less to shuffle: names, and p with birth (21 bits), zip code (17) and county (24)."""
    whole = F.concat_ws(SEPARATOR, *[F.replace(F.coalesce(c, F.lit("")), F.lit(SEPARATOR), F.lit(" ")) for c in names])
    at = lambda c, n: F.shiftleft(F.col(c).cast("bigint"), n)
    return [whole.alias("names"), F.col(born).cast("bigint").bitwiseOR(at(zips, 21)).bitwiseOR(at(county, 38)).alias("p")]


def unpacked(names: pa.Array, n: int = 5) -> list[pa.Array]:
    """The n names of each record of packed."""
    flat = pc.split_pattern(names, SEPARATOR).flatten()
    return [flat.take(pa.array(np.arange(k, len(flat), n))) for k in range(n)]


def unpacked_numbers(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """born, zip and county of packed."""
    return p & (1 << 21) - 1, p >> 21 & (1 << 17) - 1, p >> 38


def word_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(word, n) over all name words of all records, lower case, without accents."""
    # different texts are split once each
    each = df.select(F.explode(F.array(*[F.col(c).cast("string") for c in cols])).alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("n"))
    text = F.translate(F.lower("text"), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ'’`", "aaaaaaceeeeiiiinooooouuuuyy")
    return each.select("n", F.explode(F.split(text, r"[^\p{L}\p{N}]+")).alias("word")).where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def name_statistics(df: DataFrame, cols: list[str], grams: bool = False) -> tuple[dict[str, float], dict[str, float]]:
    """The established names (at most words per record / ESTABLISHED of them) with their share of the records and, if asked for,
    the idf of each n-gram of letters that at least one in IDF_LEAST words has, over all records."""
    counts = stash(word_counts(df, cols), "name-words")
    total = df.count()
    least = max(ESTABLISHED_LEAST, ESTABLISHED * total)
    established = {r["word"]: r["n"] / total for r in counts.where((F.col("n") >= least) & (F.length("word") > 1)).collect()}
    idf: dict[str, float] = {}
    if grams:
        padded = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
        pieces = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - k + 1)), lambda i: F.substring(padded, i, F.lit(k)))
        each = counts.select("n", F.explode(F.array_union(pieces(2), pieces(3))).alias("gram")).groupBy("gram").agg(F.sum("n").alias("n"))
        words = counts.agg(F.sum("n")).first()[0] or 0
        common = each.where(F.col("n") * IDF_LEAST >= words)
        idf = {r["gram"]: math.log((1 + total) / (1 + min(r["n"], total))) + 0.2 for r in common.collect()}
    drop_stash(counts)
    return established, idf


#: An n-gram that fewer than one word in so many has weighs as one of that share: at most IDF_LEAST times the letters of a word have more.
IDF_LEAST = 100_000
