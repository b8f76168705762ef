"""Records that are the same but for typing: commutative multiset fingerprints, then exact verification.

Each (field name, normalised value) pair is hashed and the hashes are added, so the order of fields doesn't matter. The
part fields (first name, last name, suffix) enter as their letters under one common field name: a part may then stand
in any of them, be split or be written together. Equal fingerprints are only candidates. A row counts as a copy when its
equal-fields are equal to the group's first row and its part fields can be cut, at token boundaries, into the same
parts. Nothing is sorted and no group is gathered: groups are reduced to one row (smallest id) by a partial aggregate and every
row is compared with that row only; rows that turn out different form the groups of the next round.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.session import stash

PARTS = ("fname", "lname", "suffix")
EQUAL = ("mname", "altlname", "byear", "bmonth", "bday", "zipcode", "county", "common_id")


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits, one space between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}\p{M}]+", " "))


def fingerprint(parts: list[Column], equal: dict[str, Column]) -> Column:
    """Sum of 56-bit hashes of the (field, value) pairs; parts are columns of tokens, all under the field 'part'."""
    letters = F.split(F.translate(F.concat(*parts), " ", ""), "")
    total = F.aggregate(letters, F.lit(0).cast("bigint"), lambda a, x: (a + F.shiftrightunsigned(F.xxhash64(F.lit("part"), x), 10)) % F.lit(1 << 54))
    for name, value in equal.items():
        total = total + F.shiftrightunsigned(F.xxhash64(F.lit(name), value), 8)
    return total


def same_parts(a: list[str], b: list[str]) -> bool:
    """Whether two lists of fields (tokens with single spaces) can be cut into the same parts. A part lies within one
    field on either side and each of its ends is the end of a token on at least one side: white space within a part or
    its loss between two parts doesn't matter, but letters never change their order within a token of both.

    Multisets are compared, nothing is sorted by value. Where they leave it open, all ways to cut are searched, whatever the
    length: first without the tokens that both have, then with them."""
    x, y = [f for f in a if f], [f for f in b if f]
    if Counter(f.replace(" ", "") for f in x) == Counter(f.replace(" ", "") for f in y):
        return True
    if Counter("".join(x).replace(" ", "")) != Counter("".join(y).replace(" ", "")):
        return False
    shared = Counter(" ".join(x).split()) & Counter(" ".join(y).split())
    return _cuttable(_without(x, shared), _without(y, shared)) or bool(shared) and _cuttable(x, y)


def _without(fields: list[str], some: Counter) -> list[str]:
    left, out = Counter(some), []
    for f in fields:
        words = []
        for w in f.split(" "):
            if left[w]:
                left[w] -= 1
            else:
                words.append(w)
        out.append(" ".join(words))
    return [f for f in out if f]


def _cuttable(x: list[str], y: list[str]) -> bool:
    """Covers the letters of x from left to right with pieces of y. A state is how far x is covered and which pieces of y
    are free; states whose free pieces read the same are one state and are searched once."""
    text_x, fields_x, ends_x = _flat(x)
    text_y, fields_y, ends_y = _flat(y)
    last_x = {i: e for s, e in fields_x for i in range(s, e)}
    shapes: dict = {}

    def shape(piece: tuple[int, int]) -> tuple:
        if piece not in shapes:
            s, e = piece
            shapes[piece] = text_y[s:e], tuple(p - s for p in range(s, e + 1) if p in ends_y)
        return shapes[piece]

    open_states, seen = [(0, fields_y)], set()
    while open_states:
        at, free = open_states.pop()
        if at == len(text_x):
            return True
        state = at, frozenset(Counter(map(shape, free)).items())
        if state in seen:
            continue
        seen.add(state)
        for k, (s, e) in enumerate(free):
            for q in range(s, e):
                if text_y[q] != text_x[at] or not (at in ends_x or q in ends_y):
                    continue
                most = 1
                while at + most < last_x[at] and q + most < e and text_x[at + most] == text_y[q + most]:
                    most += 1
                for n in range(1, most + 1):
                    if at + n in ends_x or q + n in ends_y:
                        open_states.append((at + n, free[:k] + [p for p in ((s, q), (q + n, e)) if p[0] < p[1]] + free[k + 1 :]))
    return False


def _flat(fields: list[str]) -> tuple[str, list[tuple[int, int]], set[int]]:
    """The letters, the range of each field in them, and the places where tokens begin and end."""
    text, ranges, ends = "", [], {0}
    for f in fields:
        start = len(text)
        for t in f.split(" "):
            text += t
            ends.add(len(text))
        ranges.append((start, len(text)))
    return text, ranges, ends


def _same_parts(a: Column, b: Column) -> Column:
    def each(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([same_parts(list(p), list(q)) for p, q in zip(x, y)], dtype=bool)

    return F.pandas_udf(each, "boolean")(a, b)


def copy_pairs(df: DataFrame, id_col: str = "idx", parts: tuple = PARTS, equal: tuple = EQUAL) -> DataFrame:
    """(keeper, id): every row that has copies, with the smallest id of all its copies (keeper itself included).

    NULL and '' are the same value, in parts and in equal fields. Rows without any part are copies of each other when
    the equal fields agree. Rows with a NULL id are left out; repeated ids count as one row. Other columns are ignored.
    """
    equal_as = [f"_e{i}" for i in range(len(equal))]
    rows = df.select(
        F.col(id_col).cast("bigint").alias("id"), *[tokens(F.col(c)).alias(f"_p{i}") for i, c in enumerate(parts)], *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in zip(equal, equal_as)]
    ).where("id is not null")
    part_as = [f"_p{i}" for i in range(len(parts))]
    rows = rows.withColumn("fp", fingerprint([F.col(c) for c in part_as], dict(zip(equal, map(F.col, equal_as)))))
    out, pending = [], rows
    while True:
        groups = pending.groupBy("fp").agg(F.min("id").alias("keeper"), F.max("id").alias("_last")).where("keeper < _last").drop("_last")
        grouped = stash(pending.join(groups, "fp"), "p1-groups")
        first = grouped.where("id = keeper").select("fp", *[F.col(c).alias(f"k{c}") for c in (*part_as, *equal_as)])
        both = grouped.join(first, "fp")
        fields = F.lit(True)
        for c in equal_as:
            fields = fields & (F.col(c) == F.col(f"k{c}"))
        squeezed = lambda p: F.concat_ws(" ", *[F.translate(F.col(f"{p}{c}"), " ", "") for c in part_as])
        plain = both.withColumn("_same", fields & (squeezed("") == squeezed("k")))
        sure = plain.where("_same").select("keeper", "id")
        pick = lambda p: F.array(*[F.col(f"{p}{c}") for c in part_as])
        rest = plain.where("not _same").withColumn("_ok", fields & _same_parts(pick(""), pick("k"))).select("fp", "keeper", "id", "_ok", *part_as, *equal_as)
        rest = stash(rest, "p1-rest")
        out += [sure, rest.where("_ok").select("keeper", "id")]
        left = rest.where("not _ok").select("fp", "id", *part_as, *equal_as)
        if left.isEmpty():
            break
        pending = left
    pairs = out[0]
    for more in out[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def collapse(df: DataFrame, id_col: str = "idx", parts: tuple = PARTS, equal: tuple = EQUAL) -> DataFrame:
    """The rows of df without later copies, each with n_copies: the number of rows it stands for, itself included."""
    pairs = copy_pairs(df, id_col, parts, equal)
    counts = pairs.groupBy(F.col("keeper").alias("_k")).agg(F.count("*").alias("_n"))
    later = pairs.where("id > keeper").select(F.col("id").alias("_later"))
    kept = df.join(later, F.col(id_col) == F.col("_later"), "left_anti")
    return kept.join(counts, F.col(id_col) == F.col("_k"), "left").withColumn("n_copies", F.coalesce("_n", F.lit(1).cast("bigint"))).drop("_k", "_n")


def p1_found(spark, sf_dir: str) -> DataFrame:
    pairs = copy_pairs(spark.read.parquet(f"{sf_dir}/preprocess_file_template.parquet"))
    return pairs.where("keeper < id").select(F.col("keeper").alias("idx_a"), F.col("id").alias("idx_b"))


def p1_records(spark, sf_dir: str) -> DataFrame:
    return collapse(spark.read.parquet(f"{sf_dir}/preprocess_file_template.parquet")).select("idx", "fname", "lname", "suffix", "n_copies")
