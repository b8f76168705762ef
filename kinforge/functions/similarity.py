"""Similarity of two values: Column in, Column out. Everything but Jaro-Winkler stays in whole-stage codegen."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Params = dict


def jaro_winkler_text(a: str, b: str) -> float:
    """Jaro-Winkler similarity: scale 0.1, prefix of at most 4, only above a Jaro similarity of 0.7; an empty text gives 0."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    met = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                met.append(c)
                break
    if not met:
        return 0.0
    there = [c for c, f in zip(b, free) if not f]
    turned = sum(x != y for x, y in zip(met, there)) // 2
    m = len(met)
    jaro = (m / len(a) + m / len(b) + (m - turned) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


#: Characters that the arrays of jaro_winkler_texts hold, narrowest first; longer texts are compared one by one.
WIDTHS = (16, 32, 64)


def _jaro_winkler_codes(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """jaro_winkler_text of each row of two arrays of code points, with the lengths; the places of b are bits of a word."""
    n, width = a.shape
    ones = np.uint64(2**64 - 1)
    upto = lambda k: ones >> (64 - np.clip(k, 1, 64)).astype(np.uint64)  # noqa: E731 - the lowest k bits, k >= 1
    reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
    whole = upto(lb)
    free, met = whole.copy(), np.zeros((n, width), dtype=bool)
    for i in range(int(la.max())):
        equal = np.packbits(b == a[:, i : i + 1], axis=1, bitorder="little").view(f"<u{width // 8}")[:, 0].astype(np.uint64)
        low = i - reach
        near = upto(i + reach + 1) & np.where(low > 0, ~upto(low), ones)
        hit = np.where(i < la, equal & free & near, np.uint64(0))
        first = hit & (~hit + np.uint64(1))
        free ^= first
        met[:, i] = first != 0
    there = np.unpackbits((whole ^ free).astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :width].astype(bool)
    m = met.sum(axis=1)
    turned = np.bincount(np.repeat(np.arange(n), m), weights=a[met] != b[there], minlength=n).astype(np.int64) // 2
    some = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / la + m / lb + (m - turned) / some) / 3, 0.0)
    alike = (a[:, :4] == b[:, :4]) & (np.arange(4) < np.minimum(la, lb)[:, None])
    prefix = np.cumprod(alike, axis=1).sum(axis=1)
    return np.where(jaro <= 0.7, jaro, jaro + prefix * 0.1 * (1 - jaro))


def jaro_winkler_texts(a: list[str], b: list[str]) -> np.ndarray:
    """jaro_winkler_text of each pair of two lists."""
    n = len(a)
    la, lb = (np.fromiter(map(len, x), np.int64, n) for x in (a, b))
    same = np.fromiter((x == y for x, y in zip(a, b)), bool, n)
    out = np.where(same & (la > 0), 1.0, 0.0)
    longest = np.where(same | (la == 0) | (lb == 0), 0, np.maximum(la, lb))
    for i in np.flatnonzero(longest > WIDTHS[-1]).tolist():
        out[i] = jaro_winkler_text(a[i], b[i])
    for narrower, width in zip((0, *WIDTHS), WIDTHS):
        rows = np.flatnonzero((longest > narrower) & (longest <= width))
        if len(rows):
            codes = [np.array([x[i] for i in rows.tolist()], dtype=f"U{width}").view(np.uint32).reshape(len(rows), width) for x in (a, b)]
            out[rows] = _jaro_winkler_codes(*codes, la[rows], lb[rows])
    return out


def _jaro_winkler(left: Column, right: Column) -> Column:
    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(jaro_winkler_texts(a.tolist(), b.tolist()))

    # marked so that the optimizer evaluates it once for each pair instead of copying it into every rule that reads the score
    return F.pandas_udf(batch, "double").asNondeterministic()(left, right)


def _present(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def jarowinkler(left: Column, right: Column, p: Params) -> Column:
    """Missing on either side gives missing_value; equal values never leave the JVM's comparison of the result."""
    a, b = _present(left), _present(right)
    score = _jaro_winkler(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))
    return F.when(a.isNull() | b.isNull(), F.lit(float(p["missing_value"]))).otherwise(score)


def letter_columns(c: str) -> dict[str, Column]:
    """What jarowinkler_possible reads of a text column: its letters as bits, how many these leave out, and one by its length (0 for
    a missing text). The letters fall into 32 buckets; bit k stands for a first letter in bucket k, bit k + 32 for a second one."""
    bit = "shiftleft(1L, ascii(x) & 31)"
    bits = F.expr(f"aggregate(filter(split(coalesce({c}, ''), ''), x -> x <> ''), 0L, (s, x) -> s | if((s & {bit}) = 0, {bit}, shiftleft({bit}, 32)))")
    length = F.length(F.coalesce(F.col(c), F.lit("")))
    return {f"_letters_{c}": bits, f"_more_{c}": length - F.bit_count(bits), f"_share_{c}": F.when(length > 0, F.lit(1.0) / length).otherwise(0.0)}


def jarowinkler_possible(x: str, y: str, least: float, p: Params) -> Column:
    """Whether jarowinkler of a_x and b_y can be least or more: never false where it is, as the letters that two texts share bound their
    Jaro similarity, and like beginnings take away at most 0.4 of what lacks to 1."""
    sides = lambda name: (F.col(f"a__{name}_{x}"), F.col(f"b__{name}_{y}"))
    (ca, cb), (more_a, more_b), (share_a, share_b) = map(sides, ("letters", "more", "share"))
    jaro = least if least <= 0.7 else max(0.7, (least - 0.4) / 0.6)
    can = (F.bit_count(ca.bitwiseAND(cb)) + F.least(more_a, more_b)) * (share_a + share_b) >= F.lit(3 * jaro - 1 - 1e-9)
    if float(p["missing_value"]) >= least:
        return (share_a == 0) | (share_b == 0) | can
    return can if jaro > 0.34 else (share_a > 0) & (share_b > 0) & can


def levenshtein_possible(x: str, y: str, least: float, p: Params) -> Column:
    """Whether levenshtein of a_x and b_y can be least or more, in less code."""
    if float(p["missing_value"]) >= least:
        return levenshtein(F.col(f"a_{x}"), F.col(f"b_{y}"), p) >= least
    a, b = F.col(f"a_{x}"), F.col(f"b_{y}")
    near = F.levenshtein(a, b) <= F.lit(1 - least + 1e-9) * F.greatest(F.length(a), F.length(b))
    return F.coalesce((a != "") & (b != "") & near, F.lit(False))


def levenshtein(left: Column, right: Column, p: Params) -> Column:
    a, b = _present(left), _present(right)
    score = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    return F.when(a.isNull() | b.isNull(), F.lit(float(p["missing_value"]))).otherwise(score)


def exact(left: Column, right: Column, p: Params) -> Column:
    a, b = (left, right) if p.get("empty_equals_empty") else (_present(left), _present(right))
    return F.when(a.isNull() | b.isNull(), F.lit(float(p["missing_value"]))).when(a == b, 1.0).otherwise(0.0)


def byear(left: Column, right: Column, p: Params) -> Column:
    close = F.abs(left - right) <= p.get("year_dif", 1)
    return F.when(left == right, 1.0).when(close, F.lit(float(p["within_1y"]))).when(left.isNull() | right.isNull(), F.lit(float(p["missing_value"]))).otherwise(0.0)


def bmonthbday(ma: Column, da: Column, mb: Column, db: Column, p: Params) -> Column:
    """One agreeing part counts before a missing one does."""
    is_true = lambda c: F.coalesce(c, F.lit(False))
    missing = ma.isNull() | da.isNull() | mb.isNull() | db.isNull()
    return (
        F.when(is_true((ma == mb) & (da == db)), 1.0)
        .when(is_true((ma == db) & (da == mb)), F.lit(float(p["swap_month_day"])))
        .when(is_true(ma == mb) | is_true(da == db), F.lit(float(p["either_month_day"])))
        .when(missing, F.lit(float(p["missing_value"])))
        .otherwise(0.0)
    )


def minitial(ia: Column, na: Column, ib: Column, nb: Column, p: Params) -> Column:
    a, b = _present(ia), _present(ib)
    single = (F.length(na) == 1) | (F.length(nb) == 1)
    return (
        F.when((a == b) & F.coalesce(single, F.lit(False)), 1.0)
        .when(a == b, F.lit(float(p["minit_match_mname_unclear"])))
        .when(a.isNull() | b.isNull(), F.lit(float(p["missing_value"])))
        .otherwise(0.0)
    )


def numeric(left: Column, right: Column, p: Params) -> Column:
    """Linear: 1 where equal, 0.5 at a distance of 1, 0 from 2 on."""
    score = F.greatest(F.lit(0.0), 1 - F.abs(left - right) / 2)
    return F.when(left.isNull() | right.isNull(), F.lit(float(p["missing_value"]))).otherwise(score)


def date(left: Column, right: Column, p: Params) -> Column:
    """Equal 1; day and month exchanged swap_month_day; months often confused (6 and 7, 9 and 10) 0.5."""
    confused = F.least(F.month(left), F.month(right)).isin(6, 9) & (F.abs(F.month(left) - F.month(right)) == 1)
    same_year = F.year(left) == F.year(right)
    swapped = same_year & (F.month(left) == F.dayofmonth(right)) & (F.dayofmonth(left) == F.month(right))
    months = same_year & (F.dayofmonth(left) == F.dayofmonth(right)) & confused
    return (
        F.when(left.isNull() | right.isNull(), F.lit(float(p["missing_value"])))
        .when(left == right, 1.0)
        .when(swapped, F.lit(float(p.get("swap_month_day", 0.5))))
        .when(months, F.lit(0.5))
        .otherwise(0.0)
    )


#: Kinds of comparers of one column on either side; a caller may register others.
SIMPLE: dict[str, Callable[[Column, Column, Params], Column]] = {"jarowinkler": jarowinkler, "levenshtein": levenshtein, "exact": exact, "byear": byear, "numeric": numeric, "date": date}


def register(kind: str, comparer: Callable[[Column, Column, Params], Column]) -> None:
    """Add a comparer of the caller's own."""
    SIMPLE[kind] = comparer


def inputs(name: str, kind: str) -> tuple[list[str], list[str]]:
    """The columns of a and of b that a comparison reads."""
    if kind == "inv_jarowinkler":
        return [name[:5]], [name[5:]]
    if kind == "bmonthbday":
        return ["bmonth", "bday"], ["bmonth", "bday"]
    if kind == "minitial":
        return ["minitial", "mname"], ["minitial", "mname"]
    return [name], [name]


def compare(name: str, params: Params) -> Column:
    """The score of a named comparison over a pair's columns a_... and b_...."""
    kind = params["comparer"]
    left, right = inputs(name, kind)
    a, b = [F.col(f"a_{c}") for c in left], [F.col(f"b_{c}") for c in right]
    if kind == "inv_jarowinkler":
        return jarowinkler(a[0], b[0], params)
    if kind == "bmonthbday":
        return bmonthbday(*a, *b, params)
    if kind == "minitial":
        return minitial(*a, *b, params)
    if kind not in SIMPLE:
        raise ValueError(f"unknown comparer {kind}")
    return SIMPLE[kind](a[0], b[0], params)
