"""DuckDB SQL of the linkage queries, written for the test tables and the default configuration."""

from __future__ import annotations

from kinforge.plans.people import first_sql, second_sql

_PASSES = {
    "0": ["common_id", "fname", "lname", "byear_txt", "bmonth_txt", "bday_txt"],
    "1": ["common_id"],
    "2": ["xf", "xl"],
    "3": [("xf", "xl"), ("xl", "xf")],
    "4": ["byear_txt", "bmonth_txt", "bday_txt"],
}
_DEDUP = "a.idx < b.idx and a.indv_id <> b.indv_id"


def _on(number: str) -> str:
    pairs = [(k, k) if isinstance(k, str) else k for k in _PASSES[number]]
    return "(" + " and ".join(f"a.{x} = b.{y} and a.{x} <> '' and a.{x} is not null" for x, y in pairs) + ")"


def tables(dedup: bool) -> str:
    return f"with a as ({first_sql()}), b as ({first_sql() if dedup else second_sql()})"


def pairs(number: str, past: list[str], dedup: bool, cols: str = "a.idx idx_a, b.idx idx_b", label: str | None = None) -> str:
    where = [_on(number), *([f"not ({' or '.join(map(_on, past))})"] if past else []), *([_DEDUP] if dedup else [])]
    return f"select '{label or number}' passnum, {cols} from a join b on {' and '.join(where)}"


def all_pairs(dedup: bool) -> str:
    numbers = list(_PASSES) if dedup else ["2", "3", "4"]
    return " union all ".join(pairs(n, numbers[:i], dedup) for i, n in enumerate(numbers))


def _jw(x: str, y: str, missing: str) -> str:
    return f"case when coalesce(a.{x}, '') = '' or coalesce(b.{y}, '') = '' then cast({missing} as double) else jaro_winkler_similarity(a.{x}, b.{y}) end"


SIMS = {
    "fname": _jw("fname", "fname", "0.5"),
    "lname": _jw("lname", "lname", "0.5"),
    "altlname": _jw("altlname", "altlname", "0.5"),
    "mname": _jw("mname", "mname", "-1"),
    "fnamelname": _jw("fname", "lname", "0.5"),
    "lnamefname": _jw("lname", "fname", "0.5"),
    "common_id": "case when coalesce(a.common_id, '') = '' or coalesce(b.common_id, '') = '' then cast(-1 as double) else 1 - levenshtein(a.common_id, b.common_id) / cast(greatest(length(a.common_id), length(b.common_id)) as double) end",
    "zipcode": "case when coalesce(a.zipcode, '') = '' or coalesce(b.zipcode, '') = '' then cast(0.5 as double) when a.zipcode = b.zipcode then 1 else 0 end",
    "county": "case when coalesce(a.county, '') = '' or coalesce(b.county, '') = '' then cast(0.5 as double) when a.county = b.county then 1 else 0 end",
    "byear": "case when a.byear = b.byear then cast(1 as double) when abs(a.byear - b.byear) <= 1 then 0.7 when a.byear is null or b.byear is null then 0.5 else 0 end",
    "bmonthbday": "case when a.bmonth = b.bmonth and a.bday = b.bday then cast(1 as double) when a.bmonth = b.bday and a.bday = b.bmonth then 0.8 when a.bmonth = b.bmonth or a.bday = b.bday then 0.6 when a.bmonth is null or a.bday is null or b.bmonth is null or b.bday is null then 0.5 else 0 end",
    "minitial": "case when nullif(a.minitial, '') = nullif(b.minitial, '') then case when length(a.mname) = 1 or length(b.mname) = 1 then cast(1 as double) else 0.7 end when coalesce(a.minitial, '') = '' or coalesce(b.minitial, '') = '' then 0.5 else 0 end",
}
_TAIL = ["common_id", "minitial", "zipcode", "county"]
MADE = {
    "0": [],
    "1": ["fname", "mname", "lname", "altlname", "bmonthbday", "byear", "fnamelname", "lnamefname"],
    "2": ["fname", "mname", "lname", "altlname", "bmonthbday", "byear", *_TAIL],
    "3": ["fnamelname", "mname", "lnamefname", "altlname", "bmonthbday", "byear", *_TAIL],
    "4": ["fname", "mname", "lname", "altlname", *_TAIL],
}
_ORDER = list(dict.fromkeys(n for m in MADE.values() for n in m))

_H, _VH, _IDH, _R, _IDR = "cast(0.88 as double)", "cast(0.9 as double)", "cast(0.75 as double)", "cast(0.8 as double)", "cast(0.65 as double)"
_EQ = "(bmonthbday = 1 and byear = 1)"
_PART = "((bmonthbday = 1 and byear >= 0.7) or (bmonthbday between 0.6 and 0.8 and byear = 1))"
_MID = f"(minitial = 1 or (minitial = 0.7 and mname >= {_VH}))"
_LOC = "(zipcode = 1 or county = 1)"


def _two(f: str, n: str) -> str:
    return f"(({f} = 1 and {n} = 1 and {_PART}) or ({f} >= {_H} and {n} = 1 and {_EQ}) or ({f} = 1 and {n} >= {_H} and {_EQ}))"


def _rules(number: str, has_id: bool) -> dict[str, str]:
    null, hi, rev = ("common_id = -1", f"common_id >= {_IDH}", f"common_id >= {_IDR}") if has_id else ("true", "false", "false")
    if number == "0":
        return dict.fromkeys(("strict", "moderate", "relaxed", "review"), "true")
    if number == "1":
        fl, cross = f"(fname >= {_H} and lname >= {_H})", f"(fnamelname >= {_H} and lnamefname >= {_H})"
        return {"strict": f"{_PART} and ({fl} or {cross})", "moderate": f"{fl} or {cross} or (fname >= {_H} and byear >= 0.7) or ((fname >= {_H} or lname >= {_H}) and {_PART})", "relaxed": f"fname >= {_H} or {_PART}", "review": "true"}
    f, n = ("fnamelname", "lnamefname") if number == "3" else ("fname", "lname")
    if number in "23":
        lone = f"({null} and {f} = 1 and {n} = 1 and {_EQ} and mname = -1 and {_LOC})"
        strict = f"({hi} and {_two(f, n)}) or ({null} and {_two(f, n)} and ({_MID} or altlname >= {_H})) or ({f} = 1 and {n} = 1 and {_EQ} and (altlname = 1 or {_MID}))"
        both = f"{f} >= {_H} and {n} >= {_H}"
        moderate = f"({both} and {_PART} and ({hi} or mname >= {_H} or altlname >= {_H} or {_LOC}))"
        cut = _R if number == "2" else f"({_R} - cast(0.05 as double))"
        review = f"{f} >= {cut} and {n} >= {cut} and ({_PART} or {rev})"
        return {"strict": strict + (f" or {lone}" if number == "2" else ""), "moderate": moderate + (f" or {lone}" if number == "3" else ""), "relaxed": f"{both} and ({_PART if number == '2' else _EQ} or {hi})", "review": review}
    cut = f"({_R} - cast(0.1 as double))"
    near = f"fname = 1 and lname >= {_H}"
    return {
        "strict": f"({hi} and fname >= {_H} and lname >= {_H}) or ({null} and {near} and ({_MID} or altlname >= {_H})) or ({near} and ({_MID} or altlname = 1))",
        "moderate": f"fname >= {_H} and lname >= {_H} and (mname >= {_H} or altlname >= {_H} or {_LOC})",
        "relaxed": f"(fname >= {_H} and lname >= {_H}) or (fname >= {_H} and {hi}) or (lname >= {_H} and {hi})",
        "review": f"(lname >= {cut} and {rev}) or (fname >= {cut} and lname >= {cut})",
    }


def results(dedup: bool) -> str:
    """CTEs a, b and found (all passes, with flags and weight)."""
    frames = []
    numbers = list(_PASSES) if dedup else ["2", "3", "4"]
    for i, n in enumerate(numbers):
        made = [m for m in MADE[n] if dedup or m != "common_id"]
        sims = "".join(f", {SIMS[m]} {m}" for m in made)
        scored = pairs(n, numbers[:i], dedup, f"a.indv_id indv_id_a, b.indv_id indv_id_b, a.idx idx_a, b.idx idx_b{sims}")
        rules = _rules(n, "common_id" in made)
        flags, before = [], "false"
        for level in ("strict", "moderate", "relaxed", "review"):
            before = f"{before} or coalesce({rules[level]}, false)"
            flags.append(f"({before}) match_{level}")
        terms = "".join(f" + coalesce(case when {m} = -1 then 0.5 else {m} end, 0)" if m in made else "" for m in _ORDER)
        flag_sum = " + ".join(f"cast(match_{level} as int)" for level in ("strict", "moderate", "relaxed", "review"))
        frames.append(f"select passnum, {n} pass_order, indv_id_a, indv_id_b, idx_a, idx_b, match_strict, match_moderate, match_relaxed, match_review, cast(pow(10, {5 - int(n)}) as double) + {flag_sum}{terms} weight from (select *, {', '.join(flags)} from ({scored})) where match_review")
    return f"{tables(dedup)}, found as ({' union all '.join(frames)})"
