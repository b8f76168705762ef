"""Acceptance of scored pairs: a rule for each pass and level, levels cumulative from strict to review."""

from __future__ import annotations

import importlib.util
import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinforge.config import LEVELS, MatchConfig
from kinforge.functions import similarity


@dataclass(frozen=True)
class Scores:
    """The scores of a pass as Columns. A comparison that wasn't made has no value, so a test of it is false."""

    made: frozenset[str]
    thresholds: dict[str, float]
    missed: set[str] = field(default_factory=set)

    def __getitem__(self, name: str) -> Column:
        if name not in self.made:
            self.missed.add(name)
            return F.lit(None).cast("double")
        return F.col(name)

    def cut(self, name: str) -> float:
        return self.thresholds.get(name, 1.0)

    def at_least(self, name: str, threshold: str | float) -> Column:
        return self.yes(self[name] >= (self.cut(threshold) if isinstance(threshold, str) else threshold))

    def is_one(self, *names: str) -> Column:
        return self.all(*[self.yes(self[n] == 1) for n in names])

    @staticmethod
    def yes(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    @staticmethod
    def all(*cs: Column) -> Column:
        out = cs[0]
        for c in cs[1:]:
            out = out & c
        return out

    @staticmethod
    def any(*cs: Column) -> Column:
        out = cs[0]
        for c in cs[1:]:
            out = out | c
        return out

    # masks
    @property
    def no_id(self) -> Column:
        return self.yes(self["common_id"] == -1) if "common_id" in self.made else F.lit(True)

    @property
    def initial_agrees(self) -> Column:
        return self.any(self.is_one("minitial"), self.yes(self["minitial"] == 0.7) & self.at_least("mname", "name_very_high"))

    @property
    def same_birth(self) -> Column:
        return self.is_one("bmonthbday", "byear")

    @property
    def near_birth(self) -> Column:
        near_year = self.is_one("bmonthbday") & self.at_least("byear", 0.7)
        near_day = self.yes(self["bmonthbday"].between(0.6, 0.8)) & self.is_one("byear")
        return near_year | near_day

    @property
    def same_place(self) -> Column:
        return self.is_one("zipcode") | self.is_one("county")


Rule = Callable[[Scores], Column]
RULES: dict[tuple[int, str], Rule] = {}


def rule(number: int, *levels: str) -> Callable[[Rule], Rule]:
    """Register a rule for a pass and levels; later registrations replace earlier ones, so callers can bring their own."""

    def keep(f: Rule) -> Rule:
        for level in levels:
            RULES[number, level] = f
        return f

    return keep


@rule(0, *LEVELS)
def _always(s: Scores) -> Column:
    return F.lit(True)


RULES[1, "review"] = _always


def _names(s: Scores, pair: tuple[str, str], cut: str | float = "name_high") -> Column:
    return s.at_least(pair[0], cut) & s.at_least(pair[1], cut)


STRAIGHT, CROSSED = ("fname", "lname"), ("fnamelname", "lnamefname")


@rule(1, "strict")
def _p1_strict(s: Scores) -> Column:
    return s.near_birth & (_names(s, STRAIGHT) | _names(s, CROSSED))


@rule(1, "moderate")
def _p1_moderate(s: Scores) -> Column:
    first, last = s.at_least("fname", "name_high"), s.at_least("lname", "name_high")
    return s.any(first & last, _names(s, CROSSED), first & s.at_least("byear", 0.7), (first | last) & s.near_birth)


@rule(1, "relaxed")
def _p1_relaxed(s: Scores) -> Column:
    return s.at_least("fname", "name_high") | s.near_birth


def _two(s: Scores, pair: tuple[str, str]) -> Column:
    """Both names equal and a near birth date, or one of them close and the same birth date."""
    x, y = pair
    one_close = (s.at_least(x, "name_high") & s.is_one(y)) | (s.is_one(x) & s.at_least(y, "name_high"))
    return (s.is_one(x, y) & s.near_birth) | (one_close & s.same_birth)


def _lone_place(s: Scores, pair: tuple[str, str]) -> Column:
    """Without ids and middle names, the place decides between equal names and birth dates."""
    return s.all(s.no_id, s.is_one(*pair), s.same_birth, s.yes(s["mname"] == -1), s.same_place)


def _strict_names(s: Scores, pair: tuple[str, str]) -> Column:
    with_id = s.at_least("common_id", "id_high") & _two(s, pair)
    without = s.all(s.no_id, _two(s, pair), s.initial_agrees | s.at_least("altlname", "name_high"))
    other = s.all(s.is_one(*pair), s.same_birth, s.is_one("altlname") | s.initial_agrees)
    return s.any(with_id, without, other)


def _moderate_names(s: Scores, pair: tuple[str, str]) -> Column:
    support = s.any(s.at_least("common_id", "id_high"), s.at_least("mname", "name_high"), s.at_least("altlname", "name_high"), s.same_place)
    return s.all(_names(s, pair), s.near_birth, support)


def _review_names(s: Scores, pair: tuple[str, str], cut: float) -> Column:
    return _names(s, pair, cut) & (s.near_birth | s.at_least("common_id", "id_review"))


RULES[2, "strict"] = lambda s: _strict_names(s, STRAIGHT) | _lone_place(s, STRAIGHT)
RULES[2, "moderate"] = lambda s: _moderate_names(s, STRAIGHT)
RULES[2, "relaxed"] = lambda s: _names(s, STRAIGHT) & (s.near_birth | s.at_least("common_id", "id_high"))
RULES[2, "review"] = lambda s: _review_names(s, STRAIGHT, s.cut("name_review"))
RULES[3, "strict"] = lambda s: _strict_names(s, CROSSED)
RULES[3, "moderate"] = lambda s: _moderate_names(s, CROSSED) | _lone_place(s, CROSSED)
RULES[3, "relaxed"] = lambda s: _names(s, CROSSED) & (s.same_birth | s.at_least("common_id", "id_high"))
RULES[3, "review"] = lambda s: _review_names(s, CROSSED, s.cut("name_review") - 0.05)


@rule(4, "strict")
def _p4_strict(s: Scores) -> Column:
    near, other = s.is_one("fname") & s.at_least("lname", "name_high"), s.at_least("altlname", "name_high")
    with_id = s.at_least("common_id", "id_high") & _names(s, STRAIGHT)
    return s.any(with_id, s.all(s.no_id, near, s.initial_agrees | other), near & (s.initial_agrees | s.is_one("altlname")))


@rule(4, "moderate")
def _p4_moderate(s: Scores) -> Column:
    return _names(s, STRAIGHT) & s.any(s.at_least("mname", "name_high"), s.at_least("altlname", "name_high"), s.same_place)


@rule(4, "relaxed")
def _p4_relaxed(s: Scores) -> Column:
    first, last, ids = s.at_least("fname", "name_high"), s.at_least("lname", "name_high"), s.at_least("common_id", "id_high")
    return s.any(first & last, first & ids, last & ids)


@rule(4, "review")
def _p4_review(s: Scores) -> Column:
    cut = s.cut("name_review") - 0.1
    return (s.at_least("lname", cut) & s.at_least("common_id", "id_review")) | _names(s, STRAIGHT, cut)


#: Rules that only become false if scores fall or are unknown; Possible holds for no others.
_OWN = frozenset(RULES.values())
#: Comparisons that are as cheap as a bound, by kind, the cheapest first.
_CHEAP = ("byear", "bmonthbday", "levenshtein")


class Terms(frozenset):
    """Alternatives of what must hold together, each a set of (comparison, least score); none is false, an empty one true. An
    alternative that another one implies is left out, so the condition of all levels is as short as that of the laxest."""

    def __new__(cls, terms=()):
        most = {frozenset((n, max(t for m, t in term if m == n)) for n, _ in term) for term in terms}
        implied = lambda x, y: all(any(m == n and t >= least for m, t in x) for n, least in y)  # noqa: E731 - x implies y
        return super().__new__(cls, (x for x in most if not any(x != y and implied(x, y) for y in most)))

    def __and__(self, other: Terms) -> Terms:
        return Terms(x | y for x in self for y in other)

    def __or__(self, other: Terms) -> Terms:
        return Terms([*self, *other])


_ANYTHING = Terms([frozenset()])


@dataclass(frozen=True)
class _Least:
    """A score of which only its least value counts; the value of an unknown one says nothing."""

    name: str
    known: bool

    def __ge__(self, least: float) -> Terms:
        return Terms([frozenset([(self.name, least)])]) if self.known else _ANYTHING

    def __eq__(self, value: object) -> Terms:
        return self >= value if value == 1 else _ANYTHING

    def between(self, low: float, high: float) -> Terms:
        return self >= low


@dataclass(frozen=True)
class Possible(Scores):
    """The scores of a pair as a rule's least demands on them: a rule gives Terms. What isn't known may have any value."""

    known: frozenset[str] = frozenset()

    def __getitem__(self, name: str) -> _Least:
        return _Least(name, name in self.known)

    def at_least(self, name: str, threshold: str | float) -> Terms:
        return super().at_least(name, threshold) if name in self.made else Terms()

    def is_one(self, *names: str) -> Terms:
        return super().is_one(*names) if self.made.issuperset(names) else Terms()

    @staticmethod
    def yes(c: Terms) -> Terms:
        return c

    @property
    def no_id(self) -> Terms:
        return _ANYTHING


def _bounds(made: list[str], config: MatchConfig, lettered: set[str]) -> dict[str, Callable[[float], Column]]:
    """For each comparison that can be looked at before names are compared, whether it can be at least so much: birth dates and ids as
    they are, names by the letters of columns in lettered."""
    out = {}
    for n in made:
        params = config.params(n)
        kind = params["comparer"]
        if kind == "levenshtein" and similarity.SIMPLE[kind] is similarity.levenshtein:
            (x,), (y,) = similarity.inputs(n, kind)
            out[n] = lambda least, x=x, y=y, p=params: similarity.levenshtein_possible(x, y, least, p)
        elif kind in _CHEAP:
            out[n] = lambda least, n=n, p=params: Scores.yes(similarity.compare(n, p) >= least)
        elif kind == "inv_jarowinkler" or kind == "jarowinkler" and similarity.SIMPLE[kind] is similarity.jarowinkler:
            (x,), (y,) = similarity.inputs(n, kind)
            if {x, y} <= lettered:
                out[n] = lambda least, x=x, y=y, p=params: similarity.jarowinkler_possible(x, y, least, p)
    return out


def possible(number: int, made: list[str], config: MatchConfig, levels: tuple[str, ...], lettered: set[str]) -> Column | None:
    """A condition on the two rows of a pair that holds wherever a pass's rule for one of the levels does; None if there is none, or
    a rule is the caller's own, of which nothing is known. lettered: the columns of which both sides have letter_columns.

    It is kept short, since a JVM doesn't compile methods of over 8000 bytes: what all alternatives ask for is asked once, and the
    condition of all levels is taken where it is the shorter one."""
    every = {level: r for (n, level), r in rules_of(config).items() if n == number}
    rules = [r for level, r in every.items() if level in levels]
    if not rules or not _OWN.issuperset(every.values()):
        return None
    bounds = _bounds(made, config, lettered)
    scores = Possible(frozenset(made), config.thresholds, known=frozenset(bounds))
    of = lambda rs: _ANYTHING if _always in rs else scores.any(*[r(scores) for r in rs])
    terms = min(of(rules), of([*every.values()]), key=lambda x: sum(map(len, x)))
    if terms == _ANYTHING:
        return None
    cost = lambda atom: ([*_CHEAP[:2], "inv_jarowinkler", "jarowinkler", _CHEAP[2]].index(config.params(atom[0])["comparer"]), atom)
    together = lambda atoms: Scores.all(*[bounds[n](least) for n, least in sorted(atoms, key=cost)])
    shared = frozenset.intersection(*terms) if terms else frozenset()
    rest = [together(term - shared) for term in sorted(terms, key=lambda x: sorted(map(cost, x))) if term != shared]
    parts = [*([together(shared)] if shared else []), *([Scores.any(*rest)] if rest else [])]
    return Scores.all(*parts) if parts else F.lit(bool(terms))


def load_rules(path: str) -> dict[tuple[int, str], Rule]:
    """Rules of the caller's own from a Python file, or from accept_functions.py in a folder: a function accept_p<pass>_<level>(scores)
    for each pass and level that it replaces. They hold for the run that names the file and leave RULES as it is."""
    at = Path(path)
    at = at / "accept_functions.py" if at.is_dir() else at
    spec = importlib.util.spec_from_file_location(f"rules_{abs(hash(str(at)))}", at)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    named = {n: re.fullmatch(rf"accept_p(\d+)_({'|'.join(LEVELS)})", n) for n in dir(module)}
    return {(int(m[1]), m[2]): getattr(module, n) for n, m in named.items() if m}


def rules_of(config: MatchConfig) -> dict[tuple[int, str], Rule]:
    return {**RULES, **load_rules(config.rules_path)} if config.rules_path else RULES


def level_columns(number: int, made: list[str], config: MatchConfig) -> dict[str, Column]:
    """_<level>: what a pass's rule for the level says, without the stricter ones. A rule that asks for a comparison that wasn't
    made takes it as false, with a warning."""
    scores = Scores(frozenset(made), config.thresholds)
    rules = rules_of(config)
    columns = {f"_{level}": rules[number, level](scores) for level in LEVELS if (number, level) in rules}
    if scores.missed:
        warnings.warn(f"pass {number}: rules ask for comparisons that aren't made: {', '.join(sorted(scores.missed))}", stacklevel=2)
    return {f"_{level}": columns.get(f"_{level}", F.lit(False)) for level in LEVELS}


def flags() -> dict[str, Column]:
    """match_<level> from the columns of level_columns; each level includes the stricter ones."""
    out, before = {}, None
    for level in LEVELS:
        before = F.col(f"_{level}") if before is None else before | F.col(f"_{level}")
        out[f"match_{level}"] = before
    return out
