"""Configuration of a linkage run: what to block on, what to compare, when to accept. Loads from and saves to JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

MATCH_TYPES = ("121", "12M", "M21", "M2M", "dedup")
LEVELS = ("strict", "moderate", "relaxed", "review")
STANDARD = ("indv_id", "common_id", "fname", "mname", "lname", "altlname", "minitial", "xf", "xl", "byear", "bmonth", "bday", "zipcode", "county")


@dataclass(frozen=True)
class DatasetSpec:
    """Where a dataset is and how its columns map to the standard names."""

    name: str
    path: str
    filetype: str = "parquet"
    vars: dict[str, str] = field(default_factory=dict)
    fwf_widths: tuple[int, ...] = ()
    fwf_names: tuple[str, ...] = ()
    options: dict[str, str] = field(default_factory=dict)


# The default passes, comparisons, parameters and thresholds.
def _default_blocks() -> list[list[str]]:
    return [["common_id", "fname", "lname", "byear", "bmonth", "bday"], ["common_id"], ["xf", "xl"], ["xf_inv", "xl_inv"], ["byear", "bmonth", "bday"]]


def _default_comparisons() -> list[list[str]]:
    tail = ["common_id", "minitial", "zipcode", "county"]
    return [
        [],
        ["fname", "mname", "lname", "altlname", "bmonthbday", "byear", "fnamelname", "lnamefname"],
        ["fname", "mname", "lname", "altlname", "bmonthbday", "byear", *tail],
        ["fnamelname", "mname", "lnamefname", "altlname", "bmonthbday", "byear", *tail],
        ["fname", "mname", "lname", "altlname", *tail],
    ]


def _default_params() -> dict[str, dict]:
    names = {n: {"comparer": "jarowinkler", "missing_value": 0.5} for n in ("fname", "lname", "altlname")}
    crossed = {n: {"comparer": "inv_jarowinkler", "missing_value": 0.5} for n in ("fnamelname", "lnamefname")}
    places = {n: {"comparer": "exact", "missing_value": 0.5} for n in ("zipcode", "county")}
    return {
        **names,
        **crossed,
        **places,
        "mname": {"comparer": "jarowinkler", "missing_value": -1.0},
        "common_id": {"comparer": "levenshtein", "missing_value": -1.0},
        "bmonthbday": {"comparer": "bmonthbday", "swap_month_day": 0.8, "either_month_day": 0.6, "missing_value": 0.5},
        "byear": {"comparer": "byear", "year_dif": 1, "within_1y": 0.7, "missing_value": 0.5},
        "minitial": {"comparer": "minitial", "minit_match_mname_unclear": 0.7, "missing_value": 0.5},
    }


@dataclass
class MatchConfig:
    """One run. Passes are numbered from 0; an empty list skips a pass and keeps the exclusion of earlier ones, unless
    reset_on_empty_pass. Exclusion follows SQL's three-valued logic, unless null_safe_exclusion. With empty_equals_empty
    exact comparisons take two empty texts as equal instead of missing. rules_path names a file (or a folder with
    accept_functions.py) with acceptance rules of this run."""

    match_type: str = "dedup"
    blocks_by_pass: list[list[str]] = field(default_factory=_default_blocks)
    comp_names_by_pass: list[list[str]] = field(default_factory=_default_comparisons)
    sim_param: dict[str, dict] = field(default_factory=_default_params)
    thresholds: dict[str, float] = field(default_factory=lambda: {"name_high": 0.88, "name_very_high": 0.90, "id_high": 0.75, "name_review": 0.80, "id_review": 0.65})
    ground_truth_ids: list[str] = field(default_factory=list)
    block_columns: dict[str, str] = field(default_factory=lambda: {p: f"{p}_txt" for p in ("byear", "bmonth", "bday")})
    rules_path: str = ""
    null_safe_exclusion: bool = False
    empty_equals_empty: bool = False
    reset_on_empty_pass: bool = False
    datasets: list[DatasetSpec] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.match_type not in MATCH_TYPES:
            raise ValueError(f"unknown match type {self.match_type}")
        self.datasets = [d if isinstance(d, DatasetSpec) else DatasetSpec(**{**d, "fwf_widths": tuple(d.get("fwf_widths", ())), "fwf_names": tuple(d.get("fwf_names", ()))}) for d in self.datasets]

    @property
    def dedup(self) -> bool:
        return self.match_type == "dedup"

    def params(self, name: str) -> dict:
        """The parameters of a comparison in this run."""
        given = self.sim_param[name]
        return {**given, "empty_equals_empty": True} if self.empty_equals_empty and given["comparer"] == "exact" else given

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @classmethod
    def from_json(cls, text: str) -> MatchConfig:
        return cls(**json.loads(text))
