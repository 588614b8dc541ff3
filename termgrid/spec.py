"""What a panel looks like: column names, grade bands, year windows, terms.

Inside the library every column has a short snake_case name, so nothing needs
back-ticks.  ``PanelSpec`` maps those names to the names a source file uses
(``Course Title``, ``A+``, ...) when data comes in and when results go out.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from enum import StrEnum

from pyspark.sql import DataFrame

# The grade bands of the source table and their grade points.
GRADE_POINTS = {
    "A+": 4.0, "A": 4.0, "A-": 3.7,
    "B+": 3.3, "B": 3.0, "B-": 2.7,
    "C+": 2.3, "C": 2.0, "C-": 1.7,
    "D+": 1.3, "D": 1.0, "D-": 0.7,
    "F": 0.0,
}


class Term(StrEnum):
    """The two terms that count, in calendar order."""

    SPRING = "spring"
    FALL = "fall"


TERMS = tuple(term.value for term in Term)
# Years of a window, and the years a panel's windows lie in by default.
WINDOW_YEARS = 3
FIRST_YEAR, LAST_YEAR = 2021, 2025
# Defaults of the demand, risk and profile analyses.
HIGH_DEMAND_QUANTILE = 0.75
HIGH_RISK_QUANTILE = 0.75
MIN_DEMAND = 20
RECALL_FRACTION = 0.20
MIN_SUPPORT = 20
RANDOM_STATE = 42
PROFILE_MIN_ROWS = 12
PROFILE_MAX_K = 5
PROFILE_MIN_SILHOUETTE = 0.05
MIN_HISTORY_YEARS = 3


def band_name(grade: str) -> str:
    """``A+`` -> ``a_plus``, ``A`` -> ``a``, ``A-`` -> ``a_minus``."""
    return grade.lower().replace("+", "_plus").replace("-", "_minus")


BANDS = tuple(band_name(grade) for grade in GRADE_POINTS)
BAND_POINTS = {band_name(grade): points for grade, points in GRADE_POINTS.items()}
SHARES = tuple(f"share_{band}" for band in BANDS)
MEASURES = (*BANDS, "w", "students")

COURSE_TERM_KEY = ("year", "term", "subject", "number", "title")
COURSE_KEY = ("subject", "number", "title")
STABLE_KEY = ("subject", "number")
STABLE_TERM_KEY = ("year", "term", "subject", "number")
SOURCE_ROW_KEY = ("year", "term", "subject", "number", "title", "sched_type", "instructor")


def _default_columns() -> dict[str, str]:
    names = {
        "year": "Year", "term": "Term", "year_term": "YearTerm", "subject": "Subject",
        "number": "Number", "title": "Course Title", "sched_type": "Sched Type",
    }
    names.update({band_name(grade): grade for grade in GRADE_POINTS})
    names.update({"w": "W", "students": "Students", "instructor": "Primary Instructor"})
    return names


@dataclass(frozen=True)
class PanelSpec:
    """Column names of a source and the years a window may use."""

    columns: dict[str, str] = field(default_factory=_default_columns)
    window: tuple[int, int, int] = (2021, 2022, 2023)
    terms: tuple[str, ...] = TERMS
    first_year: int = FIRST_YEAR
    last_year: int = LAST_YEAR

    def __post_init__(self) -> None:
        check_window(self.window, self)
        object.__setattr__(self, "terms", check_terms(self.terms))

    @property
    def train_years(self) -> tuple[int, int]:
        return self.window[:2]

    @property
    def holdout_year(self) -> int:
        return self.window[2]

    def windows(self) -> list[tuple[int, int, int]]:
        """Every three-year window the spec allows, earliest first."""
        return year_runs(self.first_year, self.last_year)

    def canonical(self, df: DataFrame) -> DataFrame:
        """Rename source columns to the library's names; other columns stay."""
        have = set(df.columns)
        return df.withColumnsRenamed(
            {source: name for name, source in self.columns.items() if source in have and source != name}
        )

    def published(self, df: DataFrame) -> DataFrame:
        """Rename library columns back to the names the source uses."""
        names = dict(self.columns)
        names.update({f"share_{band}": f"share_{names[band]}" for band in BANDS})
        names.update({f"historical_share_{band}": f"historical_share_{names[band]}" for band in BANDS})
        names.update({"w_proxy": "W_proxy", "year_offset": "Year_offset"})
        return df.withColumnsRenamed({c: names[c] for c in df.columns if c in names})


@dataclass(frozen=True)
class TrajectorySpec:
    """Years of the six-year same-course backtest."""

    source_years: tuple[int, ...] = (2019, 2020, 2021, 2022, 2023, 2024)
    train_years: tuple[int, ...] = (2022, 2023)
    holdout_year: int = 2024
    primary_years: tuple[int, ...] = (2021, 2022, 2023)
    terms: tuple[str, ...] = TERMS
    lags: tuple[int, ...] = (1, 2, 3)
    min_history_years: int = MIN_HISTORY_YEARS

    def __post_init__(self) -> None:
        years = self.source_years
        if not years or list(years) != list(range(years[0], years[0] + len(years))):
            raise ValueError("source years must be consecutive")
        if len(years) > 64:
            raise ValueError("at most 64 source years; title changes keep a year as one bit")
        if tuple(self.terms) != TERMS:
            raise ValueError("the trajectory uses the spring and fall terms")
        targets = set(self.target_years)
        if not targets <= set(years) or min(targets) - max(self.lags) < years[0]:
            raise ValueError("every target year needs its lag years inside the source years")

    @property
    def target_years(self) -> tuple[int, ...]:
        return (*self.train_years, self.holdout_year)


def year_runs(first: int, last: int, length: int = WINDOW_YEARS) -> list[tuple[int, ...]]:
    """Every run of ``length`` years between two years, earliest first."""
    return [tuple(range(start, start + length)) for start in range(first, last - length + 2)]


def check_window(window: tuple[int, int, int], spec: PanelSpec | None = None) -> tuple[int, int, int]:
    """The window itself, if it is one of the runs of years that the spec (or its default) allows."""
    first, last = (spec.first_year, spec.last_year) if spec else (FIRST_YEAR, LAST_YEAR)
    if type(window) is not tuple or not {type(year) for year in window} <= {int}:
        raise TypeError(f"a window is a tuple of {WINDOW_YEARS} whole years, got {window!r}")
    if window not in year_runs(first, last):
        raise ValueError(f"{window} is no run of {WINDOW_YEARS} years within {first} to {last}")
    return window


def check_terms(terms: tuple[str, ...]) -> tuple[str, ...]:
    """The names of the terms, each a ``Term`` however it is spelt, and none twice."""
    if type(terms) is not tuple or not {type(term) for term in terms} <= {str, Term}:
        raise TypeError(f"terms are a tuple of names, got {terms!r}")
    named = dict.fromkeys(Term(term.strip().lower()) for term in terms)
    if not terms or len(named) < len(terms):
        raise ValueError(f"each term is named once and there is at least one, got {terms!r}")
    return tuple(term.value for term in named)


@dataclass(frozen=True)
class NumberRange:
    """Numbers a parameter may take: their kinds, and the lowest and highest, themselves allowed or not."""

    kinds: tuple[type, ...]
    low: float
    high: float
    ends: bool

    def take(self, value, name: str):
        if not isinstance(value, self.kinds) or value is True or value is False:
            raise TypeError(f"{name} = {value!r} is not of {', '.join(kind.__name__ for kind in self.kinds)}")
        inside = self.low <= value <= self.high if self.ends else self.low < value < self.high
        if not inside:
            raise ValueError(f"{name} = {value!r} is outside of {self}")
        return value

    def __str__(self) -> str:
        return ("[{}, {}]" if self.ends else "({}, {})").format(self.low, self.high)


FRACTION = NumberRange((int, float), 0, 1, ends=False)
COUNT = NumberRange((int,), 0, float("inf"), ends=True)


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    absent = set(columns) - set(df.columns)
    if absent:
        raise ValueError(f"missing required columns: {', '.join(sorted(absent))}")
