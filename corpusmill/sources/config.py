"""Settings in YAML (S7, F12): read once, checked, with defaults for what is missing."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import yaml

from corpusmill.operators.ranking import WEIGHTS

#: How the components are called in settings.
NAMES = {"lexical": "lexical", "semantic": "semantic", "concept": "concept", "seed_overlap": "seed_overlap", "recency": "recency", "citation_velocity": "velocity", "work_type_match": "work_type"}


#: Subject areas that are searched unless others are named.
AREAS = ("COMP", "BUSI", "ENGI", "SOCI", "DECI", "ECON")


@dataclass(frozen=True)
class Scoring:
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    reference_year: int | None = None
    half_life_years: float = 3.0
    saturation_per_year: float = 30.0
    window_years: int = 5
    per_year: int = 75
    sort: str = "-citedby-count,-coverDate"
    subject_areas: tuple[str, ...] = AREAS


@lru_cache(maxsize=32)
def read_yaml(path: str) -> dict:
    """The mapping in a file; an empty file, or one with something else in it, is an error."""
    data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(data, dict):
        raise ValueError(f"{path} has no settings")
    return data


def scoring(path: str | None = None) -> Scoring:
    """Weights, ages, sampling and subject areas; without a file the defaults. Unknown weights, and ones below zero, are errors."""
    data = read_yaml(path) if path else {}
    part = lambda name: data.get(name) or {}
    given = part("weights")
    if unknown := set(given) - set(NAMES):
        raise ValueError(f"unknown weights: {sorted(unknown)}")
    weights = dict(WEIGHTS) | {NAMES[k]: float(v) for k, v in given.items()}
    if any(w < 0 for w in weights.values()):
        raise ValueError("a weight is below zero")
    ages, cites, sample, subjects = part("recency"), part("citation_velocity"), part("sampling"), part("subject_areas")
    areas = tuple(subjects.get("codes") or AREAS) if subjects.get("enabled", True) else ()
    return Scoring(weights, ages.get("current_year"), float(ages.get("half_life_years", 3.0)), float(cites.get("saturation", 30.0)), max(1, int(sample.get("window_years", 5))),
                   max(1, int(sample.get("per_year_results", 75))), str(sample.get("sort", "-citedby-count,-coverDate")), areas)
