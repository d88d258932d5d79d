"""Actions that a reviewer suggests (X22, X23, A11, U8), read from short texts and checked against seeds."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How additions and exclusions begin, the longest first.
ADDITIONS = ["add and constraint with", "add and constraint", "add constraint", "narrow with", "narrow on", "and", "add"]
EXCLUSIONS = ["exclude", "remove", "drop", "filter out"]


def _opening(starts: list[str]) -> re.Pattern[str]:
    return re.compile(rf"(?:{'|'.join(starts)})(?=[: \t]|$)[: \t]*(.*)", re.I | re.S)


_ADD, _EXCLUDE = _opening(ADDITIONS), _opening(EXCLUSIONS)


@dataclass
class Actions:
    add: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    other: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Rejected:
    phrase: str
    mode: str
    reason: str
    coverage: float | None = None


def _phrase(text: str) -> str:
    return text.strip().strip(" \t\n.,;:").strip("\"'“”‘’")


def unique(items: list[str]) -> list[str]:
    """U8: the first of items that differ in case only."""
    seen: dict[str, str] = {}
    for item in items:
        seen.setdefault(item.lower(), item)
    return list(seen.values())


def parse(texts: list[str]) -> Actions:
    """Exclusions first, then additions, each once whatever its case; the rest stays as it is."""
    out = Actions()
    for text in (t.strip() for t in texts if isinstance(t, str) and t.strip()):
        found = _EXCLUDE.match(text)
        if found and (phrase := _phrase(found[1])):
            out.exclude.append(phrase)
            continue
        found = _ADD.match(text)
        if found and (phrase := re.sub(r"\s+from\s+(the\s+)?brief\s*$", "", _phrase(found[1]), flags=re.I).strip()):
            out.add.append(phrase)
            continue
        out.other.append(text)
    out.add, out.exclude = unique(out.add), unique(out.exclude)
    return out


def coverage(phrase: str, seeds: list[str]) -> float:
    """The share of seed texts that contain a phrase; none without seeds, or without a phrase."""
    needle = phrase.lower().strip()
    return sum(needle in s.lower() for s in seeds) / len(seeds) if seeds and needle else 0.0


def coverage_by_cluster(seeds: DataFrame, phrases: list[str]) -> DataFrame:
    """A11 on a table: (cluster, phrase, coverage) over seeds (cluster, title, abstract), all phrases in one pass."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))))
    row = seeds.groupBy("cluster").agg(*[F.avg(text.contains(p.lower().strip()).cast("double")).alias(f"_{k}") for k, p in enumerate(phrases)])
    return row.select("cluster", F.explode(F.array(*[F.struct(F.lit(p).alias("phrase"), F.col(f"_{k}").alias("coverage")) for k, p in enumerate(phrases)])).alias("s")).select("cluster", "s.phrase", "s.coverage")


def validate(actions: Actions, seeds: list[str], least: float = 0.5, applied: tuple[str, ...] = (), excluded: tuple[str, ...] = ()) -> tuple[list[str], list[str], list[Rejected]]:
    """(additions, exclusions, rejected): additions keep ``least`` of the seeds, exclusions spare as many; what is applied already goes."""
    kept: dict[str, list[str]] = {"add": [], "exclude": []}
    rejected = []
    for mode, phrases, known in (("add", actions.add, applied), ("exclude", actions.exclude, excluded)):
        before = {k.lower() for k in known}
        for phrase in phrases:
            share = coverage(phrase, seeds)
            if phrase.lower() in before:
                rejected.append(Rejected(phrase, mode, "already applied in a previous iteration"))
            elif mode == "add" and share < least:
                rejected.append(Rejected(phrase, mode, f"coverage {share:.2f} < min_seed_fraction {least:.2f}", share))
            elif mode == "exclude" and share > 1 - least:
                rejected.append(Rejected(phrase, mode, f"coverage {share:.2f} > {1 - least:.2f} (excluding would drop too many seeds)", share))
            else:
                kept[mode].append(phrase)
    return kept["add"], kept["exclude"], rejected
