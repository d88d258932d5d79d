"""Reviewed corrections of clusters (R1 to R3, J16, U7, K4, K5, S7): a snapshot to edit, hard checks, a diff, and the gate."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime
from pathlib import Path

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOISE = -1
VERSION = 1


class ReviewError(ValueError):
    """A review that contradicts the clusters it is about."""


class ReviewCancelled(RuntimeError):
    """The reviewer gave up: nothing is applied."""


class NoTerminal(RuntimeError):
    """A review was to be confirmed where nobody can answer."""


@dataclass
class ReviewedCluster:
    id: int
    papers: list[str]
    label: str = ""
    description: str = ""
    notes: str = ""


@dataclass
class Applied:
    """What a review changes; ``clusters`` as they are afterwards."""

    clusters: list[dict]
    moved: list[dict] = field(default_factory=list)
    label_changes: list[dict] = field(default_factory=list)
    description_changes: list[dict] = field(default_factory=list)
    new_ids: list[int] = field(default_factory=list)
    dropped_ids: list[int] = field(default_factory=list)
    remap: dict[int, int] = field(default_factory=dict)
    before: dict[str, int] = field(default_factory=dict)
    after: dict[str, int] = field(default_factory=dict)

    @property
    def recompute(self) -> bool:
        """Whether terms and centroids must be made anew."""
        return bool(self.moved or self.new_ids or self.dropped_ids)


def violations(original: DataFrame, review: DataFrame) -> DataFrame:
    """(kind, paper_id) of what makes a review invalid: unknown papers, papers listed twice, papers listed nowhere.

    Both tables are (cluster_id, paper_id). An empty result means that the review may be applied.
    """
    phantom = review.join(original, "paper_id", "left_anti").select(F.lit("phantom").alias("kind"), "paper_id")
    twice = review.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("duplicate").alias("kind"), "paper_id")
    nowhere = original.join(review, "paper_id", "left_anti").select(F.lit("unassigned").alias("kind"), "paper_id")
    return phantom.unionByName(twice).unionByName(nowhere).distinct()


def moves(original: DataFrame, review: DataFrame) -> DataFrame:
    """(paper_id, from_cluster, to_cluster) of each paper that the review puts elsewhere."""
    old, new = original.withColumnRenamed("cluster_id", "from_cluster"), review.withColumnRenamed("cluster_id", "to_cluster")
    return old.join(new, "paper_id", "full_outer").filter("NOT (from_cluster <=> to_cluster)")


def remap(original: DataFrame, review: DataFrame) -> DataFrame:
    """(from_cluster, to_cluster) of clusters some of whose papers moved, all of those to one other."""
    went = moves(original, review).groupBy("from_cluster").agg(F.countDistinct("to_cluster").alias("n"), F.min("to_cluster").alias("to_cluster"))
    return went.filter("n = 1").select("from_cluster", "to_cluster")


def changes(original: DataFrame, clusters: DataFrame, review: DataFrame, blocks: DataFrame) -> DataFrame:
    """(kind, cluster_id, paper_id, before, after): what a valid review changes, as a table.

    ``original`` and ``review`` are (cluster_id, paper_id), ``clusters`` and ``blocks`` (cluster_id, label, description) before
    and after. Kinds are moved, label, description, new, dropped, and remap where all that left a cluster went to one
    other. An empty or missing label or description keeps the old one; papers, labels and texts are as strings.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    before = clusters.select("cluster_id", text("label").alias("_label"), text("description").alias("_told"), F.lit(True).alias("_old"))
    after = blocks.select("cluster_id", text("label").alias("label_"), text("description").alias("told_"), F.lit(True).alias("_new"))
    both = before.join(after, "cluster_id", "full_outer")
    kept = F.col("_old") & F.col("_new")
    row = lambda df, kind, paper=None, a=None, b=None: df.select(F.lit(kind).alias("kind"), F.col("cluster_id").cast("string").alias("cluster_id"), *[(F.lit(None) if c is None else c).cast("string").alias(n) for c, n in ((paper, "paper_id"), (a, "before"), (b, "after"))])
    went = moves(original, review)
    out = row(went.withColumn("cluster_id", F.col("to_cluster")), "moved", F.col("paper_id"), F.col("from_cluster"), F.col("to_cluster"))
    out = out.unionByName(row(both.filter(kept & (F.col("label_") != "") & (F.col("label_") != F.col("_label"))), "label", None, F.col("_label"), F.col("label_")))
    out = out.unionByName(row(both.filter(kept & (F.col("told_") != "") & (F.col("told_") != F.col("_told"))), "description", None, F.col("_told"), F.col("told_")))
    out = out.unionByName(row(both.filter(F.col("_old").isNull()), "new")).unionByName(row(both.filter(F.col("_new").isNull()), "dropped"))
    return out.unionByName(row(remap(original, review).withColumn("cluster_id", F.col("from_cluster")), "remap", None, F.col("from_cluster"), F.col("to_cluster")))


def change_counts(changed: DataFrame) -> DataFrame:
    """One row of ``changes``: how many of each kind, and whether terms and centroids must be made anew."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return changed.agg(n("moved").alias("n_moved"), n("label").alias("n_labels"), n("description").alias("n_descriptions"), n("new").alias("n_new"), n("dropped").alias("n_dropped"), (n("moved") + n("new") + n("dropped") > 0).alias("recompute"))


def applied_assignment(original: DataFrame, review: DataFrame) -> DataFrame:
    """The review's (cluster_id, paper_id), or an error with the first of what is wrong with it."""
    wrong = violations(original, review).orderBy("kind", "paper_id").limit(10).collect()
    if wrong:
        raise ReviewError("; ".join(f"{r['kind']}: {r['paper_id']}" for r in wrong))
    return review


def snapshot(clusters: list[dict], titles: dict[str, str] | None = None, reviewer: str = "", source: str = "", model: str = "") -> str:
    """K4: clusters (cluster_id, label, paper_ids) as YAML to edit: noise first, without a label, then by id."""
    titles = titles or {}
    rows = [{"id": c["cluster_id"], "label": "" if c["cluster_id"] == NOISE else c["label"], "description": "", "papers": [{"id": p, "title": titles.get(p, "")} for p in c["paper_ids"]]}
            for c in sorted(clusters, key=lambda c: (c["cluster_id"] != NOISE, c["cluster_id"]))]
    meta = {"reviewer": reviewer, "generated_at": datetime.now().isoformat(timespec="seconds"), "source_clusters_file": source, "model": model, "notes": ""}
    return yaml.safe_dump({"version": VERSION, "meta": meta, "clusters": rows}, sort_keys=False, allow_unicode=True, width=4096)


def read_review(text: str) -> list[ReviewedCluster]:
    """The clusters of an edited snapshot; papers may be bare ids. An empty or misshapen one is an error."""
    data = yaml.safe_load(text)
    if data is None:
        raise ReviewError("the review is empty")
    if not isinstance(data, dict) or data.get("version") != VERSION or not isinstance(data.get("clusters"), list):
        raise ReviewError(f"a review has version {VERSION} and a list of clusters")
    out = []
    for entry in data["clusters"]:
        try:
            papers = [str(p["id"] if isinstance(p, dict) else p) for p in entry.get("papers") or []]
            out.append(ReviewedCluster(int(entry["id"]), papers, *(str(entry.get(k) or "").strip() for k in ("label", "description", "notes"))))
        except (KeyError, TypeError, ValueError, AttributeError) as e:
            raise ReviewError(f"cannot read a cluster of the review: {entry!r}") from e
    return out


def _checked(review: list[ReviewedCluster], before: dict[str, int]) -> dict[str, int]:
    after: dict[str, int] = {}
    ids = [c.id for c in review]
    for c in review:
        if ids.count(c.id) > 1:
            raise ReviewError(f"cluster {c.id} is listed more than once")
        if not c.papers:
            raise ReviewError(f"cluster {c.id} has no papers: move some into it, or remove its block")
        for paper in c.papers:
            if paper not in before:
                raise ReviewError(f"paper {paper!r} of cluster {c.id} is in no cluster")
            if paper in after:
                raise ReviewError(f"paper {paper!r} is in clusters {after[paper]} and {c.id}")
            after[paper] = c.id
    if missing := sorted(set(before) - set(after)):
        raise ReviewError(f"papers in no cluster of the review: {missing[:10]}")
    return after


def apply_review(clusters: list[dict], review: list[ReviewedCluster]) -> Applied:
    """The clusters after a review, and what changed; an error if the review is invalid.

    ``clusters`` have cluster_id, label, paper_ids, and maybe top_terms and description. An empty label keeps the old
    one. A remap of an origin whose papers went to several targets is left out.
    """
    old = {c["cluster_id"]: c for c in clusters}
    before: dict[str, int] = {}
    for c in clusters:
        for paper in c["paper_ids"]:
            if paper in before:
                raise ReviewError(f"paper {paper!r} is in the original clusters {before[paper]} and {c['cluster_id']}")
            before[paper] = c["cluster_id"]
    out = Applied([], before=before, after=_checked(review, before))
    targets: dict[int, set[int]] = {}
    for entry in review:
        was = old.get(entry.id)
        label = entry.label or (was["label"] if was else "Noise" if entry.id == NOISE else f"Topic {entry.id}")
        if was is None:
            out.new_ids.append(entry.id)
        elif was["label"] != label:
            out.label_changes.append({"cluster_id": entry.id, "before": was["label"], "after": label})
        told = (was or {}).get("description", "")
        if entry.description and entry.description != told:
            out.description_changes.append({"cluster_id": entry.id, "before": told, "after": entry.description})
        for paper in entry.papers:
            if before[paper] != entry.id:
                out.moved.append({"paper_id": paper, "from_cluster": before[paper], "to_cluster": entry.id})
                targets.setdefault(before[paper], set()).add(entry.id)
        out.clusters.append({"cluster_id": entry.id, "label": label, "description": entry.description or told, "notes": entry.notes, "top_terms": list((was or {}).get("top_terms", [])),
                             "paper_ids": list(entry.papers), "representative_paper_ids": entry.papers[:3], "is_noise": entry.id == NOISE})
    out.clusters.sort(key=lambda c: (not c["is_noise"], c["cluster_id"]))
    out.dropped_ids = sorted(set(old) - {c.id for c in review})
    out.remap = {origin: next(iter(to)) for origin, to in targets.items() if len(to) == 1}
    return out


def audit(applied: Applied) -> str:
    """K5: the diff as JSON."""
    changes = asdict(applied)
    changes.pop("clusters")
    counts = {k: len(v) if k in ("moved", "label_changes", "description_changes") else v for k, v in changes.items() if k not in ("remap", "before", "after")}
    body = {"timestamp": datetime.now().isoformat(timespec="seconds"), "summary": counts | {"requires_topic_recompute": applied.recompute}} | changes
    return json.dumps(body, ensure_ascii=False, indent=2, default=str)


def summary(applied: Applied) -> str:
    """Six lines for the reviewer."""
    facts = [("Papers moved", len(applied.moved)), ("Labels changed", len(applied.label_changes)), ("New descriptions", len(applied.description_changes)),
             ("New clusters", applied.new_ids or "(none)"), ("Dropped clusters", applied.dropped_ids or "(none)"), ("Recompute c-TF-IDF", "yes" if applied.recompute else "no")]
    return "\n".join(f"  {name + ':':<22} {value}" for name, value in facts)


#: What a reviewer may answer.
READY, RELOAD, CANCEL = {"ready", "yes", "y", "ok", "continue"}, {"reload", "r"}, {"cancel", "abort", "no", "n", "quit", "exit"}


def confirm(path: Path, clusters: list[dict], ask: Callable[[str], str] | None = None, tell: Callable[[str], None] = print, needs_terminal: bool = True) -> Applied:
    """R2: waits for the reviewer, who edits the snapshot at ``path``: reload shows the diff, ready applies it, cancel gives up.

    An invalid review is told and asked for again.
    """
    if needs_terminal and not sys.stdin.isatty():
        raise NoTerminal("a review needs a terminal; give the edited snapshot itself instead")
    ask = ask or input
    while True:
        answer = ask("review> ").strip().lower()
        if answer in CANCEL:
            raise ReviewCancelled("the review was cancelled")
        if answer in READY | RELOAD:
            try:
                done = apply_review(clusters, read_review(Path(path).read_text(encoding="utf-8")))
            except (ReviewError, OSError, yaml.YAMLError) as e:
                tell(f"  {e}")
                continue
            tell(summary(done))
            if answer in READY:
                return done
        elif answer:
            tell("  ready, reload or cancel")
