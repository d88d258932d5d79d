"""When the refine loop of a cluster ends (L2), and which iteration was the best (W9): rules over metrics of iterations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The history of a cluster as a column: one struct for each iteration.
HISTORY = "array<struct<recall: double, precision: double, n_results: bigint>>"


@dataclass(frozen=True)
class Metrics:
    recall: float
    precision: float
    n_results: int = 1


@dataclass(frozen=True)
class StopPolicy:
    recall: float = 0.90
    precision: float = 0.60
    floor: float = 0.25
    iterations: int = 5
    failures: int = 2
    recall_step: float = 0.02
    precision_step: float = 0.01
    regression: float = 0.30

    def decide(self, history: list[Metrics], reviewer_stops: bool = False) -> str | None:
        """The reason to stop after the last of ``history``, or None: the first of these that holds.

        Success; the last iteration allowed; recall far below an earlier iteration that had enough of it; recall held
        and precision gains too little; precision too low several times in a row; recall gains too little and precision
        falls; the reviewer's word. Iterations without results are never compared.
        """
        if not history:
            return None
        last, earlier = history[-1], history[:-1]
        if last.recall >= self.recall and last.precision >= self.precision:
            return "success"
        if len(history) >= self.iterations:
            return "max_iterations"
        good = [m.recall for m in earlier if m.recall >= self.recall and m.n_results > 0]
        if good and last.recall <= max(good) - self.regression:
            return "recall_regression"
        before = earlier[-1] if earlier and last.n_results > 0 and earlier[-1].n_results > 0 else None
        if before and last.recall >= before.recall - 1e-9 and last.precision - before.precision < self.precision_step:
            return "plateau"
        tail = history[-self.failures:] if self.failures > 0 else []
        if tail and len(tail) == self.failures and all(m.n_results > 0 and m.precision < self.floor for m in tail):
            return "low_precision"
        if before and last.recall - before.recall < self.recall_step and last.precision < before.precision:
            return "no_gain"
        return "reviewer" if reviewer_stops else None

    def best(self, history: list[Metrics]) -> int | None:
        """The place of the best iteration: enough recall, then results at all, recall, precision; of equals the earliest."""
        worth = [(m.recall >= self.recall, m.n_results > 0, m.recall, m.precision) for m in history]
        return worth.index(max(worth)) if worth else None

    def reason(self, history: Column, reviewer_stops: Column | None = None) -> Column:
        """``decide`` for a column of histories (see ``HISTORY``): a reason, or null to go on."""
        n = F.size(history)
        last, earlier = F.element_at(history, -1), F.slice(history, 1, F.greatest(n - 1, F.lit(0)))
        before = F.get(history, n - 2)
        comparable = (n > 1) & (last["n_results"] > 0) & (before["n_results"] > 0)
        good = F.array_max(F.transform(F.filter(earlier, lambda m: (m["recall"] >= self.recall) & (m["n_results"] > 0)), lambda m: m["recall"]))
        tail = F.slice(history, F.greatest(n - self.failures + 1, F.lit(1)), F.lit(max(self.failures, 1)))
        low = F.lit(self.failures > 0) & (n >= self.failures) & F.forall(tail, lambda m: (m["n_results"] > 0) & (m["precision"] < self.floor))
        gained, nearer = last["recall"] - before["recall"], last["precision"] - before["precision"]
        told = (F.when((last["recall"] >= self.recall) & (last["precision"] >= self.precision), "success")
                .when(n >= self.iterations, "max_iterations")
                .when(last["recall"] <= good - self.regression, "recall_regression")
                .when(comparable & (last["recall"] >= before["recall"] - 1e-9) & (nearer < self.precision_step), "plateau")
                .when(low, "low_precision")
                .when(comparable & (gained < self.recall_step) & (last["precision"] < before["precision"]), "no_gain"))
        if reviewer_stops is not None:
            told = told.when(reviewer_stops, "reviewer")
        return F.when(n > 0, told)

    def best_place(self, history: Column) -> Column:
        """``best`` for a column of histories."""
        worth = F.transform(history, lambda m, k: F.struct((m["recall"] >= self.recall).alias("a"), (m["n_results"] > 0).alias("b"), m["recall"].alias("c"), m["precision"].alias("d"), (-k).alias("e")))
        return -F.array_max(worth)["e"]
