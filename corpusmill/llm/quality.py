"""Quality rules as weak supervision.

Each rule looks at one statistic of a document and votes good (1), bad (-1) or abstains (0). How far each rule can
be trusted is not set by hand: expectation-maximisation over the corpus' vote patterns estimates, for either class,
how often each rule says what, and a document's posterior probability of being good replaces a chain of filters.

Everything per document is a built-in expression in one narrow pass. The vote patterns are counted with a partial
aggregation; at most 3 ** (number of rules) of them exist, so the model is fitted on the driver from a table whose
size does not depend on the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.checkpointing import cut
from corpusmill.llm.text import WORD, boxed, whole_text, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_upper", "n_shouts", "n_odd_words", "n_sentences"]
#: A word that isn't letters with at most one mark behind them, and the mark that ends a sentence.
ODD = r"(?<![^\x20\x09-\x0D])(?![\p{L}\p{M}'’-]++[.,;:!?]?+(?![^\x20\x09-\x0D]))[^\x20\x09-\x0D]++"
ENDS = r"(?<=\p{L})[.!?](?![^\x20\x09-\x0D])"


def _occurrences(text: str, characters: str) -> Column:
    """How often any of ``characters`` occurs; a text without one is not copied."""
    length = F.length(text).cast("long")
    return sum((length - F.length(F.replace(F.col(text), F.lit(c), F.lit(""))) for c in characters[1:]), length - F.length(F.replace(F.col(text), F.lit(characters[0]), F.lit(""))))


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` plus the statistics that the rules and the base rule read.

    A missing text counts as empty. Windows are compared by 64-bit hashes of their words' 64-bit hashes.
    """
    text = whole_text()
    df = docs.withColumn("_text", text).withColumn("_words", words_of(F.col("_text")))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda line: line.rlike(WORD)))
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    parts = ", ".join(f"get(_hashes, i + {k})" for k in range(WINDOW))
    df = df.withColumn("_windows", F.expr(f"CASE WHEN size(_hashes) < {WINDOW} THEN CAST(array() AS array<bigint>) ELSE transform(sequence(0, size(_hashes) - {WINDOW}), i -> xxhash64({parts})) END"))
    df = df.withColumn("_sorted", F.expr("CASE WHEN size(array_distinct(_windows)) = size(_windows) THEN NULL ELSE array_sort(transform(_windows, (w, i) -> struct(w AS w, i AS i))) END"))
    df = df.withColumn("_repeats", F.expr("""CASE WHEN _sorted IS NULL THEN NULL ELSE array_sort(transform(filter(_sorted,
        (e, i) -> coalesce(get(_sorted, i - 1).w = e.w, false) OR coalesce(get(_sorted, i + 1).w = e.w, false)), e -> e.i)) END"""))
    repeat = F.expr(f"coalesce(aggregate(_repeats, struct(0L AS n, {-WINDOW} AS last), (a, i) -> struct(a.n + least({WINDOW}, i - a.last) AS n, i AS last)).n, 0L)")
    size = lambda c: F.size(c).cast("long")
    long_length = lambda c: F.length(c).cast("long")
    return df.withColumns({
        "n_words": size("_words"),
        "word_chars": long_length(F.array_join("_words", "")),
        "n_symbols": _occurrences("_text", SYMBOLS),
        "n_dup_lines": size("_lines") - size(F.array_distinct("_lines")),
        "n_repeat_words": repeat,
        "n_lines": size("_lines"),
        "n_upper": F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long"),
        "n_shouts": _occurrences("_text", "!?"),
        "n_odd_words": F.regexp_count("_text", F.lit(ODD)).cast("long"),
        "n_sentences": F.regexp_count("_text", F.lit(ENDS)).cast("long"),
    }).drop("_text", "_words", "_lines", "_hashes", "_windows", "_sorted", "_repeats")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes by rule; a condition that cannot be told abstains.

    Each kind of junk (symbols, tables, shouting, repetition) is seen by several rules, as expectation-maximisation
    can only learn to trust a rule from the others.
    """
    c, n = F.col, F.col("n_words")
    mean = F.when(n > 0, c("word_chars") / n)
    return {
        "length": _vote(n < 10, n >= 50),
        "word_length": _vote((mean < 2.5) | (mean > 14), (mean >= 3.5) & (mean <= 9)),
        "symbols": _vote(c("n_symbols") > 0.1 * n, c("n_symbols") == 0),
        "plain_words": _vote(c("n_odd_words") > 0.2 * n, (n > 0) & (c("n_odd_words") <= 0.03 * n)),
        "sentences": _vote((n >= 80) & (c("n_sentences") < 0.004 * n), (n > 0) & (c("n_sentences") >= 0.03 * n)),
        "duplicate_lines": _vote(c("n_dup_lines") > 0.3 * c("n_lines"), F.lit(False)),
        "repeated_words": _vote(c("n_repeat_words") > 0.2 * n, F.lit(False)),
        "capitals": _vote(c("n_upper") > 0.4 * c("word_chars"), (n > 0) & (c("n_upper") <= 0.15 * c("word_chars"))),
        "shouting": _vote(c("n_shouts") > 0.25 * n, F.lit(False)),
    }


@dataclass(frozen=True)
class VoteModel:
    """Prior of the good class, and per rule the log ratio P(vote | good) / P(vote | bad) of a bad and a good vote."""

    prior: float
    ratios: dict[str, tuple[float, float, float]]

    def posterior(self) -> Column:
        """Probability of being good, from the votes in the columns named as the rules with a leading ``v_``."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, (bad, none, good) in self.ratios.items():
            odds = odds + F.when(F.col(f"v_{name}") < 0, bad).when(F.col(f"v_{name}") > 0, good).otherwise(none)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = 100, smooth: float = 1.0) -> VoteModel:
    """Two latent classes; a rule's votes are independent given the class.

    Starts from the majority of the votes. A bad vote never speaks for a document and a good one never against it:
    where the estimates say so, the rule counts as no evidence. Without documents the votes' majority decides.
    """
    if not patterns:
        return VoteModel(0.5, {n: (-2.0, 0.0, 1.0) for n in names})
    post = [1 / (1 + math.exp(-(sum(v for v in votes if v > 0) + 3.0 * sum(v for v in votes if v < 0)))) for votes, _ in patterns]
    weights = [n for _, n in patterns]
    total = sum(weights)
    prior, rates = 0.5, {}
    for _ in range(rounds):
        mass = (sum(w * p for w, p in zip(weights, post)), sum(w * (1 - p) for w, p in zip(weights, post)))
        prior = min(0.999, max(0.001, (mass[0] + smooth) / (total + 2 * smooth)))
        rates = {}
        for k, name in enumerate(names):
            for vote in (-1, 0, 1):
                good = sum(w * p for (votes, w), p in zip(patterns, post) if votes[k] == vote)
                bad = sum(w * (1 - p) for (votes, w), p in zip(patterns, post) if votes[k] == vote)
                rates[name, vote] = math.log((good + smooth) / (mass[0] + 3 * smooth)) - math.log((bad + smooth) / (mass[1] + 3 * smooth))
            rates[name, -1], rates[name, 1] = min(0.0, rates[name, -1]), max(0.0, rates[name, 1])
            rates[name, 0] = 0.0  # who abstains says nothing
        new = [1 / (1 + math.exp(-max(-700.0, min(700.0, math.log(prior / (1 - prior)) + sum(rates[n, v] for n, v in zip(names, votes)))))) for votes, _ in patterns]
        moved = max(abs(a - b) for a, b in zip(new, post))
        post = new
        if moved < 1e-9:
            break
    return VoteModel(prior, {n: (rates[n, -1], rates[n, 0], rates[n, 1]) for n in names})


def with_votes(statistics: DataFrame) -> DataFrame:
    return statistics.withColumns({f"v_{name}": vote for name, vote in rules().items()})


def fit(votes: DataFrame) -> VoteModel:
    """Learn how far each rule can be trusted from the votes of all documents."""
    names = list(rules())
    rows = votes.groupBy([f"v_{n}" for n in names]).agg(F.count(F.lit(1)).alias("n")).collect()  # 3 ** len(names) rows at most
    return expectation_maximisation(sorted((tuple(int(r[f"v_{n}"]) for n in names), int(r["n"])) for r in rows), names)


def quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, the statistics, base_failed, the votes, the posterior and kept.

    Missing and empty texts have no words, so they fail the base rule. Repeated rows come out repeated; missing ids
    stay missing. An empty table gives an empty result. Columns beside doc_id and text are not read.
    """
    votes = cut(with_votes(with_statistics(docs.select("doc_id", "text"))).drop("text", *EXTRA))
    model = fit(votes)
    return votes.withColumn("base_failed", base_failed()).withColumn("quality", model.posterior()).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose posterior reaches ``threshold`` and that pass the base rule, all columns unchanged.

    Two narrow passes and no join: the second computes the statistics again beside the columns that stay. Rows go by a
    generator that gives none, as a filter would be pushed down and the statistics put into it over and over.
    """
    model = fit(with_votes(with_statistics(docs.select("text"))))
    scored = with_votes(with_statistics(boxed(docs).drop("doc_id")))
    kept = F.when(~base_failed() & (model.posterior() >= threshold), F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))
    return scored.select("_row", F.explode(kept).alias("_kept")).select("_row.*")
