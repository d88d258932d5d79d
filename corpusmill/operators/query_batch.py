"""Queries as data (Q7, Q9, S10): any number of queries of the dialect against a catalog in one scan.

A query becomes clauses that must all hold, each a set of literals of which one must: a phrase in title and abstract or
in the title, a year, a subject or a DOI, or that it is not there. The phrases of all queries make one Aho-Corasick
automaton; it reads each text once and gives the literals that hold. An inverted index leads from these to clauses, and
counts of satisfied clauses to queries: the work for a paper grows with what it matches, not with the queries there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.checkpointing import cut
from corpusmill.functions.records import normalize_doi
from corpusmill.operators.query_language import _Parser

#: Literals of all queries that go to every task at a time; more queries are taken in blocks, each with a scan.
LITERALS = 500_000
#: Clauses of one query.
CLAUSES = 1_000
#: Matches in a batch that leaves a worker.
BATCH = 100_000

Literal = tuple[str, str, bool]


class Clauses:
    """A query as sets of literals (kind, value, negated): one of each set must hold."""

    def __init__(self, sets: list[frozenset[Literal]]):
        if len(sets) > CLAUSES:
            raise ValueError(f"a query of more than {CLAUSES} clauses")
        self.sets = list(dict.fromkeys(sets))

    def __and__(self, other: Clauses) -> Clauses:
        return Clauses(self.sets + other.sets)

    def __or__(self, other: Clauses) -> Clauses:
        return Clauses([a | b for a in self.sets for b in other.sets])

    def __invert__(self) -> Clauses:
        return reduce(Clauses.__or__, [Clauses([frozenset([(kind, value, not negated)]) for kind, value, negated in one]) for one in self.sets])


class _ClauseParser(_Parser):
    def without(self, found: Clauses) -> Clauses:
        return ~found

    def published(self, year: int) -> Clauses:
        return Clauses([frozenset([("year", str(year), False)])])

    def match(self, field: str, phrase: str) -> Clauses:
        kind = {"SUBJAREA": "subject", "DOI": "doi", "TITLE": "title"}.get(field, "text")
        return Clauses([frozenset([(kind, phrase.lower() if kind in ("title", "text") else phrase, False)])])


def clauses_of(query: str) -> list[frozenset[Literal]]:
    """The clauses of a query; one that can't be read is an error."""
    parser = _ClauseParser(query, {})
    out = parser.disjunction("TITLE-ABS-KEY")
    if parser.peek():
        raise ValueError(f"unexpected {parser.peek()}")
    return out.sets


def parsed(queries: DataFrame) -> DataFrame:
    """(query, clause, kind, value, negated) of queries (query, text)."""
    kind = queries.schema["query"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(q, k, *literal) for q, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, one in enumerate(clauses_of(text)) for literal in sorted(one)]
            columns = list(zip(*rows)) or [()] * 5
            types = (batch.schema.field("query").type, pa.int32(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["query", "clause", "kind", "value", "negated"])

    rows = queries.select("query", "text").mapInArrow(run, f"query {kind}, clause int, kind string, value string, negated boolean")
    return rows.withColumn("value", F.when(F.col("kind") == "doi", normalize_doi(F.col("value"))).otherwise(F.col("value")))


class _Index:
    """From literals that hold for a paper to the queries it meets."""

    def __init__(self, rows: list[tuple]):
        self.queries = list(dict.fromkeys(r[0] for r in rows))
        of_query = {q: k for k, q in enumerate(self.queries)}
        literals: dict[tuple[str, str], int] = {}
        clauses: dict[tuple, int] = {}
        there, absent = {}, {}
        for query, clause, kind, value, negated in rows:
            c = clauses.setdefault((query, clause), len(clauses))
            if value is not None:
                literal = literals.setdefault((kind, value), len(literals))
                (absent if negated else there).setdefault(literal, []).append(c)
        self.query_of = np.array([of_query[q] for q, _ in clauses], np.int64)
        self.literals = literals
        self.there, self.absent = ({k: np.array(v, np.int64) for k, v in d.items()} for d in (there, absent))
        self.negated = np.bincount(np.concatenate([*self.absent.values(), np.empty(0, np.int64)]), minlength=len(clauses)) if clauses else np.empty(0, np.int64)
        self.needed = np.bincount(self.query_of[self.negated == 0], minlength=len(self.queries))
        self.free = np.flatnonzero(self.needed == 0)  # queries of negations alone hold unless one fails
        self.empty = {kind: literals.get((kind, "")) for kind in ("text", "title")}

    def automaton(self, kind: str):
        import ahocorasick

        out = ahocorasick.Automaton()
        for (k, value), literal in self.literals.items():
            if k == kind and value:
                out.add_word(value, literal)
        if len(out):
            out.make_automaton()
        return out if len(out) else None

    def met(self, literals: set[int]) -> np.ndarray:
        """Places of the queries that hold where just these literals do."""
        of = lambda table: np.concatenate([table[k] for k in literals if k in table] or [np.empty(0, np.int64)])
        there = np.unique(of(self.there))
        satisfied = there[self.negated[there] == 0]
        query, n = np.unique(self.query_of[satisfied], return_counts=True)
        found = np.concatenate([query[n == self.needed[query]], self.free])
        clause, n = np.unique(of(self.absent), return_counts=True)
        failed = np.setdiff1d(clause[n == self.negated[clause]], there)
        return np.setdiff1d(found, self.query_of[failed]) if len(failed) else found


def matches(catalog: DataFrame, clauses: DataFrame, carry: list[str], most: int = LITERALS) -> DataFrame:
    """Columns ``carry`` of ``catalog`` and ``query``: a row for each paper and query (see ``parsed``) that it meets.

    ``catalog`` has title, abstract, year, subject and doi, and keywords if it likes. A missing value meets no literal,
    and so every negated one. Literals are sent to the tasks in blocks of whole queries, about ``most`` at a time.
    """
    clauses = cut(clauses)
    n = clauses.count()
    blocks = -(-n // most)
    told = [c for c in ("title", "abstract", "keywords") if c in catalog.columns]
    rows = catalog.select(*carry, F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) if c == "keywords" else F.col(c) for c in told], *([] if "keywords" in told else [F.lit("")]))).alias("_text"),
                          F.lower("title").alias("_title"), F.col("year").cast("string").alias("_year"), F.col("subject").alias("_subject"), F.col("doi").alias("_doi"))
    schema = T.StructType([*catalog.select(*carry).schema.fields, T.StructField("query", clauses.schema["query"].dataType)])
    parts = [_matched(rows, clauses if blocks == 1 else clauses.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b), carry, schema) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts) if parts else catalog.sparkSession.createDataFrame([], schema)


def _matched(rows: DataFrame, block: DataFrame, carry: list[str], schema: T.StructType) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in block.select("query", "clause", "kind", "value", "negated").collect()])  # a block has a bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(sent.value)
        of_text, of_title = index.automaton("text"), index.automaton("title")
        kind = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}.get(schema["query"].dataType.simpleString())
        names = pa.array(index.queries, kind)

        def flush(batch: pa.RecordBatch, at: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
            n = np.fromiter(map(len, found), np.int64, len(found))
            taken = pa.array(np.repeat(np.array(at, np.int64), n))
            query = pa.array(np.concatenate(found) if found else np.empty(0, np.int64))
            return pa.RecordBatch.from_arrays([*[batch.column(c).take(taken) for c in carry], names.take(query)], [*carry, "query"])

        for batch in batches:
            at, found, size = [], [], 0
            columns = [batch.column(c).to_pylist() for c in ("_text", "_title", "_year", "_subject", "_doi")]
            for k, (text, title, year, subject, doi) in enumerate(zip(*columns)):
                held: set[int | None] = {index.literals.get(p) for p in (("year", year), ("subject", subject), ("doi", doi)) if p[1] is not None}
                for name, automaton, value in (("text", of_text, text), ("title", of_title, title)):
                    if value is not None:
                        held.add(index.empty[name])
                    if automaton is not None and value:
                        held.update(literal for _, literal in automaton.iter(value))
                held.discard(None)
                met = index.met(held)
                if len(met):
                    at.append(k)
                    found.append(met)
                    size += len(met)
                if size >= BATCH:
                    yield flush(batch, at, found)
                    at, found, size = [], [], 0
            yield flush(batch, at, found)

    return rows.mapInArrow(run, schema)


def hit_counts(catalog: DataFrame, queries: DataFrame, too_broad: int = 5000) -> DataFrame:
    """(query, hits, too_broad) of queries (query, text), those without hits included."""
    hits = matches(catalog, parsed(queries), []).groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    out = queries.select("query").distinct().join(hits, "query", "left").select("query", F.coalesce("n", F.lit(0)).alias("hits"))
    return out.withColumn("too_broad", F.col("hits") > too_broad)
