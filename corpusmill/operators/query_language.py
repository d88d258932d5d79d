"""The boolean document-query dialect (Q1, Q7): built as text, parsed to a tree, compiled to a Column.

``TITLE-ABS-KEY(a OR "b c")``, ``TITLE(...)``, ``SUBJAREA(x)``, ``DOI("d")`` and ``PUBYEAR IS y`` combine with AND, OR,
AND NOT and parentheses. A phrase matches as a substring in lower case. Everything stays in the plan, so that year,
subject and DOI reach the scan as pushed filters.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.records import normalize_doi

_TOKEN = re.compile(r'\s*("[^"]*"|\(|\)|[^\s()"]+)')
_FIELDS = ("TITLE-ABS-KEY", "TITLE", "SUBJAREA", "DOI")


def build(or_phrases: list[str] = (), axes: list[list[str]] = (), work_types: list[str] = (), constraints: list[str] = (), exclusions: list[str] = ()) -> str:
    """Q1: axes joined by AND, or one block of phrases; then work types, constraints and exclusions."""
    group = lambda phrases: "TITLE-ABS-KEY(" + " OR ".join(f'"{p}"' for p in phrases) + ")"
    parts = [group(a[:6]) for a in axes if a] or [group(list(or_phrases)[:8] or ["agents"])]
    if work_types:
        parts.append(group(list(work_types)[:8]))
    parts += [group([c]) for c in constraints]
    query = " AND ".join(parts)
    return query + (" AND NOT " + group(list(exclusions)[:4]) if exclusions else "")


class _Parser:
    def __init__(self, query: str, columns: dict[str, Column]):
        self.tokens = _TOKEN.findall(query)
        if _TOKEN.sub("", query).strip():
            raise ValueError(f"cannot read query: {query}")
        self.at, self.columns = 0, columns

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, expected: str | None = None) -> str:
        token = self.peek()
        if not token or expected and token != expected:
            raise ValueError(f"expected {expected or 'a term'}, found {token or 'the end'}")
        self.at += 1
        return token

    def disjunction(self, field: str) -> Column:
        out = self.conjunction(field)
        while self.peek() == "OR":
            self.take()
            out = out | self.conjunction(field)
        return out

    def conjunction(self, field: str) -> Column:
        out = self.term(field)
        while self.peek() in ("AND", "NOT") or self.peek() not in ("", "OR", ")"):
            if self.peek() == "AND":
                self.take()
            if self.peek() == "NOT":
                self.take()
                out = out & self.without(self.term(field))
            else:
                out = out & self.term(field)
        return out

    def term(self, field: str) -> Column:
        token = self.take()
        if token == "(":
            out = self.disjunction(field)
            self.take(")")
            return out
        if token in _FIELDS and self.peek() == "(":
            self.take()
            out = self.disjunction(token)
            self.take(")")
            return out
        if token == "PUBYEAR":
            self.take("IS")
            return self.published(int(self.take()))
        return self.match(field, token.strip('"'))

    def without(self, found: Column) -> Column:
        return ~F.coalesce(found, F.lit(False))

    def published(self, year: int) -> Column:
        return self.columns["year"] == year

    def match(self, field: str, phrase: str) -> Column:
        if field == "SUBJAREA":
            return self.columns["subject"] == phrase
        if field == "DOI":
            return self.columns["doi"] == normalize_doi(F.lit(phrase))
        if field == "TITLE":
            return F.lower(self.columns["title"]).contains(phrase.lower())
        both = F.concat_ws(" ", self.columns["title"], self.columns["abstract"], self.columns.get("keywords", F.lit("")))
        return F.lower(both).contains(phrase.lower())


def compile_query(query: str, columns: dict[str, Column] | None = None) -> Column:
    """The predicate of a query over columns title, abstract, keywords, year, subject and doi."""
    parser = _Parser(query, columns or {c: F.col(c) for c in ("title", "abstract", "year", "subject", "doi")})
    out = parser.disjunction("TITLE-ABS-KEY")
    if parser.peek():
        raise ValueError(f"unexpected {parser.peek()}")
    return out
