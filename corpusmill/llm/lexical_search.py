"""Ranked lexical search over postings in buckets of terms.

One pass over the texts gives the postings (term, document, occurrences, length of the document) and, for each batch
of rows, how many documents and terms it had. The postings are a table partitioned by the bucket of the term, so that
a search reads only the buckets of its own terms. A search joins the terms of its items with the postings, scores each
match in 64-bit integers, adds up per item and document, and keeps the first of each item by ``row_number``.

A posting is scored once, before it meets the items that hold its term. By then the postings lie with those of the
same document, so the matches of an item and a document are added up where they are made and never shuffled: what
goes on from a task is the first ``top`` documents of each item.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.checkpointing import cut, drop, session_folder
from corpusmill.functions.joins import bounded
from corpusmill.llm.text import identity, whole_text

#: Terms are ASCII letters and digits and everything beyond ASCII; in UTF-8 that is a property of single bytes.
_FOLD = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))
BUCKETS = 64
#: Distinct terms of all items that are sent to the tasks (some megabytes); with more, postings meet them in a join.
VOCABULARY = 200_000
#: Postings in a batch that leaves a worker.
BATCH = 50_000


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in order, in UTF-8, A-Z in lower case."""
    return text.encode().translate(_FOLD).split()


@dataclass
class Index:
    """Postings (term, _doc, doc_id, tf, n, bucket) and totals (documents, terms) of a corpus."""

    postings: DataFrame
    documents: int
    terms: int
    buckets: int


def _postings(docs: DataFrame, wanted: frozenset[bytes] | None) -> DataFrame:
    """One row per document and term of ``wanted`` (all terms, if None); rows without term have a batch's totals in tf and n."""
    given, kind = identity(docs)
    told = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows = told.value, ([], [], [], [], [])

        def flush() -> pa.RecordBatch:
            term, at, ids, tf, n = rows
            out = pa.RecordBatch.from_arrays([pa.array(term, pa.binary()).cast(pa.string()), pa.array(at, pa.int64()), pa.array(ids, of_id), pa.array(tf, pa.int64()), pa.array(n, pa.int64())], ["term", "_doc", "doc_id", "tf", "n"])
            for column in rows:
                column.clear()
            return out

        for batch in batches:
            of_id, documents, total = batch.schema.field("doc_id").type, 0, 0
            for at, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = terms_of(text.as_py())
                n = len(found)
                documents, total = documents + (n > 0), total + n
                held = [(t, k) for t, k in Counter(found).items() if known is None or t in known]
                for column, values in zip(rows, ([t for t, _ in held], [at] * len(held), [doc] * len(held), [k for _, k in held], [n] * len(held))):
                    column.extend(values)
                if len(rows[0]) >= BATCH:
                    yield flush()
            for column, value in zip(rows, (None, None, None, documents, total)):
                column.append(value)
            yield flush()

    rows = docs.select(F.monotonically_increasing_id().alias("_doc"), given.alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, f"term string, _doc bigint, doc_id {kind}, tf bigint, n bigint")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build_index(docs: DataFrame, items: DataFrame | None = None, buckets: int = BUCKETS, vocabulary: int = VOCABULARY) -> Index:
    """The index of ``docs``, of all terms or of those that ``items`` have.

    Each row is a document of its own, also where rows repeat a doc_id or a text or have no doc_id; a missing or an
    empty text, and one without terms, is no document. Texts of any length are read whole. An empty table gives an
    empty index. Only doc_id and text are read, whatever the other columns are called. A bucket with a very frequent
    term is written by many tasks.
    """
    wanted = None
    if items is not None:
        terms = item_terms(items).select("term").distinct()
        few = [r[0] for r in terms.limit(vocabulary + 1).collect()]
        wanted = frozenset(t.encode() for t in few) if len(few) <= vocabulary else None
    made = cut(_postings(docs, wanted))
    totals = made.filter("term IS NULL").agg(F.coalesce(F.sum("tf"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    path = f"{session_folder(docs.sparkSession)}/{uuid.uuid4().hex}"
    rows = made.filter("term IS NOT NULL").withColumn("bucket", _bucket(F.col("term"), buckets))
    rows.hint("rebalance", "bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    drop(made)
    return Index(docs.sparkSession.read.schema(rows.schema).parquet(path), *totals, buckets)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the terms of an item once each; rows that share an item_id are one item, a missing text has none."""
    folded = F.translate(whole_text(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.array_distinct(F.regexp_extract_all(folded, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))
    return items.select("item_id", F.explode(terms).alias("term")).distinct()


def search(index: Index, items: DataFrame, top: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item by score, equal scores by doc_id.

    Items without terms, or whose terms no document has, have no rows; rows without item_id are one item. Documents
    without doc_id come first among equal scores, and rows that repeat a doc_id are ranked one by one.
    """
    asked = cut(item_terms(items).withColumn("bucket", _bucket(F.col("term"), index.buckets)))
    buckets = [r[0] for r in asked.select("bucket").distinct().collect()]
    read = index.postings.filter(F.col("bucket").isin(buckets) if len(buckets) < index.buckets else F.lit(True))
    held = cut(read.join(bounded(asked.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi").groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df")))
    weight = F.floor(1000 * F.log((2 * F.lit(index.documents) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighted = held.select("bucket", "term", weight.alias("w"))
    length = F.lit(50) + F.expr(f"(50L * n * {index.documents}L) div {max(1, index.terms)}L")
    part = F.col("w") * F.expr("(1000000000L * tf) div (1000L * tf + 20L * _m)")
    scored = read.join(bounded(weighted), ["bucket", "term"]).withColumn("_m", length).select("_doc", "doc_id", "term", part.alias("_part"))
    matches = scored.repartition("_doc").join(bounded(asked.select("item_id", "term")), "term")
    scores = matches.groupBy("item_id", "_doc", "doc_id").agg(F.sum("_part").alias("score")).filter("score > 0")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "_doc")
    ranked = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, top: int = 50) -> DataFrame:
    """The ``top`` documents of each item; see ``build_index`` and ``search`` for odd rows."""
    return search(build_index(docs, items), items, top)


#: The same ranking in SQL; terms are split at runs of other ASCII characters.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
a AS (SELECT count(*) AS total, CAST(sum(len(t)) AS BIGINT) AS terms FROM d WHERE len(t) > 0),
p AS (SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, a GROUP BY term, total),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * total) // terms)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term), a GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""
