"""Personal data: base patterns, and identifiers that their contexts give away.

The base patterns find e-mail addresses, IP addresses, payment cards and telephone numbers. They are the seeds of a
bootstrap: the words before a seed are a lexical pattern; patterns and the values seen after them form a bipartite
graph over the whole corpus, on which Spark scores patterns by the share of trusted values behind them and values by
the patterns before them, in turns. Values that look like an identifier but match no base pattern are added where
the patterns before them are trusted enough.

Everything is built-in expressions and aggregations. Only what the patterns find is shuffled, never the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.checkpointing import cut
from corpusmill.llm.text import boxed, whole_text

KINDS = ["email", "ip", "card", "phone"]
#: What only contexts can give away, behind the kinds above: keys and tokens, whose seeds are long hexadecimal numbers.
SECRET = "secret"
ALL_KINDS = [*KINDS, SECRET]
_HEX = r"^[\"'(\[]?(?=[a-f]*+[0-9])(?=[0-9]*+[a-f])[0-9a-f]{32,128}[\"')\],.;:]*$"
#: The base patterns, written so that a run of characters is tried once: a match can begin only where a run begins,
#: or where the last match ended, and no repetition gives back what it took unless it has to.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A run without white space that holds an at sign or five digits.
CANDIDATE = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D]*+(?<=[^\x20\x09-\x0D]))(?=[^@\x20\x09-\x0D]*+@|(?:[^0-9\x20\x09-\x0D]*+[0-9]){5})[^\x20\x09-\x0D]++"
#: Groups of figures joined by single blanks, dots, hyphens and brackets, of seven figures at least.
JOINED = r"(?<![A-Za-z0-9.-])[(\[]?+(?=(?:[\x20.()\[\]-]{0,2}+[0-9]){7})[0-9]++(?:(?:[\x20.-]|[)\]][\x20.-]?+|[\x20.-]?+[(\[])[0-9]++)++(?![A-Za-z0-9@])"
_STEP = 256


def _spans(text: str, pattern: str, kind: str) -> Column:
    """Leftmost matches of ``pattern`` as structs (kind, start, end, value, before): code points, end exclusive.

    Positions are running sums of the lengths of the matches and of the gaps between them; summed in blocks, so that
    texts with very many matches take no more than their share.
    """
    quoted = "r'" + pattern.replace("'", "\\'") + "'"
    inner = f"""aggregate(sequence(b * {_STEP}, least(size(_h), (b + 1) * {_STEP}) - 1), named_struct('at', 0L, 'out', CAST(array() AS array<struct<start: bigint, i: bigint>>)),
        (a, i) -> named_struct('at', a.at + length(_g[i]) + length(_h[i]), 'out', concat(a.out, array(named_struct('start', a.at + length(_g[i]), 'i', i)))))"""
    offsets = f"""flatten(aggregate(transform(sequence(0, (size(_h) - 1) div {_STEP}), b -> {inner}), named_struct('at', 0L, 'outs', CAST(array() AS array<array<struct<start: bigint, i: bigint>>>)),
        (a, x) -> named_struct('at', a.at + x.at, 'outs', concat(a.outs, array(transform(x.out, s -> named_struct('start', a.at + s.start, 'i', s.i))))), a -> a.outs))"""
    value = f"transform({offsets}, s -> named_struct('kind', '{kind}', 'start', s.start, 'end', s.start + length(_h[s.i]), 'value', _h[s.i], 'before', right(concat(CASE WHEN s.i <= 2 THEN '^ ' ELSE '' END, CASE WHEN s.i >= 2 THEN concat(_g[s.i - 2], _h[s.i - 2]) ELSE '' END, CASE WHEN s.i >= 1 THEN concat(_g[s.i - 1], _h[s.i - 1]) ELSE '' END, _g[s.i]), 200)))"
    # one element arrays bind names: the matches, then the gaps
    bound = f"flatten(transform(array(regexp_extract_all({text}, {quoted}, 0)), _h -> CASE WHEN size(_h) = 0 THEN CAST(array() AS array<struct<kind: string, start: bigint, end: bigint, value: string, before: string>>) ELSE flatten(transform(array(split({text}, {quoted}, -1)), _g -> {value})) END))"
    return F.expr(bound)


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"))
    if kind == "card":
        doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        digit = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, doubled(digit(i))).otherwise(digit(i)))
        return F.when((n < 13) | (n > 19), False).otherwise(total % 10 == 0)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _holds(kind: str):
    return lambda span: _valid(kind, span["value"])


def _looks_like(kind: str, value: Column) -> Column:
    """What a run must hold to be a value of a kind."""
    n = F.length(F.regexp_replace(value, "[^0-9]", ""))
    if kind == "email":
        return value.rlike("[^@]@[^@]*[A-Za-z]")
    if kind == SECRET:
        return value.rlike(r"^[\"'(\[]?[a-z0-9_+/=-]{16,128}[\"')\],.;:!]*$") & value.rlike("[a-z]") & value.rlike("[0-9]")
    if kind == "ip":
        return n.between(4, 12) & value.rlike("[0-9](?:[.:][0-9]++){3}")
    return n.between(*((12, 19) if kind == "card" else (7, 15))) & ~value.rlike("[A-Za-z]")


def with_base_spans(docs: DataFrame) -> DataFrame:
    """Adds ``_base``, the valid matches of the base patterns, and ``_other``, runs that look like identifiers."""
    df = docs.withColumn("_text", whole_text())
    none = "CAST(array() AS array<struct<kind: string, start: bigint, end: bigint, value: string, before: string>>)"
    quick = {"email": F.col("_text").contains("@"), "ip": F.col("_text").rlike(r"[0-9]\.[0-9]"), "card": F.col("_text").rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": F.col("_text").contains("+")}
    for kind, pattern in PATTERNS.items():
        df = df.withColumn(f"_{kind}", F.filter(F.when(quick[kind], _spans("_text", pattern, kind)).otherwise(F.expr(none)), _holds(kind)))
    df = df.withColumn("_base", F.concat(*[f"_{k}" for k in KINDS])).drop(*[f"_{k}" for k in KINDS])
    df = df.withColumn("_other", F.when(F.col("_text").rlike(r"@|[0-9]"), _spans("_text", CANDIDATE, "")).otherwise(F.expr(none)))
    joined = F.when(F.col("_text").rlike(r"[0-9][\x20.()\[\]-]{1,2}[0-9]"), _spans("_text", JOINED, "")).otherwise(F.expr(none))
    df = df.withColumn("_other", F.concat("_other", joined))
    return df.withColumn("_other", F.expr("filter(_other, o -> NOT exists(_base, b -> b.start < o.end AND o.start < b.end))")).drop("_text")


def _before(column: Column) -> Column:
    """The two words before, and the one, in lower case, figures alike; a text begins with the word ``^``."""

    def last(n: int) -> Column:
        words = F.regexp_extract(column, r"((?:[^\x20\x09-\x0D]{1,40}[\x20\x09-\x0D]+){%d}[^\x20\x09-\x0D]{1,40})[\x20\x09-\x0D]*$" % (n - 1), 1)
        plain = F.regexp_replace(F.regexp_replace(F.lower(words), r"[0-9]+", "0"), r"[\x20\x09-\x0D]+", " ")
        return F.when(F.length(words) > 0, plain)

    return F.array_compact(F.array(last(2), last(1)))


def patterns_and_values(found: DataFrame, rounds: int | None = None, support: int = 3, trust: float = 0.8) -> DataFrame:
    """(before, value, kind) of values behind trusted patterns, from rows with ``_base`` and ``_other``.

    A pattern's score for a kind is the summed score of the different values behind it over their number, and it
    counts once ``support`` different values of the kind stand behind it and the score reaches ``trust``. A value's
    score is the chance that not all trusted patterns before it err, times the share of those among the patterns before
    it that ``support`` values have: one that mostly stands behind patterns of other things is none. Turns end when no
    value is new, or after ``rounds``. Copies of a text add nothing, as values count once.
    """
    own = F.when(F.lower("s.value").rlike(_HEX), SECRET)
    each = lambda c, base: found.select(F.explode(c).alias("s")).select(F.explode(_before(F.col("s.before"))).alias("before"), F.lower("s.value").alias("value"), (F.col("s.kind") if base else own).alias("seed"))
    edges = each("_base", True).unionByName(each("_other", False))
    edges = cut(edges.groupBy("before", "value").agg(F.max("seed").alias("seed")))
    scores = edges.filter("seed IS NOT NULL").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    sizes = cut(edges.groupBy("before").agg(F.count(F.lit(1)).alias("n")))
    known = cut(edges.join(sizes.filter(F.col("n") >= support).select("before"), "before", "left_semi").groupBy("value").agg(F.count(F.lit(1)).alias("known")))
    seeds = scores
    least = trust * (1 - 0.5 / support)
    ever, turn = None, 0
    while True:
        held = edges.join(scores, "value").groupBy("before", "kind").agg(F.sum("score").alias("held"), F.count(F.when(F.col("score") >= least - 1e-9, 1)).alias("support"))
        patterns = cut(held.filter(F.col("support") >= support).join(sizes, "before").withColumn("trust", F.col("held") / F.col("n")).filter(F.col("trust") >= trust).select("before", "kind", "trust"))
        behind = edges.filter(f"seed IS NULL OR seed = '{SECRET}'").join(patterns, "before").filter("seed IS NULL OR seed = kind")
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("trust") * (1 - F.lit(0.5) / support)))))
        new = behind.groupBy("value", "kind").agg((1 - doubt).alias("chance"), F.count(F.lit(1)).alias("good")).join(known, "value")
        new = new.select("value", "kind", (F.col("chance") * F.col("good") / F.col("known")).alias("score"))
        fits = F.lit(False)
        for kind in ALL_KINDS:
            fits = fits | ((F.col("kind") == kind) & _looks_like(kind, F.col("value")))
        new = cut(new.filter(fits))
        scores = seeds.unionByName(new.join(seeds, ["value", "kind"], "left_anti"))
        sure, turn = new.filter(F.col("score") >= least - 1e-9).select("value", "kind"), turn + 1
        fresh = sure if ever is None else sure.join(ever, ["value", "kind"], "left_anti")
        if turn == rounds or fresh.isEmpty():
            break
        ever = sure if ever is None else cut(ever.unionByName(fresh))
    return behind.join(new.filter(F.col("score") >= least - 1e-9), ["value", "kind"]).select("before", "value", "kind").distinct()


def find_personal_data(docs: DataFrame, rounds: int | None = None) -> DataFrame:
    """(doc_id, _hash, spans): all spans of each row as structs (kind, start, end, base), by kind as listed, then start.

    Base spans are always there; spans that the contexts give away are added, secrets behind the other kinds. A missing or
    empty text has none; texts of any length are read whole; an empty table gives an empty one; a missing doc_id is kept.
    Repeated rows come out repeated. Only doc_id and text are read.
    """
    marked = docs.select("doc_id", "text").withColumn("_hash", F.xxhash64(whole_text()))
    found = cut(with_base_spans(marked).drop("text"))
    trusted = patterns_and_values(found, rounds)
    other = found.select("doc_id", "_hash", F.explode("_other").alias("s")).withColumn("before", F.explode(_before(F.col("s.before")))).withColumn("value", F.lower("s.value"))
    added = other.join(trusted, ["before", "value"]).groupBy("doc_id", "_hash").agg(F.collect_set(F.struct("kind", F.col("s.start").alias("start"), F.col("s.end").alias("end"))).alias("_added"))
    added = cut(added.withColumnsRenamed({"doc_id": "_id", "_hash": "_h"}))
    both = found.join(added, found["doc_id"].eqNullSafe(added["_id"]) & (found["_hash"] == added["_h"]), "left")
    place = "array_position(array(" + ", ".join(f"'{k}'" for k in ALL_KINDS) + "), {})"
    spans = F.expr(f"""transform(array_sort(concat(
        transform(_base, s -> named_struct('place', {place.format('s.kind')}, 'start', s.start, 'end', s.end, 'base', true)),
        transform(coalesce(_added, CAST(array() AS array<struct<kind: string, start: bigint, end: bigint>>)), s -> named_struct('place', {place.format('s.kind')}, 'start', s.start, 'end', s.end, 'base', false)))),
        s -> named_struct('kind', element_at(array({", ".join(f"'{k}'" for k in ALL_KINDS)}), CAST(s.place AS int)), 'start', s.start, 'end', s.end, 'base', s.base))""")
    return both.select("doc_id", "_hash", spans.alias("spans"))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, rounds: int | None = None) -> DataFrame:
    """doc_id, the number of base spans by kind, base_sha256 and all spans, written kind:start:end.

    A missing or empty text has none; repeated rows come out repeated, with equal spans; an empty table gives an empty one.
    Only doc_id and text are read, whatever other columns are called.
    """
    found = find_personal_data(docs, rounds)
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: lambda s: s["kind"] == kind
    counts = [F.size(F.filter(base, of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def mask(docs: DataFrame, rounds: int | None = None) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; overlapping spans become one. A missing text stays so.

    Repeated rows are masked alike; an empty table stays empty; other columns stay, whatever they are called.
    """
    found = find_personal_data(docs, rounds).filter(F.size("spans") > 0)
    found = found.groupBy("doc_id", "_hash").agg(F.first("spans").alias("_spans")).withColumnsRenamed({"doc_id": "_id", "_hash": "_h"})
    marked = boxed(docs).withColumn("_hash", F.xxhash64(whole_text()))
    both = marked.join(found, marked["doc_id"].eqNullSafe(found["_id"]) & (marked["_hash"] == found["_h"]), "left")
    masked = F.expr("""aggregate(array_sort(transform(_spans, s -> named_struct('start', s.start, 'less', -s.end, 'kind', s.kind))), named_struct('at', 0L, 'out', CAST(array() AS array<string>)),
        (a, s) -> CASE WHEN s.start < a.at THEN named_struct('at', greatest(a.at, -s.less), 'out', a.out)
                  ELSE named_struct('at', -s.less, 'out', concat(a.out, array(substring(text, CAST(a.at + 1 AS int), CAST(s.start - a.at AS int)), '[', s.kind, ']'))) END,
        a -> concat(array_join(a.out, ''), substring(text, CAST(a.at + 1 AS int))))""")
    new = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(masked)
    return both.select(*[new.alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])
