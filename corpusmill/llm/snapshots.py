"""Difference of two snapshots, rows under new keys included, by signed multisets.

Earlier rows count +1 and later rows -1. Added up by key and content, unchanged rows cancel: they are the same. What
is left is consolidated by key: the i-th earlier and the i-th later row of a key are an update. What then is left is
consolidated by content: the i-th smallest earlier and the i-th smallest later key of a content are a rekey. The rest
are inserts and deletes.

Contents travel as digests. The place of a row in its group comes from a sort over the whole table in ranges, so that
one key or one content with a third of all rows lies in many tasks; pairs meet by group and place, which repeat nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.checkpointing import cut

#: Equal rows that one task makes of a count.
COPIES = 10_000
_ABSENT = "~"


def placed(rows: DataFrame, group: list[str], order: list[str], ties: list[str] = ()) -> DataFrame:
    """Adds ``_place``: the place, from 0, of a row in its group, by ``order`` and then ``ties``; ``rows`` is a materialised table.

    No task sees a whole group: rows are sorted in ranges, and a range knows how many rows of the group lie before it.
    Ranges are cut by a hash of the group and ``order``, which is best kept short: Spark draws a sample of these to the
    driver, of some millions of rows at most.
    """
    first = [F.col(c).asc_nulls_first() for c in order]
    hashed = F.xxhash64(*group)
    ranges = rows.repartitionByRange(hashed, *first).sortWithinPartitions(hashed, *[F.col(c).asc_nulls_first() for c in group], *first, *[F.col(c).asc_nulls_first() for c in ties])
    numbered = cut(ranges.withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_at", 33)))
    runs = numbered.groupBy(*group, "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = runs.withColumn("_base", before - F.col("_first")).select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_task").alias("_g_task"), "_base")
    same = (F.col("_task") == F.col("_g_task"))
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return numbered.join(bases, same).withColumn("_place", F.col("_at") + F.col("_base")).select(*rows.columns, "_place")


def _copies(counted: DataFrame, n: str) -> DataFrame:
    """Each row as often as ``n`` says, with ``_copy`` from 1; large counts are dealt out before they are made."""
    some = counted.filter(F.col(n) <= COPIES).withColumn("_from", F.lit(0).cast("long"))
    many = counted.filter(F.col(n) > COPIES)
    starts = F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / COPIES) - 1), lambda k: k * COPIES)
    dealt = many.withColumn("_from", F.explode(starts)).repartition(*counted.columns, "_from")
    each = F.explode(F.sequence(F.col("_from") + 1, F.least(F.col(n), F.col("_from") + COPIES)))
    return some.unionByName(dealt).withColumn("_copy", each).drop("_from")


def _signed(rows: DataFrame, key: str, content: str, others: list[str], sign: int, kind: str) -> DataFrame:
    values = [F.col(f"`{c}`").cast("string") for c in [content, *others]]
    whole = F.sha2(F.concat_ws("\n", *[F.coalesce(v, F.lit(_ABSENT)) for v in values]), 256)
    return rows.select(F.col(f"`{key}`").cast(kind).alias("_key"), F.coalesce(F.sha2(values[0], 256), F.lit(_ABSENT)).alias("_content"), *[v.alias(f"_v{k}") for k, v in enumerate(values[1:])], whole.alias("_whole"), F.lit(sign).alias("_sign"))


def _paired(left: DataFrame, right: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Rows of both sides side by side, as structs ``_e`` and ``_l``, by group and place; without a partner the other is null."""
    sides = [df.select(*[F.col(c).alias(f"{at}{c}") for c in [*group, "_place"]], F.struct(*columns).alias(at)) for df, at in ((left, "_e"), (right, "_l"))]
    same = F.col("_e_place") == F.col("_l_place")
    for c in group:
        same &= F.col(f"_e{c}").eqNullSafe(F.col(f"_l{c}"))
    return sides[0].join(sides[1], same, "full").select("_e", "_l")


def difference(earlier: DataFrame, later: DataFrame, key: str = "doc_id", content: str = "text", others: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per pair of rows, or row without partner: key, old_key, op, changed, row_sha256.

    Nulls equal only nulls, in the key too. Rows of a key that equal each other in all columns pair first; of what is
    left of a repeated key the i-th rows pair, in the order of a hash of the other columns and the copy; what is still
    left pairs by content, in the order of key, then that hash and the copy. Contents of any length are compared whole,
    by SHA-256; an empty one isn't a missing one. An empty snapshot makes all rows inserts or deletes. Columns beside
    those named are left alone, whatever they are called.
    """
    others_ = [f"_v{k}" for k in range(len(others))]
    row = ["_key", "_content", *others_, "_whole"]
    kind = earlier.schema[key].dataType.simpleString()
    signed = _signed(earlier, key, content, list(others), 1, kind).unionByName(_signed(later, key, content, list(others), -1, kind))
    sums = cut(signed.groupBy(*row).agg(F.count_if(F.col("_sign") > 0).alias("_before"), F.sum("_sign").alias("_net"), F.count(F.lit(1)).alias("_n")))
    kept = _copies(sums.withColumn("_same", ((F.col("_n") - F.abs("_net")) / 2).cast("long")).filter("_same > 0").select("_key", "_whole", "_same"), "_same")
    same = kept.select(F.col("_key").alias("key"), F.col("_key").alias("old_key"), F.lit("same").alias("op"), F.lit("").alias("changed"), F.col("_whole").alias("row_sha256"))

    rest = F.xxhash64("_content", *others_)
    residue = cut(_copies(sums.filter("_net != 0").select(*row, rest.alias("_rest"), F.signum("_net").cast("int").alias("_sign"), F.abs("_net").alias("_count")), "_count").drop("_count"))
    by_key = placed(residue, ["_sign", "_key"], ["_rest", "_copy"], ["_content", *others_])
    consolidated = cut(_paired(by_key.filter("_sign > 0"), by_key.filter("_sign < 0"), ["_key"], [*row, "_rest", "_copy"]))
    lone = F.col("_e").isNull() | F.col("_l").isNull()
    left = cut(consolidated.filter(lone).select(F.when(F.col("_l").isNull(), 1).otherwise(-1).alias("_sign"), F.coalesce("_e", "_l").alias("_r")).select("_sign", "_r.*"))
    by_content = placed(left, ["_sign", "_content"], ["_key", "_rest", "_copy"], others_)
    matched = _paired(by_content.filter("_sign > 0"), by_content.filter("_sign < 0"), ["_content"], row)

    names = [F.when(~F.col(f"_e.{c}").eqNullSafe(F.col(f"_l.{c}")), F.lit(name)) for c, name in zip(["_content", *others_], [content, *others])]
    both = F.col("_e").isNotNull() & F.col("_l").isNotNull()

    def told(pairs: DataFrame, op: str) -> DataFrame:
        kind_ = F.when(F.col("_l").isNull(), "delete").when(F.col("_e").isNull(), "insert").otherwise(op)
        key_ = F.when(F.col("_l").isNull(), F.col("_e._key")).otherwise(F.col("_l._key"))
        return pairs.select(key_.alias("key"), F.col("_e._key").alias("old_key"), kind_.alias("op"), F.when(both, F.concat_ws(",", *names)).otherwise("").alias("changed"), F.col("_l._whole").alias("row_sha256"))

    return same.unionByName(told(consolidated.filter(both), "update")).unionByName(told(matched, "rekey"))


def _remainder(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 16


def later_snapshot(docs: DataFrame) -> DataFrame:
    """The snapshot that ``op13_snapshot_difference`` compares documents with; rows without doc_id stay as they are."""
    r = F.coalesce(_remainder(F.col("doc_id")), F.lit(15))
    new = F.lit(-1) - F.col("doc_id")
    rows = docs.select("doc_id", "text", "lang", "source", r.alias("_r")).filter("_r != 0")
    changed = rows.select(
        F.when(F.col("_r").isin(3, 4), new).otherwise(F.col("doc_id")).alias("doc_id"),
        F.when(F.col("_r") == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_r") == 2, F.col("source")).otherwise(F.col("lang")).alias("lang"),
        F.when(F.col("_r") == 2, F.col("lang")).when(F.col("_r") != 4, F.col("source")).alias("source"), "_r")
    copies = F.when(F.col("_r") == 5, F.array(F.col("doc_id"), F.lit(-1) - F.col("doc_id"))).otherwise(F.array("doc_id"))
    return changed.select(F.explode(copies).alias("doc_id"), "text", "lang", "source")


#: The same in SQL, CRC-32 by its rule of eight steps a byte included. Keys are unique here.
SQL = """
WITH c AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
e AS (SELECT doc_id, text, lang, source, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 16 AS r FROM documents, c),
l AS (SELECT CASE WHEN r IN (3, 4) THEN -1 - doc_id ELSE doc_id END AS doc_id, CASE WHEN r = 1 THEN coalesce(text, '') || '+' ELSE text END AS text, CASE WHEN r = 2 THEN source ELSE lang END AS lang,
  CASE WHEN r = 2 THEN lang WHEN r = 4 THEN NULL ELSE source END AS source FROM e WHERE r <> 0 UNION ALL SELECT -1 - doc_id, text, lang, source FROM e WHERE r = 5),
k AS (SELECT coalesce(l.doc_id, e.doc_id) AS key, e.doc_id AS old_key, l.doc_id AS new_key, e.text AS a, e.lang AS b, e.source AS c, l.text AS x, l.lang AS y, l.source AS z FROM e FULL JOIN l ON e.doc_id = l.doc_id),
u AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY old_key) AS i FROM k WHERE new_key IS NULL),
v AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY new_key) AS i FROM k WHERE old_key IS NULL),
p AS (SELECT old_key, new_key, a, b, c, x, y, z, CASE WHEN a IS NOT DISTINCT FROM x AND b IS NOT DISTINCT FROM y AND c IS NOT DISTINCT FROM z THEN 'same' ELSE 'update' END AS op FROM k WHERE old_key IS NOT NULL AND new_key IS NOT NULL
  UNION ALL SELECT u.old_key, v.new_key, u.a, u.b, u.c, v.x, v.y, v.z, CASE WHEN v.new_key IS NULL THEN 'delete' WHEN u.old_key IS NULL THEN 'insert' ELSE 'rekey' END FROM u FULL JOIN v ON u.a IS NOT DISTINCT FROM v.x AND u.i = v.i)
SELECT coalesce(new_key, old_key) AS key, old_key, op,
  CASE WHEN op IN ('insert', 'delete') THEN '' ELSE concat_ws(',', CASE WHEN a IS DISTINCT FROM x THEN 'text' END, CASE WHEN b IS DISTINCT FROM y THEN 'lang' END, CASE WHEN c IS DISTINCT FROM z THEN 'source' END) END AS changed,
  CASE WHEN op <> 'delete' THEN sha256(coalesce(x, '~') || chr(10) || coalesce(y, '~') || chr(10) || coalesce(z, '~')) END AS row_sha256
FROM p
"""
