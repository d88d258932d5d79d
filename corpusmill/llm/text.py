"""Column expressions shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

#: White space of the word definition: space and the controls tab to carriage return.
WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def whole_text(column: str = "text") -> Column:
    """The text, a missing one as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def identity(docs: DataFrame) -> tuple[Column, str]:
    """The column of ids and its type: whole numbers as long, any other type as it is."""
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, (IntegralType, NullType)):
        return F.col("doc_id").cast("long"), "bigint"
    return F.col("doc_id"), kind.simpleString()


def words_of(text: Column) -> Column:
    """All words of a text, in order."""
    return F.array_remove(F.split(text, WHITE + "+", -1), "")


def boxed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _row): the whole row in one column, so that no name of the table meets a name used inside."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
