"""Documents as files (S1, S2): a scan of a folder, and decoding of PDF text by a function that the caller may replace."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.firstpage import first_page_metadata
from corpusmill.functions.records import blank_to_null, paper_id, stem, title_of_file
from corpusmill.functions.terms import file_title, pdf_text

SCHEMA = "path string, title string, doi string, pages array<string>"
_STREAM = re.compile(rb"<<(?P<dict>.{0,2000}?)>>\s*stream\r?\n(?P<data>.*?)\r?\nendstream", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[|\]|T[Jjd*Dm]|'|\"|ET|-?[0-9.]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        data = bytes.fromhex(re.sub(rb"\s", b"", token[1:-1]).decode() + "0" * (len(re.sub(rb"\s", b"", token[1:-1])) % 2))
    else:
        plain = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1])
        data = re.sub(rb"\\([0-7]{1,3}|.)", plain, token[1:-1], flags=re.S)
    return data.decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("cp1252", "replace")


def _shown(content: bytes) -> str:
    """The text that a page's drawing operators show; moves to another line break it."""
    out, held, inside = [], [], False
    for m in _TOKEN.finditer(content):
        token = m[0]
        if token[:1] in b"(<":
            held.append(_string(token))
        elif token in (b"[", b"]"):
            inside = token == b"["
        elif token in (b"Tj", b"TJ"):
            out.append("".join(held))
            held = []
        elif token in (b"'", b'"'):
            out.append("\n" + "".join(held))
            held = []
        elif token in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
            out.append("\n")
        elif inside and float(token or 0) < -200:  # a wide gap between strings is a blank
            held.append(" ")
    return re.sub(r"\n+", "\n", "".join(out)).strip()


def decode_pdf(data: bytes) -> tuple[str | None, list[str]]:
    """(title, pages) of simple PDF files: uncompressed or deflated content with one-byte text.

    Files with other encodings give empty pages; a library's decoder of the same form may be used instead.
    """
    if data[:5] != b"%PDF-":
        raise ValueError("no PDF file")
    pages = []
    for m in _STREAM.finditer(data):
        content = m["data"]
        if b"FlateDecode" in m["dict"]:
            try:
                content = zlib.decompress(content)
            except zlib.error:
                continue
        if re.search(rb"\bBT\b", content):
            pages.append(_shown(content))
    title = re.search(rb"/Title\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]+>)", data)
    return (_string(title[1]).strip() or None) if title else None, pages


def scan(spark: SparkSession, folder: str, suffix: str = "pdf", most: int | None = None, recursive: bool = True) -> DataFrame:
    """(path, length, content) of the files below a folder, the first ``most`` by path if given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", f"*.{suffix}").load(folder).select("path", "length", "content")
    return files if most is None else files.join(F.broadcast(files.select("path").orderBy("path").limit(most)), "path", "left_semi")


def decoded(files: DataFrame, decoder: Callable[[bytes], tuple[str | None, list[str]]] = decode_pdf) -> DataFrame:
    """(path, title, doi, pages) of the files that can be read; others are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    title, pages = decoder(bytes(content))
                except Exception:  # noqa: BLE001  whatever a decoder makes of a broken file
                    continue
                rows.append((path, title, None, pages))
            yield pd.DataFrame(rows, columns=["path", "title", "doi", "pages"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def papers_from_pages(pages: DataFrame, first: int = 2) -> DataFrame:
    """Records of (path, title, doi, pages): what the file's own fields say, else the first pages, else the file's name."""
    start = F.regexp_replace(F.array_join(F.transform(F.slice("pages", 1, first), lambda p: p), "\n"), r"\n?\s*[0-9]+\s*/\s*[0-9]+\s*\n?", "\n")
    rows = first_page_metadata(pages.withColumn("text", start))
    own = F.when(~file_title(F.col("title")), blank_to_null(F.col("title")))
    title = F.coalesce(own, F.col("title_candidate"), title_of_file(F.col("path")), stem(F.col("path")))
    doi = F.coalesce(blank_to_null(F.col("doi")), F.col("doi_candidate"))
    return rows.select(
        paper_id(doi, F.col("path"), title).alias("paper_id"), title.alias("title"), F.col("abstract_candidate").alias("abstract"), F.col("keywords_candidate").alias("keywords"),
        F.col("authors_candidate").alias("authors"), F.col("year_candidate").alias("year"), doi.alias("doi"), F.lit("local_pdf").alias("source"), F.col("venue_candidate").alias("venue"),
        F.lit(None).cast("string").alias("url"), F.lit(0).alias("citations_count"), F.expr("CAST(array() AS array<string>)").alias("warnings"), F.col("path").alias("pdf_path"),
        F.size("pages").alias("pdf_num_pages"), F.substring("text", 1, 2000).alias("first_pages_text_excerpt"), "title_candidate", "keywords_candidate", F.expr("CAST(array() AS array<string>)").alias("enriched_from"))


def full_texts(pages: DataFrame, least_words: int = 120) -> DataFrame:
    """(paper_id, title, abstract, source, url): the whole text up to its references, of ``least_words`` words at least."""
    text = pdf_text(F.array_join("pages", "\n"))
    rows = pages.select("path", text.alias("abstract")).filter(F.size(F.split("abstract", " ")) >= least_words)
    return rows.select(F.concat(F.lit("pdf_"), stem(F.col("path"))).alias("paper_id"), stem(F.col("path")).alias("title"), "abstract", F.lit("pdf").alias("source"), F.col("path").alias("url"))
