"""Column functions on bibliographic records. Empty strings count as missing; results never raise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.authors import dedupe_authors

#: Section labels that are no authors.
SECTION_LABELS = [
    "research article", "review article", "original article", "short communication", "letter to the editor", "abstract", "keywords",
    "acknowledgements", "acknowledgments", "references", "introduction", "preprint", "draft", "manuscript", "appendix",
    "supplementary", "editorial", "case report",
]
#: Patterns of what a title must not look like.
FILE_NAME_TITLE = [r"\+{2,}|_{2,}", r"\b[0-9]{1,4}\.\.[0-9]{1,4}\b", r"(?i)_proof\b", r"\bv[0-9]+\b"]
URL_TITLE = r"(?i)https?://"
PUBLISHER_TITLE = r"(?i)\b(all sciences proceedings|international conference|journal homepage|published by|©\s*[0-9]{4})\b"
FORWARD_TITLE = r"(?i)^\s*(manuscript\s+forthcoming|forthcoming\s+in|to\s+appear\s+in|published\s+as|preprint(?:\s+of)?)\b"
CHAPTER_TITLE = r"(?i)^\s*chapter\s+[0-9]+\b"
#: Identifiers in file names.
ARXIV_NAME = r"(?:^|[^0-9])([0-9]{4}\.[0-9]{4,5})(v[0-9]+)?(?:[^0-9]|$)"
ISBN_NAME = r"(97[89](?:[-0-9]){10,17})"


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once: inside a lambda an expression would be computed for every element."""
    return F.transform(F.array(value), f)[0]


def stripped(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    t = stripped(c)
    return F.when(t != "", t)


def single_spaced(c: Column) -> Column:
    return F.regexp_replace(stripped(c), r"(?U)\s+", " ")


def normalize_doi(c: Column) -> Column:
    """Bare lower-case DOI, without resolver, scheme or trailing marks."""
    d = stripped(F.lower(c))
    d = F.regexp_replace(d, r"^https?://(dx\.)?doi\.org/", "")
    d = F.regexp_replace(d, r"^doi:", "")
    d = stripped(F.regexp_replace(d, r"[/.,;:\s]+$", ""))
    return F.when(d != "", d)


def resolver_free_doi(c: Column, trailing: str = "") -> Column:
    """Lower case and without the doi.org resolver only; ``trailing`` characters go at both ends as well."""
    d = F.regexp_replace(F.lower(c), r"https?://doi\.org/", "")
    d = F.regexp_replace(d, f"^[{trailing}]+|[{trailing}]+$", "") if trailing else stripped(d)
    return F.when(d != "", d)


def normalize_title(c: Column) -> Column:
    """Lower case, letters, digits and single spaces only."""
    t = F.regexp_replace(stripped(F.lower(c)), r"[^\p{L}\p{M}\p{N}_\s]", "")
    return F.regexp_replace(t, r"\s+", " ")


def ascii_folded(c: Column) -> Column:
    """Letters without accents; characters that have no plain form go (X2). Of what Unicode composes, Latin only."""
    plain = F.translate(c, _COMPOSED, _PLAIN)
    for wide, narrow in _LIGATURES.items():
        plain = F.replace(plain, F.lit(wide), F.lit(narrow))
    return F.regexp_replace(plain, r"[^\x00-\x7F]", "")


def _composed() -> tuple[str, str, dict[str, str]]:
    """Latin characters whose compatibility decomposition has plain letters: one letter each, and several."""
    import unicodedata

    wide, plain, several = [], [], {}
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07)]:
        kept = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(kept) == 1:
            wide.append(chr(code))
            plain.append(kept)
        elif kept:
            several[chr(code)] = kept
    return "".join(wide), "".join(plain), several


_COMPOSED, _PLAIN, _LIGATURES = _composed()


def title_key(c: Column) -> Column:
    """The title in plain lower-case letters and digits, words apart by one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(ascii_folded(F.coalesce(c, F.lit("")))), "[^a-z0-9 ]", " "), " +", " "))


def short_hash(c: Column) -> Column:
    return F.substring(F.sha1(c.cast("binary")), 1, 12)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def arxiv_id(path: Column) -> Column:
    """P10: the arXiv number in a file name, with its version."""
    found = F.regexp_extract(file_name(path), ARXIV_NAME, 1)
    return F.when(found != "", F.concat(found, F.regexp_extract(file_name(path), ARXIV_NAME, 2)))


def isbn(path: Column) -> Column:
    """P10: the thirteen digits of an ISBN in a file name."""
    digits = F.regexp_replace(F.regexp_extract(file_name(path), ISBN_NAME, 1), "[^0-9]", "")
    return F.when(F.length(digits) >= 13, F.substring(digits, 1, 13))


def paper_id(doi: Column, path: Column, title: Column) -> Column:
    """By DOI, else by the arXiv number or the ISBN in the file name, else by a hash of title and file name."""
    arxiv = F.regexp_extract(file_name(path), ARXIV_NAME, 1)
    book = F.regexp_replace(F.regexp_extract(file_name(path), ISBN_NAME, 1), "-", "")
    hashed = F.concat_ws("|", F.regexp_replace(stripped(F.lower(F.coalesce(title, F.lit("")))), r"(?U)\s+", " "), F.lower(F.coalesce(stem(path), F.lit(""))))
    return F.coalesce(
        F.concat(F.lit("p_"), F.translate(blank_to_null(doi), "./", "__")),
        F.when(arxiv != "", F.concat(F.lit("p_arxiv_"), F.translate(arxiv, ".", "_"))),
        F.when(book != "", F.concat(F.lit("p_isbn_"), book)),
        F.concat(F.lit("p_h_"), short_hash(hashed)))


def retrieved_id(doi: Column, eid: Column, title: Column) -> Column:
    """By DOI, else by the index's own number, else by a hash of the title; rows with none of these hash as empty."""
    return F.concat(F.lit("scopus_"), F.coalesce(
        F.replace(F.when(doi != "", doi), F.lit("/"), F.lit("_")), F.when(eid != "", eid), short_hash(F.when(title != "", title)), short_hash(F.lit("[]"))))


def normalize_keywords(c: Column) -> Column:
    """P5: an array of keyword lists as one array, split at bars, semicolons and commas, first occurrences only."""
    parts = F.flatten(F.transform(F.filter(c, lambda k: k.isNotNull()), lambda k: F.split(k, r"[|;,]")))
    return F.array_distinct(F.filter(F.transform(parts, stripped), lambda p: p != ""))


def valid_year(c: Column) -> Column:
    """Whole years from 1900 to 2100; anything else is unknown."""
    y = c.try_cast("int")
    return F.when(y.between(1900, 2100), y)


def normalize(papers: DataFrame) -> DataFrame:
    """P5: whole records: title, doi, abstract, authors, keywords and year in their canonical forms; other columns stay."""
    has = lambda c: F.coalesce(c, F.expr("CAST(array() AS array<string>)"))
    names = F.filter(F.transform(F.filter(has(F.col("authors")), lambda a: a.isNotNull()), stripped), lambda a: a != "")
    return papers.withColumns({
        "title": single_spaced(F.col("title")), "doi": normalize_doi(F.col("doi")), "abstract": single_spaced(F.col("abstract")),
        "authors": dedupe_authors(names), "keywords": normalize_keywords(has(F.col("keywords"))), "year": valid_year(F.col("year"))})


def api_record(entries: DataFrame) -> DataFrame:
    """Entries of a search (title, creator, cover_date, doi, abstract, keywords, citations, source_type, source_name, eid) as records."""
    doi = F.when(F.col("doi") != "", F.lower("doi"))
    parts = F.filter(F.transform(F.split(F.coalesce(F.col("keywords"), F.lit("")), r"[|;]"), stripped), lambda k: k != "")
    return entries.select(
        "title", F.when(F.col("creator") != "", F.array("creator")).otherwise(F.expr("CAST(array() AS array<string>)")).alias("authors"),
        F.substring("cover_date", 1, 4).try_cast("int").alias("year"), doi.alias("doi"), F.concat(F.lit("https://doi.org/"), doi).alias("url"),
        F.col("abstract"), distinct_ignoring_case(parts).alias("keywords"), F.coalesce(F.col("citations").try_cast("int"), F.lit(0)).alias("citations_count"),
        F.coalesce(F.col("source_type"), F.lit("Unknown")).alias("source_type"), "source_name", "eid", "cover_date")


def distinct_ignoring_case(items: Column) -> Column:
    """U8: the first of items that differ in case only, in order."""
    return let(items, lambda a: let(F.transform(a, F.lower), lambda low: F.filter(a, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)))


def document(title: Column, abstract: Column, keywords: Column, form: str = "spaced") -> Column:
    """Title, abstract and keywords as one text: ``spaced`` always by single blanks, ``filled`` of parts that are there, ``lower`` that in lower case."""
    words = F.array_join(F.coalesce(keywords, F.expr("CAST(array() AS array<string>)")), " ")
    if form == "spaced":
        return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit("")), words)
    out = F.array_join(F.filter(F.array(title, abstract, words), lambda p: p != ""), " ")
    return F.lower(out) if form == "lower" else out


def seed_keys(papers: DataFrame) -> DataFrame:
    """(key, paper columns): each paper by its id and by ``pdf_`` and its file's stem."""
    keys = F.array_compact(F.array(F.col("paper_id"), F.concat(F.lit("pdf_"), stem(F.when(F.col("pdf_path") != "", F.col("pdf_path"))))))
    return papers.withColumn("key", F.explode(F.array_distinct(keys)))


def title_of_file(path: Column) -> Column:
    """A title from a file name; none if it is too short."""
    name = F.regexp_replace(F.regexp_replace(stem(path), r"-[0-9]+$", ""), r"v[0-9]+$", "")
    name = F.trim(F.regexp_replace(F.translate(name, "_-", "  "), r"\s+", " "))
    return F.when(F.length(name) > 3, name)


def title_variants(title: Column) -> Column:
    """Up to three prefixes of a title, longest first, of at least four words and eight characters."""
    trim = lambda c: F.regexp_replace(c, r"^[ ,;:-]+|[ ,;:-]+$", "")
    sizes = lambda w: F.when(F.size(w) >= 4, F.sequence(F.size(w), F.lit(4), F.lit(-1))).otherwise(F.expr("CAST(array() AS array<int>)"))
    starts = let(F.split(trim(F.regexp_replace(title, r"(?U)\s+", " ")), " "), lambda w: F.transform(sizes(w), lambda n: trim(F.array_join(F.slice(w, F.lit(1), n), " "))))
    all_ = F.array_distinct(F.filter(starts, lambda v: F.length(v) >= 8))
    return F.coalesce(F.slice(all_, 1, 3), F.expr("CAST(array() AS array<string>)"))


#: Hosts that are no venue.
HOSTS = ["books.google.com", "google.com", "scholar.google.com", "science.org", "nature.com", "springer", "elsevier", "wiley", "mdpi", "acm",
         "ieee", "arxiv", "academia.edu", "researchgate.net", "jstor", "springer.com", "sciencedirect.com"]


def scholarly_summary(summary: Column) -> Column:
    """Struct (authors, year, venue) of "A Author, B Author - Venue, 2020 - host"."""
    first = F.split(summary, " - ", 2)[0]
    names = F.filter(F.transform(F.split(first, r",|\band\b"), lambda c: F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[ .;:-]+|[ .;:-]+$", "")), lambda c: c != "")
    year = F.regexp_extract(summary, r"\b((?:19|20)[0-9]{2})\b", 1)
    parts = F.filter(F.transform(F.split(summary, " - "), stripped), lambda p: p != "")
    middle = F.when(F.size(parts) >= 2, F.element_at(parts, -2))
    venue = F.regexp_replace(F.regexp_replace(middle, r",?\s*(?:19|20)[0-9]{2}\b", ""), r"^[ ,]+|[ ,]+$", "")
    return F.struct(names.alias("authors"), year.try_cast("int").alias("year"), F.when((venue != "") & ~F.lower(venue).isin(*HOSTS), venue).alias("venue"))


def surname_and_given(name: Column) -> Column:
    """Struct (surname, given) of a name in plain letters: before a comma, or before initials, else all but the last word."""
    a = F.regexp_replace(stripped(ascii_folded(name)), ",+$", "")
    words = F.split(a, r"\s+")
    comma = F.struct(stripped(F.split(a, ",", 2)[0]).alias("surname"), stripped(F.split(a, ",", 2)[1]).alias("given"))
    one = F.struct(a.alias("surname"), F.lit("").alias("given"))
    many = F.struct(F.array_join(F.slice(words, F.lit(1), F.greatest(F.lit(0), F.size(words) - 1)), " ").alias("surname"), F.element_at(words, -1).alias("given"))
    return F.when(a.contains(","), comma).when(F.size(words) <= 1, one).otherwise(many)


#: Words of titles that make no key.
KEY_STOP_WORDS = ["with", "from", "using", "this", "that", "large", "based", "toward", "towards", "study", "review", "their", "into", "language",
                  "models", "model", "framework", "systems", "system"]


def citation_key(authors: Column, year: Column, title: Column) -> Column:
    """K9: surname, year and the first telling word of the title."""
    last = F.regexp_replace(F.element_at(F.split(stripped(surname_and_given(F.get(authors, F.lit(0)))["surname"]), r"\s+"), -1), "[^a-zA-Z]", "")
    words = F.filter(F.transform(F.regexp_extract_all(ascii_folded(title), F.lit("[A-Za-z]{4,}"), F.lit(0)), F.lower), lambda w: ~w.isin(*KEY_STOP_WORDS))
    return F.concat(F.coalesce(F.when(last != "", F.lower(last)), F.lit("anon")), F.coalesce(F.when(year != 0, year.cast("string")), F.lit("nd")), F.coalesce(F.get(words, F.lit(0)), F.lit("study")))


def _digits_share(t: Column) -> Column:
    return F.length(F.regexp_replace(t, r"[^\p{Nd}]", "")) / F.length(t)


def any_of(t: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (t.rlike(p) for p in patterns))


def warnings(title: Column, authors: Column, year: Column, abstract: Column, keywords: Column, now: int) -> Column:
    """codes ``field:reason`` of what is wrong with a record, in fixed order; a missing field has no other code."""
    t, text = blank_to_null(title), blank_to_null(abstract)
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    checks = [
        ("title:missing", t.isNull()),
        ("title:too_short", F.length(t) < 12),
        ("title:high_digit_ratio", _digits_share(t) > 0.2),
        ("title:contains_filename_artifacts", any_of(t, FILE_NAME_TITLE)),
        ("title:contains_url", t.rlike(URL_TITLE)),
        ("title:contains_publisher_header", t.rlike(PUBLISHER_TITLE)),
        ("title:looks_like_journal_forward", t.rlike(FORWARD_TITLE)),
        ("title:looks_like_chapter_prefix", t.rlike(CHAPTER_TITLE)),
        ("authors:missing", ~some(authors)),
        ("authors:contains_section_label", some(authors) & F.exists(authors, lambda a: F.lower(stripped(a)).isin(*SECTION_LABELS))),
        ("authors:looks_like_sentence", some(authors) & F.exists(authors, lambda a: F.size(F.split(stripped(a), r"(?U)\s+")) > 5)),
        ("authors:contains_digits", some(authors) & F.exists(authors, lambda a: a.rlike(r"\p{Nd}"))),
        ("year:missing", year.isNull()),
        ("year:out_of_range", (year < 1990) | (year > now)),
        ("abstract:missing", text.isNull()),
        ("abstract:too_short", F.length(text) < 200),
        ("keywords:missing", ~some(keywords)),
        ("keywords:too_many", some(keywords) & (F.size(keywords) > 12)),
        ("keywords:contains_body_text", some(keywords) & F.exists(keywords, lambda k: F.length(k) > 60)),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in checks]))


def validated(papers: DataFrame, now: int) -> DataFrame:
    """F1 on a table of records: its ``warnings``."""
    return papers.withColumn("warnings", warnings(*(F.col(c) for c in ("title", "authors", "year", "abstract", "keywords")), now))


def flagged(papers: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """the records with warnings, or those that are named."""
    return papers.filter(F.col("paper_id").isin(*ids)) if ids else papers.filter(F.size("warnings") > 0)


def recency(year: Column, reference: int, half_life: float = 3.0) -> Column:
    """Halves every ``half_life`` years; an unknown year has none."""
    age = F.greatest(F.lit(0), F.lit(reference) - year)
    return F.coalesce(F.pow(F.lit(0.5), age / F.lit(max(0.5, half_life))), F.lit(0.0))


def citation_velocity(citations: Column, year: Column, reference: int, saturation: float = 30.0) -> Column:
    """Citations a year as a share of ``saturation``, one at most; an unknown year counts as one year."""
    years = F.greatest(F.lit(1), F.coalesce(F.lit(reference) - year + 1, F.lit(1)))
    return F.least(F.lit(1.0), F.coalesce(citations, F.lit(0)) / years / F.lit(max(1.0, saturation)))


def phrase_fraction(text: Column, phrases: list[str]) -> Column:
    """The share of phrases that a text contains, whatever their case."""
    if not phrases:
        return F.lit(0.0)
    low = F.lower(F.coalesce(text, F.lit("")))  # one expression, which generated code computes once
    return sum((low.contains(p.lower()).cast("double") for p in phrases[1:]), low.contains(phrases[0].lower()).cast("double")) / len(phrases)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; none for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """The vector in doubles, of length one; a zero vector stays."""
    return let(F.sqrt(dot(v, v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))
