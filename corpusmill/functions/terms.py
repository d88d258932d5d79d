"""Cleaning of texts and tests of terms and phrases, as column expressions."""

from __future__ import annotations

import glob
import os
import zipfile
from functools import lru_cache, reduce

import pyspark
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.records import FILE_NAME_TITLE, any_of, ascii_folded, distinct_ignoring_case, stripped

#: Publishers and repositories.
PUBLISHERS = ["wiley", "springer", "elsevier", "ieee", "acm", "sage", "taylor", "francis", "oxford", "cambridge", "nature", "science",
              "plos", "arxiv", "biorxiv", "medrxiv", "ssrn", "jstor", "tandfonline"]
MORE_PUBLISHERS = ["pergamon", "routledge", "guild", "informa", "gale", "proquest"]
#: Beginnings of words that extraction has cut; one of them is a whole word.
CUT_WORDS = ["scienti", "technolog", "organisati", "organisat", "implementati", "administrati", "characteristi", "strategi", "decision",
             "communicat", "significan", "responsibil"]
#: What is removed from a corpus, in this order, each with whether case matters.
ARTIFACTS = [
    (r"https?://[^\s]+", True), (r"ftp://[^\s]+", True), (r"www\.[^\s]+", True), (r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", True),
    (r"\b(?:doi|isbn|issn)[:\s]?[0-9.\-/]+\b", False), (r"\b(?:doi|ISBN|ISSN)\s*[:\-]?\s*[0-9.\-/()a-zA-Z]+\b", True),
    (r"\b(?:arXiv|bioRxiv|medRxiv):[0-9.]+\b", False), (r"\bet\s+al\.?,?\s+[0-9]{4}", False), (r"\([\p{L}\p{N}_]+,?\s+[0-9]{4}\)", True),
    (r"\b(?:pp?|pages?|p\.?)\s*[0-9]+[\-–][0-9]+\b", False), (r"\b(?:vol(?:ume)?|no|issue|number)\.?\s+[0-9]+\b", False),
    (r"\b(?:" + "|".join(PUBLISHERS + MORE_PUBLISHERS) + r")\b", False),
]


def sanitized(c: Column) -> Column:
    """Without lone surrogates, which Spark's strings cannot hold, and without null characters."""
    return F.replace(c, F.lit("\x00"), F.lit(" "))


def pdf_text(c: Column) -> Column:
    """Single-spaced, up to the first word references or bibliography."""
    flat = F.regexp_replace(sanitized(c), r"\s+", " ")
    return stripped(F.split(flat, r"(?i)\b(?:references|bibliography)\b", 2)[0])


def remove_artifacts(c: Column, cut_words: bool = True) -> Column:
    """URLs, mail addresses, identifiers, citations, pages, volumes, publishers and cut words give way to a space."""
    patterns = ARTIFACTS + [(r"\b(?:" + "|".join(CUT_WORDS) + r")\b", False)] * cut_words
    out = reduce(lambda text, p: F.regexp_replace(text, ("(?U)" if p[1] else "(?iU)") + p[0], " "), patterns, c)  # words of any alphabet
    return stripped(F.regexp_replace(out, r"\s+", " "))


@lru_cache
def _listed(language: str) -> tuple[str, ...]:
    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    for jar in glob.glob(f"{home}/jars/spark-mllib_*.jar") + glob.glob(f"{os.path.dirname(pyspark.__file__)}/jars/spark-mllib_*.jar"):
        with zipfile.ZipFile(jar) as z:
            return tuple(w for w in z.read(f"org/apache/spark/ml/feature/stopwords/{language}.txt").decode().split("\n") if w)
    return tuple(StopWordsRemover.loadDefaultStopWords(language))


def stop_words(language: str = "english") -> list[str]:
    """Spark's own list, read from its library, so that none is needed running; else asked of the running one."""
    return list(_listed(language))


def clear_text(c: Column, stop: list[str] = (), custom: list[str] = (), accents: str = "first", numbers: bool = True) -> Column:
    """Artifacts go, then lower case, plain letters and digits, without stop words, custom words and digits.

    ``accents``: "first" folds accents before other characters go; "compat" lets accented letters become spaces.
    """
    out = F.lower(remove_artifacts(c))
    if accents == "first":
        out = ascii_folded(out)
    out = F.regexp_replace(out, r"[^a-zA-Z0-9']+", " ")
    unwanted = [*stop, *custom]
    if unwanted:
        out = F.array_join(F.filter(F.split(out, " "), lambda w: (w != "") & ~w.isin(*unwanted)), " ")
    if numbers:
        out = F.regexp_replace(out, "[0-9]", " ")
    return F.trim(F.regexp_replace(out, " +", " "))


#: Words that are no topic terms.
TERM_STOP_WORDS = """the a an and or but in on at to for of with by from up as is be are was were been have has had do does did will would could
should may might can must shall this that these those i you he she it we they what which who when where why how all each every both either
neither any some no not nor only own same so than too very just more most less least new old etc amp vs v de el la le les et al pp p ed eds vol
doi isbn abstract conclusion introduction method result keywords references acknowledgment funding""".split()
TERM_REJECTS = [r"^www", r"^[0-9]+$", r"^[a-z]$", r"^[a-z]{2}$", r"[0-9]{4,}", r"http|ftp|doi\.org", r"^[0-9]+\.", r"^scienti", r"^[a-z]+ing$"]


def is_quality_term(c: Column) -> Column:
    """of 3 to 30 characters, mostly letters, no stop word, publisher, number or form in -ing."""
    t = stripped(F.lower(c))
    n = F.length(t)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return F.coalesce(n.between(3, 30) & ~t.isin(*TERM_STOP_WORDS, *PUBLISHERS) & ~any_of(t, TERM_REJECTS) & (letters / n >= 0.7), F.lit(False))


def clean_terms(terms: Column, most: int = 10) -> Column:
    """The first terms of quality in lower case; without any, the first terms as they are."""
    lower = lambda a: F.transform(a, lambda t: stripped(F.lower(t)))
    good = F.slice(F.filter(terms, is_quality_term), 1, most)
    return lower(F.when(F.size(good) > 0, good).otherwise(F.slice(terms, 1, most)))


def label(terms: Column, most: int = 3) -> Column:
    """The first clean terms, or ``unknown``."""
    return F.coalesce(F.nullif(F.array_join(clean_terms(terms, most), ", "), F.lit("")), F.lit("unknown"))


GLUE = r"[A-Za-z]+[0-9]+[A-Za-z]"


def _words(c: Column) -> Column:
    return F.size(F.filter(F.split(stripped(c), r"\s+"), lambda w: w != ""))


def is_or_phrase(c: Column) -> Column:
    """F8: may be quoted in a query: no clause marks, no glued words, six words at most."""
    return F.coalesce((stripped(c) != "") & ~c.rlike("[,;:]") & ~c.rlike(GLUE) & (_words(c) <= 6), F.lit(False))


#: Phrases that say nothing of a topic.
NOISE_PHRASES = ["future directions", "existing studies", "code results", "results available", "limited resources", "time constraints",
                 "various domains", "present study", "paper presents", "case study", "case studies", "open source", "open-source",
                 "research questions", "et al", "study aims", "study presents"]


def is_keyphrase(c: Column) -> Column:
    """two to five words, no clause marks, no glued words, no filler."""
    p = stripped(c)
    return F.coalesce(~p.rlike("[,;:]") & ~p.rlike(r"[a-z]+[0-9]+[a-z]") & ~p.isin(*NOISE_PHRASES) & _words(p).between(2, 5), F.lit(False))


#: Umbrella terms.
UMBRELLA = ["artificial intelligence", "artificial intelligence (ai)", "generative artificial intelligence",
            "generative artificial intelligence (genai)", "generative ai", "genai", "ai", "machine learning", "deep learning", "neural networks",
            "neural network", "big data", "data analytics", "data science", "technology", "technologies", "digital technologies"]
QUOTES = "\"“”"


def unquoted(c: Column) -> Column:
    return F.regexp_replace(stripped(c), f"^[{QUOTES}]+|[{QUOTES}]+$", "")


def is_umbrella(c: Column) -> Column:
    """the whole phrase is an umbrella term."""
    return F.coalesce(F.lower(unquoted(c)).isin(*UMBRELLA), F.lit(False))


def looks_like_file(title: Column) -> Column:
    """no title, or one without a blank."""
    return ~F.coalesce(stripped(title).contains(" "), F.lit(False))


def safe_title(title: Column, candidate: Column) -> Column:
    """the title, else the candidate, unless it looks like a file name."""
    return F.coalesce(F.when(~looks_like_file(title), title), F.when(~looks_like_file(candidate), candidate))


#: Marks of a title that other text has run into.
CONTAMINATED = [r"Corresponding Author", r"[†∗*]", r"[0-9]+,\s*[A-Z][a-z]+\s+[A-Z][a-z]+", r"[a-z][0-9]+\*?[A-Z]", r"^\s*[0-9]{1,4}\s+[A-Z]\.\s*[A-Z]",
                r"\bet\s+al\.", r"[ﬂﬁﬀﬃﬄ]"]
#: Marks of a title that is a header or a label.
PROBLEMATIC = [r"http[s]?://", r"all sciences proceedings", r"international conference", r"journal homepage", r"published by", r"©\s*[0-9]{4}",
               r"doi\s*:", r"issn\s*:", r"^(volume|issue|pages|pp\.)", r"^\s*manuscript\s+forthcoming", r"^\s*forthcoming\s+in\b",
               r"^\s*to\s+appear\s+in\b", r"^\s*preprint(\s+of)?\b", r"^\s*chapter\s+[0-9]+\b", r"\b[0-9]{1,4}\.\.[0-9]{1,4}\b", r"_proof\b",
               r"\+{2,}|_{2,}", r"^\s*research\s+article\s*$", r"^\s*review\s+article\s*$", r"^\s*original\s+article\s*$",
               r"^\s*short\s+communication\s*$", r"^\s*case\s+report\s*$", r"^\s*editorial\s*$", r"^\s*letter\s+to\s+the\s+editor\s*$"]


def _many_digits(t: Column) -> Column:
    return F.length(F.regexp_replace(t, r"[^\p{Nd}]", "")) / F.greatest(F.lit(1), F.length(t)) > 0.2


def contaminated_title(title: Column) -> Column:
    """authors, marks or page numbers have run into the title, or there is none."""
    return F.coalesce((title == "") | any_of(title, CONTAMINATED) | (F.length(title) > 250), F.lit(True))


def file_title(title: Column) -> Column:
    """the title is a publisher's file name."""
    t = stripped(title)
    return F.coalesce((F.length(t) < 8) | any_of(t, [FILE_NAME_TITLE[0], FILE_NAME_TITLE[1], FILE_NAME_TITLE[2], r"\\n"]) | _many_digits(t), F.lit(True))


def problematic_title(title: Column) -> Column:
    """the title has a header, a URL or a section label."""
    return F.coalesce((title == "") | any_of(F.lower(title), PROBLEMATIC), F.lit(True))


def suspicious_title(title: Column) -> Column:
    """too short, too many digits, marks of file names, or problematic."""
    t = stripped(title)
    return F.coalesce((F.length(t) < 8) | _many_digits(t) | t.rlike(r"\+{2,}|_{2,}|\\n"), F.lit(True)) | problematic_title(t)


def broken_authors(authors: Column) -> Column:
    """none, or one that is too short or in capitals throughout."""
    bad = lambda a: (stripped(a) != "") & ((F.length(stripped(a)) < 3) | ((F.upper(stripped(a)) == stripped(a)) & stripped(a).rlike(r"\p{Lu}")))
    return F.coalesce(F.size(authors) <= 0, F.lit(True)) | F.coalesce(F.exists(authors, bad), F.lit(False))


CATEGORY = r"^[a-z]{2,4}\.[A-Z]{2,3}$"


def categories_only(keywords: Column) -> Column:
    """there are keywords, and each is a category of the preprint server."""
    return F.coalesce((F.size(keywords) > 0) & F.forall(keywords, lambda k: k.rlike(CATEGORY)), F.lit(False))


#: Words that no keyword begins with.
NO_KEYWORD_STARTS = """such and or but in on at to for with from into by as of the a an this that these those is are was were be been being we our
their which who whom where when why how because since while although however thus therefore moreover also though if they them despite unlike
whereas whilst""".split()
KEYWORD_REJECTS = [r"^\s*[0-9]+(\.[0-9]+)*\.?\s+[A-Z]", r"^[a-z]{1,2}:", r"^[a-zA-Z]\s+[a-z]", r"[.!?]\s*$", r"^\s*[(\[{]", r"\bet\s+al\.?|&",
                   r"\s-|-\s", r",.*,", r"\.\s+[A-Z]", r"^\p{Lu}{4,}$"]


def is_clean_keyword(c: Column) -> Column:
    """2 to 60 characters in one to five words that look like an author's keyword."""
    t = stripped(c)
    first = F.regexp_replace(F.lower(F.split(t, r"\s+")[0]), r"^[()\[\]{}.,;:]+|[()\[\]{}.,;:]+$", "")
    return F.coalesce(F.length(t).between(2, 60) & _words(t).between(1, 5) & t.rlike("[A-Za-z]") & ~any_of(t, KEYWORD_REJECTS) & ~first.isin(*NO_KEYWORD_STARTS), F.lit(False))


def clean_keywords(candidates: Column, most: int = 8) -> Column:
    """the first clean keywords, each once whatever its case."""
    good = F.transform(F.filter(F.coalesce(candidates, F.expr("CAST(array() AS array<string>)")), is_clean_keyword), stripped)
    return F.slice(distinct_ignoring_case(good), 1, most)


def springer_keywords(fragment: Column) -> Column:
    """Struct (keywords, rest) of "A · B · C 2 Section ...": up to twelve keywords; none, and all the rest, otherwise."""
    section = r"(?s)^(.*?)(\s+[0-9]{1,2}\s+[A-Z][a-zA-Z].*)$"
    parts = F.filter(F.transform(F.split(stripped(F.regexp_extract(fragment, section, 1)), "·"), stripped), lambda p: p != "")
    fits = fragment.contains("·") & fragment.rlike(section) & (F.size(parts) >= 2) & ~F.exists(parts, lambda p: F.length(p) > 80)
    none = F.expr("CAST(array() AS array<string>)")
    return F.when(F.coalesce(fits, F.lit(False)), F.struct(F.slice(parts, 1, 12).alias("keywords"), stripped(F.regexp_extract(fragment, section, 2)).alias("rest"))).otherwise(
        F.struct(none.alias("keywords"), fragment.alias("rest")))


def named_in(phrase: Column, text: Column) -> Column:
    """F16: the phrase, without quotes, stands in the text, whatever the case."""
    p = F.lower(unquoted(phrase))
    return F.coalesce((p != "") & F.lower(text).contains(p), F.lit(False))


