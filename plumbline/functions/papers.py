"""Column functions on paper text and paper metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The section types in order of precedence, each with its header patterns.
SECTION_PATTERNS = {
    "abstract": [r"abstract\s*$", r"summary\s*$", r"executive\s+summary\s*$"],
    "introduction": [r"introduction\s*$", r"1\.?\s*introduction\s*$", r"background\s*$"],
    "methods": [r"methods?\s*$", r"methodology\s*$", r"materials?\s+and\s+methods?\s*$", r"experimental\s+design\s*$"],
    "results": [r"results?\s*$", r"findings\s*$", r"results?\s+and\s+discussion\s*$"],
    "discussion": [r"discussion\s*$", r"analysis\s*$"],
    "conclusion": [r"conclusions?\s*$", r"summary\s+and\s+conclusions?\s*$", r"final\s+remarks\s*$"],
    "references": [r"references?\s*$", r"bibliography\s*$", r"works?\s+cited\s*$"],
}

# Patterns of identifiers, counters and numbered references.
DOI = r"(?i)(?:doi:)?\s*(10\.\d+/\S+)"
FEED_ID = r"(?i)arXiv:(\d+\.\d+)"
PMID = r"(?i)PMID:?\s*(\d+)"
ABSTRACT = r"(?is)abstract\s*[:\-]?\s*(.*?)(?=\n\s*(?:keywords?|introduction|1\.|\z))"
KEYWORDS = r"(?is)keywords?\s*[:\-]?\s*(.*?)(?=\n\s*(?:introduction|1\.|\z))"
FIGURE = r"(?i)figure\s+\d+"
TABLE = r"(?i)table\s+\d+"
NUMBERED = r"^\[\d+\]|^\(\d+\)|^\d+\."
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Category code -> name.
CATEGORY_NAMES = {
    "cs.AI": "Artificial Intelligence",
    "cs.CL": "Computation and Language",
    "cs.CV": "Computer Vision and Pattern Recognition",
    "cs.LG": "Machine Learning",
    "cs.NE": "Neural and Evolutionary Computing",
    "physics.med-ph": "Medical Physics",
    "physics.bio-ph": "Biological Physics",
    "quant-ph": "Quantum Physics",
    "math.ST": "Statistics Theory",
    "math.PR": "Probability",
    "math.CO": "Combinatorics",
    "q-bio.BM": "Biomolecules",
    "q-bio.CB": "Cell Behavior",
    "q-bio.GN": "Genomics",
    "q-bio.QM": "Quantitative Methods",
    "econ.EM": "Econometrics",
    "econ.TH": "Theoretical Economics",
}
UNKNOWN_CATEGORY = "Unknown Category"
CATEGORY_URL = "https://arxiv.org/list/{}/recent"


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def classify_header(line: Column) -> Column:
    """Section type of a header line, null for any other line."""
    text = trimmed(line)
    out = F.lit(None).cast("string")
    for name, patterns in reversed(SECTION_PATTERNS.items()):
        out = F.when(text.rlike("(?i)^(?:" + "|".join(patterns) + ")"), F.lit(name)).otherwise(out)
    return out


def trimmed(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def extract_title(first_page: Column) -> Column:
    """First of the first 10 lines longer than 20 characters, not all upper case and without a full stop."""
    lines = F.transform(F.slice(F.split(first_page, "\n"), 1, 10), trimmed)
    shouted = lambda x: (F.upper(x) == x) & (F.lower(x) != x)
    return F.get(F.filter(lines, lambda x: (F.length(x) > 20) & ~shouted(x) & ~F.contains(x, F.lit("."))), F.lit(0))


def _split_each(parts: Column, separator: str) -> Column:
    return F.flatten(F.transform(parts, lambda a: F.transform(F.split(a, separator), trimmed)))


def parse_authors(text: Column) -> Column:
    """Split on commas, then semicolons, then ' and ', then ampersands, trimming in between; names of 3 characters up."""
    parts = F.array(text)
    for separator in (",", ";", " and ", "&"):
        parts = _split_each(parts, separator)
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.filter(parts, lambda a: F.length(a) > 2))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def extract_doi(text: Column) -> Column:
    return found(text, DOI)


def extract_feed_id(text: Column) -> Column:
    return found(text, FEED_ID)


def extract_pmid(text: Column) -> Column:
    return found(text, PMID)


def extract_abstract(pages: Column) -> Column:
    """Abstract within the first three pages, white space collapsed, kept when longer than 50 characters."""
    text = F.array_join(F.slice(pages, 1, 3), "")
    body = F.regexp_replace(trimmed(F.regexp_extract(text, ABSTRACT, 1)), r"\s+", " ")
    return F.when(F.length(body) > 50, body)


def extract_keywords(pages: Column) -> Column:
    text = F.array_join(F.slice(pages, 1, 2), "")
    parts = F.split(trimmed(F.regexp_extract(text, KEYWORDS, 1)), r"[,;]|\sand\s")
    return F.filter(F.transform(parts, trimmed), lambda k: k != "")


def count_figures(pages: Column) -> Column:
    """Distinct literal figure references of each page, summed."""
    per_page = F.transform(pages, lambda p: F.size(F.array_distinct(F.regexp_extract_all(p, F.lit(FIGURE), F.lit(0)))))
    return F.aggregate(per_page, F.lit(0), lambda acc, n: acc + n)


def count_tables(text: Column) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(TABLE), F.lit(0))))


def url_filename(url: Column) -> Column:
    """Last path part when it ends in .pdf, else ``document.pdf``."""
    path = F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), "/+$", "")
    name = F.element_at(F.split(path, "/"), F.lit(-1))
    return F.when(F.endswith(name, F.lit(".pdf")), name).otherwise(F.lit("document.pdf"))


def join_abstract(parts: Column) -> Column:
    """array<struct<label, text>> -> ``LABEL: text`` parts joined by a space."""
    kept = F.filter(parts, lambda p: p["text"].isNotNull() & (p["text"] != ""))
    texts = F.transform(
        kept, lambda p: F.when(F.coalesce(p["label"], F.lit("")) != "", F.concat(p["label"], F.lit(": "), trimmed(p["text"]))).otherwise(trimmed(p["text"]))
    )
    return F.when(F.size(parts) > 0, F.array_join(texts, " "))


def author_names(authors: Column) -> Column:
    """array<struct<first, last>> -> ``First Last``, or the last name alone; without a last name left out."""
    named = F.filter(authors, lambda a: a["last"].isNotNull())
    return F.coalesce(F.transform(named, lambda a: F.concat_ws(" ", a["first"], a["last"])), F.array().cast("array<string>"))


def partial_date(year: Column, month: Column, day: Column) -> Column:
    """Year with optional month (number or three-letter name) and day; unknown parts are 1, an impossible date is null."""
    by_name = F.array_position(F.lit(MONTHS), month)
    m = F.coalesce(trimmed(month).try_cast("int"), F.nullif(by_name, F.lit(0).cast("long")).cast("int"), F.lit(1))
    d = F.coalesce(trimmed(day).try_cast("int"), F.lit(1))
    y = trimmed(year).try_cast("int")
    text = F.format_string("%04d-%02d-%02d", y, m, d)
    return F.when(y.between(1, 9999), text.try_cast("date")).cast("timestamp_ntz")


def clean_feed_id(text: Column, reference_labels: bool = False) -> Column:
    """Without the ``arXiv:`` prefix and the version; ``reference_labels`` cuts at the first ``v`` wherever it is."""
    bare = F.regexp_replace(text, "^arXiv:", "")
    return F.regexp_replace(bare, r"(?s)v.*$" if reference_labels else r"v\d+$", "")
