"""Paper text to sections and metadata; search, recency, sampling and statistics over papers.

A document is one row with its pages as an array, so sectioning is a map: no
shuffle, no window.  Page tables are first gathered per document.
"""

from __future__ import annotations

import functools
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import papers as fn
from plumbline.operators.profile import avg_list_size, counts_by_key, length_stats
from plumbline.operators.ranks import top_per_group
from plumbline.session import quoted

# Fixed value: type of a last section under the reference labels.
LAST_SECTION = "content"


def gather_pages(df: DataFrame, key: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """(key, pages): the pages of each document in order."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(quoted(page)).alias("p"), F.col(quoted(text)).alias("t"))))
    return df.groupBy(F.col(quoted(key))).agg(F.transform(ordered, lambda x: x["t"]).alias("pages"))


def with_sections(df: DataFrame, pages: str = "pages", reference_labels: bool = False) -> DataFrame:
    """Add ``sections``: array of (section_no, title, section_type, page_number, content).

    Lines before the first header and sections without content are dropped.  With
    ``reference_labels`` a section carries the type and page of the header after it,
    and the last one the type ``content``.
    """
    lines = F.filter(
        F.flatten(
            F.transform(
                F.col(quoted(pages)),
                lambda p, n: F.transform(F.split(p, "\n"), lambda l: F.struct(fn.trimmed(l).alias("line"), n.alias("page"))),
            )
        ),
        lambda x: x["line"] != "",
    )
    typed = F.transform(F.col("_lines"), lambda x: F.struct(x["line"].alias("line"), x["page"].alias("page"), fn.classify_header(x["line"]).alias("kind")))
    marked = F.transform(
        F.col("_typed"),
        lambda x, i: F.when(x["kind"].isNotNull(), F.struct(i.alias("at"), x["line"].alias("line"), x["page"].alias("page"), x["kind"].alias("kind"))),
    )

    def section(h: Column, j: Column) -> Column:
        after = F.get(F.col("_heads"), j + 1)
        end = F.coalesce(after["at"], F.size("_typed"))
        body = F.transform(F.slice(F.col("_typed"), h["at"] + 2, end - h["at"] - 1), lambda x: x["line"])
        if reference_labels:
            kind = F.coalesce(after["kind"], F.lit(LAST_SECTION))
            page = F.coalesce(after["page"], F.col("_last_page"))
        else:
            kind, page = h["kind"], h["page"]
        return F.struct(
            j.alias("section_no"), h["line"].alias("title"), kind.alias("section_type"), page.alias("page_number"), F.array_join(body, "\n").alias("content")
        )

    return (
        df.withColumn("_lines", lines)
        .withColumn("_last_page", F.size(F.col(quoted(pages))) - 1)
        .withColumn("_typed", typed)
        .withColumn("_heads", F.filter(marked, lambda x: x.isNotNull()))
        .withColumn("sections", F.filter(F.transform(F.col("_heads"), section), lambda s: s["content"] != ""))
        .drop("_lines", "_last_page", "_typed", "_heads")
    )


def split_sections(df: DataFrame, key: str = "doc_id", pages: str = "pages", reference_labels: bool = False) -> DataFrame:
    # the outer form keeps the planner from testing the array's size first, which would build every section twice
    sections = with_sections(df.select(quoted(key), quoted(pages)), pages, reference_labels)
    return sections.select(quoted(key), F.inline_outer("sections")).where("section_no is not null")


def references_count(sections: Column) -> Column:
    """Numbered lines of the first references section."""
    first = F.get(F.filter(sections, lambda s: s["section_type"] == "references"), F.lit(0))["content"]
    return F.coalesce(F.size(F.filter(F.split(first, "\n"), lambda l: l.rlike(fn.NUMBERED))), F.lit(0))


def process_documents(df: DataFrame, key: str = "doc_id", pages: str = "pages", reference_labels: bool = False) -> DataFrame:
    """Everything read from a paper's text, one row per document."""
    full = F.concat(F.array_join(F.col(quoted(pages)), "\n"), F.lit("\n"))
    return with_sections(df, pages, reference_labels).select(
        quoted(key),
        fn.extract_title(F.get(F.col(quoted(pages)), F.lit(0))).alias("title"),
        fn.extract_abstract(F.col(quoted(pages))).alias("abstract"),
        fn.extract_keywords(F.col(quoted(pages))).alias("keywords"),
        fn.extract_doi(full).alias("doi"),
        fn.extract_feed_id(full).alias("arxiv_id"),
        fn.extract_pmid(full).alias("pubmed_id"),
        "sections",
        full.alias("full_text"),
        fn.count_figures(F.col(quoted(pages))).alias("figures"),
        fn.count_tables(full).alias("tables"),
        references_count(F.col("sections")).alias("references"),
    )


def category_lookup(df: DataFrame, column: str) -> DataFrame:
    """Add the name and address of a category code."""
    names = F.create_map(*[F.lit(x) for pair in fn.CATEGORY_NAMES.items() for x in pair])
    code = F.col(quoted(column))
    before, after = fn.CATEGORY_URL.split("{}")
    return df.withColumn("category_name", F.coalesce(F.try_element_at(names, code), F.lit(fn.UNKNOWN_CATEGORY))).withColumn(
        "category_url", F.concat(F.lit(before), code, F.lit(after))
    )


def search_papers(
    papers: DataFrame,
    text: str | None = None,
    categories: list[str] | None = None,
    date_from: datetime | None = None,
    date_to: datetime | None = None,
    publication_types: list[str] | None = None,
    languages: list[str] | None = None,
    mesh_terms: list[str] | None = None,
    journals: list[str] | None = None,
) -> DataFrame:
    """Papers meeting every given group; within a group any value will do."""
    tests = []
    if text:
        needle = F.lit(text.lower())
        tests.append(F.contains(F.lower("title"), needle) | F.contains(F.lower("abstract"), needle))
    if date_from:
        tests.append(F.col("published") >= F.lit(date_from.isoformat(sep=" ")).cast("timestamp_ntz"))
    if date_to:
        tests.append(F.col("published") <= F.lit(date_to.isoformat(sep=" ")).cast("timestamp_ntz"))
    for column, values in (("categories", categories), ("publication_types", publication_types), ("mesh_terms", mesh_terms)):
        if values:
            tests.append(F.arrays_overlap(F.col(column), F.lit(list(values))))
    for column, values in (("language", languages), ("journal", journals)):
        if values:
            tests.append(F.col(column).isin(list(values)))
    return papers.where(functools.reduce(lambda a, b: a & b, tests)) if tests else papers


def recent_papers(papers: DataFrame, as_of: datetime, days_back: int = 7, max_results: int = 50, categories: list[str] | None = None, key: str = "id") -> DataFrame:
    """The newest papers of the last days."""
    from datetime import timedelta

    found = search_papers(papers, categories=categories, date_from=as_of - timedelta(days=days_back), date_to=as_of)
    return found.orderBy(F.col("published").desc(), F.col(quoted(key))).limit(max_results)


def sample_by_domain(papers: DataFrame, domains: list[str], size: int, key: str, domain: str = "domain", source: str = "source") -> DataFrame:
    """``size // domains`` papers per domain, half of that from each source, first by key; then cut per domain."""
    quota = size // len(domains)
    half = quota // 2
    chosen = papers.where(F.col(quoted(domain)).isin(list(domains)))
    per_source = top_per_group(chosen, [domain, source], [F.col(quoted(key))], half, key).drop("place")
    order = [F.col(quoted(source)), F.col(quoted(key))]
    return top_per_group(per_source, [domain], order, quota, key).drop("place")


def dataset_statistics(papers: DataFrame) -> DataFrame:
    """Totals, counts by source, domain and year, abstract length and list size as (metric, key, value)."""
    total = papers.agg(F.lit("total_papers").alias("metric"), F.lit("*").alias("key"), F.count(F.lit(1)).cast("double").alias("value"))
    counts = counts_by_key(papers, {"by_source": F.col("source"), "by_domain": F.col("domain")}).unionByName(
        counts_by_key(papers.where("published is not null"), {"by_year": F.year("published")})
    )
    lengths = length_stats(papers, "abstract").select(
        F.inline(
            F.array(
                F.struct(F.lit("avg_abstract_length").alias("metric"), F.lit("*").alias("key"), F.col("avg_length").alias("value")),
                F.struct(F.lit("median_abstract_length").alias("metric"), F.lit("*").alias("key"), F.col("median_length").cast("double").alias("value")),
            )
        )
    )
    authors = avg_list_size(papers, "authors").select(F.lit("avg_authors_per_paper").alias("metric"), F.lit("*").alias("key"), F.col("avg_size").alias("value"))
    by_key = counts.select(F.col("dimension").alias("metric"), "key", F.col("n").cast("double").alias("value"))
    return total.unionByName(by_key).unionByName(lengths).unionByName(authors)


def merge_paper_metadata(extracted: DataFrame, papers: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The paper record's fields replace what was read from the text, missing ones included, where there is a record."""
    record = papers.select(F.col(quoted(key)).alias("_key"), F.struct(*[F.col(quoted(c)) for c in columns]).alias("_record"))
    joined = extracted.join(record, extracted[quoted(key)] == record["_key"], "left")
    known = F.col("_key").isNotNull()
    replaced = {c: F.when(known, F.col(f"_record.{quoted(c)}")).otherwise(extracted[quoted(c)] if c in extracted.columns else F.lit(None)).alias(c) for c in columns}
    kept = [replaced.pop(c) if c in replaced else extracted[quoted(c)] for c in extracted.columns]
    return joined.select(*kept, *replaced.values())
