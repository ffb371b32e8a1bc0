"""Table readers: by suffix, whole directories, article XML, feed XML, text documents."""

from __future__ import annotations

import functools
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.papers import author_names, clean_feed_id, join_abstract, partial_date
from plumbline.session import quoted


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN cells as missing cells."""
    return df.select(
        *[
            F.nanvl(F.col(quoted(f.name)), F.lit(None).cast(f.dataType)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(quoted(f.name))
            for f in df.schema.fields
        ]
    )


def _one_object_per_line(spark: SparkSession, path: str) -> bool:
    """Whether the first line that is not blank is a JSON object by itself."""
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1)
    text = F.trim("value")
    found = first.select(text.startswith("{") & text.endswith("}") & F.try_parse_json(text).isNotNull()).collect()
    return bool(found) and bool(found[0][0])


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool | None = None) -> DataFrame:
    """Read .parquet, .csv or .json by suffix; .json holds an array, or one object per line, which is found out unless told."""
    name = path.rstrip("/")
    for packed in (".gz", ".bz2"):
        name = name.removesuffix(packed)
    suffix = PurePosixPath(name).suffix.lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if suffix == ".parquet":
        return reader.parquet(path)
    if suffix == ".csv":
        return reader.csv(path, header=True, inferSchema=schema is None)
    if suffix == ".json":
        return reader.json(path, multiLine=not (_one_object_per_line(spark, path) if lines is None else lines))
    if suffix == ".jsonl":
        return reader.json(path)
    raise ValueError(f"unsupported file type: {suffix or path}")


def read_directory(
    spark: SparkSession, folder: str, pattern: str = "*.parquet", schema: T.StructType | str | None = None
) -> DataFrame:
    """All files of one schema under a folder in one scan, with ``dataset`` = the file's stem.

    Files that can't be read give no rows; ``directory_rejects`` tells which.
    """
    reader = spark.read.option("pathGlobFilter", pattern).option("ignoreCorruptFiles", "true")
    if schema is not None:
        reader = reader.schema(schema)
    suffix = PurePosixPath(pattern).suffix.lower()
    loaders = {".parquet": reader.parquet, ".json": reader.json, ".jsonl": reader.json, ".csv": functools.partial(reader.csv, header=True)}
    if suffix not in loaders:
        raise ValueError(f"unsupported file type: {suffix}")
    df = loaders[suffix](folder)
    return df.select("*", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("dataset"))


def directory_rejects(spark: SparkSession, folder: str, pattern: str = "*.parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """(dataset, bytes, reason) of the files under a folder of which ``read_directory`` reads no row; only names and sizes are listed."""
    read = read_directory(spark, folder, pattern, schema).select("dataset").distinct()
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.col("length").alias("bytes"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), F.lit(-1)), r"\.[^.]*$", "")
    named = listed.select(stem.alias("dataset"), "bytes").join(read, "dataset", "left_anti")
    return named.withColumn("reason", F.when(F.col("bytes") == 0, F.lit("empty file")).otherwise(F.lit("no row could be read")))


def read_directory_tables(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> tuple[dict[str, DataFrame], dict[str, str]]:
    """File stem -> table, for files of differing schemas; unreadable files are reported by name."""
    jvm = spark.sparkContext._jvm
    glob = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob) or []
    tables, errors = {}, {}
    for status in found:
        path = status.getPath()
        stem = PurePosixPath(path.getName()).stem
        try:
            tables[stem] = read_table(spark, path.toString())
        except Exception as problem:  # noqa: BLE001 - reported by name
            errors[stem] = str(problem).splitlines()[0]
    return tables, errors


# Only the elements that are read; unlisted ones are skipped by the parser.
ARTICLE_SCHEMA = """
MedlineCitation struct<
  PMID: struct<_VALUE: string>,
  Article: struct<
    Journal: struct<Title: string, JournalIssue: struct<PubDate: struct<Year: string, Month: string, Day: string>>>,
    ArticleTitle: string,
    Abstract: struct<AbstractText: array<struct<_Label: string, _VALUE: string>>>,
    AuthorList: struct<Author: array<struct<LastName: string, ForeName: string,
      AffiliationInfo: array<struct<Affiliation: string>>>>>,
    Language: array<string>,
    PublicationTypeList: struct<PublicationType: array<struct<_VALUE: string>>>>,
  MeshHeadingList: struct<MeshHeading: array<struct<DescriptorName: struct<_VALUE: string>>>>,
  KeywordList: array<struct<Keyword: array<struct<_VALUE: string>>>>>,
PubmedData struct<ArticleIdList: struct<ArticleId: array<struct<_IdType: string, _VALUE: string>>>>
"""


def _texts(column: str, field: str) -> Column:
    return F.coalesce(F.filter(F.transform(F.col(column), lambda x: x[field]), lambda v: v.isNotNull()), F.array().cast("array<string>"))


def _elements(spark: SparkSession, path: str, tag: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The elements that parse, and (record, reason) of those that do not."""
    reader = spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "_").option("mode", "PERMISSIVE")
    raw = reader.option("columnNameOfCorruptRecord", "_corrupt").schema(schema + ", _corrupt string").load(path)
    first = F.col(raw.columns[0])  # Spark wants another column beside the corrupt text
    reason = F.when(first.isNull(), F.lit(f"{tag} does not parse")).otherwise(F.lit(f"{tag} parses in part"))
    broken = raw.filter("_corrupt IS NOT NULL").select(F.col("_corrupt").alias("record"), reason.alias("reason"))
    return raw.filter("_corrupt IS NULL").drop("_corrupt"), broken


def article_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(record, reason) of the articles that ``read_article_xml`` can't read."""
    return _elements(spark, path, "PubmedArticle", ARTICLE_SCHEMA)[1]


def feed_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(record, reason) of the entries that ``read_feed_xml`` can't read."""
    return _elements(spark, path, "entry", ENTRY_SCHEMA)[1]


def read_article_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row per article of bulk article XML; ``article_rejects`` gives those that do not parse."""
    return articles(_elements(spark, path, "PubmedArticle", ARTICLE_SCHEMA)[0])


def articles(raw: DataFrame) -> DataFrame:
    """Parsed article elements -> papers."""
    art = "MedlineCitation.Article"
    issued = f"{art}.Journal.JournalIssue.PubDate"
    ids = F.coalesce(F.col("PubmedData.ArticleIdList.ArticleId"), F.array().cast("array<struct<_IdType:string,_VALUE:string>>"))

    def last_id(kind: str) -> Column:
        return F.try_element_at(F.filter(ids, lambda x: (x["_IdType"] == kind) & x["_VALUE"].isNotNull()), F.lit(-1))["_VALUE"]

    affiliations = F.flatten(
        F.transform(F.col(f"{art}.AuthorList.Author"), lambda a: F.coalesce(a["AffiliationInfo"], F.array().cast("array<struct<Affiliation:string>>")))
    )
    keywords = F.flatten(F.transform(F.col("MedlineCitation.KeywordList"), lambda k: k["Keyword"]))
    return raw.select(
        F.coalesce(F.col("MedlineCitation.PMID._VALUE"), F.lit("")).alias("pmid"),
        F.trim(F.col(f"{art}.ArticleTitle")).alias("title"),
        join_abstract(F.transform(F.col(f"{art}.Abstract.AbstractText"), lambda p: F.struct(p["_Label"].alias("label"), p["_VALUE"].alias("text")))).alias("abstract"),
        author_names(F.transform(F.col(f"{art}.AuthorList.Author"), lambda a: F.struct(a["ForeName"].alias("first"), a["LastName"].alias("last")))).alias("authors"),
        F.col(f"{art}.Journal.Title").alias("journal"),
        partial_date(F.col(f"{issued}.Year"), F.col(f"{issued}.Month"), F.col(f"{issued}.Day")).alias("published"),
        last_id("doi").alias("doi"),
        last_id("pmc").alias("pmc_id"),
        F.coalesce(
            F.filter(F.transform(F.col("MedlineCitation.MeshHeadingList.MeshHeading"), lambda m: m["DescriptorName"]["_VALUE"]), lambda v: v.isNotNull()),
            F.array().cast("array<string>"),
        ).alias("mesh_terms"),
        F.coalesce(F.filter(F.transform(keywords, lambda k: k["_VALUE"]), lambda v: v.isNotNull()), F.array().cast("array<string>")).alias("keywords"),
        _texts(f"{art}.PublicationTypeList.PublicationType", "_VALUE").alias("publication_types"),
        F.get(F.filter(F.transform(affiliations, lambda x: x["Affiliation"]), lambda v: v.isNotNull()), F.lit(0)).alias("affiliation"),
        F.lower(F.get(F.col(f"{art}.Language"), F.lit(0))).alias("language"),
    )


ENTRY_SCHEMA = """
id string, title string, summary string, published string, updated string,
author array<struct<name: string>>, category array<struct<_term: string>>,
link array<struct<_href: string, _title: string>>, `arxiv:comment` string, `arxiv:journal_ref` string
"""


def read_feed_xml(spark: SparkSession, path: str, reference_labels: bool = False) -> DataFrame:
    """One row per ``entry`` of an Atom paper feed; ``feed_rejects`` gives those that do not parse."""
    return entries(_elements(spark, path, "entry", ENTRY_SCHEMA)[0], reference_labels)


def entries(raw: DataFrame, reference_labels: bool = False) -> DataFrame:
    """Parsed feed entries -> papers."""
    links = F.coalesce(F.col("link"), F.array().cast("array<struct<_href:string,_title:string>>"))

    def link(title: str) -> Column:
        return F.try_element_at(F.filter(links, lambda x: x["_title"] == title), F.lit(-1))["_href"]

    categories = _texts("category", "_term")
    return raw.select(
        clean_feed_id(F.element_at(F.split("id", "/"), F.lit(-1)), reference_labels).alias("id"),
        "title",
        _texts("author", "name").alias("authors"),
        F.col("summary").alias("abstract"),
        categories.alias("categories"),
        F.coalesce(F.get(categories, F.lit(0)), F.lit("")).alias("primary_category"),
        F.regexp_replace("published", "Z$", "").try_cast("timestamp_ntz").alias("published"),
        F.regexp_replace("updated", "Z$", "").try_cast("timestamp_ntz").alias("updated"),
        F.element_at(F.split(link("doi"), "/"), F.lit(-1)).alias("doi"),
        F.col("arxiv:journal_ref").alias("journal_ref"),
        F.coalesce(link("pdf"), F.lit("")).alias("pdf_url"),
        F.col("id").alias("entry_url"),
        F.col("arxiv:comment").alias("comment"),
    )


def read_document_dir(spark: SparkSession, folder: str, pattern: str = "*.txt", page_break: str = "\f") -> DataFrame:
    """One row per text file: filename, whole text and its pages (form feeds separate pages)."""
    files = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return files.select(
        F.col("_metadata.file_name").alias("filename"),
        F.col("value").alias("text"),
        F.split(F.col("value"), page_break).alias("pages"),
    )
