"""Papers, segments and tables to training records.  All of it is row-local: one generator per paper or segment."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.papers import blank
from plumbline.operators.ranks import top_per_group
from plumbline.session import quoted

# Length limits.
SHORTEST_SECTION = 100
LONGEST_SECTION = 1500
LONGEST_ANSWER = 1000

# Fixed texts of the record formats; {title}, {abstract}, ... are filled per paper or segment.
QA_QUESTIONS = [
    "What is the main contribution of the paper '{title}'?",
    "Summarize the research described in '{title}'.",
    "What problem does this paper address: {title}?",
    "What are the key findings of this research?",
]
SUMMARY_TASKS = [
    ("Provide a concise summary of this research paper.", "Title: {title}", "{abstract}"),
    ("Create an executive summary for this scientific paper.", "Research: {title}", "This research paper presents: {abstract}"),
]
EXPLANATION_TASKS = [
    ("Explain the methodology used in this research.", "Paper: {title}", "The methodology involves: {abstract}"),
    ("What are the implications of this research?", "Study: {title}", "The implications include: {abstract}"),
]
SYNTHETIC_TASKS = [
    ("Generate a research question that this paper might address.", "Title: {title}", "How can we {first}?"),
    ("What methodology would be appropriate for this research?", "Research topic: {title}", "Based on the abstract, this research uses {second}."),
    ("Identify the key contributions of this research.", "Paper: {title}", "The key contributions include: {abstract}"),
]
NO_SECOND_SENTENCE = "empirical analysis"
CONVERSATIONS = {
    "summary": ("Can you summarize the paper '{title}' by {authors}?", "This paper presents {abstract}"),
    "explanation": ("What is the main contribution of '{title}'?", "{abstract}"),
    "analysis": ("What are the key insights from this research: {title}?", "The key insights from this research include: {abstract}"),
}
ABSTRACT_TASK = "Summarize the key findings and contributions of this research paper."
ABSTRACT_INPUT = "Title: {title}"
ABSTRACT_REQUEST = "Provide a comprehensive abstract for the research paper titled: {title}"
ABSTRACT_PROMPT = "Research Paper Title: {title}\n\nAbstract: "
SECTION_TASK = "Explain the {section_type} section of this research paper."
SECTION_INPUT = "Paper: {paper_title}\nSection: {title}"
SECTION_REQUEST = "Describe the {section_type} of the research paper '{paper_title}'"
SECTION_QUESTION = "What are the key points in the {section_type} section?"
FINDING_QUESTION = "What is the main finding of the study titled '{title}'?"
SUMMARIZE_INPUT = "Summarize this research paper: {title}"
SYSTEM_MESSAGE = "You are a helpful assistant."
QUESTION_SECTIONS = ["methods", "results", "discussion"]
FORMATS = ("alpaca", "instruction", "completion", "sharegpt")


def fill(text: str, **values: Column) -> Column:
    """A fixed text with its ``{name}`` slots replaced by columns."""
    import string

    parts = []
    for literal, name, _, _ in string.Formatter().parse(text):
        if literal:
            parts.append(F.lit(literal))
        if name:
            parts.append(values[name])
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def or_empty(name: str) -> Column:
    return F.coalesce(F.col(quoted(name)), F.lit(""))


def usable(papers: DataFrame) -> DataFrame:
    """Papers with a title and an abstract."""
    return papers.where("title <> '' AND abstract <> ''")


def _tasks(papers: DataFrame, key: str, tasks: list[tuple[str, str, str]], kind: str, **extra: Column) -> DataFrame:
    values = {"title": F.col("title"), "abstract": F.col("abstract"), **extra}
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(a).alias("instruction"), fill(b, **values).alias("input"), fill(c, **values).alias("output"))
        for i, (a, b, c) in enumerate(tasks)
    ]
    return usable(papers).select(F.col(quoted(key)), F.lit(kind).alias("type"), F.col("title").alias("source_paper"), F.inline(F.array(*rows)))


def qa_pairs(papers: DataFrame, key: str = "id") -> DataFrame:
    rows = [
        F.struct(F.lit(i).alias("position"), fill(q, title=F.col("title")).alias("question"), F.col("abstract").alias("answer"))
        for i, q in enumerate(QA_QUESTIONS)
    ]
    return usable(papers).select(
        F.col(quoted(key)), F.lit("qa_training").alias("type"), F.col("title").alias("source_paper"), F.inline(F.array(*rows))
    )


def summary_tasks(papers: DataFrame, key: str = "id") -> DataFrame:
    return _tasks(papers, key, SUMMARY_TASKS, "summary_training")


def explanation_tasks(papers: DataFrame, key: str = "id") -> DataFrame:
    return _tasks(papers, key, EXPLANATION_TASKS, "explanation_training")


def synthetic_examples(papers: DataFrame, key: str = "id", limit: int | None = None) -> DataFrame:
    """Three derived prompts per paper from its first two sentences; with a limit the first overall by key."""
    sentences = F.split("abstract", r"\.")
    second = F.when(F.contains(F.col("abstract"), F.lit(".")), F.get(sentences, F.lit(1))).otherwise(F.lit(NO_SECOND_SENTENCE))
    made = _tasks(papers, key, SYNTHETIC_TASKS, "synthetic", first=F.lower(F.get(sentences, F.lit(0))), second=second)
    made = made.drop("type", "source_paper")
    return made if limit is None else made.orderBy(F.col(quoted(key)), F.col("position")).limit(limit)


SEGMENT_FIELDS = ["segment_type", "title", "content", "question", "answer", "section_type", "page_number", "paper_title"]


def _segment(segment_type: str, **fields: Column) -> Column:
    none = F.lit(None).cast("string")
    kinds = {"page_number": F.lit(None).cast("int")}
    values = {"segment_type": F.lit(segment_type), **fields}
    return F.struct(*[values.get(f, kinds.get(f, none)).alias(f) for f in SEGMENT_FIELDS])


def abstract_segments(papers: DataFrame, key: str = "id", style: str = "article") -> DataFrame:
    """Segments from the abstract alone.

    ``article``: the abstract and a question on its finding; ``feed``: a summary
    task (input in ``question``, output in ``answer``); ``plain``: the abstract.
    """
    abstract = _segment("abstract", title=or_empty("title"), content=F.col("abstract"))
    finding = _segment("qa_pair", question=fill(FINDING_QUESTION, title=or_empty("title")), answer=F.col("abstract"))
    summary = _segment("abstract_summary", question=fill(SUMMARIZE_INPUT, title=or_empty("title")), answer=F.col("abstract"))
    parts = {"article": [abstract, finding], "feed": [summary], "plain": [abstract]}[style]
    return papers.where("abstract <> ''").select(F.col(quoted(key)), F.inline(F.array(*parts)))


def _shortened(text: Column, longest: int | None) -> Column:
    if longest is None:
        return text
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("..."))).otherwise(text)


def training_segments(documents: DataFrame, key: str = "doc_id", longest_answer: int | None = None) -> DataFrame:
    """Abstract, every section of more than 100 characters, a question per methods / results / discussion section.

    ``documents`` has (key, title, abstract, sections).  Answers are whole unless ``longest_answer`` is given, such as
    ``LONGEST_ANSWER``.
    """
    untitled = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Untitled"))
    first = F.when(
        F.coalesce(F.col("abstract"), F.lit("")) != "", F.array(_segment("abstract", title=untitled, content=F.col("abstract")))
    ).otherwise(F.filter(F.array(_segment("abstract")), lambda s: F.lit(False)))

    def as_section(s: Column) -> Column:
        return _segment(
            "section", title=s["title"], content=s["content"], section_type=s["section_type"], page_number=s["page_number"], paper_title=F.col("title")
        )

    def as_question(s: Column) -> Column:
        body = s["content"]
        answer = _shortened(body, longest_answer)
        return _segment(
            "qa_pair", question=fill(SECTION_QUESTION, section_type=s["section_type"]), answer=answer, section_type=s["section_type"], paper_title=F.col("title")
        )

    long = F.filter("sections", lambda s: F.length(F.trim(s["content"])) > SHORTEST_SECTION)
    asked = F.filter("sections", lambda s: s["section_type"].isin(QUESTION_SECTIONS))
    every = F.concat(first, F.transform(long, as_section), F.transform(asked, as_question))
    # the outer form keeps the planner from building the array a second time to test its size
    rows = documents.select(F.col(quoted(key)), F.posexplode_outer(every).alias("position", "s")).where("s is not null")
    return rows.select(quoted(key), "position", "s.*")


def explode_segments(papers: DataFrame, segments: str = "segments", key: str = "id") -> DataFrame:
    """Nested segments of each usable paper as rows with the paper's title."""
    return usable(papers).select(
        F.col(quoted(key)), F.lit("training_segment").alias("type"), F.col("title").alias("source_paper"), F.explode(F.col(quoted(segments))).alias("content")
    ).withColumn("segment_type", F.coalesce(F.col("content.segment_type"), F.lit("")))


RECORD_FIELDS = ["instruction", "input", "output", "response", "prompt", "completion", "conversations"]


def _record(**fields: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(*[fields.get(f, none).alias(f) for f in RECORD_FIELDS])


def _turns(question: Column, answer: Column) -> Column:
    """The two turns as JSON text."""
    said = lambda who, what: F.struct(F.lit(who).alias("from"), what.alias("value"))
    return F.to_json(F.array(said("human", question), said("gpt", answer)))


def check_format(name: str) -> None:
    if name not in FORMATS:
        raise ValueError(f"unknown record format: {name}")


def _abstract_record(format_type: str) -> tuple[Column, Column | None]:
    title = or_empty("title")
    record = {
        "alpaca": _record(instruction=F.lit(ABSTRACT_TASK), input=fill(ABSTRACT_INPUT, title=title), output=F.col("content")),
        "instruction": _record(instruction=fill(ABSTRACT_REQUEST, title=title), response=F.col("content")),
        "completion": _record(prompt=fill(ABSTRACT_PROMPT, title=title), completion=F.col("content")),
    }.get(format_type)
    return (F.col("segment_type") == "abstract") & (F.col("content") != ""), record


def _section_record(format_type: str, longest: int | None = None) -> tuple[Column, Column | None]:
    body = _shortened(F.col("content"), longest)
    slots = {"section_type": F.coalesce("section_type", F.lit("content")), "paper_title": or_empty("paper_title"), "title": or_empty("title")}
    record = {
        "alpaca": _record(instruction=fill(SECTION_TASK, **slots), input=fill(SECTION_INPUT, **slots), output=body),
        "instruction": _record(instruction=fill(SECTION_REQUEST, **slots), response=body),
    }.get(format_type)
    return (F.col("segment_type") == "section") & (F.length("content") >= SHORTEST_SECTION), record


def _qa_record(format_type: str) -> tuple[Column, Column | None]:
    q, a = F.col("question"), F.col("answer")
    record = {
        "alpaca": _record(instruction=q, input=F.lit(""), output=a),
        "instruction": _record(instruction=q, response=a),
        "sharegpt": _record(conversations=_turns(q, a)),
    }.get(format_type)
    return (F.col("segment_type") == "qa_pair") & (q != "") & (a != ""), record


def _formatted(segments: DataFrame, format_type: str, keys, *kinds) -> DataFrame:
    """One pass: every segment in its kind's form; kinds without a form, and empty segments, are left out."""
    check_format(format_type)
    keys = [F.col(quoted(k)) for k in keys]
    forms = [(test, record) for test, record in (kind(format_type) for kind in kinds) if record is not None]
    if not forms:
        return segments.where(F.lit(False)).select(*keys, _record().alias("r")).select(*keys, "r.*")
    chosen = F.coalesce(*[F.when(test, record) for test, record in forms])
    return segments.select(*keys, chosen.alias("r")).where("r is not null").select(*keys, "r.*")


def format_abstract(segments: DataFrame, format_type: str = "alpaca", keys: list[str] = ()) -> DataFrame:
    return _formatted(segments, format_type, keys, _abstract_record)


def format_section(segments: DataFrame, format_type: str = "alpaca", keys: list[str] = (), longest: int | None = None) -> DataFrame:
    """Sections are whole unless ``longest`` is given, such as ``LONGEST_SECTION``."""
    return _formatted(segments, format_type, keys, functools.partial(_section_record, longest=longest))


def format_qa(segments: DataFrame, format_type: str = "alpaca", keys: list[str] = ()) -> DataFrame:
    return _formatted(segments, format_type, keys, _qa_record)


def format_segments(segments: DataFrame, format_type: str = "alpaca", keys: list[str] = (), longest: int | None = None) -> DataFrame:
    return _formatted(segments, format_type, keys, _abstract_record, functools.partial(_section_record, longest=longest), _qa_record)


def conversation_examples(papers: DataFrame, types: list[str] | None = None, format_type: str = "alpaca", key: str = "id") -> DataFrame:
    """One exchange per paper and type; types without a form yield nothing."""
    check_format(format_type)
    types = ["summary", "explanation", "analysis", "comparison"] if types is None else types
    authors = F.array_join(F.slice(F.coalesce(F.col("authors"), F.array().cast("array<string>")), 1, 3), ", ")
    slots = {"title": F.col("title"), "abstract": F.col("abstract"), "authors": authors}
    rows = []
    for t in types:
        if t in CONVERSATIONS:
            q, a = (fill(x, **slots) for x in CONVERSATIONS[t])
            record = _record(conversations=_turns(q, a)) if format_type == "sharegpt" else _record(instruction=q, response=a)
            rows.append(F.struct(F.lit(t).alias("conversation_type"), record.alias("r")))
    if not rows:
        raise ValueError("no conversation type has a form")
    return usable(papers).select(F.col(quoted(key)), F.inline(F.array(*rows))).select(quoted(key), "conversation_type", "r.*")


def chat_records(df: DataFrame, prompt: str = "problem_description", completion: str = "expected_solution", where: str | None = None, keys: list[str] = ()) -> DataFrame:
    """system / user / assistant messages as one JSON line per row."""
    missing = [c for c in (prompt, completion) if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}; available: {df.columns}")
    kept = df.filter(where) if where else df
    if kept.isEmpty():
        raise ValueError("no rows to turn into chat records")
    said = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    messages = F.array(said("system", F.lit(SYSTEM_MESSAGE)), said("user", F.col(quoted(prompt)).cast("string")), said("assistant", F.col(quoted(completion)).cast("string")))
    line = F.to_json(F.struct(messages.alias("messages")), {"ignoreNullFields": "false"})
    return kept.select(*[F.col(quoted(k)) for k in keys], line.alias("line"))


def render_prompt_text(instruction: Column, given: Column, output: Column) -> Column:
    """Instruction, optional input and response under their headings."""
    head = F.concat(F.lit("### Instruction:\n"), instruction)
    tail = F.concat(F.lit("\n\n### Response:\n"), output)
    return F.when(blank_input(given), F.concat(head, tail)).otherwise(F.concat(head, F.lit("\n\n### Input:\n"), given, tail))


def blank_input(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def literature_records(papers: DataFrame, key: str = "id", segments: str | None = "segments") -> DataFrame:
    """Questions, summaries, explanations and nested segments of each paper in one pass, as (key, type, position, body)."""
    slots = {"title": F.col("title"), "abstract": F.col("abstract")}
    entry = lambda kind, i, body: F.struct(F.lit(kind).alias("type"), F.lit(i).alias("position"), F.to_json(body).alias("body"))
    made = [
        entry("qa_training", i, F.struct(fill(q, **slots).alias("question"), F.col("abstract").alias("answer"))) for i, q in enumerate(QA_QUESTIONS)
    ]
    for kind, tasks in (("summary_training", SUMMARY_TASKS), ("explanation_training", EXPLANATION_TASKS)):
        made += [
            entry(kind, i, F.struct(F.lit(a).alias("instruction"), fill(b, **slots).alias("input"), fill(c, **slots).alias("output")))
            for i, (a, b, c) in enumerate(tasks)
        ]
    every = F.array(*made)
    if segments:
        nested = F.transform(
            F.col(quoted(segments)), lambda x, i: F.struct(F.lit("training_segment").alias("type"), i.alias("position"), F.to_json(x).alias("body"))
        )
        every = F.when(F.col(quoted(segments)).isNull(), every).otherwise(F.concat(every, nested))
    return usable(papers).select(F.col(quoted(key)), F.inline_outer(every))


def literature_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def prepare_training_set(segments: DataFrame, papers: DataFrame, format_type: str = "alpaca", key: str = "id", limit: int | None = None) -> DataFrame:
    """Formatted segments, then conversations, then derived prompts (with a limit the first by key)."""
    a = format_segments(segments, format_type, [key]).withColumn("part", F.lit("segment"))
    b = conversation_examples(papers, None, format_type, key).drop("conversation_type").withColumn("part", F.lit("conversation"))
    c = synthetic_examples(papers, key, limit).drop("position").withColumn("part", F.lit("synthetic"))
    return a.unionByName(b).unionByName(c, allowMissingColumns=True)


def category_papers(papers: DataFrame, categories: list[str], max_papers: int, key: str = "id") -> DataFrame:
    """Per category its first ``max_papers // categories`` papers by key; a paper may come under several."""
    quota = max_papers // len(categories)
    wanted = F.filter(F.array_distinct("categories"), lambda c: c.isin(list(categories)))
    each = papers.select("*", F.explode(wanted).alias("category"))
    return top_per_group(each, ["category"], [F.col(quoted(key))], quota, key).drop("place")


def category_training_set(papers: DataFrame, full_text: DataFrame, categories: list[str], max_papers: int, key: str = "id", style: str = "feed") -> DataFrame:
    """Abstract and full-text segments of the chosen papers: (category, key, segment fields)."""
    chosen = category_papers(papers, categories, max_papers, key)
    fields = [F.col(c) for c in SEGMENT_FIELDS]
    own = abstract_segments(chosen.withColumn("_k", F.struct(quoted(key), "category")), "_k", style).select(
        "_k.category", F.col(f"_k.{quoted(key)}").alias(key), *fields
    )
    texts = chosen.select("category", quoted(key)).join(full_text, key).select("category", quoted(key), *fields)
    return own.unionByName(texts)


def segments_or_abstract(papers: DataFrame, full_text: DataFrame, key: str = "id", style: str = "article") -> DataFrame:
    """Full-text segments where a paper has any, otherwise the segments of its abstract."""
    known = full_text.select(F.col(quoted(key))).distinct()
    rest = abstract_segments(papers.join(known, key, "left_anti"), key, style)
    return full_text.select(quoted(key), *SEGMENT_FIELDS).unionByName(rest.select(quoted(key), *SEGMENT_FIELDS))
