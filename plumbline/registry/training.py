"""Training-record queries over the documents as papers.  Long texts are compared by their md5."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import papers as fn
from plumbline.operators import papers as P
from plumbline.operators import prompts as R
from plumbline.operators import training as T
from plumbline.registry.base import load, union
from plumbline.registry.papers import LINES, PAGES, PAPERS, paged, paper_records
from plumbline.session import settle

TEXTS = ("answer", "output", "content", "response", "completion", "conversations", "body", "input", "question")


def hashed(df, *names):
    """The named (default: all usual) long texts replaced by their md5."""
    names = [n for n in (names or TEXTS) if n in df.columns]
    return df.withColumns({n: F.md5(F.col(n)) for n in names})


def documents(s, d):
    """Sections with the title and abstract of each paper; every seventh paper has no abstract."""
    with_text = P.with_sections(paged(s, d))
    docs = load(s, d, "documents").select("doc_id", "n_chars", "source")
    abstract = F.when(F.col("n_chars") % 7 != 0, F.concat(F.lit("Abstract of "), F.col("source"), F.lit(". It has two sentences. And a third")))
    title = F.when(F.col("n_chars") % 11 != 0, F.concat(F.lit("On "), F.col("source")))
    return with_text.join(docs, "doc_id").select("doc_id", title.alias("title"), abstract.alias("abstract"), "sections")


def segments(s, d):
    return T.training_segments(documents(s, d))


DOCUMENTS = f"""WITH {PAGES}, {LINES}, dc AS (SELECT doc_id, CASE WHEN n_chars % 11 <> 0 THEN 'On ' || source END AS title,
CASE WHEN n_chars % 7 <> 0 THEN 'Abstract of ' || source || '. It has two sentences. And a third' END AS abstract FROM documents),
seg AS (SELECT doc_id, 'abstract' AS segment_type, coalesce(title, 'Untitled') AS title, abstract AS content, NULL AS question, NULL AS answer, NULL AS section_type, CAST(NULL AS INTEGER) AS page_number, NULL AS paper_title FROM dc WHERE abstract IS NOT NULL
UNION ALL SELECT s.doc_id, 'section', s.title, s.content, NULL, NULL, s.section_type, s.page_number, dc.title FROM sec s JOIN dc USING (doc_id) WHERE length(trim(s.content)) > 100
UNION ALL SELECT s.doc_id, 'qa_pair', NULL, NULL, 'What are the key points in the ' || s.section_type || ' section?', s.content, s.section_type, NULL, dc.title
 FROM sec s JOIN dc USING (doc_id) WHERE s.section_type IN ('methods', 'results', 'discussion'))"""


def nested(s, d):
    docs = documents(s, d)
    parts = F.transform("sections", lambda x: F.struct(x["section_type"].alias("segment_type"), x["title"].alias("title"), x["content"].alias("content")))
    return docs.select(F.col("doc_id").alias("id"), "title", "abstract", parts.alias("segments"))


def turns_table(s, d):
    """One row per exchange: every user text with the assistant text of the next turn, null where there is none."""
    c = load(s, d, "conversations")
    asked = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("problem"))
    told = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("solution"))
    return asked.join(told, ["conv_id", "turn"], "left")


def prompts(s, d):
    o = load(s, d, "orders")
    n = F.col("o_orderkey")
    as_of = F.lit("2024-01-01")
    pick = lambda *xs: F.get(F.lit(list(xs)), (n % len(xs)).cast("int"))
    requests = {
        "engineering_problems": {"domain": pick("civil", "software"), "difficulty": n % 10 + 1, "constraints": F.when(n % 3 == 0, F.lit("No tools"))},
        "system_design": {"requirements": F.concat(F.lit("Handle "), F.col("o_orderpriority")), "constraints": F.concat(F.lit("Budget "), n.cast("string"))},
        "conversation": {"domain": pick("sales", "medical"), "style": pick("formal", "casual", "friendly"), "turns": n % 5 + 2, "number": n + 1, "as_of": as_of},
        "research_paper": {"field": pick("biology", "physics"), "paper_type": pick("abstract", "introduction", "full", "methodology", "results"), "complexity": pick("expert"), "number": n + 1, "as_of": as_of},
        "code": {"language": pick("go", "rust"), "problem_type": pick("algorithms"), "difficulty": pick("easy", "hard", "medium"), "include_tests": n % 2 == 0, "number": n + 1, "as_of": as_of},
        "multimodal": {"use_case": pick("education"), "alignment_quality": pick("high", "low"), "number": n + 1, "as_of": as_of,
                       "modalities": F.when(n % 2 == 0, F.array(F.lit("text"), F.lit("code"))).otherwise(F.array(F.lit("text"), F.lit("image_description"), F.lit("video_description")))},
    }
    rows = F.array(*[F.struct(F.lit(k).alias("strategy"), R.strategy_prompt(k, v).alias("prompt")) for k, v in requests.items()])
    return o.select("o_orderkey", F.inline(rows)).withColumn("prompt", F.md5("prompt"))


def _prompt_sql(strategy: str, slots: dict[str, str], optional: dict[str, str]) -> str:
    import re
    import textwrap

    text = textwrap.dedent(R.PROMPTS[strategy]).strip("\n").replace("'", "''")
    parts = []
    for piece in re.split(r"(<<\??\w+>>)", text):
        if piece.startswith("<<?"):
            line = R.OPTIONAL_LINES[piece[3:-2]].replace("'", "''")
            parts.append(f"CASE WHEN {optional[piece[3:-2]]} THEN chr(10) || '    {line}' ELSE '' END")
        elif piece.startswith("<<"):
            parts.append(f"coalesce(CAST({slots[piece[2:-2]]} AS VARCHAR), '')")
        elif piece:
            parts.append(f"'{piece}'")
    return f"SELECT o_orderkey, '{strategy}' AS strategy, md5({' || '.join(parts)}) AS prompt FROM orders"


def _pick(*xs: str) -> str:
    return f"[{', '.join(repr(x) for x in xs)}][o_orderkey % {len(xs)} + 1]"


_N = {"number": "o_orderkey + 1", "as_of": "'2024-01-01'"}
_KIND = _pick("abstract", "introduction", "full", "methodology", "results")
_MODS = "(CASE WHEN o_orderkey % 2 = 0 THEN ['text', 'code'] ELSE ['text', 'image_description', 'video_description'] END)"
PROMPT_SQL = union([
    _prompt_sql("engineering_problems", {"domain": _pick("civil", "software"), "difficulty": "o_orderkey % 10 + 1", "constraints": "CASE WHEN o_orderkey % 3 = 0 THEN 'No tools' END"}, {}),
    _prompt_sql("system_design", {"requirements": "'Handle ' || o_orderpriority", "constraints": "'Budget ' || o_orderkey"}, {}),
    _prompt_sql("conversation", {"domain": _pick("sales", "medical"), "style": _pick("formal", "casual", "friendly"), "turns": "o_orderkey % 5 + 2", **_N}, {}),
    _prompt_sql("research_paper", {"field": _pick("biology", "physics"), "paper_type": _KIND, "complexity": "'expert'", **_N},
                {"content": f"{_KIND} = 'full'", "introduction": f"{_KIND} IN ('introduction', 'full')", "methodology": f"{_KIND} IN ('methodology', 'full')", "results": f"{_KIND} IN ('results', 'full')"}),
    _prompt_sql("code", {"language": _pick("go", "rust"), "problem_type": "'algorithms'", "difficulty": _pick("easy", "hard", "medium"), **_N}, {"test_cases": "o_orderkey % 2 = 0"}),
    _prompt_sql("multimodal", {"use_case": "'education'", "alignment_quality": _pick("high", "low"), "modality_list": f"array_to_string({_MODS}, ', ')",
                               "modality_array": f"'[' || chr(39) || array_to_string({_MODS}, chr(39) || ', ' || chr(39)) || chr(39) || ']'", **_N},
                {m: f"list_contains({_MODS}, '{m}')" for m in ("text", "image_description", "audio_description", "video_description", "code")}),
])


FULL_TEXT = 100  # characters: what is shorter is a title or a note, such a paper is known by its abstract only


def paper_segments(s, d):
    """Full-text segments of all papers that have a text of their own, keyed like the paper records."""
    full = load(s, d, "documents").where(F.length("text") >= FULL_TEXT).select("doc_id")
    return segments(s, d).join(full, "doc_id", "left_semi").withColumnRenamed("doc_id", "id")


CATEGORIES = ["cs.AI", "cs.CL", "quant-ph"]


QUERIES = {
    "qa_pairs": lambda s, d: hashed(T.qa_pairs(paper_records(s, d)), "answer"),
    "summary_tasks": lambda s, d: hashed(T.summary_tasks(paper_records(s, d)), "output"),
    "explanation_tasks": lambda s, d: hashed(T.explanation_tasks(paper_records(s, d)), "output"),
    "abstract_segments": lambda s, d: hashed(T.abstract_segments(paper_records(s, d)).unionByName(T.abstract_segments(paper_records(s, d), style="feed")), "content", "answer").drop("page_number"),
    "training_segments": lambda s, d: hashed(segments(s, d), "content", "answer").drop("position"),
    "explode_segments": lambda s, d: T.explode_segments(nested(s, d)).select("id", "type", "source_paper", "segment_type", F.md5("content.content").alias("content")),
    "format_abstract": lambda s, d: hashed(_all_formats(T.format_abstract, s, d)),
    "format_section": lambda s, d: hashed(_all_formats(T.format_section, s, d)),
    "format_qa": lambda s, d: hashed(_all_formats(T.format_qa, s, d)),
    "format_segments": lambda s, d: hashed(T.format_segments(segments(s, d), "alpaca", ["doc_id"])).select("doc_id", "instruction", "input", "output"),
    "conversation_examples": lambda s, d: hashed(T.conversation_examples(paper_records(s, d)), "response").select("id", "conversation_type", "instruction", "response"),
    "synthetic_examples": lambda s, d: hashed(T.synthetic_examples(paper_records(s, d)), "output"),
    "chat_records": lambda s, d: hashed(T.chat_records(turns_table(s, d), "problem", "solution", "problem IS NOT NULL AND solution IS NOT NULL", ["conv_id", "turn"]), "line").select("conv_id", "turn", "line"),
    "render_prompt_text": lambda s, d: paper_records(s, d).select(
        "id", F.md5(T.render_prompt_text(F.concat(F.lit("Read "), F.col("domain")), F.col("title"), F.col("abstract"))).alias("text")),
    "render_strategy_prompts": prompts,
    "literature_records": lambda s, d: T.literature_counts(T.literature_records(nested(s, d))),
    "prepare_training_set": lambda s, d: T.prepare_training_set(segments(s, d).withColumnRenamed("doc_id", "id"), paper_records(s, d)).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length(F.coalesce("output", "response")).cast("long")).alias("chars")),
    "category_training_set": lambda s, d: T.category_training_set(paper_records(s, d), paper_segments(s, d), CATEGORIES, 90).groupBy("category", "segment_type").agg(
        F.count_distinct("id").alias("papers"), F.count(F.lit(1)).alias("segments")),
    "segments_or_abstract": lambda s, d: hashed(T.segments_or_abstract(paper_records(s, d), paper_segments(s, d)), "content", "answer").select("id", "segment_type", "content", "question", "answer"),
}


def _all_formats(fmt, s, d):
    cut = settle(segments(s, d))  # sectioning is the costly part, and each format reads it
    parts = [fmt(cut, f, ["doc_id"]).select(F.lit(f).alias("format"), "*") for f in T.FORMATS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _tasks_sql(tasks, kind, extra="") -> str:
    def e(text):
        out = "'" + text.replace("'", "''") + "'"
        for name, col in (("title", "title"), ("abstract", "abstract"), ("first", "lower(split_part(abstract, '.', 1))"), ("second", "CASE WHEN contains(abstract, '.') THEN split_part(abstract, '.', 2) ELSE 'empirical analysis' END")):
            out = out.replace("{" + name + "}", f"' || {col} || '")
        return out

    return union([f"SELECT id, '{kind}' AS type, title AS source_paper, {i} AS position, '{a}' AS instruction, {e(b)} AS input, md5({e(c)}) AS output FROM p WHERE title <> '' AND abstract <> ''" for i, (a, b, c) in enumerate(tasks)])


def _record_sql(source: str, where: str, forms: dict[str, dict[str, str]]) -> str:
    parts = []
    for f, fields in forms.items():
        cols = ", ".join((f"md5({fields[c]})" if c in TEXTS else fields[c]) + f" AS {c}" if c in fields else f"CAST(NULL AS VARCHAR) AS {c}" for c in T.RECORD_FIELDS)
        parts.append(f"SELECT '{f}' AS format, doc_id, {cols} FROM {source} WHERE {where}")
    return union(parts)


_body = "content"
_json = lambda e: f"'\"' || replace(replace(replace(replace({e}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't') || '\"'"
_abstract_forms = {
    "alpaca": {"instruction": f"'{T.ABSTRACT_TASK}'", "input": "'Title: ' || title", "output": "content"},
    "instruction": {"instruction": "'Provide a comprehensive abstract for the research paper titled: ' || title", "response": "content"},
    "completion": {"prompt": "'Research Paper Title: ' || title || chr(10) || chr(10) || 'Abstract: '", "completion": "content"},
}
_section_forms = {
    "alpaca": {"instruction": "'Explain the ' || section_type || ' section of this research paper.'", "input": "'Paper: ' || coalesce(paper_title, '') || chr(10) || 'Section: ' || title", "output": _body},
    "instruction": {"instruction": "'Describe the ' || section_type || ' of the research paper ''' || coalesce(paper_title, '') || ''''", "response": _body},
}
_qa_forms = {
    "alpaca": {"instruction": "question", "input": "''", "output": "answer"},
    "instruction": {"instruction": "question", "response": "answer"},
    "sharegpt": {"conversations": f"'[{{\"from\":\"human\",\"value\":' || {_json('question')} || '}},{{\"from\":\"gpt\",\"value\":' || {_json('answer')} || '}}]'"},
}
_is_section = "segment_type = 'section' AND length(content) >= 100"
_plain = lambda sql: sql.replace("SELECT 'alpaca' AS format, doc_id", "SELECT doc_id")
_alpaca = union([_record_sql("seg", w, {"alpaca": f["alpaca"]}) for w, f in (("segment_type = 'abstract'", _abstract_forms), (_is_section, _section_forms), ("segment_type = 'qa_pair'", _qa_forms))])
_full = f"seg2 AS (SELECT * FROM seg SEMI JOIN (SELECT doc_id FROM documents WHERE length(text) >= {FULL_TEXT}) USING (doc_id))"
_chosen = f"""ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id) AS k FROM (SELECT id, abstract, title, unnest(list_distinct(categories)) AS category FROM p) WHERE category IN ('cs.AI', 'cs.CL', 'quant-ph')) WHERE k <= 30)"""

ORACLE = {
    "qa_pairs": f"WITH {PAPERS} " + union([f"SELECT id, 'qa_training' AS type, title AS source_paper, {i} AS position, '" + q.replace("'", "''").replace("{title}", "' || title || '") + "' AS question, md5(abstract) AS answer FROM p WHERE title <> '' AND abstract <> ''" for i, q in enumerate(T.QA_QUESTIONS)]),
    "summary_tasks": f"WITH {PAPERS} {_tasks_sql(T.SUMMARY_TASKS, 'summary_training')}",
    "explanation_tasks": f"WITH {PAPERS} {_tasks_sql(T.EXPLANATION_TASKS, 'explanation_training')}",
    "abstract_segments": f"""WITH {PAPERS} SELECT id, 'abstract' AS segment_type, title, md5(abstract) AS content, NULL::VARCHAR AS question, NULL::VARCHAR AS answer, NULL::VARCHAR AS section_type, NULL::VARCHAR AS paper_title FROM p WHERE abstract <> ''
UNION ALL SELECT id, 'qa_pair', NULL, NULL, 'What is the main finding of the study titled ''' || title || '''?', md5(abstract), NULL, NULL FROM p WHERE abstract <> ''
UNION ALL SELECT id, 'abstract_summary', NULL, NULL, 'Summarize this research paper: ' || title, md5(abstract), NULL, NULL FROM p WHERE abstract <> ''""",
    "training_segments": f"{DOCUMENTS} SELECT doc_id, segment_type, title, md5(content) AS content, question, md5(answer) AS answer, section_type, page_number, paper_title FROM seg",
    "explode_segments": f"{DOCUMENTS} SELECT s.doc_id AS id, 'training_segment' AS type, dc.title AS source_paper, s.section_type AS segment_type, md5(s.content) AS content FROM sec s JOIN dc USING (doc_id) WHERE dc.title <> '' AND dc.abstract <> ''",
    "format_abstract": f"{DOCUMENTS} {_record_sql('seg', chr(39).join(['segment_type = ', 'abstract', '']), _abstract_forms)}",
    "format_section": f"{DOCUMENTS} {_record_sql('seg', _is_section, _section_forms)}",
    "format_qa": f"{DOCUMENTS} {_record_sql('seg', chr(39).join(['segment_type = ', 'qa_pair', '']), _qa_forms)}",
    "format_segments": f"{DOCUMENTS}, r AS ({_alpaca}) SELECT doc_id, instruction, input, output FROM r",
    "conversation_examples": f"""WITH {PAPERS}, u AS (SELECT *, array_to_string(authors[1:3], ', ') AS au FROM p WHERE title <> '' AND abstract <> '')
SELECT id, 'summary' AS conversation_type, 'Can you summarize the paper ''' || title || ''' by ' || au || '?' AS instruction, md5('This paper presents ' || abstract) AS response FROM u
UNION ALL SELECT id, 'explanation', 'What is the main contribution of ''' || title || '''?', md5(abstract) FROM u
UNION ALL SELECT id, 'analysis', 'What are the key insights from this research: ' || title || '?', md5('The key insights from this research include: ' || abstract) FROM u""",
    "synthetic_examples": f"WITH {PAPERS}, t AS ({_tasks_sql(T.SYNTHETIC_TASKS, 'synthetic')}) SELECT id, position, instruction, input, output FROM t",
    "chat_records": f"""WITH t AS (SELECT u.conv_id, u.turn, u.text AS q, a.text AS a FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')
SELECT conv_id, turn, md5('{{"messages":[{{"role":"system","content":"You are a helpful assistant."}},{{"role":"user","content":' || {_json('q')} || '}},{{"role":"assistant","content":' || {_json('a')} || '}}]}}') AS line FROM t WHERE q IS NOT NULL AND a IS NOT NULL""",
    "render_prompt_text": f"""WITH {PAPERS} SELECT id, md5('### Instruction:' || chr(10) || 'Read ' || domain || CASE WHEN title <> '' THEN chr(10) || chr(10) || '### Input:' || chr(10) || title ELSE '' END || chr(10) || chr(10) || '### Response:' || chr(10) || abstract) AS text FROM p""",
    "render_strategy_prompts": PROMPT_SQL,
    "literature_records": f"""{DOCUMENTS}, ok AS (SELECT doc_id FROM dc WHERE title <> '' AND abstract <> '')
SELECT 'qa_training' AS type, 4 * count(*) AS n FROM ok UNION ALL SELECT 'summary_training', 2 * count(*) FROM ok UNION ALL SELECT 'explanation_training', 2 * count(*) FROM ok
UNION ALL SELECT 'training_segment', count(*) FROM sec JOIN ok USING (doc_id)""",
    "prepare_training_set": f"""{DOCUMENTS}, {PAPERS}, u AS (SELECT * FROM p WHERE title <> '' AND abstract <> ''), y AS ({_tasks_sql(T.SYNTHETIC_TASKS, 'synthetic').replace('md5(', '(')})
SELECT 'segment' AS part, count(*) AS n, CAST(sum(length(CASE segment_type WHEN 'qa_pair' THEN answer WHEN 'section' THEN {_body} ELSE content END)) AS BIGINT) AS chars FROM seg
UNION ALL SELECT 'conversation', 3 * count(*), CAST(sum(3 * length(abstract) + length('This paper presents ') + length('The key insights from this research include: ')) AS BIGINT) FROM u
UNION ALL SELECT 'synthetic', count(*), CAST(sum(length(output)) AS BIGINT) FROM y""",
    "category_training_set": f"""{DOCUMENTS}, {PAPERS}, {_full}, {_chosen}, a AS (SELECT category, 'abstract_summary' AS segment_type, id FROM ch WHERE abstract <> '' UNION ALL SELECT category, segment_type, id FROM ch JOIN seg2 ON seg2.doc_id = ch.id)
SELECT category, segment_type, count(DISTINCT id) AS papers, count(*) AS segments FROM a GROUP BY ALL""",
    "segments_or_abstract": f"""{DOCUMENTS}, {PAPERS}, {_full}, rest AS (SELECT * FROM p WHERE abstract <> '' AND id NOT IN (SELECT doc_id FROM seg2))
SELECT doc_id AS id, segment_type, md5(content) AS content, question, md5(answer) AS answer FROM seg2 UNION ALL SELECT id, 'abstract', md5(abstract), NULL, NULL FROM rest
UNION ALL SELECT id, 'qa_pair', NULL, 'What is the main finding of the study titled ''' || title || '''?', md5(abstract) FROM rest""",
}
