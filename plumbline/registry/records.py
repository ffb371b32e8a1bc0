"""Record-validation queries.

Customers are written as JSON records whose defects follow their data (segment,
balance, nation), so every keyword meets valid and invalid records.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import records as J
from plumbline.registry.base import load, r6, rounded, union


def json_customers(s, d):
    c = load(s, d, "customer")
    seg, nation, key = F.col("c_mktsegment"), F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")
    age = (
        F.when(seg == "MACHINERY", F.concat(F.lit('"'), nation, F.lit('"')))
        .when(seg == "HOUSEHOLD", F.concat(nation, F.lit(".0")))
        .when(seg == "FURNITURE", F.concat(nation, F.lit(".5")))
        .otherwise(nation)
    )
    name = F.when(seg == "BUILDING", F.lit("")).otherwise(F.concat(F.lit('"name":"'), F.col("c_name"), F.lit('",')))
    odd = F.when(F.col("c_acctbal") > 8000, F.lit(',7,true')).otherwise(F.lit(""))
    text = F.concat(
        F.lit("{"), name, F.lit('"age":'), age, F.lit(',"status":"'), seg, F.lit('","user":{"profile":{"age":'), F.floor("c_acctbal").cast("string"), F.lit('}},"tags":["x","'),
        key, F.lit('"'), odd, F.lit('],"scores":{"a":'), nation, F.lit(',"zed":'), F.floor(F.col("c_acctbal") / 100).cast("string"), F.lit(',"B7":-1}'),
        F.when(F.col("c_acctbal") < -900, F.lit("")).otherwise(F.lit("}")),
    )
    return c.select("c_custkey", text.alias("record"))


AGE = {"type": "integer", "minimum": 3, "maximum": 20}
SEGMENTS = ["AUTOMOBILE", "BUILDING", "HOUSEHOLD", "MACHINERY"]
SCHEMAS = {
    "schema_required": {"type": "object", "required": ["age", "name", "absent"][:2]},
    "schema_type": {"type": "object", "properties": {"age": {"type": "integer"}}},
    "schema_range": {"type": "object", "properties": {"age": {"minimum": 3, "maximum": 20}}},
    "schema_enum": {"type": "object", "properties": {"status": {"enum": SEGMENTS}}},
    "schema_nested": {
        "type": "object",
        "properties": {
            "user": {"type": "object", "properties": {"profile": {"type": "object", "required": ["age"], "properties": {"age": {"type": "number", "minimum": 0}}}}},
            "tags": {"type": "array", "items": {"type": "string"}},
            "scores": {"type": "object", "patternProperties": {"^[a-z]+$": {"type": "number", "minimum": 0, "maximum": 70}}},
        },
    },
    "validate_records": {
        "type": "object",
        "required": ["name"],
        "properties": {
            "age": AGE,
            "status": {"enum": SEGMENTS},
            "user": {"type": "object", "properties": {"profile": {"type": "object", "properties": {"age": {"minimum": 0}}}}},
            "tags": {"items": {"type": "string"}},
        },
    },
}


def validated(key):
    return lambda s, d: J.validate_records(json_customers(s, d), "record", SCHEMAS[key]).select("c_custkey", "valid", "error")


def replies(s, d):
    """Conversation turns as model replies: JSON inside prose, broken JSON, plain prose."""
    c = load(s, d, "conversations")
    body = F.concat(F.lit('{"id": "r'), F.col("conv_id").cast("string"), F.lit('", "size": '), F.length("text").cast("string"), F.lit(', "turns": ['),
                    F.array_join(F.array_repeat(F.lit("1"), (F.col("turn") % 4).cast("int")), ","), F.lit("]}"))
    reply = (
        F.when(F.col("role") == "user", F.concat(F.lit("Sure, here it is:\n"), body, F.lit("\nThat is all.")))
        .when(F.col("turn") % 3 == 0, F.concat(F.lit("{broken "), F.col("text"), F.lit("}")))
        .otherwise(F.col("text"))
    )
    return c.select("conv_id", "turn", F.col("role"), reply.alias("reply"))


REPLIES = """rp AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'Sure, here it is:' || chr(10) || '{"id": "r' || conv_id || '", "size": ' || length(text) || ', "turns": [' || array_to_string(list_transform(range(turn % 4), lambda x: '1'), ',') || ']}' || chr(10) || 'That is all.'
 WHEN turn % 3 = 0 THEN '{broken ' || text || '}' ELSE text END AS reply, role = 'user' AS ok, '{"id":"r' || conv_id || '","size":' || length(text) || ',"turns":[' || array_to_string(list_transform(range(turn % 4), lambda x: '1'), ',') || ']}' AS good FROM conversations)"""


def requests():
    return {
        "engineering_problems": {"domain": F.lit("civil"), "difficulty": F.col("turn") + 1, "constraints": F.lit("none")},
        "system_design": {"requirements": F.col("role"), "constraints": F.lit("none")},
        "conversation": {"domain": F.lit("sales"), "style": F.col("role")},
        "research_paper": {"field": F.lit("machine_learning"), "complexity": F.lit("expert")},
        "code": {"language": F.lit("go"), "problem_type": F.lit("utilities"), "difficulty": F.lit("easy")},
        "multimodal": {"use_case": F.lit("education"), "modalities": F.array(F.lit("text"), F.lit("code")), "alignment_quality": F.lit("high")},
    }


def fallbacks(s, d):
    c = load(s, d, "conversations")
    rows = F.array(
        *[F.struct(F.lit(k).alias("strategy"), F.to_json(J.fallback_record(k, F.col("turn") + 1, F.col("text"), r)).alias("record")) for k, r in requests().items()]
    )
    return c.select("conv_id", "turn", F.inline(rows)).withColumn("record", F.md5("record"))


def parsed(s, d, turns=None):
    out = J.parse_replies(replies(s, d), "conversation" if turns is not None else "engineering_problems", "reply", F.col("turn") + 1,
                          requests()["conversation" if turns is not None else "engineering_problems"], turns)
    return out.select("conv_id", "turn", "parsed", F.md5("record").alias("record"))


def parameters(s, d):
    n = F.col("o_orderkey")
    pick = lambda *xs: F.get(F.lit(list(xs)), (n % len(xs)).cast("int"))
    df = load(s, d, "orders").select("o_orderkey", pick("Sales", "MEDICAL", "warfare").alias("domain"), pick("formal", "Casual", "rude", None).alias("style"))
    return J.check_parameters(df, "conversation").select("o_orderkey", "valid", "error")


QUERIES = {
    **{k: validated(k) for k in ("validate_records", "schema_required", "schema_type", "schema_range", "schema_enum", "schema_nested")},
    "strategy_parameters": parameters,
    "validation_score": lambda s, d: rounded(J.validation_score(J.validate_records(json_customers(s, d), "record", SCHEMAS["validate_records"]))),
    "parse_llm_json": lambda s, d: parsed(s, d),
    "parse_llm_json_turns": lambda s, d: parsed(s, d, F.lit(2)),
    "check_turn_count": lambda s, d: J.check_turn_count(load(s, d, "conversations"), "conv_id", 6),
    "fallback_records": fallbacks,
}

Q = chr(39)
BROKEN = "WHEN c_acctbal < -900 THEN 'not valid JSON'"
_n = "CAST(c_nationkey AS VARCHAR)"
_at = lambda path, message: f"'Validation error at path ''{path}'': ' || {message}"
TYPE_ERROR = f"""WHEN c_mktsegment = 'MACHINERY' THEN {_at('age', f"'''' || {_n} || ''' is not of type ''integer'''")} WHEN c_mktsegment = 'FURNITURE' THEN {_at('age', f"{_n} || '.5 is not of type ''integer'''")}"""
_shown = f"CASE WHEN c_mktsegment = 'FURNITURE' THEN {_n} || '.5' ELSE {_n} END"
_value = "(c_nationkey + CASE WHEN c_mktsegment = 'FURNITURE' THEN 0.5 ELSE 0 END)"
RANGE_ERROR = f"""WHEN c_mktsegment <> 'MACHINERY' AND {_value} < 3 THEN {_at('age', f"{_shown} || ' is less than the minimum of 3'")} WHEN c_mktsegment <> 'MACHINERY' AND {_value} > 20 THEN {_at('age', f"{_shown} || ' is greater than the maximum of 20'")}"""
ENUM_ERROR = f"""WHEN c_mktsegment = 'FURNITURE' THEN {_at('status', "'''FURNITURE'' is not one of [''AUTOMOBILE'', ''BUILDING'', ''HOUSEHOLD'', ''MACHINERY'']'")}"""
NAME_ERROR = "WHEN c_mktsegment = 'BUILDING' THEN '''name'' is a required property'"
TAG_ERROR = f"""WHEN c_acctbal > 8000 THEN {_at('tags/2', "'7 is not of type ''string'''")}"""
PROFILE_ERROR = f"""WHEN floor(c_acctbal) < 0 THEN {_at('user/profile/age', "CAST(floor(c_acctbal) AS BIGINT) || ' is less than the minimum of 0'")}"""
_z = "CAST(floor(c_acctbal / 100) AS BIGINT)"
SCORE_ERROR = f"""WHEN {_z} < 0 THEN {_at('scores/zed', f"{_z} || ' is less than the minimum of 0'")} WHEN {_z} > 70 THEN {_at('scores/zed', f"{_z} || ' is greater than the maximum of 70'")}"""


def _check(*cases: str) -> str:
    return f"WITH e AS (SELECT c_custkey, CASE {BROKEN} {' '.join(cases)} END AS error FROM customer) SELECT c_custkey, error IS NULL AS valid, error FROM e"


def _text(e: str) -> str:
    return f"'\"' || replace(replace(replace(replace({e}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't') || '\"'"


def _eng(reply: str) -> str:
    return f"""'{{"id":"civil_' || (turn + 1) || '","problem_description":' || {_text(reply)} || ',"difficulty_level":' || (turn + 1) || ',"domain":"civil","expected_solution":"Error parsing generated content","metadata":{{"constraints_used":"none","error":"JSON parse error"}}}}'"""


def _conv(style: str) -> str:
    return f"""'{{"id":"conv_' || (turn + 1) || '","domain":"sales","style":"' || {style} || '","turns":[{{"speaker":"user","message":"Hello, I need help."}},{{"speaker":"assistant","message":"I''d be happy to help you. What can I assist you with today?"}}],"metadata":{{"topic":"general_inquiry","resolution":"unresolved","sentiment":"neutral","error":"JSON parse error"}}}}'"""


FALLBACK_SQL = union([f"SELECT conv_id, turn, '{k}' AS strategy, md5({e}) AS record FROM conversations" for k, e in {
    "engineering_problems": _eng("text"),
    "system_design": f"""'{{"id":"design_1","requirements":"' || role || '","constraints":"none","design_overview":' || {_text('text')} || ',"components":[],"interfaces":[],"metadata":{{"error":"JSON parse error"}}}}'""",
    "conversation": _conv("role"),
    "research_paper": f"""'{{"id":"paper_' || (turn + 1) || '","title":"Research in Machine Learning","authors":["AI Generated"],"abstract":' || {_text("CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END")} || ',"keywords":["machine_learning","research","analysis"],"field":"machine_learning","complexity":"expert","references":[],"metadata":{{"publication_year":2024,"journal":"Journal of Machine Learning","doi":"10.1000/generated.' || (turn + 1) || '","error":"JSON parse error"}}}}'""",
    "code": f"""'{{"id":"code_' || (turn + 1) || '","problem_description":"Generate a utilities solution in go","language":"go","problem_type":"utilities","difficulty":"easy","solution":' || {_text('text')} || ',"explanation":"Code generation response","time_complexity":"O(n)","space_complexity":"O(1)","example_usage":"See solution above","metadata":{{"lines_of_code":"unknown","error":"JSON parse error"}}}}'""",
    "multimodal": f"""'{{"id":"multimodal_' || (turn + 1) || '","use_case":"education","modalities":["text","code"],"alignment_quality":"high","content":' || {_text('text')} || ',"alignment_score":0.5,"semantic_relationships":["generated","content"],"metadata":{{"complexity":"medium","target_audience":"general","error":"JSON parse error"}}}}'""",
}.items()])

ORACLE = {
    "validate_records": _check(NAME_ERROR, TYPE_ERROR, RANGE_ERROR, ENUM_ERROR, TAG_ERROR, PROFILE_ERROR),
    "schema_required": _check(NAME_ERROR),
    "schema_type": _check(TYPE_ERROR),
    "schema_range": _check(RANGE_ERROR),
    "schema_enum": _check(ENUM_ERROR),
    "schema_nested": _check(TAG_ERROR, SCORE_ERROR, PROFILE_ERROR),
    "strategy_parameters": """WITH x AS (SELECT o_orderkey, ['Sales', 'MEDICAL', 'warfare'][o_orderkey % 3 + 1] AS domain, ['formal', 'Casual', 'rude', NULL][o_orderkey % 4 + 1] AS style FROM orders),
e AS (SELECT o_orderkey, CASE WHEN domain = 'warfare' THEN 'domain must be one of: customer_service, technical_support, casual, educational, sales, medical'
WHEN style = 'rude' OR style IS NULL THEN 'style must be one of: professional, casual, formal, friendly, technical' END AS error FROM x) SELECT o_orderkey, error IS NULL AS valid, error FROM e""",
    "validation_score": f"""WITH r AS ({_check(NAME_ERROR, TYPE_ERROR, RANGE_ERROR, ENUM_ERROR, TAG_ERROR, PROFILE_ERROR)}) SELECT count(*) FILTER (WHERE valid) AS valid_records, count(*) AS total_records, {r6('count(*) FILTER (WHERE valid) / count(*)')} AS validation_score FROM r""",
    "parse_llm_json": f"WITH {REPLIES} SELECT conv_id, turn, ok AS parsed, md5(CASE WHEN ok THEN good ELSE {_eng('reply')} END) AS record FROM rp",
    "parse_llm_json_turns": f"""WITH {REPLIES}, j AS (SELECT rp.*, CASE WHEN c.role = 'user' THEN 'user' ELSE c.role END AS role FROM rp JOIN conversations c USING (conv_id, turn))
SELECT conv_id, turn, ok AND turn % 4 = 2 AS parsed, md5(CASE WHEN ok AND turn % 4 = 2 THEN good ELSE {_conv('role')} END) AS record FROM j""",
    "check_turn_count": "SELECT conv_id, count(*) AS turns, count(*) = 6 AS valid FROM conversations GROUP BY conv_id",
    "fallback_records": FALLBACK_SQL,
}
