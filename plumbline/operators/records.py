"""Record validation against JSON schemas, model replies to records, fallback records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.jsonschema import first_error, with_errors
from plumbline.operators.profile import share
from plumbline.session import quoted

NOT_JSON = "not valid JSON"

# The allowed parameter values of each generation strategy (compared in lower case).
STRATEGY_DOMAINS = {
    "engineering_problems": {"domain": ["mechanical", "electrical", "civil", "chemical", "software", "aerospace"]},
    "conversation": {
        "domain": ["customer_service", "technical_support", "casual", "educational", "sales", "medical"],
        "style": ["professional", "casual", "formal", "friendly", "technical"],
    },
    "research_paper": {
        "field": ["machine_learning", "computer_science", "biology", "physics", "chemistry", "mathematics", "engineering",
                  "medicine", "psychology", "economics"],
        "paper_type": ["abstract", "introduction", "full", "methodology", "results"],
        "complexity": ["beginner", "intermediate", "advanced", "expert"],
    },
    "code": {
        "language": ["python", "javascript", "java", "cpp", "c", "go", "rust", "typescript", "swift", "kotlin", "ruby", "php", "scala"],
        "problem_type": ["algorithms", "data_structures", "web_development", "machine_learning", "system_design", "database",
                         "api_development", "utilities"],
        "difficulty": ["easy", "medium", "hard", "expert"],
    },
    "multimodal": {
        "use_case": ["content_creation", "education", "entertainment", "research", "accessibility", "translation", "summarization"],
    },
}
MODALITIES = ["text", "image_description", "audio_description", "video_description", "code"]


def validate_records(df: DataFrame, column: str, schema: dict) -> DataFrame:
    """The rows with ``valid`` and ``error`` (null when valid); the text is parsed once per row."""
    parsed = df.withColumn("_value", F.try_parse_json(F.col(quoted(column))))
    checked = with_errors(parsed, "_value", schema, "_errors")
    error = F.when(F.col("_value").isNull(), F.lit(NOT_JSON)).otherwise(first_error(F.col("_errors")))
    return checked.withColumn("error", error).drop("_value", "_errors").withColumn("valid", F.col("error").isNull())


def validate_table(df: DataFrame, schema: dict) -> DataFrame:
    """Typed rows checked against the same schemas."""
    typed = df.withColumn("_value", F.to_variant_object(F.struct(*[F.col(quoted(c)) for c in df.columns])))
    checked = with_errors(typed, "_value", schema, "_errors").withColumn("error", first_error(F.col("_errors")))
    return checked.drop("_value", "_errors").withColumn("valid", F.col("error").isNull())


def validation_score(checked: DataFrame) -> DataFrame:
    """valid, total, score; the errors themselves stay rows (``checked.where('not valid')``)."""
    return checked.agg(F.count_if("valid").alias("valid_records"), F.count(F.lit(1)).alias("total_records")).withColumn(
        "validation_score", share(F.col("valid_records"), F.col("total_records"))
    )


def allowed_value(value: Column, allowed: list[str]) -> Column:
    return F.lower(value).isin(allowed)


def check_parameters(df: DataFrame, strategy: str) -> DataFrame:
    """Request rows with ``valid`` and the first parameter outside its allowed values."""
    wrong = F.lit(None).cast("string")
    for name, allowed in reversed(STRATEGY_DOMAINS[strategy].items()):
        bad = ~F.coalesce(allowed_value(F.col(quoted(name)), allowed), F.lit(False))
        wrong = F.when(bad, F.lit(f"{name} must be one of: {', '.join(allowed)}")).otherwise(wrong)
    return df.withColumn("error", wrong).withColumn("valid", F.col("error").isNull())


def reply_json(reply: Column) -> Column:
    """Text from the first ``{`` to the last ``}`` as a VARIANT; null when there is none or it does not parse."""
    return F.try_parse_json(F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit("")))


def title_words(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


# Fixed texts and values of the fallback records.
PARSE_ERROR = "JSON parse error"


def fallback_record(strategy: str, number: Column, reply: Column, request: dict[str, Column]) -> Column:
    """The default record of a strategy as a struct; ``number`` counts requests from 1."""
    n = number.cast("string")
    error = F.struct(F.lit(PARSE_ERROR).alias("error"))
    lit = F.lit
    if strategy == "engineering_problems":
        return F.struct(
            F.concat(request["domain"], lit("_"), n).alias("id"), reply.alias("problem_description"), request["difficulty"].alias("difficulty_level"),
            request["domain"].alias("domain"), lit("Error parsing generated content").alias("expected_solution"),
            F.struct(request["constraints"].alias("constraints_used"), lit(PARSE_ERROR).alias("error")).alias("metadata"),
        )
    if strategy == "system_design":
        return F.struct(
            lit("design_1").alias("id"), request["requirements"].alias("requirements"), request["constraints"].alias("constraints"), reply.alias("design_overview"),
            F.array().cast("array<string>").alias("components"), F.array().cast("array<string>").alias("interfaces"), error.alias("metadata"),
        )
    if strategy == "conversation":
        turn = lambda who, what: F.struct(lit(who).alias("speaker"), lit(what).alias("message"))
        return F.struct(
            F.concat(lit("conv_"), n).alias("id"), request["domain"].alias("domain"), request["style"].alias("style"),
            F.array(turn("user", "Hello, I need help."), turn("assistant", "I'd be happy to help you. What can I assist you with today?")).alias("turns"),
            F.struct(lit("general_inquiry").alias("topic"), lit("unresolved").alias("resolution"), lit("neutral").alias("sentiment"), lit(PARSE_ERROR).alias("error")).alias("metadata"),
        )
    if strategy == "research_paper":
        field = request["field"]
        abstract = F.when(F.length(reply) > 500, F.concat(F.substring(reply, 1, 500), lit("..."))).otherwise(reply)
        return F.struct(
            F.concat(lit("paper_"), n).alias("id"), F.concat(lit("Research in "), title_words(field)).alias("title"), F.array(lit("AI Generated")).alias("authors"),
            abstract.alias("abstract"), F.array(field, lit("research"), lit("analysis")).alias("keywords"), field.alias("field"), request["complexity"].alias("complexity"),
            F.array().cast("array<string>").alias("references"),
            F.struct(lit(2024).alias("publication_year"), F.concat(lit("Journal of "), title_words(field)).alias("journal"),
                     F.concat(lit("10.1000/generated."), n).alias("doi"), lit(PARSE_ERROR).alias("error")).alias("metadata"),
        )
    if strategy == "code":
        problem = F.concat(lit("Generate a "), request["problem_type"], lit(" solution in "), request["language"])
        return F.struct(
            F.concat(lit("code_"), n).alias("id"), problem.alias("problem_description"), request["language"].alias("language"), request["problem_type"].alias("problem_type"),
            request["difficulty"].alias("difficulty"), reply.alias("solution"), lit("Code generation response").alias("explanation"), lit("O(n)").alias("time_complexity"),
            lit("O(1)").alias("space_complexity"), lit("See solution above").alias("example_usage"),
            F.struct(lit("unknown").alias("lines_of_code"), lit(PARSE_ERROR).alias("error")).alias("metadata"),
        )
    if strategy == "multimodal":
        return F.struct(
            F.concat(lit("multimodal_"), n).alias("id"), request["use_case"].alias("use_case"), request["modalities"].alias("modalities"),
            request["alignment_quality"].alias("alignment_quality"), reply.alias("content"), lit(0.5).alias("alignment_score"),
            F.array(lit("generated"), lit("content")).alias("semantic_relationships"),
            F.struct(lit("medium").alias("complexity"), lit("general").alias("target_audience"), lit(PARSE_ERROR).alias("error")).alias("metadata"),
        )
    raise ValueError(f"unknown strategy: {strategy}")


def parse_replies(df: DataFrame, strategy: str, reply: str, number: Column, request: dict[str, Column], turns: Column | None = None) -> DataFrame:
    """Model replies to records: ``parsed`` and ``record`` (JSON text, the fallback where parsing fails).

    With ``turns`` a conversation must hold exactly that many turns.
    """
    value = reply_json(F.col(quoted(reply)))
    out = df.withColumn("_value", value)
    usable = F.col("_value").isNotNull()
    if turns is not None:
        usable = usable & F.coalesce(F.size(F.try_variant_get(F.col("_value"), "$.turns", "array<variant>")) == turns, F.lit(False))
    default = F.to_json(fallback_record(strategy, number, F.col(quoted(reply)), request))
    return (
        out.withColumn("parsed", usable)
        .withColumn("record", F.when(F.col("parsed"), F.to_json("_value")).otherwise(default))
        .drop("_value")
    )


def check_turn_count(turns: DataFrame, key: str, expected: int) -> DataFrame:
    """(key, turns, valid): conversations with exactly the expected number of turns."""
    return turns.groupBy(F.col(quoted(key))).agg(F.count(F.lit(1)).alias("turns")).withColumn("valid", F.col("turns") == expected)
