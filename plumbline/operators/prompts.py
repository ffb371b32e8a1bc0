"""Prompt text per request row for the generation strategies."""

from __future__ import annotations

import textwrap

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed texts of the prompts; <<name>> slots are filled from the request, <<?name>> lines appear only where they apply.
PROMPTS = {
    "engineering_problems": """
        Generate a challenging <<domain>> engineering problem with difficulty level <<difficulty>>/10.

        <<constraints>>

        Provide the output in the following JSON format:
        {
            "id": "unique_id",
            "problem_description": "Detailed description of the problem",
            "difficulty_level": <<difficulty>>,
            "domain": "<<domain>>",
            "expected_solution": "Detailed solution to the problem",
            "metadata": {
                "generated_timestamp": "<current_timestamp>",
                "constraints_used": "<<constraints>>"
            }
        }

        Return only valid JSON with no additional text or explanation.
        """,
    "system_design": """
        Generate a detailed system design based on the following requirements and constraints:

        Requirements:
        <<requirements>>

        Constraints:
        <<constraints>>

        Provide the output in the following JSON format:
        {
            "id": "design_1",
            "requirements": "<<requirements>>",
            "constraints": "<<constraints>>",
            "design_overview": "Detailed overview of the system design",
            "components": [
                {"name": "Component Name", "purpose": "Component purpose", "specifications": "Component specifications"},
                // Additional components
            ],
            "interfaces": [
                {"source": "Component A", "target": "Component B", "description": "Interface description"},
                // Additional interfaces
            ],
            "metadata": {
                "generated_timestamp": "<current_timestamp>"
            }
        }

        Return only valid JSON with no additional text or explanation.
        """,
    "conversation": """
        Generate a realistic <<style>> conversation in the <<domain>> domain with exactly <<turns>> turns.

        Format the output as JSON:
        {
            "id": "conv_<<number>>",
            "domain": "<<domain>>",
            "style": "<<style>>",
            "turns": [
                {"speaker": "user", "message": "user message"},
                {"speaker": "assistant", "message": "assistant response"},
                // ... continue for <<turns>> turns
            ],
            "metadata": {
                "topic": "conversation topic",
                "resolution": "resolved/unresolved/escalated",
                "sentiment": "positive/neutral/negative",
                "generated_timestamp": "<<as_of>>"
            }
        }

        Make the conversation natural and contextually appropriate for <<domain>>.
        Return only valid JSON with no additional text.
        """,
    "research_paper": """
        Generate a <<complexity>>-level research paper <<paper_type>> in the field of <<field>>.

        Format the output as JSON:
        {
            "id": "paper_<<number>>",
            "title": "paper title",
            "authors": ["Author 1", "Author 2"],
            "abstract": "paper abstract (150-250 words)",
            "keywords": ["keyword1", "keyword2", "keyword3"],
            "field": "<<field>>",
            "complexity": "<<complexity>>",<<?content>><<?introduction>><<?methodology>><<?results>>
            "references": [
                "Reference 1 in proper academic format",
                "Reference 2 in proper academic format"
            ],
            "metadata": {
                "publication_year": 2024,
                "journal": "appropriate journal name",
                "doi": "10.1000/example.doi",
                "generated_timestamp": "<<as_of>>"
            }
        }

        Make the content scientifically accurate and well-structured for <<field>>.
        Return only valid JSON with no additional text.
        """,
    "code": """
        Generate a <<difficulty>>-level <<language>> programming solution for a <<problem_type>> problem.

        Format the output as JSON:
        {
            "id": "code_<<number>>",
            "problem_description": "Clear description of the problem to solve",
            "language": "<<language>>",
            "problem_type": "<<problem_type>>",
            "difficulty": "<<difficulty>>",
            "solution": "complete working code solution",<<?test_cases>>
            "explanation": "explanation of the approach and algorithm",
            "time_complexity": "time complexity analysis",
            "space_complexity": "space complexity analysis",
            "example_usage": "example of how to use the code",
            "metadata": {
                "lines_of_code": "estimated number of lines",
                "generated_timestamp": "<<as_of>>"
            }
        }

        Ensure the code is syntactically correct and follows <<language>> best practices.
        Return only valid JSON with no additional text.
        """,
    "multimodal": """
        Generate a multi-modal data sample for <<use_case>> with <<alignment_quality>> alignment between modalities.
        Include the following modalities: <<modality_list>>

        Format the output as JSON:
        {
            "id": "multimodal_<<number>>",
            "use_case": "<<use_case>>",
            "modalities": <<modality_array>>,
            "alignment_quality": "<<alignment_quality>>",<<?text>><<?image_description>><<?audio_description>><<?video_description>><<?code>>
            "alignment_score": "0.0-1.0 score indicating how well modalities align",
            "semantic_relationships": ["relationship1", "relationship2"],
            "metadata": {
                "complexity": "simple/medium/complex",
                "target_audience": "intended audience",
                "generated_timestamp": "<<as_of>>"
            }
        }

        Ensure all modalities are semantically aligned and support the <<use_case>> use case.
        Return only valid JSON with no additional text.
        """,
}

# Fixed texts of the conditional lines.
OPTIONAL_LINES = {
    "content": '"content": "full paper content (if paper_type is full)",',
    "introduction": '"introduction": "introduction section",',
    "methodology": '"methodology": "methodology section",',
    "results": '"results": "results section",',
    "test_cases": '"test_cases": "unit tests for the solution",',
    "text": '"text": "text content",',
    "image_description": '"image_description": "detailed image description",',
    "audio_description": '"audio_description": "audio content description",',
    "video_description": '"video_description": "video content description",',
    "code": '"code": "relevant code snippet",',
}


def _conditions(strategy: str, request: dict[str, Column]) -> dict[str, Column]:
    if strategy == "research_paper":
        kind = request["paper_type"]
        return {
            "content": kind == "full",
            "introduction": kind.isin("introduction", "full"),
            "methodology": kind.isin("methodology", "full"),
            "results": kind.isin("results", "full"),
        }
    if strategy == "code":
        return {"test_cases": request["include_tests"]}
    if strategy == "multimodal":
        return {m: F.array_contains(request["modalities"], m) for m in ("text", "image_description", "audio_description", "video_description", "code")}
    return {}


def strategy_prompt(strategy: str, request: dict[str, Column]) -> Column:
    """The prompt of one request; ``request`` maps slot names to columns (``modalities`` is a text array)."""
    import re

    text = textwrap.dedent(PROMPTS[strategy]).strip("\n")
    values = {k: v.cast("string") for k, v in request.items() if k != "modalities"}
    if "modalities" in request:
        values["modality_list"] = F.array_join(request["modalities"], ", ")
        values["modality_array"] = F.concat(F.lit("['"), F.array_join(request["modalities"], "', '"), F.lit("']"))
    conditions = _conditions(strategy, request)
    parts = []
    for piece in re.split(r"(<<\??\w+>>)", text):
        if piece.startswith("<<?"):
            name = piece[3:-2]
            parts.append(F.when(conditions[name], F.lit("\n    " + OPTIONAL_LINES[name])).otherwise(F.lit("")))
        elif piece.startswith("<<"):
            parts.append(F.coalesce(values[piece[2:-2]], F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)
