"""Columns that read a model's text answer: fences, refusals, whitespace, JSON query plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, with the four separator controls that are also stripped from text.
BLANK = r"(?U)[\s\x1c-\x1f]"

# Fields of a query plan and the JSON types each may hold.
PLAN_FIELDS = {
    "metric": ("STRING", "VOID"),
    "dimensions": ("ARRAY",),
    "time_period": ("STRING", "VOID"),
    "filters": ("ARRAY",),
    "ambiguities": ("ARRAY",),
    "answerable": ("BOOLEAN",),
}


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def without_fence(text: Column, language: str, any_case: bool) -> Column:
    """The text inside a code fence with its language tag, or the stripped text where there is none."""
    body = stripped(text)
    tag = f"(?i)^{language}" if any_case else f"^{language}"
    inner = F.regexp_replace(F.regexp_replace(body, "^`+|`+$", ""), tag, "")
    return F.when(body.startswith("```"), stripped(inner)).otherwise(body)


def is_refusal(answer: Column) -> Column:
    return answer.rlike(r"(?i)\ACANNOT_ANSWER\.?\z")


def sql_or_refusal(text: Column) -> tuple[Column, Column]:
    """The answer's SQL (NULL for a refusal) and whether it is a refusal."""
    body = without_fence(text, "sql", any_case=True)
    refused = is_refusal(body)
    return F.when(~refused, body), refused


def single_line(text: Column) -> Column:
    return F.regexp_replace(stripped(text), f"{BLANK}+", " ")


def plan_problem(text: Column) -> Column:
    """Why a JSON query plan is not acceptable, or NULL if it is: the first failing check in field order."""
    plan = F.try_parse_json(without_fence(text, "json", any_case=False))
    problem = F.when(plan.isNull(), F.lit("invalid_json")).when(
        ~F.schema_of_variant(plan).startswith("OBJECT"), F.lit("not_an_object")
    )
    for name, kinds in PLAN_FIELDS.items():
        value = F.try_variant_get(plan, f"$.{name}", "variant")
        kind = F.schema_of_variant(value)
        allowed = None
        for k in kinds:
            match = kind.startswith(k)
            allowed = match if allowed is None else allowed | match
        problem = problem.when(value.isNull(), F.lit(f"missing:{name}")).when(~allowed, F.lit(f"wrong_type:{name}"))
    return problem
