"""Scores and verdicts: pieces of arithmetic over counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def structure_curve(ratio: Column) -> Column:
    """Score of a share of sections found: steeper from 60 % on."""
    return F.least(
        F.lit(1.0),
        F.when(ratio >= 0.95, 0.9 + (ratio - 0.95) * 2).when(ratio >= 0.80, 0.6 + (ratio - 0.80) * 2).when(ratio >= 0.60, 0.3 + (ratio - 0.60) * 1.5).otherwise(ratio * 0.5),
    )


def cleanliness(n: Column) -> Column:
    return F.when(n == 0, 1.0).when(n <= 2, 0.85).when(n <= 5, 0.70).when(n <= 15, 0.50).when(n <= 40, 0.35).otherwise(0.20)


def traceability_rubric(ratio: Column, rows: Column) -> Column:
    return F.when(rows == 0, 0.5).when(ratio >= 0.9, 0.9).when(ratio >= 0.7, 0.7).when(ratio >= 0.5, 0.5).when(ratio >= 0.25, 0.3).otherwise(0.1)


def requirements_v1(n: Column, id_ratio: Column, trace_ratio: Column) -> Column:
    return F.when(n == 0, 0.1).otherwise(F.least(n / 20.0, F.lit(1.0)) * 0.5 + id_ratio * 0.3 + trace_ratio * 0.2)


def requirements_v2(passed: Column, warned: Column, errors: Column) -> Column:
    total = passed + warned + errors
    factor = F.when(errors > 0, F.greatest(F.lit(0.3), 1 - 0.2 * errors)).otherwise(1.0)
    return F.when(total == 0, 0.1).otherwise((passed + 0.5 * warned) / total * factor)


def guide_v2(passed: Column, info: Column, warned: Column, total: Column) -> Column:
    return F.when(total == 0, 0.5).otherwise((passed + 0.8 * info + 0.4 * warned) / total)


def order_v2(violations: Column, found: Column) -> Column:
    return F.when(found == 0, 0.8).otherwise(F.greatest(F.lit(0.3), 1 - 0.1 * violations))


def verdict(overall: Column, errors: Column) -> Column:
    return F.when((overall >= 0.80) & (errors == 0), "GOOD").when((overall >= 0.60) & (errors <= 2), "ACCEPTABLE_WITH_FIXES").when(overall >= 0.35, "NOT_RELIABLE").otherwise("NON_COMPLIANT")


def verdict_override(no_id: Column, own: Column) -> Column:
    return F.when(no_id > 50, "NON_COMPLIANT").when(no_id > 30, "NOT_RELIABLE").when(no_id > 15, "ACCEPTABLE_WITH_FIXES").otherwise(own)


def fitness(errors: Column, warnings: Column, findings: Column) -> Column:
    return F.when(findings == 0, 0.5).otherwise(F.greatest(F.lit(0.1), 0.7 - 0.15 * errors - 0.05 * warnings))


def blended(model: Column, rubric: Column) -> Column:
    return F.when(F.abs(model - rubric) < 0.15, rubric).otherwise(0.4 * rubric + 0.6 * model)


def two_decimals(x: Column) -> Column:
    """Two decimals; a half goes to the even digit."""
    y = x * 100
    whole = F.floor(y)
    rest = y - whole
    return F.when(rest > 0.5 + 1e-9, whole + 1).when(rest < 0.5 - 1e-9, whole).otherwise(whole + F.pmod(whole, F.lit(2))) / 100.0


def ask_confidence(top: Column, not_found: Column) -> Column:
    """Confidence of an answer on one document, by its best score."""
    return F.when(not_found, "not_found").when(top >= 0.78, "high").when(top >= 0.60, "medium").otherwise("low")


#: Weights of a review's axes: structure, requirements, traceability, cleanliness, fitness.
WEIGHTS_REVIEW = (0.15, 0.25, 0.40, 0.10, 0.10)


def review_overall(axes: list[Column], no_id: Column) -> Column:
    """Weighted score of a review, at most 0.20 if more than 50 rows have no identifier."""
    total = two_decimals(sum((a * w for a, w in zip(axes, WEIGHTS_REVIEW, strict=True)), F.lit(0.0)) / sum(WEIGHTS_REVIEW))
    return F.when((no_id > 50) & (total > 0.20), 0.20).otherwise(total)


#: Weights of the axes: structure, order, cleanliness, requirements, guide.
WEIGHTS_V2 = (0.25, 0.05, 0.10, 0.35, 0.25)
