"""Column functions shared by the operators; all stay inside JVM expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldspark.config import (
    DEVIATION_RULE_MIN, DEVIATION_RULE_SCALE, PRIORITY_BANDS, SEVERITY_BANDS,
)


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi)))


def safe_div(num: Column, den: Column) -> Column:
    """Division that yields NULL for a zero or NULL denominator."""
    return F.try_divide(num, den)


def band(value: Column, bands: Sequence[tuple[float, str]], below: str) -> Column:
    """Label of the highest band whose floor the value reaches."""
    out = None
    for floor, label in sorted(bands, reverse=True):
        hit = value >= F.lit(float(floor))
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return F.lit(below) if out is None else out.otherwise(F.lit(below))


def severity(score: Column, bands: Sequence[tuple[float, str]] = SEVERITY_BANDS) -> Column:
    return band(clamp(score, 0, 1), bands, "NORMAL")


def priority(score: Column, bands: Sequence[tuple[float, str]] = PRIORITY_BANDS) -> Column:
    return band(score, bands, "LOW")


def is_anomalous(score: Column, threshold: float) -> Column:
    return score >= F.lit(float(threshold))


def deviation_fraction(actual: Column, expected: Column) -> Column:
    floor = F.greatest(expected, F.lit(1e-9))
    return (actual - expected) / floor


def deviation_pct(actual: Column, expected: Column) -> Column:
    """Percent deviation, zero where the expectation is zero."""
    return F.when(expected.isNull() | actual.isNull(), None).otherwise(
        F.coalesce(safe_div(actual - expected, expected) * 100.0, F.lit(0.0)))


def rule_score(dev_fraction: Column) -> Column:
    """Score of the deviation rule alone; zero below its floor."""
    size = F.abs(dev_fraction)
    return F.when(size >= DEVIATION_RULE_MIN, F.least(size / DEVIATION_RULE_SCALE, F.lit(1.0))).otherwise(0.0)


def blend_rule(score: Column, dev_fraction: Column) -> Column:
    return F.greatest(score, rule_score(dev_fraction))


def hyperbolic_rate(qi: Column, di: Column, b: Column, t: Column, eps: float = 1e-4) -> Column:
    """Hyperbolic decline rate; exponential where the exponent is below eps."""
    exponent = F.when(b < eps, -di * t).otherwise(-F.log1p(b * di * t) / F.when(b < eps, 1.0).otherwise(b))
    return qi * F.exp(exponent)


def catalogue_rate(qi: Column, di: Column, b: Column, t: Column) -> Column:
    """Catalogue form: the initial rate up to time zero, wider exponential zone."""
    return F.when(t <= 0, qi).otherwise(hyperbolic_rate(qi, di, b, t, eps=1e-3))


def to_thousands(c: Column) -> Column:
    return c / 1000.0


def to_millions(c: Column) -> Column:
    return c / 1_000_000.0


def clean_text(c: Column, max_length: int = 120) -> Column:
    return F.trim(F.substring(F.coalesce(c, F.lit("")), 1, max_length))


def template_gate(text: Column, patterns: Sequence[str], replacement: str) -> Column:
    """Replace a text that makes any of the listed claims (case-insensitive)."""
    alternation = "(?i)(" + "|".join(patterns) + ")"
    return F.when(text.rlike(alternation), F.lit(replacement)).otherwise(text)
