"""Scoring and rating functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B, RRF_K = 1.2, 0.75, 60


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_term(idf_: Column, tf: Column, length: Column, mean: Column, k1: float = K1, b: float = B) -> Column:
    return idf_ * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.nullif(mean, F.lit(0))))


def rrf_term(rank: Column, weight: Column | float = 1.0, k: int = RRF_K) -> Column:
    """rank counts from 0."""
    return (weight if isinstance(weight, Column) else F.lit(weight)) / (F.lit(k) + rank + 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if the lengths differ or a norm is 0."""
    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(F.size(a) == F.size(b), F.coalesce(value, F.lit(0.0))).otherwise(0.0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: an expression within a lambda is evaluated anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def l2_normalize(v: Column) -> Column:
    return let(v, lambda w: let(F.sqrt(dot(w, w)), lambda norm: F.transform(w, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))))


def complexity_rating(c: Column) -> Column:
    return F.when(c <= 5, "low").when(c <= 10, "medium").when(c <= 20, "high").otherwise("very-high")


SEVERITY_LIMITS = {
    "long-method": (50, 100, 200), "long-parameter-list": (5, 7, 10), "god-class": (20, 30, 50), "deep-nesting": (4, 6, 8),
    "duplicate-code": (6, 12, 20), "magic-number": (3, 6, 10), "complex-conditional": (3, 5, 7), "dead-code": (1, 1, 1),
}
SEVERITIES = ("low", "medium", "high", "critical")


def severity(kind: str, value: Column) -> Column:
    low, medium, high = SEVERITY_LIMITS[kind]
    return F.when(value <= low, "low").when(value <= medium, "medium").when(value <= high, "high").otherwise("critical")


def severity_rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), c) - 1


def cyclomatic(c: Column) -> Column:
    """1 + branches: keywords before a bracket, case, ternaries and logical operators."""
    calls = "\\b(?:if|while|for|catch)\\s*\\("
    count = lambda p: F.regexp_count(c, F.lit(p))
    return (F.lit(1) + count(calls) + count("\\bcase\\b") + count("\\?\\s*[^:]+:") + count("&&") + count("\\|\\|")).cast("int")


def magic_numbers(c: Column) -> Column:
    """Numbers after white space, but for 0, 1 and -1."""
    found = F.regexp_extract_all(c, F.lit("(?<!const|let|var)\\s+(-?\\d+\\.?\\d*)"), F.lit(1))
    return F.filter(F.transform(found, lambda x: x.cast("double")), lambda x: ~x.isin(0.0, 1.0, -1.0))


def confidence_level(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.5, "medium").otherwise("low")


def confidence_icon(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in ("high", "[GREEN]", "medium", "[YELLOW]", "low", "[RED]")])[c]


def confidence_guidance(c: Column) -> Column:
    known = ("high", "Use as is", "medium", "Check before use", "low", "Don't rely on it")
    return F.create_map(*[F.lit(x) for x in known])[c]
