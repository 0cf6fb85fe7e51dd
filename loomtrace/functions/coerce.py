"""Coercions of dirty export values (Column -> Column)."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
TRUE_WORDS = ("true", "1", "yes", "y", "t")
NO_VALUE = ("", "nan")


def strip(c: Column) -> Column:
    """Trim all Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def parse_bool(c: Column) -> Column:
    """Yes/no words and numbers as booleans; null, NaN and anything else are false."""
    number = F.expr("1").isNull()
    x = F.lower(strip(c.cast("string")))
    n = x.try_cast("double")
    return F.coalesce(x.isin(*TRUE_WORDS) | (n.isNotNull() & ~F.isnan(n) & (n != 0)), number)


def to_number(c: Column) -> Column:
    """Number or null; NaN counts as missing so that averages skip it."""
    n = c.try_cast("double")
    return F.when(~F.isnan(n), n)


def valid_number(c: Column, least: float = 0.0) -> Column:
    """Finite number of at least ``least``, else null."""
    n = to_number(c)
    return F.when((F.abs(n) < float("inf")) & (n >= least), n)


def instant(c: Column) -> Column:
    """Timestamp of an epoch number in seconds or, above 1e12, milliseconds."""
    n = to_number(c)
    return F.timestamp_millis(F.floor(F.when(n > 1e12, n).otherwise(n * 1000)).cast("long"))


def wall_time(c: Column) -> Column:
    """ISO time with its offset cut off, not converted."""
    return F.try_to_timestamp(F.regexp_replace(strip(c), r"(Z|[+-]\d\d:?\d\d)$", ""))


def month_of(c: Column) -> Column:
    return F.trunc(c, "month")


def is_missing(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c.cast("string"))).isin(*NO_VALUE), F.lit(True))


def or_other(c: Column, other: str = "Other") -> Column:
    """Label with missing ones named ``other``."""
    return F.when(c.isNull() | F.trim(c).isin(*NO_VALUE), other).otherwise(F.trim(c))


def literal_list(text: str | None) -> list[str | None]:
    """List written as JSON or as a Python literal; a scalar is a list of one, nothing an empty one."""
    if text is None or not text.strip() or text.strip().lower() == "nan":
        return []
    for read in (json.loads, ast.literal_eval):
        try:
            v = read(text)
        except (ValueError, SyntaxError, RecursionError, MemoryError):
            continue
        if isinstance(v, (list, tuple, set)):
            return [None if x is None else x if isinstance(x, str) else json.dumps(x) for x in v]
        break
    return [text]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _literal_list(c: pd.Series) -> pd.Series:
    return c.map(literal_list)


def as_list(c: Column) -> Column:
    """``literal_list`` of a column; plain JSON lists never leave the JVM."""
    return F.coalesce(F.when(F.trim(c).startswith("["), F.try_variant_get(F.try_parse_json(c), "$", "array<string>")), _literal_list(c))


def judged_json(c: Column) -> Column:
    """JSON object inside a judge's reply: the reply itself, else what stands from the first { to the last }."""
    whole = F.try_parse_json(c)
    return F.coalesce(F.when(F.schema_of_variant(whole).startswith("OBJECT"), whole), F.try_parse_json(F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))))


def score_of(reply: Column) -> Column:
    """Number of a judge's reply: the reply itself, or the ``Output`` (or ``score``) of JSON, which may be JSON text again."""
    v = judged_json(reply)
    inner = F.coalesce(F.try_variant_get(v, "$.Output", "string"), F.try_variant_get(v, "$.score", "string"))
    again = F.coalesce(F.try_variant_get(F.try_parse_json(inner), "$.Output", "string"), F.try_variant_get(F.try_parse_json(inner), "$.score", "string"))
    return valid_number(F.coalesce(to_number(reply), to_number(inner), to_number(again)))


# Names of the user's prompt as an endpoint, and entailment labels.
USER_ENDPOINTS = ("u", "user", "user_query", "user query", "user prompt")
LABELS = ("entailment", "neutral", "contradiction")


def endpoint(c: Column) -> Column:
    """Endpoint of a transition: ``U`` for the prompt, else its id without brackets and spaces; a whole float loses its ``.0`` only alone."""
    x = F.regexp_replace(F.lower(strip(c)), r"[()\[\]]", "")
    bare = F.regexp_replace(x, r"\s+", "")
    return F.when(strip(x).isin(*USER_ENDPOINTS), "U").when(bare != "", bare)


def reason(c: Column) -> Column:
    """Reason of a transition by what its label names, the first that fits: other, hybrid, expansion, rewriting."""
    x = F.lower(F.coalesce(c, F.lit("")))
    return F.when(x.contains("other"), "Other").when(x.contains("hybrid"), "Hybrid").when(x.contains("expansion"), "Expansion").when(x.rlike("rewrit(e|ing)"), "Rewriting").otherwise("Other")


def valid_label(c: Column) -> Column:
    """An entailment label, else null."""
    x = F.lower(strip(c))
    return F.when(x.isin(*LABELS), x)


def shown(c: Column, names: dict[str, str]) -> Column:
    """Display name of a category; others show as they are."""
    pairs = [F.lit(v) for kv in names.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c) if pairs else c
