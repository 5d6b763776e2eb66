"""Masking of secrets and personal data in text and nested rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Secret shapes, in the order they are masked.
SECRET_PATTERNS = {
    "store_token": r"shp(at|ss|ca|pa|ua)_[A-Za-z0-9]{16,}",
    "model_key": r"sk-ant-[A-Za-z0-9_-]{10,}",
    "git_token": r"gh[pousr]_[A-Za-z0-9]{20,}",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
}
# Text every match of a pattern must contain: a cheap test that spares clean texts the pattern search.
MARKERS = {"store_token": "shp", "model_key": "sk-ant-", "git_token": "_", "email": "@"}
# Field names that are masked whatever they hold.
SENSITIVE_KEY = (
    "token|secret|password|passwd|authorization|api[-_]?key|private|cookie|session|email|phone|address"
    "|first_?name|last_?name|card|iban|ssn"
)
# Mask words and the depth at which nesting is cut.
REDACTED, TOO_DEEP, MAX_DEPTH = "[REDACTED]", "[DEPTH]", 8

_SENSITIVE = re.compile(SENSITIVE_KEY, re.IGNORECASE)


def redact_text(c: Column) -> Column:
    for name, pattern in SECRET_PATTERNS.items():
        c = F.when(c.contains(MARKERS[name]), F.regexp_replace(c, pattern, REDACTED)).otherwise(c)
    return c


def redact_value(c: Column, dtype: T.DataType, depth: int) -> Column:
    """Masked copy of a value; the walk follows the static type, so it stays a plain expression."""
    if depth > MAX_DEPTH:
        return F.lit(TOO_DEEP)
    if isinstance(dtype, T.StringType):
        return redact_text(c)
    if isinstance(dtype, T.VariantType):
        return F.when(c.isNotNull(), F.parse_json(_masked_json(c, depth)))
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: redact_value(x, dtype.elementType, depth + 1))
    if isinstance(dtype, T.MapType):

        def mask(k: Column, v: Column) -> Column:
            return F.when(k.rlike(f"(?i){SENSITIVE_KEY}"), REDACTED).otherwise(
                redact_value(v, dtype.valueType, depth + 1).cast("string")
            )

        return F.transform_values(c, mask)
    if isinstance(dtype, T.StructType):
        fields = [
            (F.lit(REDACTED) if _SENSITIVE.search(f.name) else redact_value(c[f.name], f.dataType, depth + 1)).alias(f.name)
            for f in dtype
        ]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def redact_rows(df: DataFrame) -> DataFrame:
    """Every row treated as one log entry. For logs only: a metric called ``sessions`` would be masked."""
    return df.select(
        *[
            (F.lit(REDACTED) if _SENSITIVE.search(f.name) else redact_value(F.col(f.name), f.dataType, 1)).alias(f.name)
            for f in df.schema
        ]
    )


def _quoted(c: Column) -> Column:
    """A text as a JSON string."""
    return F.when(c.isNotNull(), F.btrim(F.to_json(F.array(c)), F.lit("[]")))  # the quotes inside stop the trim


def _masked_text(c: Column) -> Column:
    """:func:`redact_text` as a JSON string. Each step is a lambda, so that its text is worked out once and not once a mention."""

    def step(name: str, pattern: str) -> Callable[[Column], Column]:
        return lambda x: F.when(x.contains(MARKERS[name]), F.regexp_replace(x, pattern, REDACTED)).otherwise(x)

    held = F.array(c)
    for name, pattern in SECRET_PATTERNS.items():
        held = F.transform(held, step(name, pattern))
    return F.get(F.transform(held, _quoted), 0)


def _masked_json(v: Column, depth: int) -> Column:
    """JSON text of a masked variant. Members and elements are walked as the same kind of entry, so that the expression grows
    with the depth and not with the number of ways through it."""
    return F.get(F.transform(F.array(_entry(F.lit(None).cast("string"), v)), lambda e: _masked_entry(e, depth)), 0)


def _entry(k: Column, v: Column) -> Column:
    """A member (or an element, without a name) with its JSON text, whose first sign tells its kind."""
    return F.struct(k.alias("k"), v.alias("v"), F.to_json(v).alias("text"))


def _masked_entry(e: Column, depth: int) -> Column:
    """JSON text of the masked value of an entry."""
    if depth > MAX_DEPTH:
        return F.lit(f'"{TOO_DEEP}"')
    v, text = e["v"], e["text"]
    is_object = text.startswith("{")
    members = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda m: _entry(m["key"], m["value"]))
    elements = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: _entry(F.lit(None).cast("string"), x))

    def entry(m: Column) -> Column:
        name = F.coalesce(F.concat(_quoted(m["k"]), F.lit(":")), F.lit(""))
        value = F.when(m["k"].rlike(f"(?i){SENSITIVE_KEY}"), f'"{REDACTED}"').otherwise(_masked_entry(m, depth + 1))
        return F.concat(name, value)

    inside = F.array_join(F.transform(F.when(is_object, members).otherwise(elements), entry), ",")
    left, right = F.when(is_object, "{").otherwise("["), F.when(is_object, "}").otherwise("]")
    return (
        F.when(is_object | text.startswith("["), F.concat(left, inside, right))  # one place: twice would double at each depth
        .when(text.startswith('"') & (F.schema_of_variant(v) == "STRING"), _masked_text(F.try_variant_get(v, "$", "string")))
        .otherwise(F.coalesce(text, F.lit("null")))
    )


def redact_json(c: Column, depth: int = 1) -> Column:
    """Masked copy of any JSON text, whatever its shape: no schema is needed, and rows may differ in theirs.

    Values of sensitive names are masked whatever they hold, texts by the secret shapes, and what lies deeper than
    :data:`MAX_DEPTH` is cut; ``depth`` is that of the text itself (1: a field of a log entry). Members come back in the order
    of their names. Null gives null. Text that is no JSON (or repeats a name) is masked as plain text and quoted.
    """
    parsed = F.try_parse_json(c)
    return F.when(parsed.isNotNull(), _masked_json(parsed, depth)).otherwise(_quoted(redact_text(c)))


def secret_scan(df: DataFrame, text: str) -> DataFrame:
    """Rows and matches per secret shape; all shapes are counted in one pass and unfolded at the end."""
    counts = df.select(
        *[
            F.when(F.col(text).contains(MARKERS[name]), F.regexp_count(text, F.lit(p))).otherwise(0).alias(name)
            for name, p in SECRET_PATTERNS.items()
        ]
    )
    tally = [
        F.struct(
            F.lit(name).alias("pattern"),
            F.count_if(F.col(name) > 0).alias("rows_hit"),
            F.coalesce(F.sum(name), F.lit(0)).alias("matches"),
        )
        for name in SECRET_PATTERNS
    ]
    return counts.agg(F.array(*tally).alias("p")).select(F.inline("p"))
