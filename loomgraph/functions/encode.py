"""Compact encodings, detail levels, and token-budgeted context strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

# Short keys.
KEYS = {
    "finding_id": "fid",
    "pattern_id": "pid",
    "contract": "c",
    "function": "fn",
    "function_id": "fnid",
    "severity": "sev",
    "confidence": "conf",
    "line_number": "ln",
    "column_number": "col",
    "file_path": "fp",
    "timestamp": "ts",
    "description": "desc",
    "recommendation": "rec",
    "evidence": "ev",
    "properties": "props",
    "metadata": "meta",
    "external_call": "xcall",
    "state_variable": "svar",
    "state_read": "sr",
    "state_write": "sw",
    "modifier": "mod",
    "visibility": "vis",
    "callers": "clrs",
    "callees": "cles",
    "call_type": "ct",
    "target_id": "tid",
    "operations": "ops",
    "risk_score": "risk",
    "category": "cat",
    "subcategory": "sub",
    "items_included": "incl",
    "items_filtered": "filt",
    "bytes_sent": "bytes",
    "policy_level": "plvl",
}
# Short values.
VALUES = {
    "critical": "CRIT",
    "high": "HIGH",
    "medium": "MED",
    "low": "LOW",
    "informational": "INFO",
    "public": "pub",
    "external": "ext",
    "internal": "int",
    "private": "priv",
    "pending": "pend",
    "complete": "done",
    "in_progress": "prog",
    "true": "T",
    "false": "F",
    "external_call": "xcall",
    "delegate_call": "dcall",
    "static_call": "scall",
}
# Budgets from which a tier is added.
TIER_BUDGETS = (0, 75, 150, 300, 1000)


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def short_value(value: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(VALUES), value), value)


def long_value(value: Column) -> Column:
    """Not a true inverse: a text that equals a short value is rewritten."""
    return F.coalesce(F.try_element_at(_map({v: k for k, v in VALUES.items()}), value), value)


def short_map(props: Column) -> Column:
    keys = lambda k, v: F.coalesce(F.try_element_at(_map(KEYS), k), k)
    return F.transform_values(F.transform_keys(props, keys), lambda k, v: short_value(v))


def long_map(props: Column) -> Column:
    back = {v: k for k, v in KEYS.items()}
    keys = lambda k, v: F.coalesce(F.try_element_at(_map(back), k), k)
    return F.transform_values(F.transform_keys(props, keys), lambda k, v: long_value(v))


def compact_json(df: DataFrame, columns: list[str]) -> Column:
    """A minified JSON object with short keys, and short values for strings."""
    kinds = dict(df.dtypes)
    return F.to_json(F.struct(*((short_value(F.col(c)) if kinds[c] == "string" else F.col(c)).alias(KEYS.get(c, c)) for c in columns)))


def detail(df: DataFrame, level: str, summary: list[str], verbose: list[str]) -> DataFrame:
    """SUMMARY keeps the summary names, DETAILED drops the verbose ones, FULL keeps all;
    the names hold at every depth of structs. A struct without a name left goes."""
    if level not in ("SUMMARY", "DETAILED"):
        return df
    keeps = (lambda n: n in summary) if level == "SUMMARY" else (lambda n: n not in verbose)

    def pruned(value: Column, kind: DataType) -> Column | None:
        if not isinstance(kind, StructType):
            return value
        own = [(f.name, c) for f in kind.fields if keeps(f.name) and (c := pruned(value.getField(f.name), f.dataType)) is not None]
        return F.when(value.isNotNull(), F.struct(*(c.alias(n) for n, c in own))) if own else None

    columns = [(f.name, pruned(F.col(f.name), f.dataType)) for f in df.schema.fields if keeps(f.name)]
    return df.select(*(c.alias(n) for n, c in columns if c is not None))


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def compression_ratio(original: Column, tokens: Column) -> Column:
    return original / F.greatest(tokens, F.lit(1))


def reduction(before: Column, after: Column) -> Column:
    return F.bround((1 - F.length(after) / F.length(before)) * 100, 1)


def joined(items: Column, most: int | None = None, none: str | None = "none") -> Column:
    """Items by commas, the first most of them, or a word for no items."""
    text = F.array_join(F.slice(items, 1, most) if most else items, ",")
    return text if none is None else F.coalesce(F.nullif(text, F.lit("")), F.lit(none))


def with_tiers(tiers: list[Column], budget: Column) -> tuple[Column, Column]:
    """(tier, text): a tier is added if the budget allows it and the text so far is shorter."""
    text, tier = tiers[0], F.lit(1)
    for k, (more, least) in enumerate(zip(tiers[1:], TIER_BUDGETS[1:], strict=False), 2):
        add = (budget >= least) & (estimate_tokens(text) < budget)
        text, tier = F.when(add, F.concat(text, more)).otherwise(text), F.when(add, F.lit(k)).otherwise(tier)
    return tier, text


def cut(text: Column, most: int, mark: str = "...[truncated]") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def first_text(*columns: Column, most: int = 4000) -> Column:
    """The first non-empty text, cut."""
    return F.substring(F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit("")), 1, most)


def any_keyword(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w))
