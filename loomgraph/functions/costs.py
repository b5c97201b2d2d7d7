"""Model costs, budgets and usage totals. Prices are parameters; these are defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dollars for a million tokens in and out.
PRICES = {
    "x-ai/grok-code-fast-1": (0.0, 0.002),
    "minimax/minimax-m2:free": (0.0, 0.0),
    "bigpickle/bigpickle:free": (0.0, 0.0),
    "qwen/qwen-2.5-72b-instruct:free": (0.0, 0.0),
    "deepseek/deepseek-v3.2": (0.25, 0.38),
    "google/gemini-3-flash-preview": (0.50, 3.0),
    "google/gemini-3-pro-preview": (2.0, 12.0),
    "zhipu/glm-4.7": (0.0, 0.0),
}
DEFAULT_PRICE = (2.0, 10.0)
# Context windows in tokens.
CONTEXT_LIMITS = {
    "x-ai/grok-code-fast-1": 256_000,
    "minimax/minimax-m2:free": 204_000,
    "bigpickle/bigpickle:free": 200_000,
    "qwen/qwen-2.5-72b-instruct:free": 32_768,
    "deepseek/deepseek-v3.2": 164_000,
    "google/gemini-3-flash-preview": 1_000_000,
    "google/gemini-3-pro-preview": 1_000_000,
    "zhipu/glm-4.7": 128_000,
}
DEFAULT_CONTEXT = 100_000
# Dollars for a million tokens in, out, read from and written to a cache.
CACHED_PRICES = {
    "claude-opus-4-20250514": (15.0, 75.0, 1.5, 18.75),
    "claude-sonnet-4-20250514": (3.0, 15.0, 0.3, 3.75),
    "claude-haiku-4-20250514": (0.25, 1.25, 0.025, 0.3125),
    "o3": (10.0, 40.0, 2.5, 10.0),
    "gpt-4.1": (2.5, 10.0, 1.25, 2.5),
    "gpt-4o": (2.5, 10.0, 1.25, 2.5),
}
FLAT_PRICE = (5.0, 15.0)
# Token budgets.
ROLE_BUDGETS = {"classifier": 2000, "attacker": 6000, "defender": 5000, "verifier": 4000, "validator": 3000}
POOL_BUDGETS = {"triage": 2000, "investigation": 6000, "verification": 4000}
DEFAULT_BUDGET = 6000


def _map(table: dict, kind: str) -> Column:
    value = lambda v: F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v)
    return F.create_map(*(x for k, v in table.items() for x in (F.lit(k), value(v).cast(kind))))


def _look(table: dict, at: Column, default, kind: str) -> Column:
    other = F.array(*map(F.lit, default)).cast(kind) if isinstance(default, tuple) else F.lit(default).cast(kind)
    return F.coalesce(F.try_element_at(_map(table, kind), at), other)


def cost(model: Column, tokens_in: Column, tokens_out: Column, prices: dict = PRICES, default: tuple = DEFAULT_PRICE) -> Column:
    p = _look(prices, model, default, "array<double>")
    return tokens_in * p[0] / 1e6 + tokens_out * p[1] / 1e6


def cost_with_cache(model: Column, tokens_in: Column, tokens_out: Column, read: Column, written: Column, prices: dict = CACHED_PRICES) -> Column:
    """Tokens read from a cache are taken off the input; an unknown model has a flat price."""
    p = F.try_element_at(_map(prices, "array<double>"), model)
    known = (tokens_in - read) * p[0] / 1e6 + tokens_out * p[1] / 1e6 + read * p[2] / 1e6 + written * p[3] / 1e6
    return F.coalesce(known, (tokens_in * FLAT_PRICE[0] + tokens_out * FLAT_PRICE[1]) / 1e6)


def context_limit(model: Column) -> Column:
    return _look(CONTEXT_LIMITS, model, DEFAULT_CONTEXT, "int")


def is_free(model: Column) -> Column:
    p = _look(PRICES, model, DEFAULT_PRICE, "array<double>")
    return (p[0] == 0) & (p[1] == 0)


def role_budget(role: Column) -> Column:
    return _look(ROLE_BUDGETS, role, DEFAULT_BUDGET, "int")


def pool_budget(pool: Column) -> Column:
    return _look(POOL_BUDGETS, pool, DEFAULT_BUDGET, "int")


def vendor(model: Column) -> Column:
    has = lambda word: F.contains(F.lower(model), F.lit(word))
    return F.when(has("claude"), "anthropic").when(has("gpt") | has("o1"), "openai").when(has("gemini"), "google").otherwise("unknown")


def model_for_role(role: Column, custom: dict[str, str], standard: dict[str, str]) -> Column:
    """A custom model for the role, else the standard one, else null."""
    out = F.lit(None).cast("string")
    for table in (standard, custom):
        if table:
            out = F.coalesce(F.try_element_at(_map(table, "string"), role), out)
    return out


def usage_totals(log: DataFrame, by: list[str], price_in: float, price_out: float) -> DataFrame:
    """requests, input_tokens, output_tokens and cost."""
    n_in, n_out = F.sum("input_tokens"), F.sum("output_tokens")
    return log.groupBy(*by).agg(F.count("*").alias("requests"), n_in.alias("input_tokens"), n_out.alias("output_tokens"), (n_in * price_in / 1e6 + n_out * price_out / 1e6).alias("cost"))
