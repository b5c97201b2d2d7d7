"""Predicates on node properties, compiled to columns.

A missing property makes a condition not true, for every operator; leaves are
two-valued, so NOT and none-of blocks never meet a null. clause_status() tells
unknown from failed.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# The operators, and the symbols that stand for some of them.
OPERATORS = ("eq", "neq", "in", "not_in", "contains_any", "contains_all", "gt", "gte", "lt", "lte", "regex", "contains", "exists")
SYMBOLS = {"=": "eq", "==": "eq", "!=": "neq", "<>": "neq", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}


@dataclass(frozen=True)
class Condition:
    property: str
    op: str = "eq"
    value: Any = True


@dataclass(frozen=True)
class Match:
    """All of all, one of any (if there are any), none of none."""

    all: tuple[Condition, ...] = ()
    any: tuple[Condition, ...] = ()
    none: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class Not:
    item: Any


@dataclass(frozen=True)
class Both:
    items: tuple


@dataclass(frozen=True)
class Either:
    items: tuple


def operator(op: str | None) -> str:
    """A word for a symbol; no operator is eq."""
    op = (op or "eq").strip().lower()
    return SYMBOLS.get(op, op)


def _array(values: Any) -> Column:
    values = list(values) if isinstance(values, (list, tuple, set)) else [values]
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


_COMPILE: dict[str, Callable[[Column, Any], Column]] = {
    "eq": lambda c, v: c == F.lit(v),
    "neq": lambda c, v: c != F.lit(v),
    "in": lambda c, v: c.isin(list(v)),
    "not_in": lambda c, v: ~c.isin(list(v)),
    "gt": lambda c, v: c > F.lit(v),
    "gte": lambda c, v: c >= F.lit(v),
    "lt": lambda c, v: c < F.lit(v),
    "lte": lambda c, v: c <= F.lit(v),
    "regex": lambda c, v: c.rlike(v),
    "exists": lambda c, v: c.isNotNull() if v in (True, None) else c.isNull(),
    "contains": lambda c, v: F.array_contains(c, v),
    "contains_any": lambda c, v: F.arrays_overlap(c, _array(v)),
    "contains_all": lambda c, v: F.when(c.isNotNull(), F.size(F.array_except(_array(v), c)) == 0),
}


def _leaf(cond: Condition) -> Column:
    op = operator(cond.op)
    if op not in _COMPILE:
        raise ValueError(f"unsupported operator {cond.op!r}; supported: {', '.join(OPERATORS)}")
    return _COMPILE[op](F.col(cond.property), cond.value)


def condition(cond: Condition, known: Collection[str] | None = None) -> Column:
    """True or false; a property that isn't known is missing everywhere."""
    if known is not None and cond.property not in known:
        return F.lit(operator(cond.op) == "exists" and cond.value is False)
    return F.coalesce(_leaf(cond), F.lit(False))


def _fold(columns: list[Column], how: Callable[[Column, Column], Column], empty: bool) -> Column:
    return reduce(how, columns) if columns else F.lit(empty)


def match(m: Match, known: Collection[str] | None = None) -> Column:
    each = lambda cs: [condition(c, known) for c in cs]
    out = _fold(each(m.all), lambda a, b: a & b, True)
    if m.any:
        out = out & _fold(each(m.any), lambda a, b: a | b, True)
    return out & ~_fold(each(m.none), lambda a, b: a | b, False)


def compile_tree(tree: Any, known: Collection[str] | None = None) -> Column:
    """A column from a tree of Condition, Match, Both, Either and Not. NOT of a bare
    property asks for false, so a missing one does not match."""
    if isinstance(tree, Column):
        return tree
    if isinstance(tree, Condition):
        return condition(tree, known)
    if isinstance(tree, Match):
        return match(tree, known)
    if isinstance(tree, Both):
        return _fold([compile_tree(t, known) for t in tree.items], lambda a, b: a & b, True)
    if isinstance(tree, Either):
        return _fold([compile_tree(t, known) for t in tree.items], lambda a, b: a | b, False)
    if isinstance(tree, Not):
        if isinstance(tree.item, Condition) and operator(tree.item.op) == "eq" and tree.item.value is True:
            return condition(Condition(tree.item.property, "eq", False), known)
        return ~compile_tree(tree.item, known)
    raise TypeError(f"not a predicate: {tree!r}")


def clause_status(cond: Condition, known: Collection[str] | None = None) -> Column:
    """matched, failed, or unknown if the property is missing."""
    if known is not None and cond.property not in known:
        return F.lit("unknown")
    return F.when(F.col(cond.property).isNull() & F.lit(operator(cond.op) != "exists"), "unknown").when(condition(cond, known), "matched").otherwise("failed")


def conditions_of(tree: Any) -> list[Condition]:
    if isinstance(tree, Condition):
        return [tree]
    if isinstance(tree, Match):
        return [*tree.all, *tree.any, *tree.none]
    if isinstance(tree, (Both, Either)):
        return [c for t in tree.items for c in conditions_of(t)]
    return conditions_of(tree.item) if isinstance(tree, Not) else []


# Predicates on arrays of operations in the order in which they happen.


def has_operation(ops: Column, op: str) -> Column:
    return F.coalesce(F.array_contains(ops, op), F.lit(False))


def has_all_operations(ops: Column, wanted: list[str]) -> Column:
    return F.coalesce(F.size(F.array_except(_array(wanted), ops)) == 0, F.lit(False)) & ops.isNotNull()


def has_any_operation(ops: Column, wanted: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(ops, _array(wanted)), F.lit(False))


def happens_before(ops: Column, before: str, after: str) -> Column:
    """Some operation `before` stands earlier than some `after`."""
    last = F.size(ops) + 1 - F.array_position(F.reverse(ops), after)
    return F.coalesce((F.array_position(ops, before) > 0) & (F.array_position(F.reverse(ops), after) > 0) & (F.array_position(ops, before) < last), F.lit(False))


def signature_matches(signature: Column, pattern: str) -> Column:
    return F.coalesce(signature.rlike(pattern), F.lit(False))


def tiers(a: Column, b: Column, c: Column, mode: str) -> Column:
    """How a rule's tiers combine: only A, A and C (B ignored if absent), or A
    raised by B. A null tier is absent and holds where it is not required."""
    yes = F.lit(True)
    if mode in ("tier_a_only", "tier_a_required", "tier_b_enhances"):
        return F.coalesce(a, F.lit(False))
    if mode == "tier_abc_all":
        return F.coalesce(a, yes) & F.coalesce(b, yes) & F.coalesce(c, yes)
    raise ValueError(f"unknown aggregation mode {mode!r}")
