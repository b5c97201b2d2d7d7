"""Labels of functions: validity, categories, relevance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and the categories in which they matter.
CATEGORIES = {
    "IS_ACCESS_GATE": ("access_control",),
    "IS_OWNER_CHECK": ("access_control",),
    "IS_ADMIN_CHECK": ("access_control",),
    "IS_ROLE_CHECK": ("access_control",),
    "IS_MULTISIG_REQUIRED": ("access_control", "governance"),
    "PERMISSION_FOR": ("access_control",),
    "LIMIT_FOR": ("access_control", "dos"),
    "IS_PAUSE_MECHANISM": ("access_control", "dos"),
    "IS_REENTRANCY_GUARD": ("reentrancy",),
    "GUARDS": ("access_control", "reentrancy"),
    "PROTECTED_BY": ("access_control", "reentrancy"),
    "BYPASSES": ("access_control", "reentrancy"),
    "IS_PRICE_ORACLE": ("oracle",),
    "DERIVES_FROM": ("oracle",),
    "IS_FEE_COLLECTOR": ("mev", "token"),
    "IS_TREASURY": ("governance", "token"),
    "IS_USER_BALANCE_TRACKER": ("reentrancy", "token"),
    "IS_REWARD_DISTRIBUTOR": ("mev", "token"),
    "FEE_FOR": ("mev", "token"),
    "IS_RATE_LIMITER": ("dos",),
    "IS_COOLDOWN_ENFORCER": ("dos",),
    "IS_EXTERNAL_ADAPTER": ("mev", "oracle", "token"),
    "IS_CALLBACK_HANDLER": ("mev", "oracle", "reentrancy"),
    "READS_FROM": ("general",),
    "WRITES_TO": ("general",),
    "MUST_CALL_BEFORE": ("general",),
    "TRIGGERS": ("general",),
    "FALLBACK_FOR": ("general",),
}
# Categories of CONTEXT:<key>:... labels.
CONTEXT_CATEGORIES = {"PERMISSION": ("access_control",), "LIMIT": ("access_control", "dos"), "BUSINESS": ("general",), "INVARIANT": ("general",)}


def category(name: Column) -> Column:
    return F.trim(F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("-"), F.lit("_")))


def _parts(label: Column) -> Column:
    return F.split(label, ":")


def _is_context(label: Column) -> Column:
    return F.startswith(label, F.lit("CONTEXT:")) & (F.size(_parts(label)) >= 3)


def valid(label: Column) -> Column:
    return F.coalesce(label.isin(list(CATEGORIES)) | _is_context(label) & (F.trim(F.get(_parts(label), F.lit(1))) != ""), F.lit(False))


def _map(table: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))


def categories(label: Column) -> Column:
    """Sorted; general for what is not known."""
    context = F.when(_is_context(label), F.try_element_at(_map(CONTEXT_CATEGORIES), F.upper(F.trim(F.get(_parts(label), F.lit(1))))))
    return F.coalesce(F.try_element_at(_map(CATEGORIES), label), context, F.array(F.lit("general")))


def relevant(label: Column, wanted: Column) -> Column:
    """Every label is relevant to an empty category, general ones to all."""
    own = category(wanted)
    return (own == "") | F.array_contains(categories(label), "general") | F.array_contains(categories(label), own)
