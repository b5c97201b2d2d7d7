"""Identifiers: tokens, tags, and hashed ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags of variable names by the tokens that call for them.
NAME_TAGS = {
    "owner": ("owner", "admin"),
    "role": ("role", "roles"),
    "fee": ("fee", "fees", "bps"),
    "balance": ("balance", "balances", "bal"),
    "supply": ("supply", "totalsupply"),
    "stake": ("stake", "staking", "staked"),
    "collateral": ("collateral", "collat"),
    "debt": ("debt", "borrow", "loan", "liability"),
    "liquidity": ("liquidity", "liquid"),
    "reserve": ("reserve", "reserves"),
    "pool": ("pool", "pools"),
    "vault": ("vault", "vaults"),
    "position": ("position", "positions"),
    "claimable": ("claim", "claimable"),
    "pending": ("pending",),
    "reward": ("reward", "rewards", "emission", "emissions", "vesting", "vest"),
    "asset": ("asset", "assets", "principal"),
    "cap": ("cap", "limit", "max", "min"),
    "config": ("config", "settings", "params", "parameter", "merkle"),
    "upgrade": ("upgrade", "upgrader", "implementation", "impl", "proxy", "logic", "beacon"),
    "pause": ("pause", "paused", "pausable", "pauser"),
    "allowlist": ("whitelist", "allowlist", "allow", "allowed"),
    "denylist": ("blacklist", "denylist", "blocked"),
    "oracle": ("oracle", "price", "twap", "feed", "pricefeed"),
    "treasury": ("treasury", "vault", "reserve"),
    "nonce": ("nonce", "nonces"),
    "signer": ("signer", "signers", "validator", "validators"),
    "governance": ("governance", "governor", "timelock", "council", "quorum", "voting", "proposal", "threshold", "delay", "guardian"),
    "shares": ("share", "shares"),
    "lock": ("lock", "locked", "mutex", "guard", "reentrancy"),
    "dependency": ("router", "strategy", "adapter", "module", "bridge", "relayer", "endpoint", "messaging", "amm", "dex", "pair", "pool", "vault", "controller", "manager", "aggregator", "lending", "borrow", "staking", "farm"),
}
# Tags of modifiers: each needs one of the alternatives, all of whose parts must occur.
MODIFIER_TAGS = {
    "only_owner": (("only", "owner"),),
    "only_admin": (("only", "admin"),),
    "role": (("role",), ("accesscontrol",)),
    "governance": (("governor",), ("governance",), ("guardian",)),
    "allowlist": (("whitelist",), ("allowlist",)),
    "pause": (("pauser",), ("pause",)),
}
# Tags that mark privileged state.
PRIVILEGED = ("owner", "role", "governance", "upgrade", "pause", "allowlist", "denylist", "oracle", "treasury", "signer")


def tokens(name: Column) -> Column:
    """Distinct lower-case parts at _ - . and before capitals."""
    marked = F.regexp_replace(F.regexp_replace(name, "[-. ]", "_"), "(?<!^)(?=[A-Z])", "_")
    return F.array_distinct(F.filter(F.split(F.lower(marked), "_"), lambda t: t != ""))


def tags_of(parts: Column, table: dict[str, tuple[str, ...]] = NAME_TAGS) -> Column:
    """Sorted tags whose tokens meet parts."""
    each = [F.when(F.arrays_overlap(parts, F.array(*map(F.lit, words))), F.lit(tag)) for tag, words in table.items()]
    return F.array_sort(F.array_compact(F.array(*each)))


def name_tags(name: Column) -> Column:
    return tags_of(tokens(name))


def modifier_tags(modifiers: Column) -> Column:
    def one(tag: str) -> Column:
        def holds(m: Column) -> Column:
            found = F.lit(False)
            for parts in MODIFIER_TAGS[tag]:
                every = F.lit(True)
                for p in parts:
                    every = every & F.contains(F.lower(m), F.lit(p))
                found = found | every
            return found

        return F.when(F.exists(modifiers, holds), F.lit(tag))

    return F.array_sort(F.array_compact(F.array(*map(one, MODIFIER_TAGS))))


def privileged(tags: Column) -> Column:
    return F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, PRIVILEGED))), F.lit(False))


def graph_id(paths: Column) -> Column:
    """Of the sorted paths; 12 hex digits."""
    return F.substring(F.sha2(F.array_join(F.array_sort(paths), "\n"), 256), 1, 12)


def _word(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def finding_id(tool: str, rule: Column, path: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit(f"{tool}:"), F.substring(F.sha1(F.concat_ws(":", *map(_word, (rule, path, start, end)))), 1, 12))


def work_item_id(title: Column, timestamp: Column) -> Column:
    return F.concat(F.lit("bd-"), F.substring(F.sha2(F.concat_ws(":", title, timestamp), 256), 1, 8))


def context_item_id(kind: Column, protocol: Column, timestamp: Column) -> Column:
    return F.concat(F.lit("CTX-"), F.substring(F.sha2(F.concat_ws(":", kind, protocol, timestamp), 256), 1, 12))


def run_id(session: Column, tool: Column) -> Column:
    return F.concat_ws(":", F.nullif(session, F.lit("")), tool)


def edge_id(id_: Column, source: Column, target: Column) -> Column:
    return F.coalesce(id_, F.concat(source, F.lit("->"), target))


def row_hash(*columns: Column) -> Column:
    """A content hash for change detection."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def pragma_version(text: Column) -> Column:
    """First x.y.z of the pragma, else x.y with .0; null without one."""
    line = F.regexp_extract(text, r"(?m)^\s*pragma\s+solidity\s+([^;]+);", 1)
    full, short = F.regexp_extract(line, r"(\d+\.\d+\.\d+)", 1), F.regexp_extract(line, r"(\d+\.\d+)", 1)
    return F.when(full != "", full).when(short != "", F.concat(short, F.lit(".0")))


def all_matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def invariant_state(strength: Column) -> Column:
    """verified if proven, violated if known to be, else open."""
    x = F.lower(strength)
    return F.when(x == "proven", "verified").when(x == "violated", "violated").otherwise("open")


def invariant_assertion(predicate: Column, name: Column) -> Column:
    return F.concat(F.lit("assert("), predicate, F.lit("); // "), name)
