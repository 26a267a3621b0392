"""Access rules, scan overrides and combination rules over call tables.

Rule tables are small and ordered: the first that matches wins. They are turned into columns at plan time, so a call
table of any size is judged without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ToolRule:
    match: str
    action: str = "allow"
    roles: tuple[str, ...] = ()
    note: str = ""


@dataclass(frozen=True)
class ScanOverride:
    match: str
    values: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Combination:
    id: str
    all_of: tuple[str, ...]
    window_ms: int = 600_000
    action: str = "deny"


@dataclass(frozen=True)
class Policy:
    """Rules by server and tool; ``roles`` maps an identity to its roles, ``servers`` a server to the roles it admits."""

    tools: tuple[ToolRule, ...] = (ToolRule("*"),)
    roles: dict = field(default_factory=dict)
    servers: dict = field(default_factory=dict)
    overrides: tuple[ScanOverride, ...] = ()
    combinations: tuple[Combination, ...] = ()

    def __post_init__(self):
        for c in self.combinations:
            if not 2 <= len(c.all_of) <= 8:
                raise ValueError(f"combination {c.id} needs 2 to 8 patterns")
        for r in self.tools:
            if r.action not in ("allow", "deny"):
                raise ValueError(f"rule {r.match}: no such action {r.action}")


#: How a text is scanned where no override says otherwise.
SCAN_DEFAULTS = {"action": "flag", "flag_at": 40, "block_at": 70, "max_bytes": 262_144, "on_degraded": "flag"}


def tool_key(server: Column, tool: Column) -> Column:
    return F.concat_ws("__", server, tool)


def glob_pattern(glob: str) -> str:
    """An anchored pattern: * is any run and ? any one character, line ends excepted."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob) + r"\z"


def matches(key: Column, glob: str) -> Column:
    """A glob as the cheapest expression that says the same."""
    body = glob.rstrip("*")
    if glob == "*":
        return ~key.contains("\n")
    if not re.search(r"[*?]", glob):
        return key == glob
    if len(glob) - len(body) == 1 and not re.search(r"[*?]", body):
        return key.startswith(body) & ~key.contains("\n")
    return key.rlike(glob_pattern(glob))


def roles_for(identity: Column, policy: Policy) -> Column:
    """The caller's roles; an unknown or missing identity has none."""
    out = F.array().cast("array<string>")
    for who, roles in policy.roles.items():
        out = F.when(identity == who, F.array(*map(F.lit, roles)).cast("array<string>")).otherwise(out)
    return out


def _holds(roles: Column, wanted) -> Column:
    return F.arrays_overlap(roles, F.array(*map(F.lit, wanted))) if wanted else F.lit(True)


def server_admits(server: Column, roles: Column, policy: Policy) -> Column:
    """False only where the server names roles and the caller holds none of them."""
    out = F.lit(True)
    for name, wanted in policy.servers.items():
        out = F.when(server == name, _holds(roles, wanted)).otherwise(out)
    return out


def first_match(key: Column, roles: Column, policy: Policy) -> Column:
    """Index of the first rule that fits key and roles; null if none does."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(policy.tools))):
        out = F.when(matches(key, rule.match) & _holds(roles, rule.roles), F.lit(i)).otherwise(out)
    return out


def access(calls: DataFrame, policy: Policy) -> DataFrame:
    """``calls`` (server_name, tool_name, identity) with rule, decision and reason; no rule means allow."""
    roles = roles_for(F.col("identity"), policy)
    rows = calls.withColumn("_roles", roles).withColumn("admitted", server_admits(F.col("server_name"), F.col("_roles"), policy))
    rows = rows.withColumn("rule", F.when(F.col("admitted"), first_match(tool_key(F.col("server_name"), F.col("tool_name")), F.col("_roles"), policy)))
    action = F.element_at(F.array(*[F.lit(r.action) for r in policy.tools]), F.col("rule") + 1) if policy.tools else F.lit("allow")
    decision = F.when(~F.col("admitted"), "deny").otherwise(F.coalesce(F.when(F.col("rule").isNotNull(), action), F.lit("allow")))
    reason = F.when(~F.col("admitted"), "server").when(F.col("rule").isNotNull(), "rule").otherwise("default")
    return rows.withColumn("decision", decision).withColumn("reason", reason).drop("_roles")


def scan_settings(calls: DataFrame, policy: Policy, defaults: dict | None = None) -> DataFrame:
    """``calls`` with the scan settings of the first override that matches the tool, field by field over the defaults."""
    key = tool_key(F.col("server_name"), F.col("tool_name"))
    out = calls
    for name, value in (defaults or SCAN_DEFAULTS).items():
        chosen = F.lit(value)
        for o in reversed(policy.overrides):
            chosen = F.when(matches(key, o.match), F.lit(o.values.get(name, value))).otherwise(chosen)
        out = out.withColumn(name, chosen)
    return out


#: Fixed value: UTF-16 units of the longest tool name that combination rules follow.
MAX_TRACKED_NAME = 4096


def server_name_check(server: Column, policy: Policy, enforce: bool = True) -> Column:
    """``error`` (``event`` where the policy isn't enforced) if the policy names servers but not this one, else ``ok``."""
    if not policy.servers:
        return F.lit("ok")
    return F.when(F.coalesce(server.isin(list(policy.servers)), F.lit(False)), "ok").otherwise("error" if enforce else "event")


def name_too_long(tool: Column, policy: Policy, enforce: bool = True, most: int = MAX_TRACKED_NAME) -> Column:
    """What becomes of a call whose tool name is too long to follow: ``deny`` if an enforced combination denies, else ``flag``.

    Null for other calls, and for all if there are no combinations.
    """
    if not policy.combinations:
        return F.lit(None).cast("string")
    denies = enforce and any(c.action == "deny" for c in policy.combinations)
    return F.when(F.octet_length(F.encode(tool, "UTF-16BE")) > 2 * most, "deny" if denies else "flag")


def _frame(key: str, at: str, window_ms: int):
    return Window.partitionBy(key).orderBy(at).rangeBetween(-window_ms, 0)


def combination_hits(calls: DataFrame, combination: Combination, session: str = "session_id", at: str = "at_ms", order: str = "call_id") -> DataFrame:
    """``calls`` with ``hit``: whether this call completes the combination.

    A call hits when it matches one of the patterns and the calls of its session up to ``window_ms`` before it (and those
    before it at the same time, by ``order``) can be dealt to the patterns one to one. By Hall's theorem that is so
    when, for every set of patterns, at least as many calls match one of them as the set has patterns. Calls at one
    time see each other only backwards.
    """
    globs = combination.all_of
    key = tool_key(F.col("server_name"), F.col("tool_name"))
    rows = calls
    for i, g in enumerate(globs):
        rows = rows.withColumn(f"_m{i}", matches(key, g))
    wide = _frame(session, at, combination.window_ms)
    later = Window.partitionBy(session, at).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    enough = F.lit(True)
    for subset in range(1, 1 << len(globs)):
        members = [i for i in range(len(globs)) if subset >> i & 1]
        some = F.lit(False)
        for i in members:
            some = some | F.col(f"_m{i}")
        n = F.sum(some.cast("int")).over(wide) - F.coalesce(F.sum(some.cast("int")).over(later), F.lit(0))
        enough = enough & (n >= len(members))
    mine = F.lit(False)
    for i in range(len(globs)):
        mine = mine | F.col(f"_m{i}")
    return rows.withColumn("hit", mine & enough).drop(*[f"_m{i}" for i in range(len(globs))])
