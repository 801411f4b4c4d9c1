"""Who may call what: fingerprints, grants, approvals, guards, routing, guarded changes of state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a grant of a capability allows.
GRANT_TOOLS = {
    "file.read": ["read_file", "list_dir", "search_content"],
    "file.write": ["write_file", "edit_file", "restore_file"],
    "file.delete": ["delete_file"],
    "command": ["run_command"],
    "network": ["web_search", "web_fetch"],
    "delegate": ["dispatch_to_agent"],
    "ssh": ["ssh_run", "ssh_get", "ssh_put"],
}


#: An approval lets through calls of the same scope only.
SCOPE = ["account", "space", "principal", "tool", "fingerprint"]


def quoted(text: Column) -> Column:
    """A string as JSON, control characters in lower-case digits; a backslash before ``u`` counts where it is not itself escaped."""
    listed = F.to_json(F.array(text))
    quoted = F.substring(listed, F.lit(2), F.length(listed) - 2)
    for digit in "ABCDEF":
        quoted = F.regexp_replace(quoted, f"(?<!\\\\)((?:\\\\\\\\)*)\\\\u00([01]){digit}", f"$1\\\\u00$2{digit.lower()}")
    return quoted


def fingerprint(tool: Column, args: Column) -> Column:
    """The digest that names a call: JSON with sorted keys of the tool and its arguments (a map from names to JSON values)."""
    pairs = F.transform(F.array_sort(F.map_entries(args)), lambda e: F.concat(quoted(e["key"]), F.lit(": "), e["value"]))
    return F.sha2(F.concat(F.lit('{"args": {'), F.array_join(pairs, ", "), F.lit('}, "tool": '), quoted(tool), F.lit("}")), 256)


def capability_of(tool: Column, tools: dict[str, list[str]] = GRANT_TOOLS) -> Column:
    """The first capability that has the tool; null where none has."""
    return F.coalesce(*[F.when(tool.isin(*names), name) for name, names in tools.items()])


def resolve(requests: DataFrame, grants: DataFrame, approvals: DataFrame, policies: DataFrame, now: Column) -> DataFrame:
    """requests (request_id, account, space, principal, tool, conversation, fingerprint, decision) with outcome, reason and approval_id.

    A grant (request_id) overrides any refusal. A request that needs approval is refused where its
    conversation's policy is ``never``; else the newest of the unexpired approvals of its whole scope (account, space, principal, tool,
    fingerprint) that isn't denied counts, by requested_at (of equal ones the greatest id): an approved one allows, any other is
    waited for even if an older one is approved, and where there is none a new one is due.
    """
    live = approvals.filter((F.col("expires_at") > now) & (F.col("status") != "denied"))
    best = live.groupBy(*SCOPE).agg(F.max_by(F.struct("approval_id", "status"), F.struct("requested_at", "approval_id")).alias("a"))
    given = grants.select("request_id", F.lit(True).alias("granted")).distinct()
    rows = requests.join(given, "request_id", "left").join(policies, "conversation", "left").join(best, SCOPE, "left")
    asks, never = F.col("decision") == "REQUIRES_APPROVAL", F.coalesce(F.col("approval_policy") == "never", F.lit(False))
    steps = [
        (F.col("decision") == "ALLOW", "ALLOW", "policy"),
        (F.col("granted").isNotNull(), "ALLOW", "grant_allowed"),
        (~asks, "DENY", "denied"),
        (never, "REQUIRES_APPROVAL", "approval_policy_never"),
        (F.coalesce(F.col("a.status") == "approved", F.lit(False)), "ALLOW", "approval_granted"),
        (F.col("a.status").isNotNull(), "REQUIRES_APPROVAL", "approval_pending"),
    ]
    step = F.coalesce(*[F.when(c, F.struct(F.lit(o).alias("outcome"), F.lit(r).alias("reason"))) for c, o, r in steps], F.struct(F.lit("REQUIRES_APPROVAL").alias("outcome"), F.lit("approval_due").alias("reason")))
    used = F.when(step["reason"].isin("approval_granted", "approval_pending"), F.col("a.approval_id"))
    return rows.select(*[F.col(c) for c in requests.columns], step["outcome"].alias("outcome"), step["reason"].alias("reason"), used.alias("approval_id"))


class Guards:
    """Conditions that refuse a call, in the order they were added; the first reason counts and none can allow."""

    def __init__(self) -> None:
        self._all: dict[int, tuple[str, Column]] = {}
        self._next = 0

    def add(self, reason: str, refuses: Column) -> Callable[[], None]:
        """Adds a guard and returns what takes it away again."""
        me, self._next = self._next, self._next + 1
        self._all[me] = (reason, refuses)
        return lambda: self._all.pop(me, None) and None

    def reason(self) -> Column:
        """The first guard that refuses a row, null where none does; a guard that can't tell refuses."""
        whens = [F.when(F.coalesce(c, F.lit(True)), F.when(c.isNull(), "guard_internal_error").otherwise(r)) for r, c in self._all.values()]
        return F.coalesce(*whens, F.lit(None).cast("string"))


def visible(tools: DataFrame, decision: Column) -> DataFrame:
    """The tools that a caller is told of: those it may use, at least with approval."""
    return tools.filter(decision.isin("ALLOW", "REQUIRES_APPROVAL"))


def route(principals: DataFrame, links: DataFrame) -> DataFrame:
    """Adds route: owners by credential or token, others only from an approved device of a linked account."""
    linked = links.filter("link_status = 'active' and owner_status = 'active'").select("account_id", F.lit(True).alias("_linked")).distinct()
    rows = principals.join(linked, "account_id", "left")
    owner = F.col("credential").isNotNull() | ((F.col("principal_id") == "principal-owner") & (F.col("token_id") == "token-owner"))
    step = F.when(F.coalesce(owner, F.lit(False)), "owner").when(F.coalesce(F.col("device_status") != "approved", F.lit(True)), "assistant").when(F.col("_linked").isNotNull(), "owner").otherwise("assistant")
    return rows.select(*[F.col(c) for c in principals.columns], step.alias("route"))


def decide(rows: DataFrame, decisions: DataFrame, key: str, now: Column, open_status: str = "pending", expires: str | None = "expires_at") -> DataFrame:
    """Guarded change of state: the first decision for a row takes effect if the row is open and unexpired. A decision without
    a time is made ``now``; of decisions at one time the first in the alphabet counts.

    Rows that aren't open stay as they are; an open row that a decision meets after its time becomes
    ``expired``. Decisions for rows that don't exist change nothing.
    """
    made = F.coalesce("decided_at", now.cast(decisions.schema["decided_at"].dataType)).alias("decided_at")
    first = decisions.select(key, "decision", "decided_by", made).groupBy(key).agg(F.min(F.struct("decided_at", "decision", "decided_by")).alias("_d"))
    joined = rows.join(first, key, "left")
    meets = (F.col("status") == open_status) & F.col("_d").isNotNull()
    late = (F.col(expires) <= F.col("_d.decided_at")) if expires else F.lit(False)
    status = F.when(~meets, F.col("status")).when(late, "expired").otherwise(F.col("_d.decision"))
    keep = [F.col(c) for c in rows.columns if c not in ("status", "decided_at", "decided_by")]
    old = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    return joined.select(*keep, status.alias("status"), F.when(meets, F.col("_d.decided_at")).otherwise(old("decided_at")).alias("decided_at"), F.when(meets, F.col("_d.decided_by")).otherwise(old("decided_by")).alias("decided_by"))
