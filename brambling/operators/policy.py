"""Decisions as ordered conditions: tool policy, grants, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decide(tool: Column, kinds: dict[str, str], owner: Column, known: Column) -> Column:
    """Unknown tools are denied, reading is allowed, gated tools need approval, the owner may write."""
    kind = F.coalesce(*[F.when(tool == t, k) for t, k in kinds.items()], F.lit("unknown"))
    return F.when(kind == "unknown", "DENY").when(kind == "read", "ALLOW").when(kind == "gated", "REQUIRES_APPROVAL").when(~known, "DENY").when(owner & kind.isin("write", "delegate"), "ALLOW").otherwise("DENY")


def match_grants(requests: DataFrame, grants: DataFrame, key: str, scope: str, now: Column) -> DataFrame:
    """Requests with the newest grant that fits: unexpired, and for the request's scope or any ('').

    The wildcard is a second equi-join, not a comparison of every request with every grant.
    """
    live = grants.filter(F.col("status") == "active").filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    exact = requests.join(live.filter(F.col(scope) != ""), [key, scope])
    wild = requests.join(live.filter(F.col(scope) == "").drop(scope), key)
    both = exact.unionByName(wild)
    return both.groupBy(*requests.columns).agg(F.max_by("grant_id", F.struct("created_at", "grant_id")).alias("grant_id"))
