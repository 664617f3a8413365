"""Factors of a work item's priority as Columns of 0 to 100."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions.scores import banded, clamp, col

#: Points by level of impact (to users, and for the effort), of risk, and by complexity of the effort.
IMPACT = {"none": 10, "minimal": 25, "low": 40, "medium": 55, "high": 75, "critical": 95}
VALUE = {"none": 10, "minimal": 25, "low": 40, "medium": 60, "high": 80, "critical": 95}
RISK = {"none": 0, "minimal": 5, "low": 15, "medium": 30, "high": 50, "critical": 70}
EASE = {"trivial": 95, "simple": 75, "moderate": 50, "complex": 25, "heroic": 10}
#: Parts of tags that tell of risk or of compliance.
RISK_TAGS = ["security", "vulnerability", "compliance", "stability", "reliability", "critical-bug", "data-integrity"]
COMPLIANCE_TAGS = ["compliance", "regulatory", "audit", "legal", "gdpr", "hipaa"]


def points(level: Column | str, table: dict[str, int], otherwise: int) -> Column:
    """The points of a level; `otherwise` for null and unknown ones."""
    out = F.lit(otherwise)
    for name, n in table.items():
        out = F.when(col(level) == name, F.lit(n)).otherwise(out)
    return out


def _holding(tags: Column | str, parts: list[str]) -> Column:
    """Those of the tags that hold one of the parts, in any case."""
    tags = F.coalesce(col(tags), F.array().cast("array<string>"))
    return F.filter(tags, lambda t: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(F.lower(t), p)))


def strategic_alignment(ranks: Column | str) -> Column:
    """ranks: the priorities (1 to 3) of the pillars an item serves. Null: no pillars are set, 50; none served: 30."""
    ranks = col(ranks)
    bonus = F.aggregate(ranks, F.lit(50).cast("long"), lambda acc, r: acc + (4 - r) * 15)
    return F.when(ranks.isNull(), F.lit(50)).when(F.size(ranks) == 0, F.lit(30)).otherwise(clamp(bonus, 0, 100))


def user_impact(level: Column | str, users: Column | str, reversibility: Column | str) -> Column:
    """50 without a level. users: 'all', 'subset' or a count as text; 1.3 times for all, 1.2 beyond 1000, and 1.15 times more where hard to undo."""
    level, users = col(level), col(users)
    wide = F.when(users == "all", F.lit(1.3)).when(users.try_cast("double") > 1000, F.lit(1.2)).otherwise(F.lit(1.0))
    hard = F.when(col(reversibility).isin("irreversible", "difficult"), F.lit(1.15)).otherwise(F.lit(1.0))
    return F.when(level.isNull(), F.lit(50.0)).otherwise(F.least(F.lit(100.0), points(level, IMPACT, 50) * wide * hard))


def risk_reduction(tags: Column | str, risk: Column | str, kind: Column | str) -> Column:
    """30, 20 for each tag of risk, the points of the risk's level and 15 for work on debt; 100 at most."""
    debt = F.when(col(kind) == "debt", F.lit(15)).otherwise(F.lit(0))
    return F.least(F.lit(100), 30 + 20 * F.size(_holding(tags, RISK_TAGS)) + points(risk, RISK, 0) + debt)


def effort_value(level: Column | str, complexity: Column | str) -> Column:
    """What is won times how easy it is, over 100. Null levels are medium, null complexities moderate."""
    return points(F.coalesce(col(level), F.lit("medium")), VALUE, 50) * points(F.coalesce(col(complexity), F.lit("moderate")), EASE, 50) / 100


def external_pressure(days_left: Column | str, hard: Column | str, references: Column | str, tags: Column | str) -> Column:
    """By days to the deadline (null: none, 30), 10 more (100 at most) for a hard one, 5 a reference from outside, 20 for tags of compliance; 100 at most."""
    days = col(days_left)
    near = F.when(days.isNull(), F.lit(30)).otherwise(banded(days, [(14, 30), (7, 60), (3, 75), (0, 90)], 95))
    due = F.when(days.isNotNull() & F.coalesce(col(hard), F.lit(False)), F.least(F.lit(100), near + 10)).otherwise(near)
    ruled = F.when(F.size(_holding(tags, COMPLIANCE_TAGS)) > 0, F.lit(20)).otherwise(F.lit(0))
    return F.least(F.lit(100), due + 5 * F.coalesce(col(references), F.lit(0)) + ruled)
