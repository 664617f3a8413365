"""Scores and scalar rules as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | float | int


def col(x: Value | str) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clamp(x: Value, low: float, high: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def clamp01(x: Value) -> Column:
    return clamp(x, 0.0, 1.0)


def lerp(a: Value, b: Value, t: Value) -> Column:
    return col(a) + (col(b) - col(a)) * col(t)


def banded(x: Value, bands: list[tuple[float, object]], otherwise: object, strict: bool = False) -> Column:
    """The value of the first band, from the top, whose edge x reaches (or passes, if strict)."""
    x = col(x)
    out = None
    for edge, value in bands:
        test = x > edge if strict else x >= edge
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def half_life(age: Value, life: Value) -> Column:
    """0.5 ** (age / life); 1 without a half-life or for an age of 0 or less."""
    age, life = col(age), col(life)
    return F.when(life.isNull() | (age <= 0), F.lit(1.0)).otherwise(F.pow(F.lit(0.5), age / life))


def staleness(age: Value, sla: Value) -> Column:
    age, sla = col(age), col(sla)
    return F.when(age <= sla, "fresh").when(age < 2 * sla, "stale").otherwise("critical")


def freshness_confidence(age: Value, sla: Value) -> Column:
    """1 within the SLA, falling to 0.5 at twice the SLA, then 0.5 * sla / age but 0.1 at least; unknown age 0.5."""
    age, sla = col(age), col(sla)
    return F.when(age.isNull(), 0.5).when(age <= sla, 1.0).when(age <= 2 * sla, 1 - 0.5 * (age - sla) / sla).otherwise(F.greatest(F.lit(0.1), 0.5 * sla / age))


def stale_reason(relative: Value, absolute: Value, dependency: Value, limit: float = 0.5) -> Column:
    """Which check makes an item stale first: relative, absolute, dependency (freshness under the limit), or none."""
    return F.when(col(relative), "relative").when(col(absolute), "absolute").when(col(dependency) < limit, "dependency").otherwise("none")


def refresh_priority(stale: Value, access: Value, impact: Value) -> Column:
    return 0.5 * col(stale) + 0.3 * col(access) + 0.2 * col(impact)


def priority_band(score: Value) -> Column:
    return banded(score, [(0.7, "high"), (0.4, "normal")], "low", strict=True)


def recency(days: Value, decay_days: float, default: float) -> Column:
    d = col(days)
    return F.when(d.isNull(), default).otherwise(F.exp(-F.greatest(d, F.lit(0)) / decay_days))


def mean_present(*signals: Column, default: float = 0.5) -> Column:
    """The mean of the signals that are not null."""
    there = reduce(lambda a, b: a + b, [s.isNotNull().cast("int") for s in signals])
    total = reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(0.0)) for s in signals])
    return F.when(there > 0, total / there).otherwise(F.lit(default))


def capped(x: Value, cap: float, factor: float = 1.0) -> Column:
    """x / cap, 1 at most, times factor, 1 at most; null stays null (least would skip it)."""
    return F.when(col(x).isNotNull(), F.least(F.lit(1.0), F.least(F.lit(1.0), col(x) / cap) * factor))


def churn_score(commits: Value, authors: Value, recent: Value, frequency: Value, cochange: Value) -> Column:
    """Caps: 100 commits, 10 authors, 20 recent changes (weight 1.3), 10 changes a month (0.5), strength (0.3)."""
    return mean_present(capped(commits, 100), capped(authors, 10), capped(recent, 20, 1.3), capped(frequency, 10, 0.5), col(cochange) * 0.3)


def hotspot_score(churn: Value, complexity: Value) -> Column:
    return F.pow(col(churn), F.lit(0.7)) * F.pow(col(complexity), F.lit(0.5))


def debt_total(signals: dict[str, Column], weights: dict[str, float]) -> Column:
    return F.least(F.lit(100.0), reduce(lambda a, b: a + b, [signals[k] * w for k, w in weights.items()]))


def debt_priority(total: Value) -> Column:
    return banded(total, [(80, "critical"), (60, "high"), (40, "medium")], "low")


def grade(score: Value) -> Column:
    return banded(score, [(90, "A"), (80, "B"), (70, "C"), (60, "D")], "F")


def complexity_debt(lines: Value, functions: Value, cyclomatic: Value | None = None) -> Column:
    """Points by bands: lines over 150 / 300 / 500, functions over 10 / 20 / 50, branches over 15 / 30 / 60."""
    out = banded(lines, [(500, 40), (300, 25), (150, 10)], 0, strict=True) + banded(functions, [(50, 30), (20, 20), (10, 10)], 0, strict=True)
    if cyclomatic is not None:
        out = out + banded(cyclomatic, [(60, 30), (30, 20), (15, 10)], 0, strict=True)
    return F.least(out, F.lit(100))


def debt_roi(interest: Value, principal: Value, sprints: int = 12) -> Column:
    return F.when(col(principal) <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), (col(interest) - 1) * sprints))


def debt_risk(severity: Value, files: Value, days: Value, interest: Value) -> Column:
    one = F.lit(1.0)
    return 100 * (0.4 * col(severity) + 0.2 * F.least(one, col(files) / 20) + 0.2 * F.least(one, col(days) / 365) + 0.2 * F.least(one, F.greatest(F.lit(0.0), 10 * (col(interest) - 1))))


def unblock_score(dependents: Value) -> Column:
    n = col(dependents)
    return F.when(n <= 0, 20.0).otherwise(F.least(F.lit(85.0), 40 + 25 * F.log2(n + 1)))


def momentum_score(related: Value) -> Column:
    return F.least(F.lit(85.0), 50 + 10.0 * col(related))


def time_decay_bonus(days: Value, after: float, rate: float, most: float) -> Column:
    d = col(days)
    return F.when(d > after, F.least(F.lit(most), (d - after) * rate)).when(d < 7, 10.0).otherwise(0.0)


def diff_complexity(hunks: Value, added: Value, removed: Value) -> Column:
    """Hunks of 5, changed lines of 100, and how one-sided the change is."""
    n = col(added) + col(removed)
    balance = F.when(n > 0, F.abs(col(added) - col(removed)) / n).otherwise(0.0)
    return 0.3 * F.least(F.lit(1.0), col(hunks) / 5) + 0.4 * F.least(F.lit(1.0), n / 100) + 0.3 * (1 - balance)


def uncertainty(p: Value) -> tuple[Column, Column]:
    """Binary entropy in bits and variance."""
    p = col(p)
    entropy = F.when((p <= 0) | (p >= 1), 0.0).otherwise(-(p * F.log2(p)) - (1 - p) * F.log2(1 - p))
    return entropy, p * (1 - p)


def edge_confidence(source: Value, exact_line: Value, resolved: Value, ambiguous: Value, external: Value) -> Column:
    """0.5 + by source (compiler .35, parser .2, heuristic .1) + .05 line + .05 resolved - .1 ambiguous - .15 external, within .15 to .95."""
    s = col(source)
    base = F.when(s == "compiler", 0.35).when(s == "parser", 0.2).when(s == "heuristic", 0.1).otherwise(0.0)
    return clamp(0.5 + base + 0.05 * col(exact_line).cast("int") + 0.05 * col(resolved).cast("int") - 0.1 * col(ambiguous).cast("int") - 0.15 * col(external).cast("int"), 0.15, 0.95)


def escalation(mean_confidence: Value, entropy: Value) -> Column:
    """How far retrieval escalates: thresholds .2, .4, .6 on mean confidence, 1.5 and 2 bits on entropy."""
    c, e = col(mean_confidence), col(entropy)
    return F.when(c < 0.2, "full").when((c < 0.4) | (e > 2.0), "deep").when((c < 0.6) | (e > 1.5), "widen").otherwise("none")


def doc_bias(similarity: Value, is_doc: Value, bias: float) -> Column:
    s = col(similarity)
    return F.when(col(is_doc), F.least(F.lit(1.0), s * (1 + 0.5 * (bias - 0.3)))).otherwise(s) if bias > 0.3 else s


def definition_bias(similarity: Value, is_definition: Value, bias: float) -> Column:
    s = col(similarity)
    if bias <= 0.1:
        return s
    return F.when(col(is_definition), F.least(F.lit(1.0), s * (1 + 1.5 * bias))).otherwise(s * (1 - 0.7 * bias) if bias > 0.3 else s)


def entry_bias(similarity: Value, is_entry: Value, is_helper: Value, bias: float) -> Column:
    s = col(similarity)
    if bias <= 0.1:
        return s
    helped = F.when(col(is_helper), s * (1 - 0.2 * bias)).otherwise(s) if bias > 0.5 else s
    return F.when(col(is_entry), F.least(F.lit(1.0), s * (1 + 0.6 * bias))).otherwise(helped)
