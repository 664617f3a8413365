"""Debt of an entity by kind, as Columns of 0 to 100, and the hours to mend it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions.scores import banded, col

#: Points of each band, of each clone type, of each severity of a loop, and hours that a kind of debt adds beyond its edge.
COVERAGE = [(0.8, 0), (0.6, 10), (0.4, 20), (0.2, 35)]
RISK = [(80, 50), (60, 35), (40, 20), (20, 10)]
CLONES = {"exact": 40, "renamed": 25, "similar": 15, "semantic": 10}
LOOPS = {"critical": 30, "high": 20, "medium": 10, "low": 5}
HOURS = {"architecture": (50, 8), "complexity": (70, 4), "duplication": (50, 2), "security": (50, 6)}


def _points(test: Column, points: int) -> Column:
    return F.when(test, F.lit(points)).otherwise(F.lit(0))


def coverage_debt(coverage: Column | str, tested: Column | str) -> Column:
    """50 without tests (null counts as none), 25 for an unknown coverage, else by band of the covered share."""
    coverage = col(coverage)
    known = F.when(coverage.isNull(), F.lit(25)).otherwise(banded(coverage, COVERAGE, 50))
    return F.when(F.coalesce(col(tested), F.lit(False)), known).otherwise(F.lit(50))


def documentation_debt(purpose: Column | str, summary: Column | str) -> Column:
    """30 for a purpose of under 10 characters, 20 for a summary of under 20; null is empty."""
    short = lambda c, n: F.coalesce(F.char_length(col(c)), F.lit(0)) < n
    return _points(short(purpose, 10), 30) + _points(short(summary, 20), 20)


def security_debt(risk: Column | str) -> Column:
    """By band of a risk of 0 to 100; an edge belongs to the band below it. Null: 0."""
    return banded(risk, RISK, 0, strict=True)


def duplication_debt(counts: dict[str, Column], shared_lines: Column | str) -> Column:
    """Points of each clone type that is there at all, 10 more beyond 200 shared lines, 100 at most. counts: clones by type; null is none."""
    found = [_points(F.coalesce(col(n), F.lit(0)) > 0, CLONES[kind]) for kind, n in counts.items()]
    return F.least(F.lit(100), sum(found, _points(F.coalesce(col(shared_lines), F.lit(0)) > 200, 10)))


def architecture_debt(cycle_size: Column | str, is_root: Column | str, loops: dict[str, Column]) -> Column:
    """40 within a cycle, 10 more for its root, and points for every open loop by severity; 100 at most. Null: no cycle, no loop."""
    cyclic = F.coalesce(col(cycle_size), F.lit(0)) > 1
    score = _points(cyclic, 40) + _points(cyclic & F.coalesce(col(is_root), F.lit(False)), 10)
    for severity, n in loops.items():
        score = score + F.coalesce(col(n), F.lit(0)) * LOOPS[severity]
    return F.least(F.lit(100), score)


def fix_hours(total: Column | str, kinds: dict[str, Column]) -> Column:
    """A tenth of the total debt and the hours of each kind beyond its edge, to a tenth of an hour."""
    extra = [_points(col(score) > HOURS[kind][0], HOURS[kind][1]) for kind, score in kinds.items() if kind in HOURS]
    return F.round(sum(extra, col(total) / 10), 1)
