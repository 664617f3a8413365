"""The registry of scoring signals: each gives a score and a confidence as Columns. Users add their own with register()."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions import scores as S

_SIGNALS: dict[str, Callable[..., tuple[Column, Column]]] = {}


def register(name: str):
    def add(f):
        _SIGNALS[name] = f
        return f

    return add


def signal(name: str) -> Callable[..., tuple[Column, Column]]:
    return _SIGNALS[name]


def names() -> list[str]:
    return sorted(_SIGNALS)


def _known(x: Column, score: Column, confidence: float, missing: tuple[float, float]) -> tuple[Column, Column]:
    return F.when(x.isNull(), missing[0]).otherwise(score), F.when(x.isNull(), missing[1]).otherwise(confidence)


@register("semantic")
def semantic(similarity):
    return F.greatest(S.col(similarity), F.lit(0.0)) + S.col(similarity) * 0, F.lit(0.9)


@register("structural")
def structural(distance):
    d = S.col(distance)
    return _known(d, F.exp(-d / 5.0), 0.7, (0.5, 0.3))


@register("recency")
def recency(hours):
    return F.exp(-S.col(hours) / 24.0), F.lit(0.6)


@register("keyword")
def keyword(terms, name, path, content):
    """Equal name 1, name holds a term .9, path holds one .75, all terms in content .65, else .3 + .05 a hit, .5 at most. Terms of 3 letters or more."""
    t = F.filter(S.col(terms), lambda x: F.length(x) >= 3)
    n, p, c = (F.lower(S.col(x)) for x in (name, path, content))
    hits = F.size(F.filter(t, lambda x: c.contains(x)))
    score = F.when(F.exists(t, lambda x: n == x), 1.0).when(F.exists(t, lambda x: n.contains(x)), 0.9).when(F.exists(t, lambda x: p.contains(x)), 0.75).when((F.size(t) > 0) & (hits == F.size(t)), 0.65)
    return score.when(hits > 0, F.least(F.lit(0.5), 0.3 + 0.05 * hits)).otherwise(0.0), F.lit(0.8)


@register("domain")
def domain(domains, wanted):
    return F.size(F.array_intersect(S.col(domains), S.col(wanted))) / F.greatest(F.size(S.col(wanted)), F.lit(1)), F.lit(0.85)


@register("entity_type")
def entity_type(matches):
    return S.col(matches).cast("double"), F.lit(0.9)


@register("ownership")
def ownership(owners, user, team):
    return F.when(F.array_contains(S.col(owners), user), 1.0).when(F.arrays_overlap(S.col(owners), S.col(team)), 0.8).otherwise(0.0), F.lit(0.8)


@register("risk")
def risk(value):
    return S.clamp01(value), F.lit(0.7)


@register("test")
def test(coverage):
    return S.clamp01(coverage), F.lit(0.6)


@register("dependency")
def dependency(neighbours, target):
    return F.when(F.array_contains(S.col(neighbours), target), 1.0).otherwise(0.5), F.lit(0.7)


@register("history")
def history(changes):
    return F.least(F.lit(1.0), S.col(changes) / 100), F.lit(0.6)


@register("hotspot")
def hotspot(churn, complexity):
    return S.hotspot_score(churn, complexity), F.lit(0.7)


@register("directory_affinity")
def directory_affinity(path, targets: list[str], competing: list[str]):
    """1 in a target folder, .15 in a competing one, .35 elsewhere; .5 without targets; .3 without a path."""
    p = S.col(path)
    if not targets:
        return F.lit(0.5), F.lit(0.2)
    inside = lambda folders: F.lit(False) if not folders else F.greatest(*[F.coalesce(p.startswith(f.rstrip("/") + "/"), F.lit(False)) for f in folders], F.lit(False))
    score = F.when(p.isNull(), 0.3).when(inside(targets), 1.0).when(inside(competing), 0.15).otherwise(0.35)
    return score, F.when(p.isNull(), 0.3).when(inside(targets), 0.85).when(inside(competing), 0.8).otherwise(0.6)


def update_weights(weights: dict[str, float], feedback: list[tuple[str, float, float, float]], rate: float = 0.1) -> dict[str, float]:
    """Fold (signal, target, score, confidence) in order: w += rate * (target - score) * confidence, within .01 to .5, then all sum to 1."""
    out = dict(weights)
    for name, target, score, confidence in feedback:
        out[name] = min(0.5, max(0.01, out[name] + rate * (target - score) * confidence))
        total = sum(out.values())
        out = {k: v / total for k, v in out.items()}
    return out
