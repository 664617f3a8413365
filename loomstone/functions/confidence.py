"""Confidence algebra, Bayesian updates, intervals, belief masses and information measures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions.scores import Value, clamp, clamp01, col

#: Normal quantiles by two-sided confidence.
Z = {0.90: 1.6448536269514722, 0.95: 1.959963984540054, 0.99: 2.5758293035489004}


def wilson(successes: Value, total: Value, confidence: float = 0.95) -> tuple[Column, Column]:
    s, n, z = col(successes).cast("double"), col(total).cast("double"), Z[confidence]
    p = s / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(1.0)


def smooth(successes: Value, total: Value, alpha: float, beta: float) -> Column:
    return (col(successes) + alpha) / (col(total) + alpha + beta)


def beta_mean(a: Value, b: Value) -> Column:
    return col(a) / (col(a) + col(b))


def beta_variance(a: Value, b: Value) -> Column:
    a, b = col(a), col(b)
    return a * b / ((a + b) * (a + b) * (a + b + 1))


def beta_interval(a: Value, b: Value) -> tuple[Column, Column]:
    """Normal approximation at 1.96 standard deviations, whatever the level."""
    mean, half = beta_mean(a, b), 1.96 * F.sqrt(beta_variance(a, b))
    return F.greatest(F.lit(0.0), mean - half), F.least(F.lit(1.0), mean + half)


def bayes_step(prior: Column, success: Column, if_true: float = 0.85, if_false: float = 0.35, damping: float = 0.7) -> Column:
    """One observation: posterior by likelihoods, the move damped, within .05 to .95."""
    yes = prior * if_true / (prior * if_true + (1 - prior) * if_false)
    no = prior * (1 - if_true) / (prior * (1 - if_true) + (1 - prior) * (1 - if_false))
    posterior = F.when(success, yes).otherwise(no)
    return clamp(prior + damping * (posterior - prior), 0.05, 0.95)


def bayes_fold(prior: Value, outcomes: Column, **options: float) -> Column:
    return F.aggregate(outcomes, col(prior).cast("double"), lambda p, s: bayes_step(p, s, **options))


def information_gain(prior: Value, posterior: Value) -> Column:
    """KL divergence of the posterior from the prior, in bits."""
    p, q = col(posterior), col(prior)
    return p * F.log2(p / q) + (1 - p) * F.log2((1 - p) / (1 - q))


def entropy_bits(parts: Column) -> Column:
    """Shannon entropy of an array of weights, made to sum to 1; zeros count nothing."""
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s - F.when(x > 0, x / total * F.log2(x / total)).otherwise(0.0))


def kl_bits(p: Column, q: Column) -> Column:
    return F.aggregate(F.zip_with(p, q, lambda a, b: F.when(a > 0, a * F.log2(a / b)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)


def js_bits(p: Column, q: Column) -> Column:
    m = F.zip_with(p, q, lambda a, b: (a + b) / 2)
    return 0.5 * kl_bits(p, m) + 0.5 * kl_bits(q, m)


def all_present(x: Value) -> Column:
    """For a group: has it rows, and no null among them."""
    return (F.count(F.lit(1)) > 0) & (F.count(F.lit(1)) == F.count(col(x)))


def sequence_confidence(x: Value) -> Column:
    """Group aggregate: the least; null if any is absent."""
    return F.when(all_present(x), F.min(col(x)))


def product(x: Value) -> Column:
    return F.product(col(x))


def parallel_all(x: Value, correlation: float = 0.0) -> Column:
    """Group aggregate: (1 - rho) * product + rho * least; null if any is absent."""
    return F.when(all_present(x), (1 - correlation) * F.product(col(x)) + correlation * F.min(col(x)))


def parallel_any(x: Value, correlation: float = 0.0, skip_absent: bool = False) -> Column:
    """Group aggregate: (1 - rho) * noisy or + rho * greatest; null if any is absent, unless those are skipped."""
    value = (1 - correlation) * (1 - F.product(1 - col(x))) + correlation * F.max(col(x))
    return F.when(F.count(col(x)) > 0 if skip_absent else all_present(x), value)


def interval_and(low: Value, high: Value) -> tuple[Column, Column]:
    """Group aggregate: the least of the lower and of the upper ends; [1, 1] of none."""
    return F.coalesce(F.min(col(low)), F.lit(1.0)), F.coalesce(F.min(col(high)), F.lit(1.0))


def interval_or(low: Value, high: Value) -> tuple[Column, Column]:
    """Group aggregate: one less the product of the complements; [0, 0] of none."""
    return F.coalesce(1 - F.product(1 - col(low)), F.lit(0.0)), F.coalesce(1 - F.product(1 - col(high)), F.lit(0.0))


def interval_product(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    ends = [x * y for x in a for y in b]
    return F.least(*ends), F.greatest(*ends)


def linear_pool(value: Value, weight: Value = 1.0) -> Column:
    """Group aggregate: weighted mean of the values that are there."""
    v, w = col(value), F.coalesce(col(weight), F.lit(1.0))
    return F.sum(v * w) / F.sum(F.when(v.isNotNull(), w))


def log_pool(value: Value, weight: Value = 1.0) -> Column:
    """Group aggregate: sigmoid of the weighted mean log odds; values at or beyond 0 and 1 are skipped; .5 of none."""
    v = F.when((col(value) > 0) & (col(value) < 1), col(value))
    w = F.coalesce(col(weight), F.lit(1.0))
    odds = F.sum(w * F.log(v / (1 - v))) / F.sum(F.when(v.isNotNull(), w))
    return F.coalesce(1 / (1 + F.exp(-odds)), F.lit(0.5))


def weighted_geometric_mean(value: Value, weight: Value, floor: float = 0.001) -> Column:
    v, w = F.greatest(col(value), F.lit(floor)), col(weight)
    return F.exp(F.sum(w * F.log(v)) / F.sum(w))


def computed_confidence(structural: Value, semantic: Value, historical: Value, cross: Value, weights=(0.4, 0.3, 0.2)) -> Column:
    return clamp(weights[0] * col(structural) + weights[1] * col(semantic) + weights[2] * col(historical) + col(cross), 0.15, 0.85)


def hoeffding_samples(accuracy: float, confidence: float, bins: int = 1) -> Column:
    return F.ceil(F.log(F.lit(2.0 * bins / (1 - confidence))) / (2 * accuracy * accuracy))


def hoeffding_accuracy(n: Value, confidence: float, bins: int = 1) -> Column:
    return F.least(F.lit(1.0), F.sqrt(F.log(F.lit(2.0 * bins / (1 - confidence))) / (2 * col(n) / bins)))


def shrink_to_bucket(raw: Value, accuracy: Value, n: Value, full: float = 20.0, least: int = 3) -> Column:
    """Raw confidence moved towards its bucket's accuracy by n / full, 1 at most; with fewer than `least` samples it stays."""
    w = F.least(F.lit(1.0), col(n) / full)
    return F.when(F.coalesce(col(n), F.lit(0)) < least, col(raw)).otherwise(clamp01(col(raw) * (1 - w) + col(accuracy) * w))


def bounded_decay(strength: Value, elapsed: Value, kind: str, span: float) -> Column:
    """none, step (0 after the span), linear (0 at the span), exponential (half a span)."""
    s, e = col(strength), col(elapsed)
    return {
        "none": s,
        "step": F.when(e > span, 0.0).otherwise(s),
        "linear": s * F.greatest(F.lit(0.0), 1 - e / span),
        "exponential": s * F.pow(F.lit(0.5), e / span),
    }[kind]


def evaluate_formula(node: dict, values: dict[str, Column]) -> Column:
    """A formula tree as one Column: {'op': 'const' | 'input' | 'add' | 'mul' | 'min' | 'max' | 'sub' | 'div', ...}."""
    op = node["op"]
    if op == "const":
        return F.lit(float(node["value"]))
    if op == "input":
        return values[node["name"]]
    args = [evaluate_formula(a, values) for a in node["args"]]
    if op in ("min", "max"):
        return F.least(*args) if op == "min" else F.greatest(*args)
    out = args[0]
    for a in args[1:]:
        out = {"add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y, "div": lambda x, y: F.when(y == 0, 0.0).otherwise(x / y)}[op](out, a)
    return out


def belief(masses: Column, subset: Column) -> Column:
    """masses: array<struct<members: array<string>, mass: double>>. Sum of the masses within subset."""
    inside = F.filter(masses, lambda m: F.size(F.array_except(m["members"], subset)) == 0)
    return F.aggregate(inside, F.lit(0.0), lambda s, m: s + m["mass"])


def plausibility(masses: Column, subset: Column) -> Column:
    touching = F.filter(masses, lambda m: F.arrays_overlap(m["members"], subset))
    return F.aggregate(touching, F.lit(0.0), lambda s, m: s + m["mass"])


def pignistic(masses: Column, element: Value) -> Column:
    having = F.filter(masses, lambda m: F.array_contains(m["members"], element))
    return F.aggregate(having, F.lit(0.0), lambda s, m: s + m["mass"] / F.size(m["members"]))


def combine_dempster(a: Column, b: Column) -> Column:
    """Dempster's rule on two mass arrays: products on intersections over 1 - conflict; null where the conflict is total."""
    pairs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(F.array_sort(F.array_intersect(x["members"], y["members"])).alias("members"), (x["mass"] * y["mass"]).alias("mass")))))
    agree = F.filter(pairs, lambda p: F.size(p["members"]) > 0)
    left = F.aggregate(agree, F.lit(0.0), lambda s, p: s + p["mass"])
    sets = F.array_sort(F.array_distinct(F.transform(agree, lambda p: p["members"])))
    summed = F.transform(sets, lambda k: F.struct(k.alias("members"), (F.aggregate(F.filter(agree, lambda p: p["members"] == k), F.lit(0.0), lambda s, p: s + p["mass"]) / left).alias("mass")))
    return F.when(left > 1e-10, summed)
