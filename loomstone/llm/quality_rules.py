"""Quality rules: fixed base rules, then robust multivariate outliers by language and source.

The outlier test is the minimum covariance determinant: of each (lang, source) group, the mean and covariance of the
`support` share of its rows whose covariance has the least determinant. Concentration steps lead there from three
deterministic starts: a step takes the rows with the smallest Mahalanobis distances, exactly as many as the share asks
for, and their mean and covariance; a start is done when the determinant falls no more, and the least determinant wins.

No group is ever gathered in a task. The distance up to which rows belong to a step is found over counts: of a range of
distances, then of the part of it where the share ends, until that part holds EDGE rows at most; sums over the rows
below it and the rows of the part itself, by distance, are what comes together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import drop, ready, staged, table
from loomstone.llm.textstats import COUNTS, with_counts

#: The base rules.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
STATS = ["x_words", "x_length", "x_symbols", "x_dup_lines", "x_repeats"]
#: Share of a group that the estimate rests on; chi-square quantile of a rejected distance.
SUPPORT, CUTOFF = 0.75, 0.999
#: Below this spread a statistic counts as constant: a group of equal rows has no outliers by rounding alone. Each is so small that its statistic can reject alone, whatever the size of the group.
LEAST_SPREAD = np.array([0.5, 0.06, 0.03, 0.15, 0.12])
#: Groups of about so many rows take half of their covariance from fixed spreads, LEAN times the least; smaller ones more.
FEW, LEAN = 20, 2.0
#: The error of measuring: one line, and the words of one window, may be repeated by chance.
FREE_LINES, FREE_WORDS = 1, 3
#: Starts of the concentration steps, and the relative fall of a log determinant that still counts as one.
STARTS, LEAST_FALL = 3, 1e-5
#: Parts of a range of distances; rows of a part that are no longer counted but listed.
PARTS, EDGE = 1024, 2000
#: Width of the bins that a start's medians are read from, as a share of the least spread.
MEDIAN_BIN = 0.1
#: The first range: squared distances as the bits of their doubles, which are in the same order.
FIRST = np.concatenate([[0], np.linspace(*np.array([1e-3, 1e6]).view(np.int64), PARTS - 1).astype(np.int64), [np.iinfo(np.int64).max]])


def chi2_quantile(q: float, p: int) -> float:
    """By bisection of the regularised lower incomplete gamma function's series."""
    from math import exp, lgamma, log

    def cdf(x: float) -> float:
        a, y = p / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= y / n
            total += term
        return total * exp(-y + a * log(y) - lgamma(a))

    low, high = 1e-9, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < q else (low, mid)
    return low


def statistics(counts: DataFrame) -> DataFrame:
    """The transformed vector of each document, from its counts."""
    words = F.col("n_words") + 1.0

    def root_share(part: str, whole, free: int = 0):
        """Square roots of shares: a few of many are near 0, and all of them is near 1; the first `free` don't count."""
        return F.sqrt(F.greatest(F.col(part) - free, F.lit(0)) / F.greatest(whole, F.lit(1)))

    return counts.withColumns({
        "x_words": F.log(words),
        "x_length": F.log((F.col("word_chars") + 5.0) / words),
        "x_symbols": root_share("n_symbols", F.greatest("word_chars", "n_symbols")),
        "x_dup_lines": root_share("n_dup_lines", F.col("n_lines"), FREE_LINES),
        "x_repeats": root_share("n_repeat_words", F.col("n_words"), FREE_WORDS),
    })


def _distance(x: np.ndarray, model: np.ndarray, p: int) -> np.ndarray:
    """Squared Mahalanobis distance of each row to its own group's (mean, inverse Cholesky factor): the same bits whatever rows stand beside it."""
    total = np.zeros(len(x))
    for i in range(p):
        z = np.zeros(len(x))
        for j in range(i + 1):
            z = z + model[:, p + i * p + j] * (x[:, j] - model[:, j])
        total = total + z * z
    return total


def _edges(low: int, high: int) -> np.ndarray:
    """The ends of the parts of a range of distances (as bits): PARTS at most, each of one value at least."""
    if (low, high) == (0, int(FIRST[-1])):
        return FIRST
    return np.unique(low + (high - low) * np.arange(PARTS + 1).astype(object) // PARTS).astype(np.int64)


def _moments(x: np.ndarray) -> np.ndarray:
    """Of each row its values and their products."""
    p = x.shape[1]
    return np.concatenate([x, *[x[:, i : i + 1] * x[:, i:] for i in range(p)]], axis=1)


def _summed(kernel, columns: DataFrame, by: list[str], keys: list[str], sums: int) -> DataFrame:
    """What `kernel` makes of the batches of `columns`, (by..., keys..., rows, s0...), added up: first within a batch, then by Spark."""
    names = [*by, *keys, "rows", *[f"s{i}" for i in range(sums)]]
    schema = ", ".join([f"`{b}` string" for b in by] + [f"{k} long" for k in keys] + ["rows long"] + [f"s{i} double" for i in range(sums)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            group = b.select(by).to_pandas()
            parts = []
            for which, keyed, values in kernel(b):
                frame = group.iloc[which].reset_index(drop=True)
                for k, v in zip(keys, keyed, strict=True):
                    frame[k] = v
                frame["rows"] = 1
                parts.append(pd.concat([frame, pd.DataFrame(values, columns=names[len(names) - sums :])], axis=1))
            frame = pd.concat(parts)
            if len(frame):
                yield pa.RecordBatch.from_pandas(frame.groupby([*by, *keys], dropna=False, as_index=False).sum()[names], preserve_index=False)

    made = columns.mapInArrow(run, schema).groupBy(*by, *keys)
    return made.agg(F.sum("rows").alias("rows"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(sums)])


def _by_group(rows: DataFrame, state: DataFrame, by: list[str], function, schema: str) -> DataFrame:
    """`function` of the sums of each group, with the group's state in every row."""
    kept = [c for c in state.columns if c not in by]
    joined = rows.alias("r").join(state.alias("s"), _same(by)).select("r.*", *[f"s.{c}" for c in kept])
    return joined.groupBy(*by).applyInPandas(function, schema)


def _square(s: np.ndarray, p: int) -> np.ndarray:
    """The matrix of products out of the sums that _moments makes."""
    out = np.empty((p, p))
    at = p
    for i in range(p):
        out[i, i:] = out[i:, i] = s[at : at + p - i]
        at += p - i
    return out


def robust_groups(rows: DataFrame, by: list[str], stats: list[str], support: float = SUPPORT, least_spread=None, few: int = FEW) -> DataFrame:
    """(by..., n, model, log_det): of each group the mean and inverse Cholesky factor of the covariance of least determinant, corrected for the support share.

    by: string columns; null is a group. Every row counts in every step. Rows at exactly the distance where the share
    ends take equal parts of the places left, so the result does not depend on the order of rows. A variance below the
    square of least_spread is raised to it, and a group of n rows takes few / (few + n) of its covariance from the
    diagonal, so that small groups and constant statistics have a determinant.
    """
    p = len(stats)
    floor = np.asarray(LEAST_SPREAD if least_spread is None else least_spread, float)
    consistent = _consistency(support, p) if support < 1 else 1.0
    m = p + p * (p + 1) // 2
    group = ", ".join(f"`{b}` string" for b in by)
    shape = f"{group}, n long, model array<double>, log_det array<double>, open array<boolean>"
    step = MEDIAN_BIN * floor

    def vectors(b: pa.RecordBatch) -> np.ndarray:
        return np.stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in stats], axis=1)

    def lists(b: pa.RecordBatch, name: str, width: int) -> np.ndarray:
        return b.column(b.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    def binned(b: pa.RecordBatch):
        at = np.floor(vectors(b) / step).astype(np.int64)
        for i in range(p):
            yield np.arange(b.num_rows), (np.full(b.num_rows, i), at[:, i]), np.zeros((b.num_rows, 0))

    def middles(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """Medians, and medians of the distance to them, from counted bins."""
        centre, spread = np.zeros(p), np.zeros(p)
        for i, part in frame.groupby("stat"):
            value, count = (part["bin"].to_numpy() + 0.5) * step[i], part["rows"].to_numpy()
            for out in (centre, spread):
                order = np.lexsort((value, value if out is centre else np.abs(value - centre[i])))
                out[i] = value[order][np.searchsorted(np.cumsum(count[order]), count.sum() / 2)]
            spread[i] = max(1.4826 * abs(spread[i] - centre[i]), floor[i])
        return pd.DataFrame([[*keys, int(frame["rows"].sum()) // p, centre, spread]], columns=[*by, "n", "centre", "spread"])

    counted = _summed(binned, rows, by, ["stat", "bin"], 0)
    middle = staged(counted.groupBy(*by).applyInPandas(middles, f"{group}, n long, centre array<double>, spread array<double>"), "mcd-middle")

    def shapes(b: pa.RecordBatch):
        """Two covariances that no row can pull far: of values bent by tanh, and of directions from the centre."""
        z = (vectors(b) - lists(b, "centre", p)) / lists(b, "spread", p)
        length = np.sqrt((z * z).sum(axis=1, keepdims=True))
        for k, y in enumerate((np.tanh(z), z / np.maximum(length, 1e-12))):
            yield np.arange(b.num_rows), (np.full(b.num_rows, k),), _moments(y)

    def begin(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        centre, spread, n = frame["centre"].iloc[0], frame["spread"].iloc[0], int(frame["n"].iloc[0])
        models = [np.concatenate([centre, np.diag(1 / spread).ravel()])]
        for _, row in frame.sort_values("kind").iterrows():
            c = _square(row[[f"s{i}" for i in range(m)]].to_numpy(float), p) / n
            c = c + np.eye(p) * max(np.trace(c) / p, 1e-6) * 0.05
            models.append(np.concatenate([centre, np.linalg.inv(np.linalg.cholesky(c * np.outer(spread, spread))).ravel()]))
        return pd.DataFrame([[*keys, n, np.concatenate(models), [np.inf] * STARTS, [True] * STARTS]], columns=[*by, "n", "model", "log_det", "open"])

    held = _with_models(rows, middle, by, stats, columns=("centre", "spread"))
    state = staged(_by_group(_summed(shapes, held, by, ["kind"], m), middle, by, begin, shape), "mcd-start")
    drop(middle)

    def distances(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(start, rows whose group still works on it, bits of their distances)."""
        x, model, going = vectors(b), lists(b, "model", STARTS * (p + p * p)), lists(b, "open", STARTS)
        for k in range(STARTS):
            mine = np.flatnonzero(going[:, k])
            yield k, mine, _distance(x[mine], model[mine, k * (p + p * p) : (k + 1) * (p + p * p)], p).view(np.int64)

    def parts(b: pa.RecordBatch):
        low, high = lists(b, "low", STARTS), lists(b, "high", STARTS)
        for k, mine, d in distances(b):
            pairs, kind = np.unique(np.stack([low[mine, k], high[mine, k]], axis=1), axis=0, return_inverse=True)
            part = np.full(len(mine), -1)
            for i, (a, z) in enumerate(pairs):
                own = np.flatnonzero((kind.ravel() == i) & (d >= a) & (d < z))
                part[own] = np.searchsorted(_edges(int(a), int(z)), d[own], side="right") - 1
            inside = part >= 0
            yield mine[inside], (np.full(int(inside.sum()), k), part[inside]), np.zeros((int(inside.sum()), 0))

    def narrow(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """The part of each start's range where the support share ends."""
        first = frame.iloc[0]
        low, high, below, inside = (list(first[c]) for c in ("low", "high", "below", "inside"))
        need = _support(int(first["n"]), support)
        for k, part in frame.groupby("start"):
            part = part.sort_values("part")
            reach = below[k] + np.cumsum(part["rows"].to_numpy())
            at = min(int(np.searchsorted(reach, need)), len(part) - 1)
            ends = _edges(low[k], high[k])
            this = int(part["part"].iloc[at])
            low[k], high[k], inside[k] = int(ends[this]), int(ends[this + 1]), int(part["rows"].iloc[at])
            below[k] = int(reach[at]) - inside[k]
        row = [*keys, first["n"], first["model"], first["log_det"], first["open"], low, high, below, inside]
        return pd.DataFrame([row], columns=[*by, "n", "model", "log_det", "open", "low", "high", "below", "inside"])

    def sums(b: pa.RecordBatch):
        """Rows below the range under the key -1, rows within it under their distance."""
        x, low, high = vectors(b), lists(b, "low", STARTS), lists(b, "high", STARTS)
        for k, mine, d in distances(b):
            near = d < high[mine, k]
            key = np.where(d < low[mine, k], -1, d)
            yield mine[near], (np.full(int(near.sum()), k), key[near]), _moments(x[mine[near]])

    def concentrate(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        n, models, log_det, going = int(first["n"]), np.array(first["model"]).reshape(STARTS, -1), list(first["log_det"]), list(first["open"])
        need, lean = _support(n, support), few / (few + n)
        for k, part in frame.groupby("start"):
            part = part.sort_values("key")
            count = part["rows"].to_numpy(float)
            share = np.clip((need - (np.cumsum(count) - count)) / count, 0, 1)
            total = (part[[f"s{i}" for i in range(m)]].to_numpy(float) * share[:, None]).sum(axis=0)
            taken = (count * share).sum()
            mean = total[:p] / taken
            cov = (_square(total, p) / taken - np.outer(mean, mean)) * (consistent if need < n else 1.0)
            cov = (1 - lean) * cov + lean * np.diag(np.maximum(np.diag(cov), LEAN * floor**2))
            cov = cov + np.diag(np.maximum(floor**2 - np.diag(cov), 0))
            lower = np.linalg.cholesky(cov)
            det = 2 * float(np.log(np.diag(lower)).sum())
            going[k] = bool(det < log_det[k] - LEAST_FALL * (1 + abs(det)))
            if going[k]:
                log_det[k], models[k] = det, np.concatenate([mean, np.linalg.inv(lower).ravel()])
        return pd.DataFrame([[*keys, n, models.ravel(), log_det, going]], columns=[*by, "n", "model", "log_det", "open"])

    any_open = F.exists("open", lambda o: o)
    ranged = shape + ", low array<long>, high array<long>, below array<long>, inside array<long>"
    every = [F.array(*[F.lit(v).cast("long")] * STARTS) for v in (0, int(FIRST[-1]), 0)]
    while state.where(any_open).limit(1).count():
        now = state.where(any_open).select("*", *[c.alias(n) for c, n in zip(every, ("low", "high", "below"), strict=True)], every[1].alias("inside"))
        old = []
        while True:
            held = _with_models(rows, now, by, stats, columns=("model", "open", "low", "high"))
            now = staged(_by_group(_summed(parts, held, by, ["start", "part"], 0), now, by, narrow, ranged), "mcd-range")
            old.append(now)
            wide = F.exists(F.arrays_zip("open", "inside", "low", "high"), lambda r: r["open"] & (r["inside"] > EDGE) & (r["high"] - r["low"] > 1))
            if not now.where(wide).limit(1).count():
                break
        held = _with_models(rows, now, by, stats, columns=("model", "open", "low", "high"))
        after = _by_group(_summed(sums, held, by, ["start", "key"], m), now, by, concentrate, shape)
        after = staged(after.unionByName(state.where(~any_open)), "mcd")
        for t in (state, *old):
            drop(t)
        state = after
    best = F.array_position("log_det", F.array_min("log_det")).cast("int") - 1
    return state.select(*by, "n", F.slice("model", best * (p + p * p) + 1, p + p * p).alias("model"), F.array_min("log_det").alias("log_det"))


def _support(n: int, support: float) -> int:
    return max(1, int(np.ceil(support * n)))


def _consistency(support: float, p: int) -> float:
    """Covariance of the whole normal distribution over that of its nearest `support` share."""
    edge = chi2_quantile(support, p)
    low, high = 0.0, 1.0
    for _ in range(60):  # the share of a chi-square with p + 2 degrees below the same edge
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_quantile(max(mid, 1e-9), p + 2) < edge else (low, mid)
    return support / max(low, 1e-6)


def _same(by: list[str], left: str = "r", right: str = "s"):
    return [F.col(f"{left}.{b}").eqNullSafe(F.col(f"{right}.{b}")) for b in by]


def _with_models(rows: DataFrame, models: DataFrame, by: list[str], stats: list[str], keep: tuple[str, ...] = (), columns: tuple[str, ...] = ("model",)) -> DataFrame:
    """The models are one small row a group: Spark broadcasts them when their size allows it, else joins with skewed groups split."""
    return rows.alias("r").join(models.alias("s"), _same(by)).select(*[F.col(f"r.{b}") for b in by], *[F.col(f"r.{c}") for c in (*stats, *keep)], *[F.col(f"s.{c}") for c in columns])


def _arrays(b: pa.RecordBatch, k: int, p: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack([b.column(k + i).to_numpy(zero_copy_only=False) for i in range(p)], axis=1)
    return x, b.column(b.schema.get_field_index("model")).flatten().to_numpy(zero_copy_only=False).reshape(-1, p + p * p)


def apply_rules(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, distance (squared, null where base_failed).

    Documents that fail a base rule are rejected first and take no part in the estimates. A null or empty text has no
    words and fails. A null lang or source is a group of its own. Groups of few rows lean on wide fixed spreads; equal
    rows are at distance 0. Repeated rows get equal verdicts. An empty table gives an empty table.
    """
    ready(docs.sparkSession)
    counts = with_counts(docs, ["doc_id", "lang", "source"]).select("doc_id", "lang", "source", *COUNTS[:6])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    rows = staged(statistics(counts).withColumn("base_failed", failed), "statistics")
    passed = rows.where(~F.col("base_failed"))
    by, p = ["lang", "source"], len(STATS)
    models = robust_groups(passed.select(*by, *STATS), by, STATS)
    limit = chi2_quantile(cutoff, p)
    keep = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def verdict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, model = _arrays(b, len(by), p)
            d = _distance(x, model, p)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(np.zeros(len(d), bool)), pa.array(d <= limit), pa.array(d)], names=[*keep, "base_failed", "kept", "distance"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, distance double"
    tested = _with_models(passed, models, by, STATS, keep).mapInArrow(verdict, schema)
    rejected = rows.where("base_failed").select(*keep, "base_failed", F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return tested.unionByName(rejected)


def op6_quality_rules(spark, sf_dir):
    return apply_rules(table(spark, sf_dir, "documents"))
