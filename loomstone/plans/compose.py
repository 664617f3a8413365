"""Composition of plans: a construction is a function from a DataFrame (or any value) to another."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Construction = Callable[[Any], Any]


def identity(x: Any) -> Any:
    return x


def atom(f: Construction) -> Construction:
    """A function as a construction."""
    return lambda x: f(x)


def seq(*steps: Construction) -> Construction:
    def run(x: Any) -> Any:
        for s in steps:
            x = s(x)
        return x

    return run


def fanout(left: Construction, right: Construction) -> Construction:
    """Both results of one input. A DataFrame is read by each; Spark reuses equal exchanges."""
    return lambda x: (left(x), right(x))


def parallel(*parts: Construction) -> Construction:
    """All results of one input, jobs side by side."""

    def run(x: Any) -> list:
        with ThreadPoolExecutor(len(parts)) as pool:
            return list(pool.map(lambda p: p(x), parts))

    return run


def fallback(first: Construction, second: Construction) -> Construction:
    """The second if the first raises. Plans are lazy: put the action inside the first."""

    def run(x: Any) -> Any:
        try:
            return first(x)
        except Exception:  # noqa: BLE001  any failure is what the second is for
            return second(x)

    return run


def conditional(test: Callable[[Any], bool], yes: Construction, no: Construction = identity) -> Construction:
    return lambda x: yes(x) if test(x) else no(x)


def select(choose: Callable[[Any], tuple[bool, Any]], on_left: Construction) -> Construction:
    """choose gives (is_left, value): left values go through on_left, right ones are done."""

    def run(x: Any) -> Any:
        left, value = choose(x)
        return on_left(value) if left else value

    return run


def branch(predicate: Column, yes: Callable[[DataFrame], DataFrame], no: Callable[[DataFrame], DataFrame]) -> Construction:
    """Rows for which predicate is true through one plan, the others (null too) through the other, and both together."""
    ok = F.coalesce(predicate, F.lit(False))
    return lambda df: yes(df.where(ok)).unionByName(no(df.where(~ok)))


def fix(body: Construction, stop: Callable[[Any], bool], most: int = 100, metric: Callable[[Any], float] | None = None, cut: Callable[[DataFrame], DataFrame] | None = None) -> Construction:
    """The body again and again until stop, `most` rounds at most; a metric that no longer rises ends it too. cut (a checkpoint) keeps the plan small."""

    def run(x: Any) -> Any:
        last = None
        for _ in range(most):
            if stop(x):
                break
            x = body(x)
            x = cut(x) if cut else x
            if metric:
                now = metric(x)
                if last is not None and now <= last:
                    break
                last = now
        return x

    return run


def dimap(c: Construction, before: Construction, after: Construction) -> Construction:
    return lambda x: after(c(before(x)))


def contramap(c: Construction, before: Construction) -> Construction:
    return lambda x: c(before(x))


def map_result(c: Construction, after: Construction) -> Construction:
    return lambda x: after(c(x))


def map_error(c: Construction, change: Callable[[Exception], Exception]) -> Construction:
    def run(x: Any) -> Any:
        try:
            return c(x)
        except Exception as e:  # noqa: BLE001
            raise change(e) from e

    return run


def with_retry(c: Construction, tries: int = 3, wait: float = 0.0) -> Construction:
    """Again on an error. Spark retries tasks by itself; this is for what fails on the driver."""

    def run(x: Any) -> Any:
        for i in range(tries):
            try:
                return c(x)
            except Exception:
                if i == tries - 1:
                    raise
                time.sleep(wait * 2**i)

    return run


def with_timeout(c: Construction, seconds: float, df: DataFrame | None = None) -> Construction:
    """TimeoutError after so long; the Spark jobs of the call are cancelled."""

    def run(x: Any) -> Any:
        frame = df if df is not None else x
        sc = frame.sparkSession.sparkContext if isinstance(frame, DataFrame) else None
        with ThreadPoolExecutor(1) as pool:
            tag = f"loomstone-{id(pool)}"

            def call() -> Any:
                if sc:
                    sc.addJobTag(tag)
                return c(x)

            future = pool.submit(call)
            try:
                return future.result(seconds)
            except TimeoutError:
                if sc:
                    sc.cancelJobsWithTag(tag)
                raise

    return run


class Cached:
    """A construction whose result for a key is kept for some time."""

    def __init__(self, c: Construction, key: Callable[[Any], Any], seconds: float = 300.0, most: int = 100):
        self.c, self.key, self.seconds, self.most, self.held = c, key, seconds, most, {}

    def __call__(self, x: Any) -> Any:
        k, now = self.key(x), time.monotonic()
        if k in self.held and now - self.held[k][0] < self.seconds:
            return self.held[k][1]
        out = self.c(x)
        while len(self.held) >= self.most:
            self.held.pop(min(self.held, key=lambda i: self.held[i][0]))
        self.held[k] = (now, out)
        return out
