"""Line differences of pairs of texts, as hunks with context."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.operators.graph import cut
from loomstone.session import ship

#: Equal lines before and after a change that its hunk shows.
CONTEXT = 3

HUNKS = "array<struct<old_start: int, old_lines: int, new_start: int, new_lines: int, lines: array<string>>>"


def _middle(a: list[int], b: list[int]) -> tuple[int, int, int, int]:
    """(x, y, u, v): a snake in the middle of a shortest edit script from a to b: greedy from both ends until they meet, with two rows of memory."""
    n, m = len(a), len(b)
    delta, odd = n - m, (n - m) % 2
    ahead, behind = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = ahead[k + 1] if k == -d or (k != d and ahead[k - 1] < ahead[k + 1]) else ahead[k - 1] + 1
            y = x - k
            x0, y0 = x, y
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            ahead[k] = x
            if odd and -(d - 1) <= delta - k <= d - 1 and x + behind[delta - k] >= n:
                return x0, y0, x, y
        for k in range(-d, d + 1, 2):
            x = behind[k + 1] if k == -d or (k != d and behind[k - 1] < behind[k + 1]) else behind[k - 1] + 1
            y = x - k
            x0, y0 = x, y
            while x < n and y < m and a[n - x - 1] == b[m - y - 1]:
                x, y = x + 1, y + 1
            behind[k] = x
            if not odd and -d <= delta - k <= d and x + ahead[delta - k] >= n:
                return n - x, m - y, n - x0, m - y0
    raise AssertionError("two texts always have a shortest script")


def common_lines(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence, in linear space and in time that grows with the lines times the differences."""
    number: dict[str, int] = {}
    x, y = ([number.setdefault(line, len(number)) for line in text] for text in (a, b))
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and x[a0] == y[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and x[a1 - 1] == y[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 < a1 and b0 < b1:
            s, t, u, v = _middle(x[a0:a1], y[b0:b1])
            out += [(a0 + s + i, b0 + t + i) for i in range(u - s)]
            todo += [(a0, a0 + s, b0, b0 + t), (a0 + u, a1, b0 + v, b1)]
    return sorted(out)


def hunks(a: list[str], b: list[str], context: int = CONTEXT) -> tuple[int, int, list[dict]]:
    """(added, deleted, hunks): lines with ' ', '-' or '+' before them; starts count from 1, and are the place before which nothing stands where a side has no lines."""
    lines: list[tuple[str, int, int, str]] = []
    i = j = 0
    for s, t in [*common_lines(a, b), (len(a), len(b))]:
        lines += [("-", k, j, a[k]) for k in range(i, s)] + [("+", s, k, b[k]) for k in range(j, t)]
        if s < len(a) and t < len(b):
            lines.append((" ", s, t, a[s]))
        i, j = s + 1, t + 1
    changed = [k for k, line in enumerate(lines) if line[0] != " "]
    spans: list[list[int]] = []
    for k in changed:
        if spans and k - context <= spans[-1][1]:
            spans[-1][1] = min(len(lines), k + context + 1)
        else:
            spans.append([max(0, k - context), min(len(lines), k + context + 1)])
    out = []
    for p, q in spans:
        part = lines[p:q]
        old, new = sum(s != "+" for s, *_ in part), sum(s != "-" for s, *_ in part)
        out.append({"old_start": part[0][1] + (old > 0), "old_lines": old, "new_start": part[0][2] + (new > 0), "new_lines": new, "lines": [s + text for s, _, _, text in part]})
    return sum(s == "+" for s, *_ in lines), sum(s == "-" for s, *_ in lines), out


def with_next(rows: DataFrame, group: str, order: str) -> DataFrame:
    """rows, and under the same names with _next before them the row that comes next by `order` in its group; the last rows of groups are left out.

    Groups are dealt by ranges, so a group is spread over tasks; each range gets a copy of the first row of the next.
    """
    plain = [F.col(c) for c in rows.columns]
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(ranges, group, order).withColumn("_range", F.spark_partition_id()))
    first = dealt.groupBy(group, "_range").agg(F.min_by(F.struct(*plain), order).alias("_first"))
    heads = first.withColumn("_range", F.lag("_range").over(Window.partitionBy(group).orderBy("_range"))).where("_range is not null")
    both = dealt.unionByName(heads.select("_first.*", "_range"))
    after = Window.partitionBy("_range", group).orderBy(order)
    return both.select(*plain, *[F.lead(c).over(after).alias(f"_next_{c}") for c in rows.columns]).where(F.col(f"_next_{order}").isNotNull())


def unified_diffs(pairs: DataFrame, key: list[str], a: str, b: str, context: int = CONTEXT) -> DataFrame:
    """(key..., additions, deletions, changes, hunks) of each row's two texts, line by line.

    Texts are split at line ends, so one that ends in a line end has an empty last line; a null text is empty, and has
    one empty line. Additions and deletions are the fewest that lead from a to b. A row is compared in its own task's
    batch; memory is linear in its lines.
    """
    ship(pairs.sparkSession)
    plain = pairs.select(*key, *(F.coalesce(c, F.lit("")).alias(n) for c, n in ((F.col(a), "_a"), (F.col(b), "_b"))))
    kinds = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in key)

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [hunks(x.split("\n"), y.split("\n"), context) for x, y in zip(f["_a"], f["_b"])]
            yield f[key].assign(additions=[m[0] for m in made], deletions=[m[1] for m in made], changes=[m[0] + m[1] for m in made], hunks=[m[2] for m in made])

    return plain.mapInPandas(kernel, f"{kinds}, additions long, deletions long, changes long, hunks {HUNKS}")


def patched(text: str, hunks_: list[dict]) -> str:
    """a with its hunks applied: b."""
    lines, out, at = text.split("\n"), [], 0
    for h in hunks_:
        start = h["old_start"] - (h["old_lines"] > 0)
        out += lines[at:start]
        at = start + h["old_lines"]
        out += [line[1:] for line in h["lines"] if line[0] != "-"]
    return "\n".join(out + lines[at:])
