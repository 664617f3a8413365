"""Scans: filter vocabularies, symbol lookups, ledger queries. All predicates reach the Parquet reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.tables import all_of


def one_of(column: str, values: list | None) -> Column | None:
    return F.col(column).isin(list(values)) if values is not None else None


def search_filter(df: DataFrame, path_prefix: str | None = None, language: str | None = None, exported: bool | None = None, pure: bool | None = None, exclude_tests: bool = False, most_bytes: int | None = None) -> DataFrame:
    """The conjunction of what is given, on columns path, language, is_exported, is_pure, size_bytes."""
    return df.where(all_of(
        F.col("path").startswith(path_prefix) if path_prefix else None,
        F.col("language") == language if language else None,
        F.col("is_exported") == exported if exported is not None else None,
        F.col("is_pure") == pure if pure is not None else None,
        ~F.col("path").rlike(r"(^|/)(tests?|__tests__)/|[._](test|spec)\.") if exclude_tests else None,
        F.col("size_bytes") <= most_bytes if most_bytes is not None else None,
    ))


def scan_edges(edges: DataFrame, from_ids=None, to_ids=None, kinds=None, sources=None, limit: int | None = None) -> DataFrame:
    """Edges (src, dst, kind, source_file); a limit takes the first in (src, dst, kind) order."""
    predicates = [one_of(c, v) for c, v in (("src", from_ids), ("dst", to_ids), ("kind", kinds), ("source_file", sources))]
    out = edges.where(all_of(*predicates))
    return out.orderBy("src", "dst", "kind").limit(limit) if limit else out


def _in_order(symbols: DataFrame) -> list[Column]:
    """By name, file and line, nulls last as in SQL, and of equals by id if there is one."""
    return [F.asc_nulls_last(c) for c in ("name", "file", "line", "id") if c in symbols.columns]


def find_symbols(symbols: DataFrame, name: str | None = None, ignore_case: bool = False, kind: str | None = None, file: str | None = None, exported: bool | None = None, like: str | None = None, limit: int | None = None) -> DataFrame:
    """Symbols (name, kind, file, line, exported) by any of these; a limit takes the first in (name, file, line) order, nulls last, of equals those with the least id if there is one."""
    out = symbols.where(all_of(
        (F.lower("name") == name.lower() if ignore_case else F.col("name") == name) if name is not None else None,
        F.col("kind") == kind if kind is not None else None,
        F.col("file") == file if file is not None else None,
        F.col("exported") == exported if exported is not None else None,
        F.lower("name").like(like.lower()) if like is not None else None,
    ))
    out = out.orderBy(*_in_order(out)) if limit else out
    return out.limit(limit) if limit else out


def find_fuzzy(symbols: DataFrame, pattern: str, kind: str | None = None, limit: int = 50) -> DataFrame:
    """Names that hold pattern whatever the case (% and _ are wild cards): equal names first, then shorter ones, then by name, file and line, nulls last, of equals those with the least id if there is one."""
    low = pattern.lower()
    found = find_symbols(symbols, kind=kind).where(F.lower("name").like(f"%{low}%"))
    return found.orderBy(F.when(F.lower("name") == low, 0).otherwise(1), F.length("name"), *_in_order(found)).limit(limit)


def symbol_stats(symbols: DataFrame, kinds: list[str]) -> DataFrame:
    """(kind, n, files): counts of the given kinds, 0 where there are none."""
    literal = symbols.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    counts = symbols.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"))
    return literal.join(counts, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("files", F.lit(0)).alias("files"))


def query_ledger(ledger: DataFrame, kinds=None, since=None, until=None, session=None, json: tuple[str, str, str] | None = None, contains: tuple[str, str] | None = None, order: list | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Ledger rows (kind, ts, session, ...): kinds, time range inclusive, session, json = (column, path, value), contains = (column, text)."""
    out = ledger.where(all_of(
        one_of("kind", kinds),
        F.col("ts") >= F.lit(since) if since is not None else None,
        F.col("ts") <= F.lit(until) if until is not None else None,
        F.col("session") == session if session is not None else None,
        F.get_json_object(json[0], json[1]) == json[2] if json else None,
        F.col(contains[0]).contains(contains[1]) if contains else None,
    ))
    if order:
        out = out.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit else out


def holds_id(json_array: str, value: str) -> Column:
    """Membership in a JSON array of strings."""
    return F.array_contains(F.from_json(json_array, "array<string>"), value)


def page(df: DataFrame, order: list, size: int, number: int) -> DataFrame:
    """Page `number`, from 0, in a total order."""
    return df.orderBy(*order).offset(size * number).limit(size)
