"""Code clones: exact copies, token measures, groups and their metrics."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.session import ship

_COMMENT = re.compile(r"//[^\n]*|#[^\n]*|/\*.*?\*/", re.DOTALL)
_TOKEN = re.compile(r"\w+|[^\w\s]")
_NAME = re.compile(r"[A-Za-z_]\w*\Z")

#: Over this cosine a clone that shares no tokens is semantic.
SEMANTIC = 0.85


def tokenize(code: str) -> list[str]:
    return _TOKEN.findall(_COMMENT.sub(" ", code or ""))


def rename(tokens: list[str], keywords: frozenset[str] = frozenset(("if", "else", "for", "while", "return", "def", "function", "class", "const", "let", "var", "import"))) -> list[str]:
    """Identifiers by the order in which they first appear."""
    seen: dict[str, str] = {}
    return [seen.setdefault(t, f"v{len(seen)}") if _NAME.match(t) and t not in keywords else t for t in tokens]


def lcs_ratio(a: list[str], b: list[str]) -> float:
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            up = row[j]
            row[j] = left + 1 if x == y else max(up, row[j - 1])
            left = up
    return 2 * row[-1] / (len(a) + len(b))


def clone_type(lcs: float, normal: float, original: float, embedding: float = 0.0) -> str:
    if lcs > 0.95:
        return "exact"
    if normal > 0.9 and original < 0.9:
        return "type2"
    if normal > 0.7:
        return "type3"
    return "semantic" if embedding > SEMANTIC else "type1"


def clone_kind(lcs: Column, normal: Column, original: Column, embedding: Column) -> Column:
    """clone_type of measures in columns; null measures count as 0."""
    lcs, normal, original, embedding = (F.coalesce(c, F.lit(0.0)) for c in (lcs, normal, original, embedding))
    kind = F.when(lcs > 0.95, "exact").when((normal > 0.9) & (original < 0.9), "type2").when(normal > 0.7, "type3")
    return kind.when(embedding > SEMANTIC, "semantic").otherwise("type1")


def _measure(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    rows = []
    for x, y in zip(a, b, strict=True):
        s, t = tokenize(x), tokenize(y)
        m, n = rename(s), rename(t)
        j = lambda u, v: len(set(u) & set(v)) / len(set(u) | set(v)) if u or v else 0.0
        original, normal, lcs = j(s, t), j(m, n), lcs_ratio(m, n)
        rows.append((original, normal, lcs, clone_type(lcs, normal, original)))
    return pd.DataFrame(rows, columns=["original", "normal", "lcs", "kind"])


def token_similarity(spark: SparkSession, a, b) -> Column:
    """Of two texts: a struct of the Jaccard of their tokens, of renamed tokens, the LCS ratio of renamed tokens, and the clone type."""
    ship(spark)
    return F.pandas_udf(_measure, "original double, normal double, lcs double, kind string")(a, b)


def exact_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, copies, first): equal texts by SHA-256, counted with map-side sums, joined back (skewed keys may be split)."""
    hashed = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("_h"))
    groups = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"))
    return hashed.join(groups, "_h").select("doc_id", "copies", "first")


def greedy_groups(pairs: list[tuple]) -> dict:
    """Group ids in candidate order; two groups that exist are never merged."""
    group: dict = {}
    for a, b in pairs:
        if a in group:
            group.setdefault(b, group[a])
        elif b in group:
            group[a] = group[b]
        else:
            group[a] = group[b] = len(set(group.values()))
    return group
