"""History sources: git log, blame, diff and reflog text into rows. Readers take folders of text files; parsing is in Columns or per file."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions.text import commit_category, reflog_action
from loomstone.session import ship

#: Words by which a changed line counts, and lines that change nothing.
STRUCTURAL = ["interface", "class", "export", "import", "extends", "implements", "public", "private", "protected", "static", "abstract", "function", "method", "constructor", "type", "enum", "module", "namespace", "package", "require", "from"]
BEHAVIORAL = ["if", "else", "switch", "case", "for", "while", "do", "return", "throw", "try", "catch", "finally", "await", "async", "new", "delete", "call", "apply", "bind", "===", "!==", "==", "!=", ">", "<", ">=", "<=", "&&", "||", "!", "?", ":"]
COSMETIC = [r"^//", r"^/\*", r"^\*", r"^\*/", r"^$", r"""^["']use strict["']"""]

_structural = re.compile(r"\b(" + "|".join(STRUCTURAL) + r")\b")
_cosmetic = re.compile("|".join(COSMETIC))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): every file as one row."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def parse_log(texts: DataFrame) -> DataFrame:
    """(commit, author, at, message, category, files) of `git log --name-only --format=@%H|%an|%aI|%s` text in column text."""
    entries = texts.select(F.explode(F.split("text", r"(?m)^@")).alias("e")).where(F.length(F.trim("e")) > 0)
    head = F.split(F.element_at(F.split("e", "\n"), 1), r"\|")
    lines = F.transform(F.slice(F.split("e", "\n"), 2, 100_000), lambda x: F.trim(x))
    out = entries.select(head[0].alias("commit"), head[1].alias("author"), F.to_timestamp(head[2]).alias("at"), F.array_join(F.slice(head, 4, 100), "|").alias("message"), F.filter(lines, lambda x: x != "").alias("files"))
    return out.withColumn("category", commit_category("message"))


def parse_reflog(texts: DataFrame) -> DataFrame:
    """(commit, ref, message, action, previous) of `git reflog --format="%H %gd %gs"` lines."""
    line = texts.select(F.explode(F.split("text", "\n")).alias("l")).where(F.length(F.trim("l")) > 0)
    p = r"^([0-9a-f]{7,40}) (\S+) (.*)$"
    out = line.select(F.regexp_extract("l", p, 1).alias("commit"), F.regexp_extract("l", p, 2).alias("ref"), F.regexp_extract("l", p, 3).alias("message")).where("commit <> ''")
    before = F.regexp_extract("message", r"(?i)moving to ([0-9a-f]{7,40})", 1)
    return out.withColumns({"action": reflog_action("message"), "previous": F.when(before != "", before)})


def read_blame(text: str) -> Iterator[tuple]:
    """(commit, line, author, time, content) of porcelain blame; what a commit's first block tells holds for its others."""
    known: dict[str, dict[str, str]] = {}
    commit, line = "", 0
    for row in text.split("\n"):
        if m := re.match(r"([0-9a-f]{40}) \d+ (\d+)", row):
            commit, line = m[1], int(m[2])
            known.setdefault(commit, {})
        elif row.startswith("\t"):
            about = known.get(commit, {})
            yield commit, line, about.get("author"), int(about["author-time"]) if "author-time" in about else None, row[1:]
        elif " " in row and commit:
            k, v = row.split(" ", 1)
            known[commit].setdefault(k, v)


def parse_blame(texts: DataFrame) -> DataFrame:
    """(path, commit, line, author, time, content) of files of porcelain blame."""
    ship(texts.sparkSession)

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *r) for p, t in zip(f["path"], f["text"], strict=True) for r in read_blame(t or "")]
            yield pd.DataFrame(rows, columns=["path", "commit", "line", "author", "time", "content"])

    return texts.select("path", "text").mapInPandas(kernel, "path string, commit string, line long, author string, time long, content string")


def blame_chunks(lines: DataFrame) -> DataFrame:
    """Runs of lines of one author and commit: path, author, commit, start, stop, rows."""
    from loomstone.operators.windows import runs

    return runs(lines.select("path", "line", "author", "commit"), ["path"], "line", ["author", "commit"])


def change_category(added: list[str], removed: list[str]) -> str:
    """structural or behavioral over half, cosmetic over .7, else mixed; nothing counted is cosmetic."""
    n = {"structural": 0, "behavioral": 0, "cosmetic": 0}
    for line in (x.strip() for x in (*added, *removed)):
        if _cosmetic.search(line):
            n["cosmetic"] += 1
            continue
        n["structural"] += bool(_structural.search(line))
        n["behavioral"] += any(k in line for k in BEHAVIORAL)
    total = sum(n.values())
    if not total or n["cosmetic"] > 0.7 * total:
        return "cosmetic"
    return next((k for k in ("structural", "behavioral") if n[k] > 0.5 * total), "mixed")


def read_diff(text: str) -> Iterator[tuple]:
    """(file, hunks, additions, deletions, category) of each file of a unified diff."""
    for part in re.split(r"(?m)^diff --git ", text)[1:]:
        m = re.search(r"(?m)^\+\+\+ b/(.+)$", part) or re.match(r"a/(\S+)", part)
        body = part[part.index("@@") :] if "@@" in part else ""
        added = [x[1:] for x in body.split("\n") if x.startswith("+")]
        removed = [x[1:] for x in body.split("\n") if x.startswith("-")]
        yield m[1] if m else "", len(re.findall(r"(?m)^@@ ", part)), len(added), len(removed), change_category(added, removed)


def parse_diffs(texts: DataFrame) -> DataFrame:
    """(path, file, hunks, additions, deletions, category) of files of unified diffs."""
    ship(texts.sparkSession)

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *r) for p, t in zip(f["path"], f["text"], strict=True) for r in read_diff(t or "")]
            yield pd.DataFrame(rows, columns=["path", "file", "hunks", "additions", "deletions", "category"])

    return texts.select("path", "text").mapInPandas(kernel, "path string, file string, hunks long, additions long, deletions long, category string")
